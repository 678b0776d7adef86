"""Exact percentiles that never hold a group in one task.

Equal values are counted first, groups are cut along the value axis, and only the slices that
contain a wanted rank are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .ordered import SLICE, has_hot_key, rows_per_task, sliced


#: Distinct values of a group that a task may hold as objects; more are counted by value, written and sliced.
BUILTIN_VALUES = 100_000


def _ranks(kind: str, p: float, n: Column) -> list[tuple[Column, Column]]:
    """Zero-based ranks and weights that make up one percentile."""
    if kind == "nearest":
        return [(F.greatest(F.lit(0), F.ceil(n * F.lit(p)) - 1), F.lit(1.0))]
    at = (n - 1) * F.lit(p)
    low = F.floor(at)
    share = at - low
    return [(low, 1 - share), (F.least(low + 1, n - 1), share)]


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: Column | str,
    wanted: Mapping[str, tuple[str, float]],
    target_rows: int | None = None,
) -> DataFrame:
    """One row per group with each wanted percentile as a column.

    ``wanted`` maps a column name to ``("linear", p)`` (interpolation at ``(n-1)*p``) or
    ``("nearest", p)`` (the value at rank ``ceil(n*p)``). Nulls are skipped; groups without
    any value are absent, so callers left join.
    """
    groups = list(groups)
    target_rows = min(BUILTIN_VALUES, rows_per_task(df, target_rows))
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*groups, v.cast("double").alias("_v")).filter("_v is not null")
    counted = rows.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_c"))
    # The first test needs no shuffle of values; the second only runs for large groups, whose counts are written once.
    hot = has_hot_key(rows, groups, target_rows)
    if hot:
        counted = cut_lineage(counted)
        hot = has_hot_key(counted, groups, target_rows)
    everything = Window.partitionBy(*groups)

    def ranks(total: Column) -> Column:
        return F.array(*[
            F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank"), weight.alias("weight"))
            for name, (kind, p) in wanted.items()
            for rank, weight in _ranks(kind, p, total)
        ])

    if not hot:
        # Every group holds at most ``target_rows`` distinct values, which the built-ins count by value.
        builtin = {
            name: F.percentile("_v", F.lit(p)) if kind == "linear" else F.expr(f"percentile_disc({p}) within group (order by _v)")
            for name, (kind, p) in wanted.items()
        }
        return rows.groupBy(*groups).agg(*[c.alias(name) for name, c in builtin.items()])
    cut = sliced(counted, groups, ["_v"], target_rows).drop("_hot")
    before = everything.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice: its offset within the group and the size of the group.
    slices = cut.groupBy(*groups, SLICE).agg(F.sum("_c").alias("_s")).select(
        *groups, SLICE, "_s",
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_offset"), F.sum("_s").over(everything).alias("_total"),
    )
    inside = lambda r: (r["rank"] >= F.col("_offset")) & (r["rank"] < F.col("_offset") + F.col("_s"))
    targets = slices.withColumn("_ranks", F.filter(ranks(F.col("_total")), inside)).filter(F.size("_ranks") > 0)
    running = Window.partitionBy(*groups, SLICE).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.join(targets, [*groups, SLICE]).withColumn("_upto", F.sum("_c").over(running) + F.col("_offset"))
    here = lambda r: (r["rank"] < F.col("_upto")) & (r["rank"] >= F.col("_upto") - F.col("_c"))
    hits = placed.select(*groups, "_v", F.explode(F.filter("_ranks", here)).alias("_r"))
    return hits.groupBy(*groups).agg(
        *[F.sum(F.when(F.col("_r.name") == name, F.col("_v") * F.col("_r.weight"))).alias(name) for name in wanted]
    )


def figure_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    figures: Mapping[str, Column | str],
    wanted: Mapping[str, Mapping[str, tuple[str, float]]],
    target_rows: int | None = None,
) -> DataFrame:
    """Percentiles of several figures of one table from one pass over (group, figure, value).

    ``wanted`` maps each figure to the percentiles asked of it, as for ``exact_quantiles``. A group is absent if all of its
    figures are null throughout; without groups there is always one row.
    """
    groups = list(groups)
    kinds = {kind: f"_q{i}" for i, kind in enumerate(dict.fromkeys(k for names in wanted.values() for k in names.values()))}
    value = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    melted = df.select(*groups, F.inline(F.array(*[F.struct(F.lit(f).alias("_figure"), value(c).alias("_value")) for f, c in figures.items()])))
    each = exact_quantiles(melted, [*groups, "_figure"], "_value", {name: kind for kind, name in kinds.items()}, target_rows)
    return each.groupBy(*groups).agg(
        *[F.max(F.when(F.col("_figure") == f, F.col(kinds[kind]))).alias(name) for f, names in wanted.items() for name, kind in names.items()]
    )
