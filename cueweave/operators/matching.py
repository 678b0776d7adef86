"""One-to-one matching of interval sets and the quality report built on it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, cut_lineage, join_on
from .ordered import FOLD_ROWS, rows_per_task, sequence_of
from .quantiles import figure_quantiles
from .ranges import iou, overlap_join

PRIMARY_MINIMUM_SECONDS = 1.2
TOLERANCE = 1e-9


def primary_subset(truth: DataFrame, minimum: float = PRIMARY_MINIMUM_SECONDS) -> DataFrame:
    return truth.filter(F.col("end_seconds") - F.col("start_seconds") + TOLERANCE >= minimum)


def _shapes(side: DataFrame, on: Sequence[str], tag: str) -> DataFrame:
    """Distinct intervals of one side with how many copies each has and its largest index."""
    return side.groupBy(*on, "start_seconds", "end_seconds").agg(
        F.count(F.lit(1)).alias(f"{tag}_n"), F.max("idx").alias(f"{tag}_top")
    ).withColumnsRenamed({"start_seconds": f"{tag}_start", "end_seconds": f"{tag}_end"})


def _members(side: DataFrame, live: DataFrame, key: Sequence[str], tag: str, copied: bool, target_rows: int) -> DataFrame:
    """Indexes of the intervals that have a candidate, ranked from the largest down."""
    rank, idx = f"{tag}_rank", f"{tag}_idx"
    if not copied:
        return live.select(*key, F.col(f"{tag}_top").alias(idx), F.lit(1).cast("long").alias(rank)).distinct()
    named = side.withColumnsRenamed({"start_seconds": f"{tag}_start", "end_seconds": f"{tag}_end"})
    used = named.join(live.select(*key).distinct(), list(key), "left_semi").withColumn("_down", -F.col("idx"))
    ranked = sequence_of(used, key, ["_down"], target_rows).row_number(rank).done()
    return cut_lineage(ranked.select(*key, F.col("idx").alias(idx), rank))


def _clusters(live: DataFrame, on: Sequence[str], target_rows: int | None) -> DataFrame:
    """Number the stretches of time that candidates chain together (``_cluster``) and add their ``_size`` and most ``_copies``.

    Candidates of one interval overlap, so no interval has candidates in two clusters.
    """
    spans = live.withColumns({"_low": F.least("t_start", "p_start"), "_high": F.greatest("t_end", "p_end")})
    seq = sequence_of(spans, on, ["_low", "_high", "t_top", "p_top"], target_rows)
    seq = seq.running_max(_reach=F.col("_high")).previous(_before=F.col("_reach"))
    opens = F.col("_before").isNull() | (F.col("_low") >= F.col("_before"))
    numbered = cut_lineage(seq.running_sum(_cluster=F.when(opens, 1).otherwise(0)).done().drop("_low", "_high", "_reach", "_before"))
    sizes = numbered.groupBy(*on, "_cluster").agg(F.count(F.lit(1)).alias("_size"), F.max(F.greatest("t_n", "p_n")).alias("_copies"))
    return cut_lineage(numbered.join(sizes, [*on, "_cluster"]))


def _match_whole(pairs: DataFrame, on: Sequence[str], rows: int) -> DataFrame:
    """Greedy matching of whole clusters in one grouped pass over buckets of about ``rows`` candidates."""
    buckets = pairs.count() // rows + 1
    spread_out = pairs.withColumn("_bucket", F.pmod(F.xxhash64(*on, "_cluster"), F.lit(buckets)))
    names = [*on, "t_top", "p_top", "iou", "t_start", "t_end", "p_start", "p_end"]

    def take(bucket: pd.DataFrame) -> pd.DataFrame:
        best = bucket.sort_values(["iou", "t_top", "p_top"], ascending=False, kind="stable")
        groups = list(zip(*[best[c].tolist() for c in on])) if on else [()] * len(best)
        used_t, used_p, kept = set(), set(), []
        for i, (group, t, p) in enumerate(zip(groups, best["t_top"].tolist(), best["p_top"].tolist())):
            if (group, t) not in used_t and (group, p) not in used_p:
                used_t.add((group, t))
                used_p.add((group, p))
                kept.append(i)
        return best.iloc[kept][names]

    shape = T.StructType([pairs.schema[n] for n in names])
    taken = spread_out.select(*names, "_bucket").groupBy("_bucket").applyInPandas(take, shape)
    return taken.withColumnsRenamed({"t_top": "t_idx", "p_top": "p_idx"})


def greedy_match(truth: DataFrame, predicted: DataFrame, on: Sequence[str], minimum_iou: float = 0.5, target_rows: int | None = None) -> DataFrame:
    """Pairs of a greedy one-to-one matching by (IoU, truth index, predicted index), descending.

    Both sides need ``idx`` (unique per ``on``), ``start_seconds`` and ``end_seconds``. Candidates
    are pairs of distinct intervals, so copies of an interval do not multiply. A sweep over time
    (running maximum of ends) cuts them into clusters that share no interval; all clusters that fit
    into a task are matched in one grouped pass, however long their chains. Larger clusters and
    those with copies go through rounds.
    """
    on = list(on)
    t = truth.select(*on, "idx", "start_seconds", "end_seconds")
    p = predicted.select(*on, "idx", "start_seconds", "end_seconds")
    score = iou(F.col("t_start"), F.col("t_end"), F.col("p_start"), F.col("p_end"))
    apart = 1 if minimum_iou >= 0.5 else None
    t_key, p_key = [*on, "t_start", "t_end"], [*on, "p_start", "p_end"]
    live = overlap_join(
        _shapes(t, on, "t"), _shapes(p, on, "p"), on, ("t_start", "t_end"), ("p_start", "p_end"), score >= minimum_iou, apart
    )
    none = F.lit(0).cast("long")
    live = live.select(*t_key, "p_start", "p_end", score.alias("iou"), "t_n", "t_top", none.alias("t_used"), "p_n", "p_top", none.alias("p_used"))
    pairs = _clusters(cut_lineage(live), on, target_rows)
    rows = rows_per_task(pairs, target_rows, FOLD_ROWS)
    fits = (F.col("_size") <= rows) & (F.col("_copies") == 1)
    whole = _match_whole(pairs.filter(fits), on, rows)
    rest = pairs.filter(~fits).select(*live.columns)
    return whole if rest.isEmpty() else whole.unionByName(_match_in_rounds(rest, t, p, on, target_rows))


def _match_in_rounds(live: DataFrame, t: DataFrame, p: DataFrame, on: Sequence[str], target_rows: int | None) -> DataFrame:
    """Greedy matching without a bound on clusters or copies.

    A pair that is the best choice of both its sides is final, which gives the greedy result in a
    few rounds. When a best pair has no rival of equal IoU, all its copies are matched at once.
    """
    t_key, p_key = [*on, "t_start", "t_end"], [*on, "p_start", "p_end"]
    # Copies are used up from the largest index down, so a count per interval holds their state.
    copied = {"t": not live.filter("t_n > 1").isEmpty(), "p": not live.filter("p_n > 1").isEmpty()}
    keys, sides = {"t": t_key, "p": p_key}, {"t": t, "p": p}
    members = {tag: _members(sides[tag], live, keys[tag], tag, copied[tag], target_rows) for tag in "tp"}

    choice = F.struct("iou", "t_top", "p_top")

    def best(tag: str) -> DataFrame:
        """Best candidate of each interval and how many candidates share its IoU."""
        level = live.groupBy(*keys[tag], "iou").agg(F.max(choice).alias("_c"), F.count(F.lit(1)).alias("_n"))
        return level.groupBy(*keys[tag]).agg(F.max(F.struct("_c", "_n")).alias(f"_{tag}"))

    blocks = []
    while True:
        mutual = live.join(best("t"), t_key).join(best("p"), p_key).filter((choice == F.col("_t._c")) & (choice == F.col("_p._c")))
        alone = (F.col("_t._n") == 1) & (F.col("_p._n") == 1)
        most = F.least(F.col("t_n") - F.col("t_used"), F.col("p_n") - F.col("p_used"))
        block = cut_lineage(mutual.withColumn("take", F.when(alone, most).otherwise(1).cast("long")).drop("_t", "_p", "t_top", "p_top"))
        if block.isEmpty():
            break
        blocks.append(block)
        for tag in "tp":
            if not copied[tag]:
                live = live.join(block.select(*keys[tag]), keys[tag], "left_anti")
                continue
            spent = block.groupBy(*keys[tag]).agg(F.sum("take").alias("_take"))
            live = live.join(spent, keys[tag], "left").withColumn(f"{tag}_used", F.col(f"{tag}_used") + F.coalesce("_take", F.lit(0)))
            # The next copy is the one ranked right after those used.
            next_up = members[tag].select(*keys[tag], (F.col(f"{tag}_rank") - 1).alias(f"{tag}_used"), F.col(f"{tag}_idx").alias(f"{tag}_top"))
            live = live.drop("_take", f"{tag}_top").join(next_up, [*keys[tag], f"{tag}_used"])
        live = cut_lineage(live.select(*block.columns[:-1], "t_top", "p_top"))
    taken = reduce(DataFrame.unionByName, blocks) if blocks else block
    matched = taken.join(members["t"], t_key).filter((F.col("t_rank") > F.col("t_used")) & (F.col("t_rank") <= F.col("t_used") + F.col("take")))
    matched = matched.withColumn("p_rank", F.col("t_rank") - F.col("t_used") + F.col("p_used"))
    return matched.join(members["p"], [*p_key, "p_rank"]).select(*on, "t_idx", "p_idx", "iou", "t_start", "t_end", "p_start", "p_end")


def overlap_counts(of: DataFrame, others: DataFrame, on: Sequence[str], target_rows: int | None = None) -> DataFrame:
    """How many of ``others`` each interval overlaps, without forming a single pair.

    Others that start before the end, minus those that end by the start: two running counts.
    """
    on = list(on)
    side = others.filter("end_seconds > start_seconds")
    kind = lambda df, at, order, **cols: df.select(*on, F.col(at).alias("_at"), F.lit(order).alias("_o"), *[c.alias(n) for n, c in cols.items()])
    none = F.lit(None).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    proper = of.filter("end_seconds > start_seconds")
    # At equal times: ends of others, then our starts, then our ends, then starts of others.
    marks = (
        kind(side, "end_seconds", 0, idx=none, started=zero, ended=one)
        .unionByName(kind(proper, "start_seconds", 1, idx=F.col("idx").cast("long"), started=zero, ended=zero))
        .unionByName(kind(proper, "end_seconds", 2, idx=F.col("idx").cast("long"), started=zero, ended=zero))
        .unionByName(kind(side, "start_seconds", 3, idx=none, started=one, ended=zero))
    )
    seq = sequence_of(marks, on, ["_at", "_o"], target_rows).running_sum(_s=F.col("started"), _e=F.col("ended")).done()
    mine = seq.filter("idx is not null").withColumn("_value", F.when(F.col("_o") == 2, F.col("_s")).otherwise(-F.col("_e")))
    counted = mine.groupBy(*on, "idx").agg(F.sum("_value").alias("overlaps"))
    return of.join(counted, [*on, "idx"], "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))


def fragmentation(truth: DataFrame, predicted: DataFrame, on: Sequence[str], by: Sequence[str], target_rows: int | None = None) -> DataFrame:
    """Extra predictions per truth and extra truths per prediction, summed per ``by``."""
    extra = F.sum(F.greatest(F.lit(0), F.col("overlaps") - 1))
    split = overlap_counts(truth, predicted, on, target_rows).groupBy(*by).agg(extra.alias("oversegmentation_extra_count"))
    merged = overlap_counts(predicted, truth, on, target_rows).groupBy(*by).agg(extra.alias("merged_truth_extra_count"))
    return join_on(split, merged, by, "full_outer").na.fill(0, ["oversegmentation_extra_count", "merged_truth_extra_count"])


def interval_report(truth: DataFrame, predicted: DataFrame, on: Sequence[str], by: Sequence[str], minimum_iou: float = 0.5) -> DataFrame:
    """Counts, precision, recall, fragmentation and boundary errors per ``by``."""
    on, by = list(on), list(by)
    matches = cut_lineage(greedy_match(truth, predicted, on, minimum_iou))
    errors = matches.select(*by, F.abs(F.col("t_start") - F.col("p_start")).alias("start_error"), F.abs(F.col("t_end") - F.col("p_end")).alias("end_error"))
    sides = {"truth_count": truth, "prediction_count": predicted, "matched_count": matches}
    rows = reduce(DataFrame.unionByName, [side.select(*by, F.lit(name).alias("_side")) for name, side in sides.items()])
    counts = rows.groupBy(*by).agg(*[F.count_if(F.col("_side") == name).alias(name) for name in sides])
    share = lambda whole: F.when(F.col(whole) > 0, F.col("matched_count") / F.col(whole)).otherwise(0.0)
    out = counts.withColumn("precision", share("prediction_count")).withColumn("recall", share("truth_count"))
    out = join_on(out, fragmentation(truth, predicted, on, by), by)
    names = ("start_error", "end_error")
    wanted = {n: {f"{n}_median_seconds": ("linear", 0.5), f"{n}_p95_seconds": ("nearest", 0.95)} for n in names}
    return join_on(out, figure_quantiles(errors, by, {n: n for n in names}, wanted), by)


def partition_report(
    truth: DataFrame, predicted: DataFrame, methods: DataFrame, on: Sequence[str], by: Sequence[str] = ("partition_id",),
    minimum: float = PRIMARY_MINIMUM_SECONDS, minimum_iou: float = 0.5,
) -> DataFrame:
    """Interval reports per partition, method and block: ``all`` truths, and the ``primary`` ones of at least ``minimum`` seconds.

    ``methods`` lists the (``by``, method) that have results; a method without a single interval is still reported, and truths
    of partitions without results are not. Each truth is routed to its blocks once, each prediction to every block, so both
    tables are read and matched once. ``predicted`` has a ``method`` column; ``idx`` is unique per ``on`` and method.
    """
    by = list(by)
    long_enough = F.col("end_seconds") - F.col("start_seconds") + TOLERANCE >= minimum
    blocks = F.array_compact(F.array(F.lit("all"), F.when(long_enough, F.lit("primary"))))
    listed = broadcast_if_small(methods.select(*by, "method").distinct())
    routed = truth.join(listed, by).withColumn("block", F.explode(blocks))
    claimed = predicted.join(listed, [*by, "method"], "left_semi").withColumn("block", F.explode(F.array(F.lit("all"), F.lit("primary"))))
    # Every listed method has a row in both blocks, also without truths and predictions.
    wanted = listed.withColumn("block", F.explode(F.array(F.lit("all"), F.lit("primary"))))
    cell = [*by, "method", "block"]
    report = wanted.join(interval_report(routed, claimed, [*dict.fromkeys([*on, *cell])], cell, minimum_iou), cell, "left")
    counted = [c for c in report.columns if c.endswith("_count")]
    return report.na.fill(0, counted).na.fill(0.0, ["precision", "recall"])


def unmatched_truth(truth: DataFrame, matches: DataFrame, on: Sequence[str]) -> DataFrame:
    return truth.join(matches.select(*on, F.col("t_idx").alias("idx")), [*on, "idx"], "left_anti")


def runtime_report(projects: DataFrame, legacy_line_count: Column | int = 1) -> DataFrame:
    """Counters of each document, with the defaults of older ones."""
    p = lambda n: F.col(f"processing.{n}")
    lines = legacy_line_count if isinstance(legacy_line_count, Column) else F.lit(legacy_line_count)
    return projects.select(
        "*",
        p("sample_count").alias("sample_count"),
        F.coalesce(p("detection_count"), p("subtitle_count")).alias("detected_interval_count"),
        F.coalesce(p("ocr_call_count"), p("sample_count") * lines).alias("ocr_call_count"),
        F.coalesce(p("translation_call_count"), p("subtitle_count")).alias("translation_call_count"),
        F.greatest(F.lit(0), F.size(p("errors"))).alias("error_count"),
    )
