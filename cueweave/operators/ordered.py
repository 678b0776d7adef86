"""Ordered operators that stay distributed when one key holds most of the rows.

A plain window partitioned by key puts a whole key into one task. Before the first window the
rows per key are counted (two columns, partial aggregate). If no key exceeds ``target_rows``,
plain windows follow and share one shuffle. Otherwise the keys over the limit are sorted by a
range exchange on (keys, order), which splits a key wherever its rows are, and numbered into
slices of ``target_rows`` rows, rows of one position included; windows run per slice, and one
summary row per slice is carried to the next. Keys within the limit keep their plain windows
and are not written.

Slice tables hold a few rows per ``target_rows`` input rows; they are written, measured, and
broadcast only if small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, cut_lineage, spread

TARGET_ROWS = "spark.cueweave.targetRows"
FOLD_ROWS = "spark.cueweave.foldRows"
_DEFAULTS = {TARGET_ROWS: 1_000_000, FOLD_ROWS: 20_000}
SLICE = "_slice"
_HOT = "_hot"
#: Rows that one task of the range exchange sorts, and room for slice numbers of a task.
_SORTED_ROWS, _PER_TASK = 1_000_000, 1 << 32


def rows_per_task(df: DataFrame, given: int | None, setting: str = TARGET_ROWS) -> int:
    """Rows of one key that a task may hold: as given, else as the session sets it."""
    return given or int(df.sparkSession.conf.get(setting, str(_DEFAULTS[setting])))


def _attach(df: DataFrame, side: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a slice table on null-safe keys; it is written and measured before it may be broadcast."""
    renamed = broadcast_if_small(cut_lineage(side.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in side.columns])))
    match = F.lit(True)
    for c in on:
        match = match & df[c].eqNullSafe(renamed[f"_on_{c}"])
    return df.join(renamed, match, how).drop(*[f"_on_{c}" for c in on])


def has_hot_key(df: DataFrame, keys: Sequence[str], target_rows: int) -> bool:
    return not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > target_rows).isEmpty()


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], target_rows: int | None = None) -> DataFrame:
    """Add the slice number of each row: -1 for keys within ``target_rows``, else rising along ``order``.

    Order columns may be of any sortable type. Only rows of larger keys are written. No slice is
    larger than ``target_rows``, however rows bunch or tie.
    """
    target_rows = rows_per_task(df, target_rows)
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > target_rows).withColumn(_HOT, F.lit(True))
    large = cut_lineage(large)
    rows = large.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    marked = _attach(df, large.drop("_n"), keys)
    cold = marked.filter(F.col(_HOT).isNull()).withColumns({_HOT: F.lit(False), SLICE: F.lit(-1).cast("long")})
    ranged = marked.filter(_HOT).repartitionByRange(rows // _SORTED_ROWS + 1, *keys, *order).withColumn("_task", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("_task", *keys).orderBy(*order)) - 1
    hot = ranged.withColumn(SLICE, F.col("_task") * _PER_TASK + F.floor(place / target_rows)).drop("_task")
    return cold.unionByName(cut_lineage(hot))


def sequence_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], target_rows: int | None = None) -> "Ordered":
    """``df`` as rows in order within keys, ready for the operators of ``Ordered``."""
    target_rows = rows_per_task(df, target_rows)
    if has_hot_key(df, keys, target_rows):
        return Ordered(sliced(df, keys, order, target_rows), list(keys), list(order), True)
    return Ordered(spread(df, *keys), list(keys), list(order), False)


class Ordered:
    """Rows in order within keys; ``cut`` tells whether keys are cut into slices."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], cut: bool):
        self.df, self.keys, self.order, self.cut = df, keys, order, cut

    def _with(self, df: DataFrame) -> "Ordered":
        return Ordered(df, self.keys, self.order, self.cut)

    def _inside(self):
        return Window.partitionBy(*self.keys, *([SLICE] if self.cut else [])).orderBy(*self.order)

    def _neighbour(self, values: Mapping[str, Column], forward: bool) -> "Ordered":
        df, keys = self.df, self.keys
        packed = F.struct(*[c.alias(name) for name, c in values.items()])
        look = F.lead if forward else F.lag
        local = df.withColumn("_packed", packed).withColumn("_near", look("_packed").over(self._inside()))
        if self.cut:
            edge_of = F.min_by if forward else F.max_by
            across = Window.partitionBy(*keys).orderBy(SLICE)
            edges = (
                df.filter(_HOT).groupBy(*keys, SLICE)
                .agg(edge_of(packed, F.struct(*self.order)).alias("_edge"))
                .select(*keys, SLICE, look("_edge").over(across).alias("_carried"))
            )
            # The struct itself is never null, so a null neighbour means the border of the slice.
            local = _attach(local, edges, [*keys, SLICE]).withColumn("_near", F.coalesce("_near", "_carried"))
        return self._with(local.select(*df.columns, *[F.col("_near")[name].alias(name) for name in values]))

    def previous(self, **values: Column) -> "Ordered":
        """Add columns holding ``values`` of the previous row of the key; null on its first row."""
        return self._neighbour(values, forward=False)

    def next(self, **values: Column) -> "Ordered":
        """Add columns holding ``values`` of the next row of the key; null on its last row."""
        return self._neighbour(values, forward=True)

    def _running(self, values: Mapping[str, Column], total: Callable[[Column], Column], combine: Callable[[Column, Column], Column]) -> "Ordered":
        """Add running totals; ``combine`` joins the total of the slices before (null: none) with that inside the slice."""
        df, keys = self.df, self.keys
        inside = self._inside().rowsBetween(Window.unboundedPreceding, 0)
        local = df.select("*", *[total(c).over(inside).alias(name) for name, c in values.items()])
        if not self.cut:
            return self._with(local.withColumns({name: combine(F.lit(None), F.col(name)) for name in values}))
        across = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        totals = (
            df.filter(_HOT).groupBy(*keys, SLICE)
            .agg(*[total(c).alias(f"_sum_{name}") for name, c in values.items()])
            .select(*keys, SLICE, *[total(F.col(f"_sum_{name}")).over(across).alias(f"_before_{name}") for name in values])
        )
        out = _attach(local, totals, [*keys, SLICE])
        return self._with(out.select(*df.columns, *[combine(F.col(f"_before_{name}"), F.col(name)).alias(name) for name in values]))

    def running_sum(self, **values: Column) -> "Ordered":
        """Add running sums, the current row included."""
        none = F.lit(0)
        return self._running(values, F.sum, lambda before, inside: F.coalesce(inside, none) + F.coalesce(before, none))

    def running_max(self, **values: Column) -> "Ordered":
        """Add running maxima, the current row included; nulls do not count."""
        return self._running(values, F.max, lambda before, inside: F.greatest(before, inside))

    def row_number(self, name: str) -> "Ordered":
        return self.running_sum(**{name: F.lit(1).cast("long")})

    def filter(self, condition: Column | str) -> "Ordered":
        return self._with(self.df.filter(condition))

    def with_columns(self, **columns: Column) -> "Ordered":
        return self._with(self.df.withColumns(columns))

    def done(self) -> DataFrame:
        return self.df.drop(SLICE, _HOT)


def global_rank(df: DataFrame, digest: str, ties: Sequence[str] = (), name: str = "rank", digits: int = 4) -> DataFrame:
    """Rank of every row by a hex digest column, without sorting all rows in one task.

    Rows are spread over ``16 ** digits`` buckets by the first digits; bucket sizes give the
    offset of each bucket, and only those sizes pass through a single task.
    """
    bucketed = df.withColumn("_bucket", F.conv(F.substring(digest, 1, digits), 16, 10).cast("int"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("_bucket").count().select(
        "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy(digest, *ties)
    ranked = bucketed.withColumn("_inner", F.row_number().over(inside))
    return _attach(ranked, offsets, ["_bucket"]).select(
        *df.columns, (F.col("_offset") + F.col("_inner")).alias(name)
    )


Fold = Callable[[pd.DataFrame, bytes | None, bool], tuple[list[dict], bytes | None]]


def _fold_whole_keys(rows: DataFrame, keys: list[str], order: list[str], fold: Fold, out: T.StructType) -> DataFrame:
    """The fold of keys that all fit into a task: one pass over rows sorted by key, many keys to a batch.

    Only the last key of a batch is carried to the next one. Nulls of whole numbers are sent beside them, as one null would
    turn the column of its batch into floats.
    """
    schema = T.StructType([*[rows.schema[k] for k in keys], *out.fields])
    whole = [f for f in rows.schema if isinstance(f.dataType, T.IntegralType)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def folded(frame: pd.DataFrame, bounds: Sequence[int]) -> Iterator[pd.DataFrame]:
            heads = {k: frame[k].tolist() for k in keys}
            lines = []
            for low, high in zip(bounds, bounds[1:]):
                head = {k: values[low] for k, values in heads.items()}
                lines += [{**head, **item} for item in fold(frame.iloc[low:high], None, True)[0]]
            if lines:
                yield pd.DataFrame(lines, columns=schema.names, dtype=object)

        for frame in frames:
            if frame.empty:
                continue
            for f in whole:
                null = frame.pop(f"_null_{f.name}").to_numpy(bool)
                if null.any():
                    values = frame[f.name].to_numpy(object)
                    values[null] = None
                    frame[f.name] = values
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            own, before = frame[keys], frame[keys].shift()
            changed = ((own != before) & ~(own.isna() & before.isna())).any(axis=1).to_numpy()
            bounds = [0, *(changed[1:].nonzero()[0] + 1).tolist()]
            yield from folded(frame, bounds)
            held = frame.iloc[bounds[-1] :]
        if held is not None:
            yield from folded(held, [0, len(held)])

    near = spread(rows, *keys)
    near = rows.repartition(*keys) if near is rows else near
    ordered = near.sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in order])
    filled = {f.name: F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)) for f in whole}
    return ordered.withColumns({f"_null_{name}": F.col(name).isNull() for name in filled} | filled).mapInPandas(run, schema)


def ordered_fold(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, out: T.StructType, target_rows: int | None = None
) -> DataFrame:
    """Sequential fold per key, exact and bounded in memory for keys of any size.

    ``fold(rows, state, last)`` takes the ordered rows of one slice, the state left by the slice
    before (None at the start) and whether the slice is the last of its key; it returns output
    rows and the state it leaves. Every slice first runs from the empty state. Slices whose
    incoming state turns out different are run again until no state changes, which is the
    sequential result; state that settles inside a slice makes that two rounds.
    """
    keys = list(keys)
    cut = [*keys, SLICE]
    target_rows = rows_per_task(rows, target_rows, FOLD_ROWS)
    hot = has_hot_key(rows, keys, target_rows)
    if not hot:
        return _fold_whole_keys(rows, keys, list(order), fold, out)
    data = cut_lineage(sliced(rows, keys, order, target_rows).drop(_HOT))
    key_fields = [rows.schema[k] for k in keys]
    schema = T.StructType([
        *key_fields,
        T.StructField(SLICE, T.LongType()),
        T.StructField("_out", out),
        T.StructField("_left", T.BinaryType()),
        T.StructField("_end", T.BooleanType()),
    ])

    def run(group: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if start.empty or group.empty:
            return pd.DataFrame(columns=schema.names)
        state, last = start["_state"].iloc[0], bool(start["_last"].iloc[0])
        ordered = group.sort_values(list(order), kind="stable")
        produced, left = fold(ordered, None if state is None else bytes(state), last)
        head = {c: group[c].iloc[0] for c in cut}
        lines = [{**head, "_out": item, "_left": None, "_end": False} for item in produced]
        lines.append({**head, "_out": None, "_left": left, "_end": True})
        return pd.DataFrame(lines, columns=schema.names)

    def pass_over(part: DataFrame, starts: DataFrame) -> DataFrame:
        renamed = starts.select(*[F.col(c).alias(f"_start_{c}") for c in cut], "_state", "_last")
        at = renamed.groupBy(*[f"_start_{c}" for c in cut])
        return part.groupBy(*cut).cogroup(at).applyInPandas(run, schema)

    across = Window.partitionBy(*keys).orderBy(SLICE)
    slices = (
        data.groupBy(*cut).agg(F.count(F.lit(1)).alias("_rows"))
        .select(*cut, F.lead(F.lit(1)).over(across).isNull().alias("_last"))
        .withColumn("_state", F.lit(None).cast("binary"))
    )
    result = cut_lineage(pass_over(data, slices))
    used = cut_lineage(slices)
    while True:
        left = result.filter("_end").select(*cut, F.lag("_left").over(across).alias("_incoming"))
        fresh = used.join(left, cut).filter(~F.col("_state").eqNullSafe(F.col("_incoming")))
        changed = cut_lineage(fresh.select(*cut, "_last", F.col("_incoming").alias("_state")))
        if changed.isEmpty():
            return result.filter(~F.col("_end")).select(*keys, "_out.*")
        again = data.join(changed.select(*cut), cut, "left_semi")
        kept = result.join(changed.select(*cut), cut, "left_anti")
        result = cut_lineage(kept.unionByName(pass_over(again, changed)))
        used = cut_lineage(used.join(changed.select(*cut), cut, "left_anti").unionByName(changed.select(*used.columns)))


def rows_of(frame: pd.DataFrame) -> Iterator[dict]:
    """Rows of a pandas frame as dictionaries."""
    names = list(frame.columns)
    for values in zip(*[frame[n].tolist() for n in names]):
        yield dict(zip(names, values))
