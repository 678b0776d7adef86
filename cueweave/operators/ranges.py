"""Interval joins keyed by size class and bucket.

Each interval falls into the size class whose bucket width is the next power of four above its
length, so it touches at most two buckets of its own class and of every larger class. A pair is
joined in the class of its longer side, in the bucket where the overlap starts. One very long
interval therefore costs two rows, not one row per bucket it covers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BASE = 4.0
LOWEST, HIGHEST = -5, 15  # about a millisecond to thirty years


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    shared = overlap(a_start, a_end, b_start, b_end)
    union = (a_end - a_start) + (b_end - b_start) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def size_class(start: Column, end: Column) -> Column:
    """Smallest class whose bucket width is at least the length."""
    length = F.greatest(end - start, F.lit(BASE**LOWEST))
    return F.least(F.lit(HIGHEST), F.greatest(F.lit(LOWEST), F.ceil(F.log2(length) / 2))).cast("int")


def _buckets(start: Column, end: Column, level: Column) -> Column:
    width = F.pow(F.lit(BASE), level)
    return F.sequence(F.floor(start / width).cast("long"), F.floor(F.greatest(start, end) / width).cast("long"))


def _spread(df: DataFrame, start: str, end: str, levels: Column, own: str) -> DataFrame:
    return (
        df.withColumn(own, size_class(F.col(start), F.col(end)))
        .withColumn("_level", F.explode(levels))
        .withColumn("_bucket", F.explode(_buckets(F.col(start), F.col(end), F.col("_level"))))
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    condition: Column | None = None,
    classes_apart: int | None = None,
) -> DataFrame:
    """Pairs with equal ``on`` columns and overlapping ranges, each pair once.

    The range columns of both sides must have different names. ``classes_apart`` bounds how far
    the sizes of a pair may differ (an IoU of at least one half means one class); without it
    only the classes that occur on the other side are used.
    """
    (ls, le), (rs, re) = left_range, right_range
    own = size_class(F.col(ls), F.col(le))
    other = size_class(F.col(rs), F.col(re))
    if classes_apart is not None:
        up = lambda c: F.sequence(c, F.least(F.lit(HIGHEST), c + classes_apart))
        wide_l, wide_r = _spread(left, ls, le, up(own), "_lc"), _spread(right, rs, re, up(other), "_rc")
    else:
        # Classes of each side: at most 21 values per side, so the array is bounded.
        seen_l = left.agg(F.collect_set(own).alias("_seen"))
        seen_r = right.agg(F.collect_set(other).alias("_seen"))

        def spread(df, start, end, mine, seen, name):
            levels = F.array_distinct(F.concat(F.array(mine), F.filter("_seen", lambda k: k > mine)))
            return _spread(df.withColumn("_seen", seen.scalar()), start, end, levels, name).drop("_seen")

        wide_l = spread(left, ls, le, own, seen_r, "_lc")
        wide_r = spread(right, rs, re, other, seen_l, "_rc")
    matched = wide_l.alias("l").join(wide_r.alias("r"), [*on, "_level", "_bucket"])
    width = F.pow(F.lit(BASE), F.col("_level"))
    begins = F.greatest(F.col(ls), F.col(rs))
    keep = (
        (F.col("_level") == F.greatest(F.col("_lc"), F.col("_rc")))
        & (F.col("_bucket") == F.floor(begins / width))
        & (begins < F.least(F.col(le), F.col(re)))
    )
    if condition is not None:
        keep = keep & condition
    return matched.filter(keep).drop("_level", "_bucket", "_lc", "_rc")


def simultaneous(captions: DataFrame, video: str = "video_id") -> DataFrame:
    """Pairs of captions on different lines of one video that are shown together."""
    base = captions.select(video, "line_id", "ordinal", "id", "start_seconds", "end_seconds")
    first = base.select(video, *[F.col(c).alias(f"a_{c}") for c in base.columns if c != video])
    second = base.select(video, *[F.col(c).alias(f"b_{c}") for c in base.columns if c != video])
    pairs = overlap_join(
        first, second, [video], ("a_start_seconds", "a_end_seconds"), ("b_start_seconds", "b_end_seconds"),
        (F.col("a_line_id") != F.col("b_line_id")) & (F.col("a_ordinal") < F.col("b_ordinal")),
    )
    start = F.greatest("a_start_seconds", "b_start_seconds")
    end = F.least("a_end_seconds", "b_end_seconds")
    return pairs.filter(end > start + 1e-9).select(
        video, F.col("a_id").alias("first_id"), F.col("b_id").alias("second_id"),
        start.alias("start_seconds"), end.alias("end_seconds"),
    )


def points_in_intervals(points: DataFrame, intervals: DataFrame, on: Sequence[str], t: str = "t", start: str = "start_seconds", end: str = "end_seconds") -> DataFrame:
    """All (point, interval) pairs with ``start <= t < end``."""
    length = F.col(end) - F.col(start)
    seen = intervals.agg(F.collect_set(size_class(F.col(start), F.col(end))).alias("_seen"))
    level = size_class(F.col(start), F.col(end))
    wide = (
        intervals.filter(length > 0).withColumn("_level", level)
        .withColumn("_bucket", F.explode(_buckets(F.col(start), F.col(end), F.col("_level"))))
    )
    probes = (
        points.withColumn("_level", F.explode(seen.scalar()))
        .withColumn("_bucket", F.floor(F.col(t) / F.pow(F.lit(BASE), F.col("_level"))).cast("long"))
    )
    hit = (F.col(start) <= F.col(t)) & (F.col(t) < F.col(end))
    return probes.join(wide, [*on, "_level", "_bucket"]).filter(hit).drop("_level", "_bucket")


def active_at(points: DataFrame, captions: DataFrame, on: Sequence[str], point_id: str, t: str = "t") -> DataFrame:
    """The caption on top at each point: lowest line, then earliest start, then id; nulls where none is shown.

    Points take part once more without a caption, which never wins, so none is lost and no second join is needed.
    """
    pairs = points_in_intervals(points, captions, on, t).withColumn("_order", F.struct("line_index", "start_seconds", "id"))
    rest = [c for c in pairs.columns if c not in (point_id, t, "_order", *on)]
    best = F.min_by(F.struct(*rest), "_order")
    every = pairs.unionByName(points, allowMissingColumns=True)
    return every.groupBy(*on, point_id, t).agg(best.alias("_best")).select(*on, point_id, t, "_best.*")
