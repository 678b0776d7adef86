"""Pixel and mask queries: embeddings stand in for images, line items for pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as fr
from ..operators.ordered import sequence_of
from .registry import query, table
from .timeline import observations

PIXELS = """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity * 5)::INTEGER AS b, (l_linenumber * 36)::INTEGER AS g, (floor(l_extendedprice)::BIGINT % 256)::INTEGER AS r FROM lineitem),
h AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS s FROM p),
c AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE floor((s * round(1044480 / v::DOUBLE) + 2048) / 4096)::INTEGER END AS sat,
  CASE WHEN s = 0 THEN 0 ELSE floor((CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * s ELSE r - g + 4 * s END * round(122880 / s::DOUBLE) + 2048) / 4096)::INTEGER END AS hue0 FROM h),
q AS (SELECT *, CASE WHEN hue0 < 0 THEN hue0 + 180 ELSE hue0 END AS hue FROM c)
"""


def pixels(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 5).cast("int").alias("b"), (F.col("l_linenumber") * 36).cast("int").alias("g"),
        (F.floor("l_extendedprice").cast("long") % 256).cast("int").alias("r"),
    )


@query("candidate_mask", PIXELS + """
SELECT l_orderkey, l_linenumber, l_partkey, hue, sat, (v >= 175 AND sat <= 120) OR (hue BETWEEN 8 AND 42 AND sat >= 65 AND v >= 135) AS candidate FROM q
""")
def candidate_mask(spark, d):
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    hue, sat, _ = fr.hsv(b, g, r)
    return pixels(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", hue.alias("hue"), sat.alias("sat"), fr.candidate_pixel(b, g, r).alias("candidate"))


@query("pixel_contrast", PIXELS + """
SELECT l_orderkey, l_linenumber, l_partkey, floor(greatest(0.0, least(255.0, (b - 127.5) * 1.5 + 127.5)))::INTEGER AS contrast,
  ((3735 * b + 19235 * g + 9798 * r + 16384) >> 15)::INTEGER AS gray, CASE WHEN v - s >= 170 AND s <= 60 THEN 255 ELSE 0 END AS white
FROM q WHERE b >= 10 AND b < 80
""")
def pixel_contrast(spark, d):
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    rows = pixels(spark, d).filter(fr.in_band(b))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", fr.contrast(b).alias("contrast"), fr.grayscale(b, g, r).alias("gray"), fr.white_mask(b, g, r).alias("white")
    )


@query("otsu_threshold", """
WITH h AS (SELECT l_returnflag, l_quantity::INTEGER AS level, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT *, sum(n) OVER w AS n0, sum(level * n) OVER w AS s0, sum(n) OVER (PARTITION BY l_returnflag) AS nn, sum(level * n) OVER (PARTITION BY l_returnflag) AS ss
      FROM h WINDOW w AS (PARTITION BY l_returnflag ORDER BY level)),
v AS (SELECT *, (n0::DOUBLE / nn) * (1 - n0::DOUBLE / nn) * power(s0::DOUBLE / n0 - (ss - s0)::DOUBLE / (nn - n0), 2) AS x FROM s WHERE n0 < nn)
SELECT l_returnflag, arg_max(level, (x, -level)) AS threshold, round(max(x), 6) AS between_variance FROM v GROUP BY l_returnflag
""")
def otsu_threshold(spark, d):
    out = fr.otsu_thresholds(table(spark, d, "lineitem", "l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity")
    return out.withColumn("between_variance", F.round("between_variance", 6))


@query("presence_score", """
SELECT p_partkey, round(least(1.0, p_size / (120.0 * 30) * 18 + (p_partkey % 10) / 10.0 * 0.8), 9) AS score FROM part
""")
def presence_score(spark, d):
    score = fr.presence_score(F.col("p_size"), F.lit(120.0), F.lit(30.0), (F.col("p_partkey") % 10) / 10.0)
    return table(spark, d, "part").select("p_partkey", F.round(score, 9).alias("score"))


def neighbours(spark, d):
    seq = sequence_of(observations(spark, d), ["video_id"], ["source_index"])
    return seq.previous(before=F.col("mask")).filter("before is not null").done()


MASKS = """
WITH p AS (SELECT vec_id, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings),
x AS (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings),
m AS (SELECT vec_id, i // 8 AS r, i % 8 AS c FROM x WHERE embedding[i + 1] > 0.05),
n AS (SELECT vec_id, count(*) AS n FROM m GROUP BY vec_id),
k AS (SELECT p.vec_id, p.prev, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM p LEFT JOIN n a ON a.vec_id = p.vec_id LEFT JOIN n b ON b.vec_id = p.prev WHERE prev IS NOT NULL)
"""


@query("mask_overlap", MASKS + """
, near AS (SELECT p.vec_id, count(DISTINCT (a.r, a.c)) AS a_hit, count(DISTINCT (b.r, b.c)) AS b_hit FROM p JOIN m a ON a.vec_id = p.vec_id JOIN m b ON b.vec_id = p.prev
  WHERE abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY p.vec_id)
SELECT k.vec_id::INTEGER AS vec_id, round(CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE least(1.0, (coalesce(a_hit, 0) + coalesce(b_hit, 0)) / (na + nb)::DOUBLE) END, 9) AS overlap
FROM k LEFT JOIN near ON near.vec_id = k.vec_id
""")
def mask_overlap(spark, d):
    rows = neighbours(spark, d)
    return rows.select(F.col("source_index").alias("vec_id"), F.round(fr.mask_overlap(F.col("before"), F.col("mask"), F.col("mask_w"), F.col("mask_h")), 9).alias("overlap"))


@query("dice_shift", MASKS + """
, s AS (SELECT p.vec_id, dy, dx, count(*) AS hit FROM p, (VALUES (-1), (0), (1)) y(dy), (VALUES (-1), (0), (1)) z(dx), m a, m b
  WHERE a.vec_id = p.vec_id AND b.vec_id = p.prev AND a.r = b.r + dy AND a.c = b.c + dx GROUP BY ALL),
t AS (SELECT vec_id, max(hit) AS hit FROM s GROUP BY vec_id)
SELECT k.vec_id::INTEGER AS vec_id, round(CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE 2 * coalesce(hit, 0) / (na + nb)::DOUBLE END, 9) AS dice
FROM k LEFT JOIN t ON t.vec_id = k.vec_id
""")
def dice_shift(spark, d):
    rows = neighbours(spark, d)
    return rows.select(F.col("source_index").alias("vec_id"), F.round(fr.dice_shift(F.col("before"), F.col("mask"), F.col("mask_w"), F.col("mask_h")), 9).alias("dice"))


@query("frame_features")
def frame_features(spark, d):
    """Each embedding as a 16x32 image whose caption-coloured blocks are its large values."""
    cell = F.transform(F.col("embedding"), lambda v: F.when(v > 0.05, F.lit("FFFFFFFFFFFFFFFFFFFFFFFF")).otherwise(F.lit("101010101010101010101010")))
    line = lambda r: F.repeat(F.array_join(F.slice(cell, r * 8 + 1, 8), ""), 2)
    frames = table(spark, d, "embeddings").select(
        F.col("label").cast("string").alias("video_id"), F.col("vec_id").alias("frame_id"), (F.col("vec_id") * F.lit(0.2)).alias("ts"),
        F.lit(32).alias("width"), F.lit(16).alias("height"), F.unhex(F.concat(*[line(r) for r in range(8)])).alias("pixels"),
    )
    out = fr.frame_features(frames, 0.5)
    return out.select("video_id", "source_index", "line_id", "present", "components", "text_pixels", F.round("presence", 9).alias("presence"), F.round("sharpness", 6).alias("sharpness"))
