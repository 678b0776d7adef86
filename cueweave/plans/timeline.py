"""Timeline, window and streaming-shaped queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import ranges, reviews, timeline as tl, tracking
from ..operators.ordered import sequence_of
from .registry import micros, query, table

INTERVAL = 0.2


def samples(spark, d) -> DataFrame:
    """Events as samples of one line per user: errors fail, views show no text."""
    status = F.when(F.col("event_type") == "error", "ocr_error").when(F.col("event_type") == "view", "no_subtitle").otherwise("subtitle")
    return table(spark, d, "events").select(
        "user_id", "event_id", (micros("ts") / 1e6).alias("ts"), status.alias("status"), F.col("event_type").alias("raw_text"),
        F.array().cast("array<string>").alias("raw_lines"), (F.col("value") / 100).alias("confidence"), F.lit(None).cast("string").alias("error"),
    )


def captions(spark, d) -> DataFrame:
    return tl.merge_runs(samples(spark, d), INTERVAL, None, ["user_id"], ["ts", "event_id"])


def whole_micros(name: str):
    return F.round(F.col(name) * 1_000_000).cast("long")


RUNS = """
WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN event_type NOT IN ('error', 'view') THEN event_type END AS k FROM events),
l AS (SELECT *, lag(k) OVER w AS pk, row_number() OVER w AS rn, max(us) OVER (PARTITION BY user_id) AS top FROM s WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
c AS (SELECT *, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS nx FROM l WHERE rn = 1 OR pk IS DISTINCT FROM k),
runs AS (SELECT user_id, event_id, us AS start_us, greatest(us, coalesce(nx, top + 200000)) AS end_us, k AS raw_text FROM c WHERE k IS NOT NULL)
"""


@query("merge_runs", RUNS + "SELECT user_id, start_us, end_us, raw_text FROM runs")
def merge_runs(spark, d):
    return captions(spark, d).select("user_id", whole_micros("start_seconds").alias("start_us"), whole_micros("end_seconds").alias("end_us"), "raw_text")


@query("sample_errors", "SELECT user_id, epoch_us(ts) AS us, 'OCR failed' AS message FROM events WHERE event_type = 'error'")
def sample_errors(spark, d):
    return tl.sample_errors(samples(spark, d), ["user_id"]).select("user_id", whole_micros("timestamp_seconds").alias("us"), "message")


@query("timeline_totals", RUNS + """
SELECT user_id, count(*)::BIGINT AS captions, sum(end_us - start_us)::BIGINT AS total_us FROM runs
WHERE end_us - start_us >= 3600000000 GROUP BY user_id
""")
def timeline_totals(spark, d):
    kept = tl.split_by_duration(captions(spark, d), 3600.0).filter("reason is null")
    spent = whole_micros("end_seconds") - whole_micros("start_seconds")
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("captions"), F.sum(spent).alias("total_us"))


@query("min_duration_split", RUNS + """
SELECT user_id, start_us, CASE WHEN end_us - start_us < 3600000000 THEN 'shorter_than_minimum_duration' ELSE 'kept' END AS reason FROM runs
""")
def min_duration_split(spark, d):
    rows = tl.split_by_duration(captions(spark, d), 3600.0)
    return rows.select("user_id", whole_micros("start_seconds").alias("start_us"), F.coalesce("reason", F.lit("kept")).alias("reason"))


@query("stabilize", RUNS + """
, g AS (SELECT *, CASE WHEN lag(raw_text) OVER w = raw_text AND start_us - lag(end_us) OVER w <= 7200000000 THEN 0 ELSE 1 END AS opens
        FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY start_us, end_us)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, min(start_us) AS start_us, max(end_us) AS end_us, any_value(raw_text) AS raw_text,
  CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END::BIGINT AS variants
FROM i GROUP BY user_id, island HAVING max(end_us) - min(start_us) >= 600000
""")
def stabilize(spark, d):
    rows = tl.stabilize(captions(spark, d), 7200.0, 0.6, ["user_id"])
    return rows.select(
        "user_id", whole_micros("start_seconds").alias("start_us"), whole_micros("end_seconds").alias("end_us"), "raw_text",
        F.when(F.col("variants").isNull(), 0).otherwise(F.size("variants")).cast("long").alias("variants"),
    )


@query("stabilize_gap", """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w - 60000000 <= 1800000000 THEN 0 ELSE 1 END AS opens FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, island::BIGINT AS island, min(us) AS start_us, max(us) + 60000000 AS end_us, count(*)::BIGINT AS members FROM i GROUP BY user_id, island
""")
def stabilize_gap(spark, d):
    rows = samples(spark, d).select("user_id", "event_id", "ts", (F.col("ts") + 60).alias("stop"))
    out = tl.merge_by_gap(rows, ["user_id"], "ts", "stop", 1800.0, ["event_id"])
    return out.select("user_id", F.col("island").cast("long").alias("island"), whole_micros("ts").alias("start_us"), whole_micros("stop").alias("end_us"), "members")


def observations(spark, d) -> DataFrame:
    """Embeddings as 8x8 masks of one line per label, in id order."""
    bits = F.transform(F.col("embedding"), lambda v: F.when(v > 0.05, F.lit("1")).otherwise("0"))
    packed = F.unhex(F.lpad(F.conv(F.array_join(bits, ""), 2, 16), 16, "0"))
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, d, "embeddings").select(
        F.col("label").cast("string").alias("video_id"), F.lit("line-1").alias("line_id"), F.lit(0).alias("line_index"),
        (F.col("vec_id") * F.lit(0.2)).alias("ts"), (F.col("vec_id") * F.lit(0.2)).alias("pts"), F.col("vec_id").cast("int").alias("source_index"),
        packed.alias("mask"), F.lit(8).alias("mask_w"), F.lit(8).alias("mask_h"), (e(0) > -0.15).alias("present"),
        F.abs(e(1)).alias("presence"), (F.abs(e(2)) * 1000).alias("sharpness"), F.lit(2).alias("components"), F.lit(1).alias("text_pixels"),
    )


@query("track_intervals")
def track_intervals(spark, d):
    config = tracking.TrackerConfig(minimum_duration=0.1, similarity=0.55, detail_similarity=0.45)
    out = tracking.track_intervals(observations(spark, d), config, range_end=1e6)
    return out.select("video_id", "kind", "start_seconds", "end_seconds", "sample_count", "start_reason", "end_reason", "needs_review")


@query("confirmed_runs", """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type AS v FROM events),
l AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
k AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY us, event_id) AS pk FROM l WHERE p IS DISTINCT FROM v AND n = v)
SELECT user_id, v AS event_type, us AS start_us, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS end_us FROM k WHERE pk IS DISTINCT FROM v
""")
def confirmed_runs(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", micros("ts").alias("us"), "event_type")
    out = tl.confirmed_runs(rows, ["user_id"], ["us", "event_id"], "event_type")
    return out.withColumnsRenamed({"start": "start_us", "end": "end_us"})


@query("open_tail", """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type <> 'error' AS b FROM events),
l AS (SELECT *, lag(b) OVER w AS pb, lag(us) OVER w AS pus, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
d AS (SELECT *, lag(b, 1, false) OVER (PARTITION BY user_id ORDER BY rn) AS before FROM l WHERE b = pb),
s AS (SELECT user_id, arg_max(b, rn) AS shown, max(pus) FILTER (b AND NOT before) AS start_us FROM d GROUP BY user_id),
t AS (SELECT l.user_id, l.b, l.us, coalesce(shown, false) AS shown, start_us FROM l LEFT JOIN s ON s.user_id = l.user_id WHERE rn = n)
SELECT user_id, CASE WHEN shown THEN 'interval' ELSE 'dropped' END AS kind, CASE WHEN shown THEN start_us ELSE us END AS start_us,
  CASE WHEN NOT shown THEN 'appearance_not_confirmed' WHEN b THEN 'range_end' ELSE 'range_end_with_unconfirmed_transition' END AS reason
FROM t WHERE shown OR b
""")
def open_tail(spark, d):
    """What the tracker closes at the end of the range: events as samples of one mask, errors as its absence."""
    end = 1e10
    at = micros("ts") / 1e6
    samples = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("video_id"), F.lit("line-1").alias("line_id"), at.alias("ts"), at.alias("pts"), F.col("event_id").cast("int").alias("source_index"),
        F.lit(0).alias("line_index"), F.unhex(F.lit("F" * 16)).alias("mask"), F.lit(8).alias("mask_w"), F.lit(8).alias("mask_h"), (F.col("event_type") != "error").alias("present"),
        F.lit(0.5).alias("presence"), F.lit(1.0).alias("sharpness"), F.lit(2).alias("components"), F.lit(64).alias("text_pixels"),
    )
    tail = tracking.track_intervals(samples, tracking.TrackerConfig(minimum_duration=0.0), range_end=end).filter(F.col("end_seconds") == end)
    kind = table(spark, d, "events").schema["user_id"].dataType
    return tail.select(
        F.col("video_id").cast(kind).alias("user_id"), "kind", F.round(F.col("start_seconds") * 1e6).cast("long").alias("start_us"), F.coalesce("end_reason", "dropped_reason").alias("reason")
    )


@query("top3_per_group", """
SELECT user_id, event_id, value, rn::INTEGER AS rank FROM (SELECT user_id, event_id, value,
  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS rn FROM events) WHERE rn <= 3
""")
def top3_per_group(spark, d):
    rows = table(spark, d, "events", "user_id", "event_id", "value", "ts")
    return tl.top_per_group(rows, ["user_id"], "value", ["ts", "event_id"]).drop("ts")


@query("rep_score", """
SELECT event_id, round(0.4 * (1 - exp(-greatest(0.0, value * 10) / 500)) + 0.35 * (value / 200) + 0.25 * 0.5, 9) AS score FROM events
""")
def rep_score(spark, d):
    score = tl.representative_score(F.col("value") * 10, F.col("value") / 200, F.lit(0.5))
    return table(spark, d, "events").select("event_id", F.round(score, 9).alias("score"))


@query("assign_ids", RUNS + """
SELECT user_id, start_us, printf('subtitle-%05d', row_number() OVER (PARTITION BY user_id ORDER BY start_us, end_us)) AS id FROM runs
""")
def assign_ids(spark, d):
    rows = captions(spark, d).withColumn("line_index", F.lit(0))
    return tl.assign_ids(rows, ["user_id"]).select("user_id", whole_micros("start_seconds").alias("start_us"), "id")


@query("adjacent_stability", """
WITH l AS (SELECT user_id, event_type AS t, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, count(p)::BIGINT AS adjacent_pairs, count(*) FILTER (p <> t)::BIGINT AS changed_pairs,
  round(count(*) FILTER (p <> t) / nullif(count(p), 0)::DOUBLE, 9) AS change_rate,
  round(avg(CASE WHEN p IS NOT NULL THEN levenshtein(p, t) / greatest(length(p), length(t), 1)::DOUBLE END), 9) AS mean_distance FROM l GROUP BY user_id
""")
def adjacent_stability(spark, d):
    rows = table(spark, d, "events", "user_id", "ts", "event_id", "event_type")
    out = tl.adjacent_change(rows, "user_id", ["ts", "event_id"], "event_type")
    return out.select("user_id", "adjacent_pairs", "changed_pairs", F.round("change_rate", 9).alias("change_rate"), F.round("mean_normalized_edit_distance", 9).alias("mean_distance"))


@query("stability_summary", r"""
WITH a AS (SELECT conv_id, turn, {TEXT} AS t FROM conversations),
l AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM a),
g AS (SELECT conv_id, avg(CASE WHEN p <> t THEN 1.0 WHEN p = t THEN 0.0 END) AS r,
  avg(CASE WHEN p IS NOT NULL THEN levenshtein(p, t) / greatest(length(p), length(t), 1)::DOUBLE END) AS m FROM l GROUP BY conv_id HAVING count(p) > 0)
SELECT count(*)::BIGINT AS groups, round(avg(r), 9) AS change_rate, round(avg(m), 9) AS mean_distance FROM g
""")
def stability_summary(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("t"))
    out = tl.stability_summary(tl.adjacent_change(rows, "conv_id", ["turn"], "t"))
    return out.select("groups", F.round("group_mean_change_rate", 9).alias("change_rate"), F.round("group_mean_normalized_edit_distance", 9).alias("mean_distance"))


@query("first_accepted", """
WITH r AS (SELECT l_orderkey, l_returnflag || l_linestatus AS t, l_quantity / 50 AS c,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rk FROM lineitem),
t AS (SELECT * FROM r WHERE rk <= 3),
a AS (SELECT l_orderkey, min(rk) FILTER (c >= 0.6) AS hit, count(*) AS n, arg_max(rk, (c, -rk)) AS fb FROM t GROUP BY l_orderkey)
SELECT a.l_orderkey, CASE WHEN hit IS NULL THEN 'error' ELSE 'completed' END AS status, t.t AS raw_text, round(t.c, 6) AS confidence,
  coalesce(hit, n)::BIGINT AS call_count FROM a JOIN t ON t.l_orderkey = a.l_orderkey AND t.rk = coalesce(hit, fb)
""")
def first_accepted(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    lines = lines.withColumn("score", -F.col("l_linenumber"))
    tries = tl.top_per_group(lines, ["l_orderkey"], "score", ["l_partkey", "l_suppkey", "l_extendedprice"]).select(
        "l_orderkey", F.col("rank").alias("attempt"), F.concat("l_returnflag", "l_linestatus").alias("raw_text"), (F.col("l_quantity") / 50).alias("confidence")
    )
    return tl.first_accepted(tries, ["l_orderkey"]).withColumn("confidence", F.round("confidence", 6))


@query("attempt_log", """
WITH r AS (SELECT l_orderkey, l_quantity::INTEGER AS q, l_quantity / 50 AS c, l_returnflag || l_linestatus AS t,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rk FROM lineitem),
k AS (SELECT l_orderkey, rk, CASE WHEN q % 5 = 0 OR q % 7 = 0 THEN '' ELSE t END AS t, CASE WHEN q % 5 > 0 THEN c END AS c, CASE WHEN q % 5 = 0 THEN 'engine' END AS error,
  q % 5 > 0 AND q % 7 > 0 AND c >= 0.6 AS ok FROM r WHERE rk <= 3),
a AS (SELECT l_orderkey, min(rk) FILTER (ok) AS hit FROM k GROUP BY l_orderkey)
SELECT k.l_orderkey, CASE WHEN hit IS NULL THEN 'error' ELSE 'completed' END AS status, rk::INTEGER AS attempt, t AS raw_text, round(c, 6) AS confidence, ok AS accepted,
  CASE WHEN error IS NOT NULL THEN 'ocr_exception' WHEN t = '' THEN 'empty_ocr' WHEN NOT ok THEN 'low_information_ocr' END AS rejection_reason, error
FROM k JOIN a ON a.l_orderkey = k.l_orderkey WHERE hit IS NULL OR rk <= hit
""")
def attempt_log(spark, d):
    """Order lines as tries: some fail, some read nothing, some are unsure."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    lines = lines.withColumn("score", -F.col("l_linenumber"))
    count = F.col("l_quantity").cast("int")
    tries = tl.top_per_group(lines, ["l_orderkey"], "score", ["l_partkey", "l_suppkey", "l_extendedprice"]).select(
        "l_orderkey", F.col("rank").alias("attempt"), F.when(count % 7 == 0, "  ").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("raw_text"),
        (F.col("l_quantity") / 50).alias("confidence"), F.when(count % 5 == 0, "engine").alias("failure"),
    )
    rows = tl.attempt_ledger(tries, ["l_orderkey"], error="failure").select("l_orderkey", "status", F.inline("attempts"))
    return rows.withColumn("confidence", F.round("confidence", 6))


@query("ordered_concat", """
SELECT conv_id, turn // 2 AS pair, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY ALL
""")
def ordered_concat(spark, d):
    rows = table(spark, d, "conversations").withColumn("pair", F.floor(F.col("turn") / 2))
    return tl.order_in_group(rows, ["conv_id", "pair"], "turn", "text").select("conv_id", "pair", F.md5("joined").alias("digest"))


@query("seeded_rank", """
SELECT doc_id, row_number() OVER (ORDER BY sha256('93271:' || doc_id), doc_id) AS rank FROM documents
""")
def seeded_rank(spark, d):
    return reviews.seeded_order(table(spark, d, "documents", "doc_id"), "93271", "doc_id")


# --- overlap and points --------------------------------------------------------------------


def shown(spark, d) -> DataFrame:
    """Events as captions: the user is the video, the event type the line."""
    start = micros("ts") / 1e6
    return table(spark, d, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_type").alias("line_id"), F.col("event_id").alias("ordinal"), F.col("event_id").alias("id"),
        start.alias("start_seconds"), (start + F.col("value") * 60).alias("end_seconds"),
        F.length("event_type").alias("line_index"),
    )


SHOWN = """
WITH c AS (SELECT user_id, event_type, event_id, epoch_us(ts) / 1e6::DOUBLE AS s, epoch_us(ts) / 1e6::DOUBLE + value * 60 AS e FROM events)
"""


@query("simultaneous_pairs", SHOWN + """
SELECT a.user_id AS video_id, a.event_id AS first_id, b.event_id AS second_id, round(least(a.e, b.e) - greatest(a.s, b.s), 4) AS shared
FROM c a JOIN c b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type <> b.event_type
WHERE least(a.e, b.e) > greatest(a.s, b.s) + 1e-9
""")
def simultaneous_pairs(spark, d):
    pairs = ranges.simultaneous(shown(spark, d))
    return pairs.select("video_id", "first_id", "second_id", F.round(F.col("end_seconds") - F.col("start_seconds"), 4).alias("shared"))


@query("active_at", SHOWN + """
, p AS (SELECT user_id, event_id AS point_id, epoch_us(ts) / 1e6::DOUBLE + 600 AS t FROM events WHERE event_type = 'click'),
h AS (SELECT point_id, event_id, row_number() OVER (PARTITION BY point_id ORDER BY length(event_type), s, event_id) AS rn
      FROM p JOIN c ON p.user_id = c.user_id AND c.s <= p.t AND p.t < c.e)
SELECT p.point_id, f.event_id AS id FROM p LEFT JOIN (SELECT * FROM h WHERE rn = 1) f ON f.point_id = p.point_id
""")
def active_at(spark, d):
    points = table(spark, d, "events").filter("event_type = 'click'").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("point_id"), (micros("ts") / 1e6 + 600).alias("t")
    )
    return ranges.active_at(points, shown(spark, d), ["video_id"], "point_id").select("point_id", "id")


@query("interval_iou", SHOWN + """
, l AS (SELECT *, lag(s) OVER w AS ps, lag(e) OVER w AS pe FROM c WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
o AS (SELECT *, greatest(0.0, least(e, pe) - greatest(s, ps)) AS shared FROM l WHERE ps IS NOT NULL)
SELECT event_id, round(CASE WHEN (e - s) + (pe - ps) - shared > 0 THEN shared / ((e - s) + (pe - ps) - shared) ELSE 0.0 END, 6) AS iou FROM o
""")
def interval_iou(spark, d):
    seq = sequence_of(shown(spark, d), ["video_id"], ["start_seconds", "id"])
    rows = seq.previous(ps=F.col("start_seconds"), pe=F.col("end_seconds")).filter("ps is not null").done()
    return rows.select(F.col("id").alias("event_id"), F.round(ranges.iou(F.col("ps"), F.col("pe"), F.col("start_seconds"), F.col("end_seconds")), 6).alias("iou"))


# --- shapes shared with streaming ----------------------------------------------------------


@query("range_filter", """
SELECT event_id, (epoch_us(ts) - 1704067200000000 - 86400000000) // 1000 AS ms FROM events
WHERE epoch_us(ts) - 1704067200000000 >= 86400000000 - 200000 - 1 AND epoch_us(ts) - 1704067200000000 < 172800000000 - 1
""")
def range_filter(spark, d):
    frames = table(spark, d, "events").select("event_id", (micros("ts") / 1e6).alias("pts"))
    out = tl.frame_range_filter(frames, 86400.0, 172800.0, INTERVAL, source_start=1704067200.0)
    return out.select("event_id", F.floor((F.round(F.col("ts") * 1e6) - 86400000000) / 1000).alias("ms"))


#: Events of a quarter day, each user a video.
QUARTER = """
WITH k AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events
  WHERE epoch_us(ts) - 1704067200000000 >= 86400000000 - 200000 - 1 AND epoch_us(ts) - 1704067200000000 < 108000000000 - 1)
"""


def quarter(spark, d):
    frames = table(spark, d, "events").select("user_id", "event_id", (micros("ts") / 1e6).alias("pts"))
    return tl.numbered_frames(frames, ["user_id"], 86400.0, 108000.0, INTERVAL, source_start=1704067200.0, ties=["event_id"])


@query("frame_index", QUARTER + """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS frame_index FROM k
""")
def frame_index(spark, d):
    return quarter(spark, d).select("user_id", "event_id", "frame_index")


@query("range_report", QUARTER + """
SELECT u.user_id, count(k.event_id)::BIGINT AS frames, CASE WHEN count(k.event_id) = 0 THEN 'range.empty' END AS problem
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN k ON k.user_id = u.user_id GROUP BY u.user_id
""")
def range_report(spark, d):
    return tl.range_report(table(spark, d, "events", "user_id"), quarter(spark, d), ["user_id"])


@query("interval_sample", """
SELECT user_id, epoch_us(ts) // 3600000000 AS interval_index, arg_min(event_id, (epoch_us(ts), event_id)) AS event_id FROM events GROUP BY ALL
""")
def interval_sample(spark, d):
    frames = table(spark, d, "events").select("user_id", "event_id", (micros("ts") / 1e6).alias("ts"))
    return tl.fixed_interval_sample(frames, ["user_id"], "ts", 3600.0, ["event_id"]).select("user_id", "interval_index", "event_id")


@query("order_violations", """
WITH l AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT user_id, event_id, round(p, 4) AS previous_ts FROM l WHERE p > value
""")
def order_violations(spark, d):
    rows = table(spark, d, "events", "user_id", "event_id", "value")
    out = tl.order_violations(rows, ["user_id"], ["event_id"], "value")
    return out.select("user_id", "event_id", F.round("previous_ts", 4).alias("previous_ts"))


@query("session_gap", """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w < 21600000000 THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*)::BIGINT AS events FROM i GROUP BY user_id, s
""")
def session_gap(spark, d):
    """Whole microseconds; the built-in session window would put a busy user into one task."""
    rows = table(spark, d, "events").select("user_id", "event_id", micros("ts").alias("us"))
    out = tl.gap_sessions(rows, ["user_id"], ["us", "event_id"], 21_600_000_000)
    return out.select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), F.col("rows").alias("events"))
