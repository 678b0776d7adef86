"""Scans, sources and sinks over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import readers, writers
from ..operators import reviews
from .registry import query, table


@query("scan_events_parquet", "SELECT event_id, user_id, event_type, value FROM events")
def scan_events_parquet(spark, d):
    return table(spark, d, "events", "event_id", "user_id", "event_type", "value")


@query("explode_subtitles", """
SELECT conv_id, turn, line AS text, CASE WHEN role = 'user' THEN 'line-1' ELSE role END AS line_id
FROM (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line FROM conversations)
""")
def explode_subtitles(spark, d):
    line_id = F.when(F.col("role") == "user", F.lit("")).otherwise(F.col("role"))
    nested = table(spark, d, "conversations").select(
        "conv_id", "turn",
        F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("text"), line_id.alias("line_id"))).alias("subtitles"),
    )
    return readers.explode_subtitles(nested, ["conv_id", "turn"], "line-1").select("conv_id", "turn", "text", "line_id")


@query("filtered_scan", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'
""")
def filtered_scan(spark, d):
    rows = table(spark, d, "lineitem")
    return readers.keep_equal(rows, l_returnflag="A", l_linestatus="F").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS copies FROM lineitem
WHERE l_returnflag = 'A' AND l_linestatus = 'F' GROUP BY ALL HAVING count(*) > 1
""")
def duplicate_keys(spark, d):
    rows = readers.keep_equal(table(spark, d, "lineitem"), l_returnflag="A", l_linestatus="F")
    return readers.duplicates(rows, ["l_orderkey", "l_linenumber"])


@query("union_by_name_missing", """
SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment, NULL::INTEGER AS nation FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL, s_nationkey FROM supplier
""")
def union_by_name_missing(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nation"))
    return readers.union_roles([customers, suppliers])


@query("nested_double_explode", """
SELECT p_partkey, slot::INTEGER AS slot, word, rune FROM (
  SELECT p_partkey, slot, word, unnest(string_split(word, '')) AS rune FROM (
    SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word,
           generate_subscripts(string_split(p_name, ' '), 1) - 1 AS slot FROM part))
WHERE rune <> ''
""")
def nested_double_explode(spark, d):
    words = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("word"), F.split(w, "").alias("runes")))
    nested = table(spark, d, "part").select("p_partkey", words.alias("slots"))
    return (
        readers.explode_nested(nested, ["p_partkey"], "slots", "runes", "slot", "rune")
        .select("p_partkey", "slot", F.col("outer.word").alias("word"), "rune").filter("rune <> ''")
    )


@query("missing_parts", """
SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 2)
""")
def missing_parts(spark, d):
    listed = table(spark, d, "part", "p_partkey", "p_name")
    present = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_linenumber > 2").select(F.col("l_partkey").alias("p_partkey"))
    return readers.missing(listed, present, ["p_partkey"])


@query("concat_tags", """
SELECT user_id, string_agg(event_type, '|' ORDER BY event_type) AS tags
FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id
""")
def concat_tags(spark, d):
    # Distinct first, so that a busy user sends each tag once per task.
    tags = table(spark, d, "events", "user_id", "event_type").distinct()
    grouped = tags.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("tags"))
    return grouped.select("user_id", writers.join_tags("tags").alias("tags"))


@query("pending_orders", """
SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT EXISTS (
  SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'F')
""")
def pending_orders(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_sha"), "o_orderstatus")
    results = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job_sha"), F.when(F.col("l_linestatus") == "F", "ok").otherwise("error").alias("status"), F.lit(True).alias("intact")
    )
    return reviews.pending_jobs(jobs, results, ["job_sha"]).withColumnRenamed("job_sha", "o_orderkey")


@query("pending_intact", """
SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT EXISTS (
  SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'F' AND l.l_returnflag = 'R')
""")
def pending_intact(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_sha"), "o_orderstatus")
    results = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job_sha"), F.when(F.col("l_linestatus") == "F", "ok").otherwise("error").alias("status"),
        (F.col("l_returnflag") == "R").alias("intact"),
    )
    return reviews.pending_jobs(jobs, results, ["job_sha"]).withColumnRenamed("job_sha", "o_orderkey")


@query("expand_lines", r"""
WITH c AS (SELECT c_custkey, c_acctbal, c_name AS speech, CASE WHEN c_nationkey < 10 THEN c_mktsegment END AS note FROM customer),
r AS (SELECT *, unnest(CASE WHEN note IS NULL THEN ['speech'] ELSE ['annotation', 'speech', 'whole'] END) AS role FROM c)
SELECT c_custkey || '_' || role || '_f0' || (step + 2) AS id, round(c_acctbal + 0.5 + step / 30.0::DOUBLE, 6) AS ts, step = 0 AS "primary",
  CASE role WHEN 'annotation' THEN 1 WHEN 'speech' THEN CASE WHEN note IS NULL THEN 1 ELSE 2 END END AS reading_order,
  CASE role WHEN 'annotation' THEN note WHEN 'speech' THEN speech ELSE note || chr(10) || speech END AS source_ko, role = 'whole' AS diagnostic_only
FROM r, (VALUES (-1), (0), (1)) v(step)
""")
def expand_lines(spark, d):
    samples = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("time"), F.lit(30.0).alias("fps"), F.lit(0.5).alias("correction"),
        F.col("c_name").alias("speech"), F.when(F.col("c_nationkey") < 10, F.col("c_mktsegment")).alias("annotation"),
    )
    out = readers.expand_lines(samples)
    return out.select("id", F.round("timestamp_seconds", 6).alias("ts"), "primary", "reading_order", "source_ko", "diagnostic_only")


@query("saved_projects", """
WITH t AS (SELECT conv_id, turn, role, unnest(string_split(text, '. ')) AS raw_text, generate_subscripts(string_split(text, '. '), 1) AS place FROM conversations)
SELECT conv_id || ':' || turn AS video_id, place::VARCHAR AS id, CASE WHEN role = 'user' THEN 'line-1' ELSE role END AS line_id,
  place / 4.0::DOUBLE AS start_seconds, raw_text FROM t
""")
def saved_projects(spark, d):
    """Turns saved as documents of captions, one per line, read again and laid out by caption."""
    line_id = F.when(F.col("role") == "user", F.lit("")).otherwise(F.col("role"))
    caption = lambda piece, i: F.struct(
        (i + 1).cast("string").alias("id"), line_id.alias("line_id"), ((i + 1) / 4).alias("start_seconds"), F.struct(piece.alias("raw_text")).alias("ocr"),
    )
    documents = table(spark, d, "conversations").select(
        F.lit(2).alias("schema_version"), F.struct(F.concat_ws(":", "conv_id", "turn").alias("id")).alias("video"),
        F.transform(F.split("text", r"\. "), caption).alias("subtitles"),
    )
    path = f"{shared_folder(spark)}/projects-{uuid.uuid4().hex}"
    writers.sink_json(documents, path)
    read = readers.scan_projects(spark, path, lines=True).select(F.col("video.id").alias("video_id"), "subtitles")
    return readers.explode_subtitles(read, ["video_id"], "line-1").select("video_id", "id", "line_id", "start_seconds", F.col("ocr.raw_text").alias("raw_text"))


@query("saved_results", """
WITH r AS (SELECT item_id, text, length(text) % 5 <> 0 AS has_job, length(text) % 7 <> 0 AS fits, left(text, 2) AS sample FROM benchmark),
c AS (SELECT sample, count(*) AS copies FROM r WHERE has_job GROUP BY sample)
SELECT md5(text) AS digest, CASE WHEN has_job THEN 'result' ELSE 'skipped' END AS route, fits AS intact, CASE WHEN has_job THEN copies END::BIGINT AS result_copies
FROM r LEFT JOIN c USING (sample)
""")
def saved_results(spark, d):
    """Benchmark items saved as run results, one file each, read again with their route, integrity and copies."""
    items = table(spark, d, "benchmark", "item_id", "text")
    job = F.struct(F.lit("all").alias("condition"), F.lit(True).alias("primary"), F.left("text", F.lit(2)).alias("sample_id"))
    answer = F.struct(F.lit(True).alias("done"), F.struct(F.col("text").alias("content")).alias("message"))
    # Fields by name at every level, as the canonical form of the checksum wants them.
    body = [F.struct(F.lit("m").alias("model")).alias("identity"), F.when(F.length("text") % 5 != 0, job).alias("job"), answer.alias("response"), F.lit("ok").alias("status")]
    checksum = F.sha2(F.to_json(F.struct(*body)), 256)
    files = items.select(*body, F.when(F.length("text") % 7 != 0, checksum).otherwise(F.reverse(checksum)).alias("checksum"))
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    files.write.option("maxRecordsPerFile", 1).json(path)
    out = readers.scan_results(spark, path)
    return out.select(F.md5("response.message.content").alias("digest"), "route", "intact", "result_copies")
