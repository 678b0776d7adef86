"""Violation queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary as dic, projects, quality as q, reviews
from .registry import micros, query, table


@query("manifest_violations", r"""
WITH g AS (SELECT source || lang AS gid, min(text) <> max(text) AS mixed FROM documents GROUP BY 1),
dup AS (SELECT md5(text) AS f FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id::VARCHAR AS id, v AS violation FROM documents d JOIN g ON g.gid = d.source || d.lang, LATERAL (SELECT unnest([
  CASE WHEN n_chars < 100 THEN 'image.time' END,
  CASE WHEN md5(text) IN (SELECT f FROM dup) THEN 'image.file_again' END,
  CASE WHEN lang = 'fr' THEN 'image.status' END,
  CASE WHEN length(text) - length(replace(text, chr(10), '')) + 1 <> 3 THEN 'image.lines' END,
  CASE WHEN lang = 'de' THEN 'image.tags' END,
  CASE WHEN mixed THEN 'image.group_truth' END]) AS v) WHERE v IS NOT NULL
""")
def manifest_violations(spark, d):
    images = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.concat("source", "lang").alias("group_id"), (F.col("n_chars") - 100).cast("double").alias("timestamp_seconds"),
        F.md5("text").alias("image_file"), F.col("text").alias("ground_truth"), F.when(F.col("lang") != "fr", "verified").alias("ground_truth_status"),
        F.lit(3).alias("line_count"), F.when(F.col("lang") == "de", F.array("lang", "lang")).otherwise(F.array("lang")).alias("tags"),
    )
    return q.check_manifest(images)


@query("result_mismatch", """
WITH m AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders),
r AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN o_orderkey + 1 ELSE o_orderkey END AS id, CASE WHEN o_totalprice > 50000 THEN o_orderkey ELSE -1 - o_orderkey END AS k,
      o_custkey AS c, CASE WHEN o_orderpriority = '1-URGENT' THEN 'F' ELSE o_orderstatus END AS s FROM orders)
SELECT coalesce(m.k, r.k) AS ordinal, 'result.order' AS violation FROM m FULL JOIN r ON r.k = m.k WHERE r.id IS DISTINCT FROM m.k
UNION ALL SELECT m.k, 'result.s' FROM m JOIN r ON r.k = m.k AND r.id = m.k WHERE r.s <> m.s
""")
def result_mismatch(spark, d):
    orders = table(spark, d, "orders")
    manifest = orders.select(F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"))
    results = orders.select(
        F.when(F.col("o_totalprice") > 50000, F.col("o_orderkey")).otherwise(-1 - F.col("o_orderkey")).alias("ordinal"), F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey")).alias("image_id"),
        F.col("o_custkey").alias("c"), F.when(F.col("o_orderpriority") == "1-URGENT", "F").otherwise(F.col("o_orderstatus")).alias("s"),
    )
    return q.check_results(results, manifest, ["c", "s"])


@query("overlap_violations", """
WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6::DOUBLE AS s, epoch_us(ts) / 1e6::DOUBLE + (value - 2) * 600 AS e FROM events),
l AS (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY event_id) AS pe FROM e)
SELECT user_id, event_id::VARCHAR AS id, 'caption.order' AS violation FROM l WHERE s < coalesce(pe, -1) OR e < s
""")
def overlap_violations(spark, d):
    start = micros("ts") / 1e6
    captions = table(spark, d, "events").select(
        "user_id", F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("ordinal"), F.lit("line-1").alias("line_id"), F.lit(0).alias("line_index"),
        start.alias("start_seconds"), (start + (F.col("value") - 2) * 600).alias("end_seconds"), F.col("event_type").alias("raw_text"),
    )
    return q.check_project(captions, "user_id")


@query("orphan_refs", """
SELECT o_orderkey, ref FROM (SELECT o_orderkey, unnest([o_custkey * 2, o_custkey + 700]) AS ref FROM orders) WHERE ref NOT IN (SELECT c_custkey FROM customer)
""")
def orphan_refs(spark, d):
    refs = F.array(F.col("o_custkey") * 2, F.col("o_custkey") + 700)
    return q.orphans(table(spark, d, "orders"), "o_orderkey", refs, table(spark, d, "customer"), "c_custkey").select("o_orderkey", "ref")


@query("domain_violations", """
WITH r AS (SELECT o_orderkey AS blind_id, CASE o_orderstatus WHEN 'F' THEN 'human_confirmed' WHEN 'O' THEN 'ai_provisional' ELSE 'new' END AS st,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'none' END AS sev, o_custkey % 3 = 0 AS silent, o_custkey % 5 = 0 AS unproven, o_custkey % 7 = 0 AS odd FROM orders)
SELECT blind_id, 'review.status' AS violation FROM r WHERE st = 'new' UNION ALL SELECT blind_id, 'review.severity' FROM r WHERE sev = 'low'
UNION ALL SELECT blind_id, 'review.reason' FROM r WHERE silent
UNION ALL SELECT blind_id, 'review.evidence' FROM r WHERE st = 'human_confirmed' AND unproven
UNION ALL SELECT blind_id, 'review.error_types' FROM r WHERE odd
""")
def domain_violations(spark, d):
    c = F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "human_confirmed").when(F.col("o_orderstatus") == "O", "ai_provisional").otherwise("new")
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("blind_id"), status.alias("review_status"), F.when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("none").alias("severity"),
        F.when(c % 3 > 0, "why").otherwise("").alias("rationale"), F.lit("someone").alias("reviewer"),
        F.when(c % 5 > 0, F.array(F.lit("seen"))).otherwise(F.array().cast("array<string>")).alias("evidence"),
        F.when(c % 7 > 0, F.array(F.lit("number"))).otherwise(F.array(F.lit("odd"))).alias("error_types"),
    )
    return reviews.review_violations(rows)


@query("range_violations", """
WITH r AS (SELECT p_partkey AS request_id, p_size AS sz, p_partkey AS k, p_retailprice AS price FROM part),
s AS (SELECT *, CASE WHEN k % 13 = 0 THEN 3 WHEN k % 2 = 0 THEN 1 ELSE 2 END AS version, sz * 110 AS interval_ms, CASE WHEN k % 4 > 0 THEN sz / 50.0::DOUBLE END AS split,
  CASE WHEN k % 3 > 0 THEN (price * 40)::INTEGER END AS min_ms, k % 5 AS m FROM r)
SELECT request_id, 'request.version' AS violation FROM s WHERE version = 3
UNION ALL SELECT request_id, 'request.region' FROM s WHERE 0.3 + sz / 60.0::DOUBLE > 1 + 1e-9
UNION ALL SELECT request_id, 'request.mode' FROM s WHERE m = 4
UNION ALL SELECT request_id, 'request.bounds' FROM s WHERE m < 2 AND (sz - 5 < 0 OR 30 <= sz - 5)
UNION ALL SELECT request_id, 'request.bounds_unused' FROM s WHERE m IN (2, 3)
UNION ALL SELECT request_id, 'request.interval' FROM s WHERE interval_ms < 50 OR interval_ms > 5000
UNION ALL SELECT request_id, 'request.split' FROM s WHERE split < 0.1 OR split > 0.9
UNION ALL SELECT request_id, 'request.duration' FROM s WHERE CASE WHEN version = 1 THEN coalesce(min_ms, 1200) ELSE min_ms END IS NULL OR min_ms > 60000
""")
def range_violations(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    mode = F.when(k % 5 < 2, "range").when(k % 5 < 4, "whole").otherwise("other")
    requests = table(spark, d, "part").select(
        k.alias("request_id"), F.when(k % 13 == 0, 3).when(k % 2 == 0, 1).otherwise(2).alias("schema_version"), F.lit("/v/a.mp4").alias("video_path"),
        F.struct(F.lit(0.3).alias("x"), F.lit(0.1).alias("y"), (size / 60.0).alias("width"), F.lit(0.2).alias("height")).alias("subtitle_region"),
        F.struct(mode.alias("mode"), (size - 5).cast("double").alias("start_seconds"), F.lit(30.0).alias("end_seconds")).alias("analysis_range"),
        F.struct(
            (size * 110).alias("sample_interval_ms"), F.when(k % 4 > 0, size / 50.0).alias("line_split_ratio"),
            F.when(k % 3 > 0, F.round(F.col("p_retailprice") * 40).cast("int")).alias("minimum_display_duration_ms"),
        ).alias("settings"),
    )
    return q.check_request(requests)


@query("json_props", """
WITH e AS (SELECT event_id, (props->>'k')::BIGINT AS k FROM events)
SELECT event_id, k, CASE WHEN k % 10 = 0 THEN 'answer.candidates' WHEN k % 10 = 1 THEN 'answer.silent' END AS problem FROM e
""")
def json_props(spark, d):
    """Event props turned into judge answers: the key is the candidate, some answers are faulty."""
    k = F.get_json_object("props", "$.k")
    digit = k.cast("long") % 10
    answer = F.struct(F.array(F.struct(
        F.when(digit == 0, "other").otherwise(k).alias("candidate_id"), F.lit("none").alias("severity"), F.array().cast("array<string>").alias("error_types"),
        F.when(digit == 1, "").otherwise("why").alias("rationale"), F.lit("s").alias("semantic_signature"),
    )).alias("judgements"))
    rows = table(spark, d, "events").select("event_id", F.to_json(answer).alias("response"), F.array(k).alias("expected"), k.cast("long").alias("k"))
    return q.parse_judgement(rows, "response", "expected").select("event_id", "k", "problem")


@query("migrate_defaults", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 2 END AS schema_version,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 700 ELSE 1200 END AS minimum_ms,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'legacy' END AS detection, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 1::BIGINT END AS detection_count,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS ocr_call_count, o_orderpriority AS raw_text FROM orders
""")
def migrate_defaults(spark, d):
    from .. import schemas

    none = lambda kind: F.lit(None).cast(kind)
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 700)
    old = F.col("o_orderstatus") != "P"
    caption_type = schemas.CAPTION
    ocr = F.struct(
        F.lit("completed").alias("status"), F.col("o_orderpriority").alias("raw_text"), none("array<string>").alias("raw_lines"), F.lit(0.5).alias("confidence"),
        none("string").alias("error"), none(f"array<{schemas.ATTEMPT}>").alias("attempts"), none(f"array<{schemas.VARIANT}>").alias("variants"),
    )
    caption = F.struct(
        F.lit("subtitle-00001").alias("id"), none("string").alias("line_id"), none("int").alias("line_index"), F.lit(0.0).alias("start_seconds"), F.lit(1.0).alias("end_seconds"),
        none(schemas.DETECTION).alias("detection"), ocr.alias("ocr"), none("string").alias("corrected_ko"), none(schemas.TRANSLATION).alias("translation"),
    ).cast(caption_type)
    processing = F.from_json(F.to_json(F.struct(F.col("o_custkey").alias("sample_count"))), schemas.PROCESSING)
    made = table(spark, d, "orders").select(
        "o_orderkey", F.when(old, 1).otherwise(2).alias("schema_version"),
        F.struct(F.when(old, urgent).alias("minimum_display_duration_ms")).alias("analysis"),
        none("struct<detection:struct<version:string,boundary_source:string,migrated_from_schema_version:int>>").alias("configuration"),
        F.array(caption).alias("subtitles"), processing.alias("processing"),
    )
    out = projects.migrate_v1(made)
    first = F.col("subtitles")[0]
    return out.select(
        "o_orderkey", "schema_version", F.col("analysis.minimum_display_duration_ms").alias("minimum_ms"), first["detection"]["status"].alias("detection"),
        F.col("processing.detection_count").alias("detection_count"), F.col("processing.ocr_call_count").alias("ocr_call_count"), first["ocr"]["raw_text"].alias("raw_text"),
    )


@query("set_digest", """
WITH h AS (SELECT p_brand, sha256(p_name || p_size) AS h FROM part),
s AS (SELECT p_brand, count(*) AS n, sum(('0x' || substr(h, 1, 15))::HUGEINT) AS a, sum(('0x' || substr(h, 16, 15))::HUGEINT) AS b,
  sum(('0x' || substr(h, 31, 15))::HUGEINT) AS c, sum(('0x' || substr(h, 46, 15))::HUGEINT) AS d FROM h GROUP BY p_brand)
SELECT p_brand, n::BIGINT AS rows, sha256(n || ':' || a || ':' || b || ':' || c || ':' || d) AS digest FROM s
""")
def set_digest(spark, d):
    return dic.set_digest(table(spark, d, "part"), ["p_brand"], F.concat("p_name", "p_size"))


@query("content_drift", """
SELECT p_partkey FROM part WHERE p_size > 40 AND (p_size > 48 OR p_brand = 'Brand#1')
""")
def content_drift(spark, d):
    parts = table(spark, d, "part", "p_partkey", "p_name", "p_size", "p_brand")
    baseline = parts.filter("p_size > 40").select("p_partkey", "p_name", "p_size")
    changed = F.when(F.col("p_brand") == "Brand#1", F.upper("p_name")).otherwise(F.col("p_name"))
    current = parts.filter("p_size <= 48").select("p_partkey", changed.alias("p_name"), "p_size")
    return dic.content_drift(baseline, current, "p_partkey").select("p_partkey")


@query("file_counts", """
SELECT p_brand AS file_name, count(*) FILTER (p_size < 10)::BIGINT AS expected_concept_count, count(*) FILTER (p_size >= 10)::BIGINT AS expected_count,
  CASE WHEN p_brand = 'Brand#1' THEN 'role? other' END AS problem FROM part GROUP BY p_brand
""")
def file_counts(spark, d):
    files = table(spark, d, "part").select(
        F.when(F.col("p_brand") == "Brand#1", "other").otherwise("terms").alias("role"), F.col("p_brand").alias("file_name"), F.md5("p_brand").alias("sha256"),
        F.when(F.col("p_size") < 10, "concept").otherwise("alias").alias("kind"), F.col("p_partkey").alias("item_id"),
    )
    return dic.refresh_manifest(files).select("file_name", "expected_concept_count", "expected_count", "problem")
