"""Aggregations over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary as dic, metrics as me, reviews
from ..operators.quantiles import exact_quantiles
from .registry import query, table


def scored_parts(spark, d):
    """Part names as truth, part types as readings; every tenth size failed to read."""
    output = F.when(F.col("p_size") % 10 > 0, F.lower("p_type"))
    parts = table(spark, d, "part").select(
        "p_partkey", "p_brand", "p_size", "p_retailprice", F.split("p_name", " ").alias("tags"), F.col("p_name").alias("ground_truth"),
        output.alias("raw_output"), F.when(output.isNull(), "failed").alias("error"),
    )
    return me.with_row_metrics(parts)


SCORED = r"""
WITH s AS (SELECT *, p_name AS t, CASE WHEN p_size % 10 > 0 THEN lower(p_type) ELSE '' END AS o, string_split(p_name, ' ') AS tags FROM part),
m AS (SELECT *, levenshtein(t, o) AS e, length(t) AS c, levenshtein(replace(t, ' ', ''), o) AS be, length(replace(t, ' ', '')) AS bc FROM s)
"""
SUMS = """count(*)::BIGINT AS image_count, count(*) FILTER (p_size % 10 = 0)::BIGINT AS failure_count, sum(c)::BIGINT AS reference_characters,
  sum(e)::BIGINT AS edit_distance, count(*) FILTER (t = o)::BIGINT AS exact_matches, round(sum(e) / sum(c)::DOUBLE, 9) AS cer, round(sum(be) / sum(bc)::DOUBLE, 9) AS whitespace_free_cer"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("corpus_cer", SCORED + f"SELECT {SUMS} FROM m")
def corpus_cer(spark, d):
    return _rounded(me.corpus_metrics(scored_parts(spark, d)), "cer", "whitespace_free_cer")


@query("metrics_by_tag", SCORED + f", x AS (SELECT unnest(list_distinct(tags)) AS tag, * FROM m) SELECT tag, {SUMS} FROM x GROUP BY tag")
def metrics_by_tag(spark, d):
    return _rounded(me.metrics_by_tag(scored_parts(spark, d)), "cer", "whitespace_free_cer")


@query("line_summary", SCORED + """
SELECT p_size % 2 = 1 AS "primary", count(DISTINCT p_brand)::BIGINT AS groups, count(*)::BIGINT AS units, round(sum(e) / sum(c)::DOUBLE, 9) AS cer,
  round(sum(be) / sum(bc)::DOUBLE, 9) AS whitespace_free_cer, count(*) FILTER (t = o)::BIGINT AS exact_units,
  count(*) FILTER (be = 0)::BIGINT AS whitespace_free_exact_units, round(quantile_cont(p_retailprice, 0.5), 6) AS median_ocr_ms FROM m GROUP BY 1
""")
def line_summary(spark, d):
    rows = scored_parts(spark, d).withColumnsRenamed({"p_brand": "group_id", "p_retailprice": "ocr_ms"}).withColumn("primary", F.col("p_size") % 2 == 1)
    return _rounded(me.line_ocr_summary(rows), "cer", "whitespace_free_cer").withColumn("median_ocr_ms", F.round("median_ocr_ms", 6))


@query("latency_stats", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY l_returnflag
""")
def latency_stats(spark, d):
    out = me.latency_stats(table(spark, d, "lineitem"), ["l_returnflag"], ["l_extendedprice"])
    return out.select("l_returnflag", F.round("l_extendedprice_median", 4).alias("median"), F.round("l_extendedprice_p95", 4).alias("p95"))


@query("latency_overall", """
SELECT round(quantile_cont(l_extendedprice, 0.5), 4) AS price_median, round(quantile_cont(l_extendedprice, 0.95), 4) AS price_p95,
  round(quantile_cont(l_quantity, 0.5), 4) AS quantity_median, round(quantile_cont(l_quantity, 0.95), 4) AS quantity_p95 FROM lineitem
""")
def latency_overall(spark, d):
    out = me.latency_stats(table(spark, d, "lineitem"), [], ["l_extendedprice", "l_quantity"])
    names = {"price": "l_extendedprice", "quantity": "l_quantity"}
    return out.select(*[F.round(f"{column}_{p}", 4).alias(f"{name}_{p}") for name, column in names.items() for p in ("median", "p95")])


@query("nearest_rank", """
SELECT l_linestatus, quantile_disc(l_quantity, 0.95) AS p95, quantile_disc(l_extendedprice, 0.5) AS p50 FROM lineitem GROUP BY l_linestatus
""")
def nearest_rank(spark, d):
    rows = table(spark, d, "lineitem")
    a = exact_quantiles(rows, ["l_linestatus"], "l_quantity", {"p95": ("nearest", 0.95)})
    return a.join(exact_quantiles(rows, ["l_linestatus"], "l_extendedprice", {"p50": ("nearest", 0.5)}), "l_linestatus")


@query("dataset_summary", """
WITH t AS (SELECT l_orderkey, l_quantity > 25 AS ok, unnest([NULL, l_returnflag, l_linestatus]) AS tag FROM lineitem)
SELECT tag, count(*)::BIGINT AS image_count, count(DISTINCT l_orderkey)::BIGINT AS subtitle_group_count, count(*) FILTER (ok)::BIGINT AS verified_ground_truth_count
FROM t GROUP BY tag
""")
def dataset_summary(spark, d):
    images = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.array("l_returnflag", "l_linestatus").alias("tags"), "l_quantity")
    return me.dataset_summary(images.withColumn("ground_truth_status", F.when(F.col("l_quantity") > 25, "verified")), F.coalesce(F.col("l_quantity") > 25, F.lit(False)))


@query("condition_summary", """
SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS requests, count(DISTINCT l_orderkey)::BIGINT AS subtitle_groups,
  count(*) FILTER (l_discount >= 0.09)::BIGINT AS request_failures, sum(CASE WHEN l_discount < 0.09 THEN l_linenumber ELSE 0 END)::BIGINT AS generated_tokens,
  sum(l_linenumber)::BIGINT AS all_generated_tokens_including_failures, count(*) FILTER (l_quantity = 50)::BIGINT AS truncated_outputs,
  count(*) FILTER (l_tax = 0)::BIGINT AS thinking_outputs,
  round(quantile_cont(CASE WHEN l_discount < 0.09 THEN l_extendedprice END, 0.5), 4) AS wall_ms_median,
  round(quantile_cont(CASE WHEN l_discount < 0.09 THEN l_extendedprice END, 0.95), 4) AS wall_ms_p95,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS all_wall_ms_median FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def condition_summary(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_orderkey").alias("group_id"), F.when(F.col("l_discount") < 0.09, "ok").otherwise("error").alias("status"),
        F.col("l_extendedprice").alias("wall_ms"), F.col("l_linenumber").cast("long").alias("eval_count"),
        F.when(F.col("l_quantity") == 50, "length").otherwise("stop").alias("done_reason"), F.when(F.col("l_tax") == 0, "x").otherwise("").alias("thinking"),
    )
    out = reviews.condition_summary(rows, ["l_returnflag", "l_linestatus"])
    return out.withColumns({n: F.round(n, 4) for n in ("wall_ms_median", "wall_ms_p95", "all_wall_ms_median")})


def judged(spark, d):
    """Documents as results; a label is a review of them."""
    docs = table(spark, d, "documents", "doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "human_confirmed").when(F.col("quality") == 0, "ai_provisional")
    severity = F.when(F.col("toxic") == 1, "major").when(F.col("doc_id") % 5 == 0, "undetermined").when(F.col("toxic") == 0, "none")
    kinds = F.when(F.col("toxic") == 1, F.array(F.lit("omission"), F.lit("number"))).when(F.col("toxic") == 0, F.array().cast("array<string>"))
    return docs.select(
        "doc_id", "lang", F.floor(F.col("doc_id") / 2).alias("group_id"), status.alias("review_status"),
        F.when(status.isNotNull(), severity).alias("severity"), kinds.alias("error_types"),
    )


JUDGED = """
WITH j AS (SELECT d.doc_id, lang, d.doc_id // 2 AS g, CASE quality WHEN 1 THEN 'human_confirmed' WHEN 0 THEN 'ai_provisional' END AS st,
  CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 'major' WHEN d.doc_id % 5 = 0 THEN 'undetermined' ELSE 'none' END AS sev, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
k AS (SELECT *, coalesce(st = 'human_confirmed', false) AS judged, coalesce(st = 'human_confirmed' AND sev <> 'undetermined', false) AS det FROM j)
"""


@query("review_summary", JUDGED + """
SELECT lang, count(*) FILTER (judged)::BIGINT AS reviewed_units, count(*) FILTER (det)::BIGINT AS determined_units,
  count(*) FILTER (judged AND NOT det)::BIGINT AS undetermined_units, count(*) FILTER (det AND sev = 'major')::BIGINT AS major_units,
  count(*) FILTER (judged AND toxic = 1)::BIGINT AS error_omission, count(*) FILTER (judged AND toxic = 1)::BIGINT AS error_number,
  count(*) FILTER (false)::BIGINT AS error_format FROM k GROUP BY lang
""")
def review_summary(spark, d):
    out = reviews.review_summary(judged(spark, d), ["lang"], "human_confirmed")
    return out.select("lang", "reviewed_units", "determined_units", "undetermined_units", "major_units", "error_omission", "error_number", "error_format")


@query("complete_groups", JUDGED + """
, g AS (SELECT lang, g, bool_and(det) AS a, bool_or(det AND sev = 'major') AS m FROM k GROUP BY lang, g)
SELECT lang, count(*) FILTER (a)::BIGINT AS fully_determined_groups, count(*) FILTER (a AND m)::BIGINT AS major_fully_determined_groups,
  count(*) FILTER (m)::BIGINT AS major_groups FROM g GROUP BY lang
""")
def complete_groups(spark, d):
    return reviews.complete_groups(judged(spark, d), ["lang"], "human_confirmed")


@query("unreviewed_units", JUDGED + "SELECT lang, count(*) FILTER (st IS NULL)::BIGINT AS unreviewed_units FROM k GROUP BY lang")
def unreviewed_units(spark, d):
    return reviews.unreviewed_units(judged(spark, d), ["lang"])


@query("paired_conditions", """
WITH o AS (SELECT o_custkey, chr(64 + substr(o_orderpriority, 1, 1)::INTEGER) AS c, ['none', 'minor', 'major', 'terminology', 'undetermined'][(o_orderkey % 5 + 1)::INTEGER] AS sev,
  CASE o_orderstatus WHEN 'F' THEN 'human_confirmed' WHEN 'O' THEN 'ai_provisional' ELSE 'unreviewed' END AS st FROM orders),
u AS (SELECT o_custkey, c, max(sev || '|' || st) AS v FROM o WHERE st <> 'unreviewed' AND sev <> 'undetermined' GROUP BY ALL)
SELECT a.o_custkey, a.c || b.c AS pair, split_part(a.v, '|', 1) AS "left", split_part(b.v, '|', 1) AS "right",
  CASE WHEN ends_with(a.v, 'human_confirmed') AND ends_with(b.v, 'human_confirmed') THEN 'human_confirmed' ELSE 'ai_provisional' END AS review_status
FROM u a JOIN u b ON a.o_custkey = b.o_custkey AND a.c || b.c IN ('AB', 'CD', 'BD')
""")
def paired_conditions(spark, d):
    names = F.array(*[F.lit(s) for s in ("none", "minor", "major", "terminology", "undetermined")])
    status = F.when(F.col("o_orderstatus") == "F", "human_confirmed").when(F.col("o_orderstatus") == "O", "ai_provisional").otherwise("unreviewed")
    rows = table(spark, d, "orders").select(
        "o_custkey", F.chr(F.substring("o_orderpriority", 1, 1).cast("int") + 64).alias("condition"),
        F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("severity"), status.alias("review_status"), F.lit(True).alias("primary"),
    )
    return reviews.paired_judgements(rows, ["o_custkey"])


@query("adjacent_groups", """
WITH r AS (SELECT role, conv_id, 'c_f' || conv_id AS line, CASE WHEN turn % 4 = 3 THEN NULL ELSE (length(text) % 3)::VARCHAR END AS sig FROM conversations)
SELECT role, conv_id, line, count(*)::BIGINT AS frames, count(DISTINCT sig)::BIGINT AS distinct_reviewed_meanings, bool_and(sig IS NOT NULL) AS fully_reviewed,
  count(DISTINCT sig) > 1 AS meaning_changed FROM r GROUP BY ALL HAVING count(*) >= 2
""")
def adjacent_groups(spark, d):
    rows = table(spark, d, "conversations").select(
        "role", "conv_id", F.concat(F.lit("c_f"), "conv_id", F.lit("_f"), "turn").alias("sample_id"),
        F.when(F.col("turn") % 4 == 3, "unreviewed").otherwise("ai_provisional").alias("review_status"), (F.length("text") % 3).cast("string").alias("semantic_signature"),
    )
    return reviews.adjacent_judgements(rows, ["role", "conv_id"])


@query("comparison_counts", """
SELECT CASE WHEN toxic = 0 AND quality = 0 THEN 'improved' WHEN quality = 1 AND toxic = 1 THEN 'regressed' WHEN quality = 1 THEN 'unchanged_pass' ELSE 'unchanged_fail' END AS comparison,
  count(*)::BIGINT AS cases FROM labels GROUP BY 1
""")
def comparison_counts(spark, d):
    rows = table(spark, d, "labels").select((F.col("quality") == 1).alias("old"), (F.col("toxic") == 0).alias("new"))
    return reviews.comparison_counts(rows, "old", "new")


@query("count_check", """
SELECT p_brand AS key, count(*)::BIGINT AS actual_count, count(*) FILTER (p_size <> 7)::BIGINT AS expected_count FROM part GROUP BY p_brand HAVING count(*) <> count(*) FILTER (p_size <> 7)
""")
def count_check(spark, d):
    parts = table(spark, d, "part")
    expected = dic.counts_by(parts.filter("p_size <> 7"), F.col("p_brand")).withColumnRenamed("actual_count", "expected_count")
    return dic.count_differences(dic.counts_by(parts, F.col("p_brand")), expected)


@query("job_counters", """
SELECT user_id, count(*)::BIGINT AS line_observation_count, count(*) FILTER (value < 50)::BIGINT AS sample_count,
  count(*) FILTER (event_type = 'click')::BIGINT AS subtitle_count, coalesce(sum(CASE WHEN event_type = 'click' THEN 1 + event_id % 3 END), 0)::BIGINT AS ocr_call_count,
  count(*) FILTER (event_type = 'click')::BIGINT AS translation_call_count, count(*) FILTER (event_type = 'error')::BIGINT AS error_count,
  count(*) FILTER (event_type = 'click')::BIGINT AS detection_count,
  CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS state FROM events GROUP BY user_id
""")
def job_counters(spark, d):
    events = table(spark, d, "events")
    samples = events.select("user_id", (F.col("value") < 50).alias("first_line"))
    made = events.filter("event_type = 'click'").select("user_id", (1 + F.col("event_id") % 3).alias("ocr_calls"), F.lit(1).alias("translation_calls"))
    return me.job_counters(made, events.filter("event_type = 'error'"), samples, ["user_id"])


@query("distinct_outputs", """
SELECT user_id, event_type AS output, 'candidate-' || substr(sha256('["' || user_id || '","' || event_type || '"]'), 1, 12) AS candidate_id
FROM (SELECT DISTINCT user_id, event_type FROM events)
""")
def distinct_outputs(spark, d):
    return reviews.group_candidates(table(spark, d, "events").withColumnRenamed("event_type", "output"), "user_id", "output")


@query("candidate_violations", """
WITH e AS (SELECT event_id // 3 AS sample, event_type FROM events),
s AS (SELECT sample, count(DISTINCT event_type) AS n FROM e GROUP BY sample),
k AS (SELECT sample FROM e GROUP BY sample HAVING bool_or(event_type = 'view'))
SELECT sample, 'group.sources' AS violation FROM s WHERE n > 1
UNION ALL SELECT sample, 'group.target' FROM s WHERE sample NOT IN (SELECT sample FROM k)
""")
def candidate_violations(spark, d):
    events = table(spark, d, "events").select(F.expr("event_id div 3").alias("sample"), "event_type")
    targets = events.groupBy("sample").agg(F.bool_or(F.col("event_type") == "view").alias("seen")).filter("seen")
    return reviews.candidate_violations(events.withColumnRenamed("event_type", "source_ko"), targets, "sample")


@query("completion_counts", """
WITH l AS (SELECT CASE WHEN quality IS NULL THEN '' WHEN quality = 1 THEN 'ok' ELSE 'wrong' END AS s, toxic, lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT count(*) FILTER (s = 'ok')::BIGINT AS source_checked, count(*) FILTER (s = 'ok' AND toxic = 0 AND lang <> 'en')::BIGINT AS fully_rated, count(*) FILTER (s = '')::BIGINT AS unfinished FROM l
""")
def completion_counts(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    ledger = docs.select(
        F.when(F.col("quality").isNull(), "").when(F.col("quality") == 1, "ok").otherwise("wrong").alias("source_status"),
        F.lit("ok").alias("condition_A"), F.when(F.col("toxic") == 0, "ok").alias("condition_B"),
        F.when(F.col("lang") != "en", "minor").otherwise("").alias("condition_C"), F.lit("unknown").alias("condition_D"),
    )
    return reviews.review_completion(ledger)
