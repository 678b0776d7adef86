"""User functions over the driver tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import scoring as sc
from .matching import benchmark_terms
from .registry import query, table


@query("retry_outcome", """
WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a,
  CASE event_type WHEN 'click' THEN 'ok' WHEN 'error' THEN 'stop' ELSE 'retry' END AS o FROM events),
t AS (SELECT user_id, min(a) FILTER (o <> 'retry') AS e, arg_min(o, a) FILTER (o <> 'retry') AS how, max(a) AS last FROM l WHERE a <= 2 GROUP BY user_id)
SELECT user_id, CASE WHEN how = 'ok' THEN 'ok' ELSE 'error' END AS status, coalesce(e, last)::BIGINT AS calls,
  (coalesce(e, last) - CASE WHEN how = 'ok' THEN 1 ELSE 0 END)::BIGINT AS failures FROM t
""")
def retry_outcome(spark, d):
    """The first two events of a user as attempts; only two rows per user reach the shuffle."""
    from ..operators.timeline import top_per_group

    rows = table(spark, d, "events", "user_id", "event_id", "ts", "event_type").withColumn("score", -F.unix_micros(F.col("ts").cast("timestamp")))
    first = top_per_group(rows, ["user_id"], "score", ["event_id"], 2)
    outcome = F.when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "error", "stop").otherwise("retry")
    return sc.retry_outcomes(first.select("user_id", F.col("rank").alias("attempt"), outcome.alias("outcome")), ["user_id"])


def _reverser():
    def recognise(row: dict):
        if row["turn"] % 5 == 4:
            raise ValueError("unreadable")
        return row["text"][::-1], 0.5

    return recognise


@query("recognize_batch", """
SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 THEN md5(reverse(text)) END AS digest, CASE WHEN turn % 5 = 4 THEN 'ValueError: unreadable' END AS error FROM conversations
""")
def recognize_batch(spark, d):
    out = sc.recognize_batch(table(spark, d, "conversations", "conv_id", "turn", "text"), _reverser, keep=["conv_id", "turn"])
    return out.select("conv_id", "turn", F.md5("raw_output").alias("digest"), "error")


def _model():
    def call(payload: str) -> dict:
        size = len(payload)
        if size % 7 == 0:
            raise ValueError("broken")
        content = "" if size % 5 == 0 else f"{size} characters"
        return {"done": True, "done_reason": "length" if size % 10 == 0 else "stop", "eval_count": size, "message": {"content": content}}

    return call


@query("infer_with_retry", """
WITH p AS (SELECT conv_id, turn, length(text) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n % 7 = 0 OR n % 5 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN n % 7 = 0 THEN NULL WHEN n % 5 = 0 THEN '' ELSE n || ' characters' END AS content,
  CASE WHEN n % 7 = 0 THEN 'ValueError,ValueError' WHEN n % 10 = 0 THEN 'OutputLimitWithoutTranslation' WHEN n % 5 = 0 THEN 'ValueError,ValueError' ELSE '' END AS errors FROM p
""")
def infer_with_retry(spark, d):
    jobs = table(spark, d, "conversations", "conv_id", "turn", "text")
    out = sc.infer_with_retry(jobs, _model, "text", attempts=2, sleep=lambda seconds: None)
    kinds = F.array_join(F.transform("result.errors", lambda e: e["type"]), ",")
    return out.select("conv_id", "turn", "result.status", "result.content", kinds.alias("errors"))


def _echo():
    def call(payload: str) -> dict:
        content = json.loads(payload)["messages"][0]["content"]
        return {"done": True, "done_reason": "stop", "eval_count": len(content), "message": {"content": f" {len(content)} "}}

    return call


@query("translate", r"""
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM benchmark),
tok AS (SELECT doc_id, unnest(regexp_split_to_array(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]+')) AS word FROM documents),
n AS (SELECT doc_id, count(DISTINCT term) AS n FROM tok JOIN w ON word = replace(term, 'ß', 'ss') WHERE term <> '' GROUP BY doc_id)
SELECT d.doc_id AS id, CASE WHEN trim(text) = '' THEN 'error' ELSE 'completed' END AS translation_status, trim(text) <> '' AS translated,
  least(CASE WHEN length(text) <= 80 THEN 5 ELSE 8 END, coalesce(n, 0))::INTEGER AS terms, CASE WHEN trim(text) = '' THEN 0 ELSE 1 END AS calls
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
""")
def translate(spark, d):
    """Documents translated by a stand-in model, with the benchmark words found in them as context."""
    words = benchmark_terms(spark, d).filter(~F.col("term").contains(" "))
    entries = words.select(
        F.col("term").alias("id"), F.lit("word").alias("category"), F.col("term").alias("ko"), F.upper("term").alias("ja"),
        F.lit(None).cast("string").alias("champion_id"), F.lit(None).cast("string").alias("slot"), F.lit("official").alias("origin"), F.lit(None).cast("string").alias("meaning"),
    )
    from .. import schemas

    aliases = spark.createDataFrame([], schemas.ALIAS)
    captions = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("source_ko"), F.lit("completed").alias("ocr_status"))
    prompts = {"qwen3": "Translate.", "glossary_instruction": "Use these terms.", "options": {"temperature": 0}, "qwen_think": False}
    out = sc.translate_with(captions, entries, aliases, "qwen3:4b", prompts, _echo)
    return out.select("id", "translation_status", F.col("generated_ja").isNotNull().alias("translated"), F.greatest(F.lit(0), F.size("trace")).alias("terms"), "calls")


@query("compare_conditions", """
WITH t AS (SELECT user_id, string_agg(DISTINCT event_type, ' ' ORDER BY event_type) FILTER (value < 55) AS o, string_agg(DISTINCT event_type, ' ' ORDER BY event_type) FILTER (value >= 55) AS n FROM events GROUP BY user_id),
p AS (SELECT coalesce(contains(o, 'click') AND (contains(o, 'error') OR contains(o, 'view')), false) AS old, coalesce(contains(n, 'click') AND (contains(n, 'error') OR contains(n, 'view')), false) AS new FROM t)
SELECT count(*)::BIGINT AS case_count, count(*) FILTER (new AND NOT old)::BIGINT AS improved, count(*) FILTER (old AND NOT new)::BIGINT AS regressed,
  count(*) FILTER (old AND new)::BIGINT AS unchanged_pass, count(*) FILTER (NOT old AND NOT new)::BIGINT AS unchanged_fail FROM p
""")
def compare_conditions(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_type", "value")
    side = lambda keep: events.groupBy("id").agg(F.array_sort(F.collect_set(F.when(keep, F.col("event_type")))).alias("selected")).withColumn("output", F.concat_ws(" ", "selected"))
    required = F.array(F.array(F.lit("click")), F.array(F.lit("error"), F.lit("view")))
    cases = events.select("id").distinct().withColumn("required_ja", required)
    out = sc.compare_conditions(cases, side(F.col("value") < 55), side(F.col("value") >= 55))
    return sc.comparison_summary(out).select("case_count", "improved", "regressed", "unchanged_pass", "unchanged_fail")


def _reader():
    """Stand-in that answers with all it was asked."""

    def call(payload: str) -> dict:
        return {"done": True, "done_reason": "stop", "eval_count": 1, "message": {"content": json.loads(payload)["messages"][0]["content"]}}

    return call


@query("compare_dictionaries", """
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part),
c AS (SELECT length(words[1]) % 2 = 0 AS old, length(words[1]) % 3 = 0 AS new, length(words[-1]) % 2 = 0 AS old_other, length(words[-1]) % 3 = 0 AS new_other FROM w)
SELECT count(*)::BIGINT AS case_count, count(*) FILTER (new AND NOT old)::BIGINT AS improved, count(*) FILTER (old AND NOT new)::BIGINT AS regressed,
  count(*) FILTER (old AND new)::BIGINT AS unchanged_pass, count(*) FILTER (NOT old AND NOT new)::BIGINT AS unchanged_fail,
  count(*) FILTER (old_other)::BIGINT AS baseline_selection_checks_passed, count(*) FILTER (new_other)::BIGINT AS current_selection_checks_passed,
  count(*) FILTER (old)::BIGINT AS baseline_term_checks_passed, count(*) FILTER (new)::BIGINT AS current_term_checks_passed FROM c
""")
def compare_dictionaries(spark, d):
    """Part names translated with the words of even length and with those whose length three divides."""
    from .. import schemas

    parts = table(spark, d, "part", "p_partkey", "p_name")
    words = F.split("p_name", " ")
    shown = lambda w: F.concat(F.lit("<"), F.upper(w), F.lit(">"))
    last = F.array(F.element_at(words, -1))
    cases = parts.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("source_ko"), F.array(F.array(shown(words[0]))).alias("required_ja"),
        last.alias("expected_baseline_target_ids"), last.alias("expected_target_ids"),
    )
    listed = parts.select(F.explode(words).alias("term")).distinct().select(
        F.col("term").alias("id"), F.lit("word").alias("category"), F.col("term").alias("ko"), shown(F.col("term")).alias("ja"),
        F.lit(None).cast("string").alias("champion_id"), F.lit(None).cast("string").alias("slot"), F.lit("official").alias("origin"), F.lit(None).cast("string").alias("meaning"),
    )
    aliases = spark.createDataFrame([], schemas.ALIAS)
    prompts = {"qwen3": "Translate.", "glossary_instruction": "Use these terms.", "options": {"temperature": 0}, "qwen_think": False}
    even, third = (listed.filter(F.length("id") % n == 0) for n in (2, 3))
    out = sc.compare_dictionaries(cases, (even, aliases), (third, aliases), "qwen3:4b", prompts, _reader)
    return sc.comparison_summary(out)
