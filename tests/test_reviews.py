"""Jobs, payloads, packets, reviews, scoring functions and comparisons."""

import json
import os
import random
import sys
import uuid
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark import cloudpickle
from pyspark.sql import Row, functions as F

from cueweave import schemas
from cueweave.operators import reviews as rv, scoring as sc
from cueweave.plans import QUERIES
from cueweave.session import shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_jobs_and_resume(spark):
    records = spark.createDataFrame([("s1", True, "참", "인식"), ("s2", False, "참", "인식")], "sample_id string, primary boolean, source_ko string, ocr_ko string")
    jobs = rv.expand_jobs(records)
    got = sorted((r.sample_id, r.condition, r.text, r.with_glossary) for r in jobs.collect())
    assert got == [("s1", "A", "참", False), ("s1", "B", "인식", False), ("s1", "C", "참", True), ("s1", "D", "인식", True), ("s2", "B", "인식", False), ("s2", "D", "인식", True)]
    want = spark.createDataFrame([("j1", "i"), ("j2", "i"), ("j3", "i")], "job_sha string, identity_sha string")
    stored = spark.createDataFrame([("j1", "i", "ok", True), ("j2", "i", "error", True), ("j3", "other", "ok", False)], "job_sha string, identity_sha string, status string, intact boolean")
    assert sorted(r.job_sha for r in rv.pending_jobs(want, stored, ["job_sha", "identity_sha"]).collect()) == ["j2", "j3"]
    assert [r.violation for r in rv.identity_mismatches(want, stored).collect()] == ["resume.identity"]


PROMPTS = {"qwen3": "옮겨라", "translategemma": "T", "glossary_instruction": "용어", "options": {"temperature": 0}, "qwen_think": False}


def test_groups_are_counted_in_parts(spark):
    from cueweave.session import distinct_in_parts

    rows = spark.range(0, 4000, numPartitions=2).select((F.col("id") % 1000).alias("group_id"), F.when(F.col("id") < 2000, "a").alias("k"), F.lit("ok").alias("status"))
    parts = distinct_in_parts(rows.select("k", "group_id"), 500)
    assert parts.count() == 2000
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning") and ", 9), REPARTITION_BY_NUM" in plan  # nothing is gathered before the shuffle
    more = {"wall_ms": F.col("group_id").cast("double"), "eval_count": F.lit(2), "done_reason": F.lit("length"), "thinking": F.lit("")}
    out = {r.k: r for r in rv.condition_summary(rows.withColumns(more), ["k"]).collect()}
    assert {k: (r.requests, r.subtitle_groups, r.generated_tokens, r.truncated_outputs, r.thinking_outputs) for k, r in out.items()} == {"a": (2000, 1000, 4000, 2000, 0), None: (2000, 1000, 4000, 2000, 0)}
    assert out["a"].wall_ms_median == 499.5


def test_payload(spark):
    df = spark.createDataFrame([("본문", "a = b"), ("본문", ""), ("본문", None)], "t string, g string")
    rows = df.select(rv.build_payload("qwen3:4b", F.col("t"), PROMPTS, F.col("g")).alias("p")).collect()
    assert [r.p.messages[0].content for r in rows] == ["옮겨라\n용어\na = b\n\n\n본문", "옮겨라\n\n\n본문", "옮겨라\n\n\n본문"]
    assert rows[0].p.think is False and "think" not in df.select(rv.build_payload("translategemma:4b", F.col("t"), PROMPTS).alias("p")).first().p.asDict()
    with pytest.raises(ValueError):
        rv.build_payload("other:1b", F.col("t"), PROMPTS)


def fake_model(answers):
    def make():
        calls = {}

        def call(payload):
            n = calls[payload] = calls.get(payload, 0) + 1
            answer = answers[payload][min(n, len(answers[payload])) - 1]
            if isinstance(answer, int):
                error = OSError("http")
                error.code = answer
                raise error
            return answer

        return call

    return make


def reply(content, reason="stop", done=True):
    return {"done": done, "done_reason": reason, "eval_count": 3, "message": {"content": content}}


def test_retries(spark):
    answers = {
        "fine": [reply("訳")], "second": [500, reply("訳")], "client": [404], "cut": [reply(" ", "length")], "blank": [reply(""), reply("")],
        "half": [reply("訳", done=False), reply("訳")], "down": [503, 503],
    }
    jobs = spark.createDataFrame([(k,) for k in answers], "payload string").coalesce(1)
    got = {r.payload: r.result for r in sc.infer_with_retry(jobs, fake_model(answers), sleep=lambda s: None).collect()}
    brief = {k: (v.status, [(e.type, e.http_status) for e in v.errors]) for k, v in got.items()}
    assert brief == {
        "fine": ("ok", []), "second": ("ok", [("OSError", 500)]), "client": ("error", [("OSError", 404)]),
        "cut": ("error", [("OutputLimitWithoutTranslation", None)]), "blank": ("error", [("ValueError", None)] * 2),
        "half": ("ok", [("ValueError", None)]), "down": ("error", [("OSError", 503)] * 2),
    }
    waits = []
    sc.call_with_retry(fake_model({"x": [500]})(), "x", attempts=3, sleep=waits.append)
    assert waits == [1, 2]


def test_recognize(spark):
    def make():
        seen = []

        def recognise(row):
            seen.append(row["id"])
            if row["id"] == "bad":
                raise RuntimeError("no text")
            return f"{row['id']} {len(seen)}", 0.5

        return recognise

    images = spark.createDataFrame([("a", b"x"), ("bad", b"y"), ("c", b"z")], "id string, pixels binary").coalesce(1)
    got = sorted(((r.id, r.error, r.inference_ms is None) for r in sc.recognize_batch(images, make, warmups=2).collect()))
    assert got == [("a", None, False), ("bad", "RuntimeError: no text", True), ("c", None, False)]


def test_translate(spark):
    captions = spark.createDataFrame(
        [("1", "보라 왔다", "completed"), ("2", " ", "completed"), ("3", "x", "error"), ("4", "실패", "completed")], "id string, source_ko string, ocr_status string"
    )
    context = spark.createDataFrame([("1", "용어집", [Row(source_id="s")])], "text_id string, prompt_text string, matches array<struct<source_id:string>>")

    def make():
        def call(payload):
            content = json.loads(payload)["messages"][0]["content"]
            if "실패" in content:
                raise ValueError("no")
            return reply(f"  訳:{'용어집' in content} ")

        return call

    out = sc.translate(captions, context, "qwen3:4b", PROMPTS, make, sleep=lambda s: None)
    got = {r.id: (r.translation_status, r.generated_ja, r.error, r.calls) for r in out.collect()}
    assert got == {
        "1": ("completed", "訳:True", None, 1), "2": ("error", None, "no source text", 0), "3": ("pending", None, None, 0),
        "4": ("error", None, "translation failed: ValueError, ValueError", 1),
    }
    assert sorted(r.subtitle_id for r in sc.translation_errors(out).collect()) == ["2", "4"]


def test_translate_asks_once_per_caption(spark, folder):
    """Filters on the answers ask nothing again, and tasks without anything to send build no client."""
    captions = spark.createDataFrame([(i, "x" if i < 6 else " ", "completed") for i in range(12)], "id int, source_ko string, ocr_status string").repartition(4, "id")
    context = spark.createDataFrame([(0, "p", None)], "text_id int, prompt_text string, matches array<struct<source_id:string>>")

    def make():
        def call(payload):
            Path(folder, uuid.uuid4().hex).touch()
            return reply("y")

        return call

    out = sc.translate(captions, context, "qwen3:4b", PROMPTS, make)
    assert out.filter("translation_status = 'completed' and generated_ja = 'y'").count() == 6 and len(os.listdir(folder)) == 6
    assert out.filter("translation_status = 'error'").count() == 6 and len(os.listdir(folder)) == 12

    def never():
        raise AssertionError("nothing is to be sent")

    assert sc.translate(captions.filter("id >= 6"), context, "qwen3:4b", PROMPTS, never).filter("calls = 0").count() == 6


def test_translate_writes_less_than_its_texts(spark, folder):
    """Every word of the texts is a match; what is written on the way is measured in the checkpoint folder."""
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    rng = random.Random(5)
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(words))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    used = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(urlparse(shared_folder(spark)).path) for f in files)
    before = used()
    out = QUERIES["translate"](spark, folder)
    assert used() - before < sum(map(len, texts))
    assert {tuple(r) for r in out.select("translation_status", "translated", "terms", "calls").collect()} == {("completed", True, 8, 1)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [doc_id") == 1  # what is left to do reads texts once, and so shuffles them once


def results(spark):
    rows = [
        ("r1", "e", "g1_speech_f01", "g1", "A", True, "x"), ("r2", "e", "g1_speech_f01", "g1", "B", True, "y"),
        ("r3", "e", "g1_speech_f02", "g1", "B", False, "z"), ("r4", "e", "g2_speech_f01", "g2", "B", True, "w"),
    ]
    return spark.createDataFrame(rows, "result_id string, experiment string, sample_id string, group_id string, condition string, primary boolean, output string")


def test_blind_packet_and_append(spark):
    df = results(spark)
    packet = rv.blind_packet(df)
    again = rv.blind_packet(df.repartition(3))
    assert {tuple(r)[:2] for r in packet.collect()} == {tuple(r)[:2] for r in again.collect()}
    assert "result_id" not in packet.columns and "condition" not in packet.columns
    scoring = packet.drop("position").limit(1).withColumn("review_status", F.lit("human_confirmed"))
    merged = rv.append_new_reviews(packet, scoring)
    assert merged.count() == 4 and merged.filter("review_status = 'human_confirmed'").count() == 1
    assert rv.orphan_reviews(packet, scoring).isEmpty()


def review(blind, sample, output, status="ai_provisional", severity="none", kinds=(), rationale="r", reviewer="me", evidence=("e",), signature="m"):
    return (blind, sample, output, True, status, severity, list(kinds), rationale, reviewer, list(evidence), signature)


def test_review_links_and_rules(spark):
    rows, mapping = results(spark), rv.blind_mapping(results(spark))
    ids = {r.result_id: r.blind_id for r in mapping.collect()}
    scoring = spark.createDataFrame([
        review(ids["r1"], "g1_speech_f01", "x"), review("review-unknown", "s", "x"), review(ids["r2"], "g1_speech_f01", "other"),
    ], schemas.REVIEW)
    bad = {r.blind_id: r.violation for r in rv.review_link_violations(rows, mapping, scoring).collect()}
    assert bad == {"review-unknown": "link.blind_id", ids["r2"]: "link.content"}
    linked = rv.attach_reviews(rows, mapping, scoring.filter(F.col("blind_id") == ids["r1"]))
    assert {r.result_id: r.review.severity if r.review else None for r in linked.collect()} == {"r1": "none", "r2": None, "r3": None, "r4": None}
    broken = spark.createDataFrame([
        review("1", "s", "o", status="done"), review("2", "s", "o", severity="bad"), review("3", "s", "o", rationale=""),
        review("4", "s", "o", status="human_confirmed", evidence=()), review("5", "s", "o", kinds=["typo"]), review("6", "s", "o", status="unreviewed", rationale=""),
    ], schemas.REVIEW)
    assert sorted(r.blind_id for r in rv.review_violations(broken).collect()) == ["1", "2", "3", "4", "5"]


def test_decisions(spark):
    packet = spark.createDataFrame([
        review("1", "g1_a", "x", status="unreviewed"), review("2", "g1_b", "x", status="unreviewed"), review("3", "g1_c", "x", status="human_confirmed"), review("4", "g2_a", "y", status="unreviewed"),
    ], schemas.REVIEW)
    decisions = spark.createDataFrame([("g1", None, "x", "minor"), ("g1", "g1_a", "x", "major")], "group_id string, sample_id string, output string, severity string")
    out = {r.blind_id: (r.severity, r.applied) for r in rv.apply_decisions(packet, decisions).collect()}
    assert out == {"1": ("major", True), "2": ("minor", True), "3": ("none", False), "4": ("none", False)}
    assert rv.duplicate_decisions(decisions.union(decisions)).count() == 2


def test_summaries(spark):
    rows = [
        ("e", "s_f01", "g1", "A", True, "human_confirmed", "major", ["number"], "m1"), ("e", "s_f01", "g1", "B", True, "human_confirmed", "none", [], "m1"),
        ("e", "t_f01", "g2", "C", True, "ai_provisional", "undetermined", [], "m2"), ("e", "t_f01", "g2", "D", True, "human_confirmed", "minor", [], "m2"),
        ("e", "t_f02", "g2", "D", False, "unreviewed", "undetermined", [], ""), ("e", "s_f02", "g1", "A", False, "ai_provisional", "none", [], "m9"),
    ]
    df = spark.createDataFrame(rows, "experiment string, sample_id string, group_id string, condition string, primary boolean, review_status string, severity string, error_types array<string>, semantic_signature string")
    s = rv.review_summary(df, ["experiment"], "human_confirmed").first()
    assert (s.reviewed_units, s.determined_units, s.major_units, s.error_number) == (3, 3, 1, 1)
    c = {r.condition: (r.fully_determined_groups, r.major_fully_determined_groups) for r in rv.complete_groups(df, ["condition"], "human_confirmed").collect()}
    assert c == {"A": (0, 0), "B": (1, 0), "C": (0, 0), "D": (0, 0)}
    pairs = [(r.pair, r.left, r.right, r.review_status) for r in rv.paired_judgements(df).collect()]
    assert pairs == [("AB", "major", "none", "human_confirmed")]
    adjacent = {(r.condition, r.line): (r.frames, r.distinct_reviewed_meanings, r.meaning_changed, r.fully_reviewed) for r in rv.adjacent_judgements(df).collect()}
    assert adjacent == {("A", "s"): (2, 2, True, True), ("D", "t"): (2, 1, False, False)}
    assert rv.unreviewed_units(df, ["experiment"]).first().unreviewed_units == 1


def test_format_flags_and_checks(spark):
    packet = spark.createDataFrame([
        review("1", "s", "  ", status="unreviewed"), review("2", "s", "Okay, I will TRANSLATE", status="unreviewed"), review("3", "s", "  ", status="human_confirmed"), review("4", "s", "訳", status="unreviewed"),
    ], schemas.REVIEW)
    got = {r.blind_id: (r.review_status, r.error_types) for r in rv.apply_format_flags(packet).collect()}
    assert got == {"1": ("ai_provisional", ["format"]), "2": ("ai_provisional", ["format"]), "3": ("human_confirmed", []), "4": ("unreviewed", [])}
    cases = spark.createDataFrame(
        [("1", [["竜", "ドラゴン"], ["倒"]], ["a"], ["b"]), ("2", [["竜"]], ["a"], []), ("3", [], [], [])],
        "id string, required_ja array<array<string>>, expected_target_ids array<string>, forbidden_target_ids array<string>",
    )
    side = lambda rows: spark.createDataFrame(rows, "id string, output string, selected array<string>")
    compared = sc.compare_conditions(cases, side([("1", "x", []), ("2", "竜", ["a"]), ("3", "", [])]), side([("1", "ドラゴンを倒", ["a", "b"]), ("2", "x", ["a"]), ("3", "", [])]))
    got = {r.id: (r.comparison, r.current_selection.passed, r.current_selection.forbidden_selected) for r in compared.collect()}
    assert got == {"1": ("improved", False, ["b"]), "2": ("regressed", True, []), "3": ("unchanged_pass", True, [])}
    total = sc.comparison_summary(compared).first()
    assert (total.case_count, total.improved, total.regressed, total.current_selection_checks_passed) == (3, 1, 1, 2)


def test_strict_pairs(spark):
    manifest = spark.createDataFrame([("i_f02", "참", "g"), ("i_f01", "참", "g"), ("m", "참", "g")], "id string, ground_truth string, group_id string")
    ocr = spark.createDataFrame([("i_f02", "o", "참", "g"), ("i_f01", "o", "다름", "g"), ("z", "o", "참", "g")], "image_id string, raw_output string, ground_truth string, group_id string")
    got = {r.id: (r.problem, r.primary) for r in sc.records_with_source(manifest, ocr).collect()}
    assert got == {"i_f02": (None, True), "i_f01": ("mismatch", False), "m": ("pair.absent", False), "z": ("pair.extra", False)}
