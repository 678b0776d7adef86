"""Sources, sinks, documents, dictionary audit and checks."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from cueweave import schemas
from cueweave.operators import dictionary as dic, metrics as me, projects, quality as q
from cueweave.sources import readers, writers


def put(path, value):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(value, out, ensure_ascii=False, indent=2)


OLD = {
    "schema_version": 1, "kind": "project", "video": {"id": "v", "duration_seconds": 10.0}, "analysis": {"start_seconds": 0.0, "end_seconds": 10.0},
    "subtitles": [{
        "id": "subtitle-00001", "start_seconds": 1.0, "end_seconds": 2.5, "ocr": {"status": "completed", "raw_text": "원문", "raw_lines": ["원문"], "confidence": 0.9},
        "corrected_ko": "고침", "translation": {"status": "stale", "source_ko": "원문", "generated_ja": "訳", "user_ja": "手動"},
    }],
    "processing": {"sample_count": 50, "subtitle_count": 1, "errors": []},
}


def test_projects_round_trip_and_migration(spark, folder):
    put(f"{folder}/a.json", OLD)
    put(f"{folder}/b.json", {**OLD, "schema_version": 2})
    scanned = readers.scan_projects(spark, folder)
    moved = {r.source_file.rsplit("/", 1)[1]: r for r in projects.migrate_v1(scanned).collect()}
    a, b = moved["a.json"], moved["b.json"]
    c = a.subtitles[0]
    assert (a.schema_version, a.analysis.minimum_display_duration_ms, a.configuration.detection.boundary_source) == (2, 1200, "ocr_text")
    assert (c.line_id, c.line_index, c.detection.status, c.ocr.attempts) == ("line-1", 0, "legacy", [])
    assert (c.start_seconds, c.corrected_ko, c.translation.user_ja) == (1.0, "고침", "手動")
    assert (a.processing.detection_count, a.processing.ocr_call_count, a.processing.translation_call_count, a.processing.dropped_intervals) == (1, 50, 1, [])
    assert b.subtitles[0].line_id is None and b.processing.detection_count is None and b.configuration is None
    rows = readers.explode_subtitles(scanned, ["source_file"], "line-2")
    assert {r.line_id for r in rows.collect()} == {"line-2"} and rows.count() == 2
    writers.sink_json(scanned.drop("source_file"), f"{folder}/out")
    assert spark.read.schema(schemas.PROJECT).json(f"{folder}/out").filter("schema_version = 1").first().subtitles[0].ocr.raw_text == "원문"


def test_json_refuses_nan(spark, folder):
    df = spark.createDataFrame([(1, [(1.0,), (float("nan"),)])], "id int, parts array<struct<x:double>>")
    writers.sink_json(df.limit(1).select(F.lit("before").alias("kept")), f"{folder}/out")
    with pytest.raises(Exception, match="JSON cannot hold"):
        writers.sink_json(df, f"{folder}/out")
    assert [r.kept for r in spark.read.json(f"{folder}/out").collect()] == ["before"]
    writers.sink_json(df.withColumn("parts", F.slice("parts", 1, 1)), f"{folder}/ok")
    assert spark.read.json(f"{folder}/ok").count() == 1


def test_results_scan(spark, folder):
    body = {"identity": {"model": "m"}, "job": {"sample_id": "s", "group_id": "g", "split": "dev", "primary": True, "condition": "A"}, "status": "ok",
            "response": {"done": True, "done_reason": "stop", "eval_count": 3, "message": {"content": "訳", "thinking": None}}, "errors": [], "wall_ms": 12.5}
    body["ps"] = {"field of no schema": [1, 2.5, None]}
    checksum = hashlib.sha256(json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    put(f"{folder}/exp/a.json", {**body, "checksum": checksum})
    put(f"{folder}/exp/b.json", {**body, "checksum": "wrong", "job": {**body["job"], "condition": "B"}})
    put(f"{folder}/exp/warmup-1.json", body)
    put(f"{folder}/exp/identity.json", {"identity": {"model": "m"}})
    scanned = readers.scan_results(spark, folder)
    assert {r.file_name: (r.route, r.intact) for r in scanned.collect() if r.route == "result"} == {"a.json": ("result", True), "b.json": ("result", False)}
    assert {r.file_name: r.route for r in scanned.collect()}["warmup-1.json"] == "warmup"
    row = readers.result_rows(scanned).first()
    assert (row.output, row.model, row.condition, row.thinking) == ("訳", "m", "A", "")
    assert [(r.file_name, r.violation) for r in readers.result_violations(scanned).collect()] == [("b.json", "result.checksum")]
    put(f"{folder}/exp2/a.json", {**body, "checksum": checksum})
    assert {r.violation for r in readers.result_violations(readers.scan_results(spark, folder)).collect()} == {"result.checksum", "result.again"}


def test_details_csv(spark, folder):
    records = spark.createDataFrame(
        [("i1", "g", 0.2, ["a", "b"], 2, "참\n둘", "참 \r\n둘", 0.5, 1.0, 2.0, 3.0, None), ("i2", "g", 0.4, ["a"], 1, '말 "인용"', None, None, None, None, None, "bad")],
        "image_id string, group_id string, timestamp_seconds double, tags array<string>, line_count int, ground_truth string, raw_output string, confidence double, preprocessing_ms double, inference_ms double, total_ms double, error string",
    )
    details = writers.details_rows(records, {"engine": "paddleocr", "engine_version": "1", "model_id": "m", "preprocessing": "contrast"})
    assert len(details.columns) == 23
    writers.sink_details_csv(details.coalesce(1), f"{folder}/csv")
    part = next(f for f in os.listdir(f"{folder}/csv") if f.endswith(".csv"))
    assert open(f"{folder}/csv/{part}", "rb").read(9) == "﻿engine".encode("utf-8")
    back = {r.image_id: r for r in readers.scan_details_csv(spark, f"{folder}/csv").collect()}
    assert (back["i1"].ground_truth, back["i1"].tags, back["i1"].edit_distance, back["i1"].exact_match) == ("참\n둘", "a|b", 1, False)
    assert (back["i2"].ground_truth, back["i2"].edit_distance, back["i2"].error) == ('말 "인용"', 6, "bad")
    assert readers.scan_details_csv(spark, f"{folder}/csv", "other").isEmpty()


def test_corpus_metrics(spark):
    rows = [("i1", "g1", ["a"], "가나다라", "가나다", None), ("i2", "g1", ["a", "b"], "가 나", "가나", None), ("i3", "g2", ["b"], "다", None, "boom")]
    df = spark.createDataFrame(rows, "id string, group_id string, tags array<string>, ground_truth string, raw_output string, error string")
    scored = me.with_row_metrics(df)
    m = me.corpus_metrics(scored).first()
    assert (m.image_count, m.failure_count, m.reference_characters, m.edit_distance, m.exact_matches) == (3, 1, 8, 3, 0)
    assert m.cer == 3 / 8 and m.whitespace_free_cer == 2 / 7
    assert {r.tag: (r.image_count, r.edit_distance) for r in me.metrics_by_tag(scored).collect()} == {"a": (2, 2), "b": (2, 2)}
    summary = {r.tag: (r.image_count, r.subtitle_group_count, r.verified_ground_truth_count) for r in me.dataset_summary(df.withColumn("ground_truth_status", F.lit("verified"))).collect()}
    assert summary == {None: (3, 2, 3), "a": (2, 1, 2), "b": (2, 2, 2)}


def test_line_ocr_summary(spark):
    rows = [(True, "g1", 1, 4, 1, 3, False, 10.0), (True, "g1", 0, 2, 0, 2, True, 30.0), (True, "g2", 2, 4, 0, 4, False, None), (False, "g1", 0, 1, 0, 1, True, 5.0)]
    df = spark.createDataFrame(rows, "primary boolean, group_id string, edits int, characters int, whitespace_free_edits int, whitespace_free_characters int, exact boolean, ocr_ms double")
    out = {r.primary: tuple(r)[1:] for r in me.line_ocr_summary(df).collect()}
    assert out == {True: (2, 3, 3 / 10, 1 / 9, 1, 2, 20.0), False: (1, 1, 0.0, 0.0, 1, 1, 5.0)}


def test_two_line_diagnostics(spark):
    rows = [("l2", "g", True, False, 2, "나", "나"), ("l1", "g", True, False, 1, "가", "다"), ("w", "g", True, True, None, "가\n나", "x"), ("o", "h", True, False, 1, "가", "가")]
    df = spark.createDataFrame(rows, "id string, group_id string, primary boolean, diagnostic_only boolean, reading_order int, source_ko string, ocr_ko string")
    (r,) = me.two_line_diagnostics(df).collect()
    assert (r.line_ids, r.edits, r.characters, r.whole_crop_id) == (["l1", "l2"], 1, 3, "w")


def test_dictionary_scan(spark, folder):
    entries = [{"id": "item:1", "category": "item", "ko": "검", "ja": "剣"}, {"id": "champion:B", "category": "champion", "ko": "보라", "ja": "ボラ"}]
    put(f"{folder}/official.json", {"entries": entries, "counts": {"item": 1, "champion": 1}})
    put(f"{folder}/sources.json", {"sources": {"s1": {"url": "u", "kind": "k"}}})
    alias = {"id": "a1", "ko": "칼", "target_ids": ["item:1"], "type": "short", "status": "source_checked", "sources": ["s1"]}
    put(f"{folder}/aliases.json", {"aliases": [alias, {**alias, "id": "a2", "ko": "ㅋ", "target_ids": ["none:1"], "status": "maybe", "sources": ["s9"]}]})
    put(f"{folder}/terms.json", {"concepts": [{"id": "c1", "category": "play", "ko": "한타", "ja": "集団戦", "meaning": "m"}], "aliases": [{**alias, "id": "a3", "target_ids": ["c1"]}]})
    files = {r.file_name: r.sha256 for r in readers.file_digests(spark, [f"{folder}/{n}.json" for n in ("official", "sources", "aliases", "terms")]).collect()}
    item = lambda role, name, **more: {"role": role, "path": f"{name}.json", "sha256": files[f"{name}.json"], **more}
    manifest = {
        "app_dictionary_version": "1", "official_file": item("official", "official", expected_count=2), "sources_file": item("sources", "sources", expected_count=1),
        "alias_files": [item("aliases", "aliases", expected_count=2, target_category="item")], "term_files": [{**item("terms", "terms"), "sha256": "stale"}],
    }
    put(f"{folder}/manifest.json", manifest)
    d = readers.scan_dictionary(spark, f"{folder}/manifest.json")
    assert {r.id: r.origin for r in d.entries.collect()} == {"item:1": "official", "champion:B": "official", "c1": "curated_concept"}
    assert {r.id for r in d.aliases.collect()} == {"a1", "a2", "a3"}
    assert {r.file_name: r.intact for r in d.files.collect()} == {"official.json": True, "sources.json": True, "aliases.json": True, "terms.json": False}
    bad = {(r.id, r.violation) for r in q.check_dictionary(d.entries, d.aliases, d.sources, d.files).collect()}
    assert bad == {
        ("a2", "alias.status"), ("a2", "alias.short"), ("a2", "alias.source_ref"), ("a2", "alias.target_ref"),
        ("a1", "alias.short"), ("a3", "alias.short"),
    }
    counts = {(r.what, r.key): r.actual_count for r in dic.dictionary_counts(d.entries, d.aliases).collect()}
    assert counts[("official", "item")] == 1 and counts[("alias_status", "source_checked")] == 2 and counts[("alias", "historical")] == 0
    assert dic.version_record(d.files, "1", "p").count() == 1
    with pytest.raises(ValueError):
        put(f"{folder}/manifest.json", {**manifest, "sources_file": {**manifest["sources_file"], "path": "../x.json"}})
        readers.scan_dictionary(spark, f"{folder}/manifest.json")


def snapshot(folder, locale, names):
    at = f"{folder}/{locale}"
    spells = [{"id": f"B{s}", "name": f"{names['b']} {s}"} for s in "QWER"]
    put(f"{at}/champion/B.json", {"data": {"B": {"name": names["b"], "passive": {"name": "<i>p</i>"}, "spells": spells}}})
    items = {"1": {"name": names["i"], "maps": {"11": True}}, "2": {"name": "x", "maps": {"11": False}}}
    if locale == "ko":
        items["3"] = {"name": "only", "maps": {"11": True}}
    put(f"{at}/item.json", {"data": items})
    put(f"{at}/runesReforged.json", [{"id": 8, "name": "tree", "slots": [{"runes": [{"id": 81, "name": "r1"}, {"id": 82, "name": "r2"}]}]}])
    put(f"{at}/summoner.json", {"data": {"F": {"name": names["s"], "modes": ["x"]}}})


def test_snapshot_pairing(spark, folder):
    snapshot(folder, "ko", {"b": "보라", "i": "검", "s": "점멸"})
    snapshot(folder, "ja", {"b": "ボラ", "i": " ", "s": "フラッシュ"})
    ko, ja = (readers.scan_locale_snapshot(spark, folder, x) for x in ("ko", "ja"))
    paired = dic.pair_locales(ko, ja)
    assert {r.id: r.problem for r in paired.collect() if r.problem} == {"item:3": "missing_ja", "item:1": "empty_name"}
    made = {r.id: r for r in dic.official_entries(paired).collect()}
    assert made["ability:B:P"].ko == "p" and made["ability:B:R"].ja == "ボラ R" and made["ability:B:R"].slot == "R"
    assert set(made) == {"champion:B", "ability:B:P", "ability:B:Q", "ability:B:W", "ability:B:E", "ability:B:R", "rune-tree:8", "rune:81", "rune:82", "summoner-spell:F"}
    assert readers.incomplete_spells(spark, folder, "ko").isEmpty()


def test_images(spark, folder):
    import hashlib

    for name, content in (("a.png", b"one"), ("b.png", b"two")):
        open(f"{folder}/{name}", "wb").write(content)
    images = readers.scan_images(spark, folder)
    listed = spark.createDataFrame(
        [("1", "a.png", hashlib.sha256(b"one").hexdigest()), ("2", "b.png", "x"), ("3", "c.png", "y")], "id string, image_file string, image_sha256 string"
    )
    assert {r.id: r.violation for r in readers.image_violations(listed, images).collect()} == {"2": "file.digest", "3": "file.missing"}


def test_surveys_and_drift(spark):
    aliases = spark.createDataFrame([("a", "칼", ["item:1"])], "id string, ko string, target_ids array<string>")
    concepts = spark.createDataFrame([("한타",)], "ko string")
    survey = spark.createDataFrame([("칼", "added_active"), ("방패", "active"), ("한타", "rejected:x"), ("용", "unconfirmed")], "term string, decision string")
    assert {(r.term, r.problem) for r in dic.survey_mismatch(survey, aliases, concepts).collect()} == {("방패", "missing_confirmed"), ("한타", "forbidden_active")}
    pages = spark.createDataFrame([("칼", ["item:1"], "added_active"), ("칼", ["item:2"], "duplicate_existing"), ("칼", ["item:1"], "held_unconfirmed")], "term string, target_ids array<string>, decision string")
    assert sorted(r.problem for r in dic.page_survey_mismatch(pages, aliases).collect()) == ["forbidden_active", "missing_confirmed"]
    old = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, ko string")
    new = spark.createDataFrame([("a", "x"), ("b", "Y"), ("d", "w")], "id string, ko string")
    assert {r.id: r.change for r in dic.version_diff(old, new, "id", ["ko"]).collect()} == {"b": "renamed", "c": "removed", "d": "added"}
    assert {r.id for r in dic.content_drift(old, new, "id").collect()} == {"b", "c"}
    one = dic.set_digest(old, [], F.concat_ws("|", "id", "ko")).first().digest
    assert one == dic.set_digest(old.repartition(3).orderBy(F.desc("id")), [], F.concat_ws("|", "id", "ko")).first().digest
    assert one != dic.set_digest(new, [], F.concat_ws("|", "id", "ko")).first().digest


def test_requests(spark):
    good = ("ok", 2, "/v.mp4", (0.1, 0.1, 0.5, 0.5), ("range", 0.0, 5.0), (200, None, 600))
    variants = {
        "version": good[1:1] + (3,) + good[2:], "path": (2, " ") + good[3:], "relative": (2, "v.mp4") + good[3:], "region": (2, "/v.mp4", (0.9, 0.1, 0.5, 0.5)) + good[4:],
        "order": good[1:4] + (("range", 5.0, 5.0), good[5]), "whole": good[1:4] + (("whole", 0.0, None), good[5]), "mode": good[1:4] + (("part", None, None), good[5]),
        "fast": good[1:5] + ((49, None, 600),), "split": good[1:5] + ((200, 0.95, 600),), "long": good[1:5] + ((200, 0.5, 60_001),), "nodur": good[1:5] + ((200, 0.5, None),),
        "legacy": (1,) + good[2:5] + ((200, 0.5, None),), "nan": good[1:4] + (("range", float("nan"), 5.0), good[5]),
    }
    rows = [good] + [(name, *rest) for name, rest in variants.items()]
    bad = q.check_request(spark.createDataFrame(rows, "request_id string, " + schemas.REQUEST)).collect()
    by = {}
    for r in bad:
        by.setdefault(r.request_id, []).append(r.violation)
    assert set(by) == set(variants) - {"legacy"}
    assert by["path"] == ["request.path", "request.path_relative"] and len(by["order"]) == 1
    raw = spark.createDataFrame([("a", '{"mode":"whole","extra":1}'), ("b", '{"mode":1,"start":2}')], "id string, j string")
    got = q.unknown_fields(raw, "j", ["mode", "start"], ["id"]).collect()
    assert [(r.id, r.unknown, r.missing) for r in got] == [("a", ["extra"], ["start"])]


def test_judgements(spark):
    answer = lambda ids, why="w": json.dumps({"judgements": [{"candidate_id": i, "severity": "none", "error_types": [], "rationale": why, "semantic_signature": "s"} for i in ids]})
    rows = [("1", answer(["a", "b"]), ["b", "a"]), ("2", answer(["a"]), ["a", "b"]), ("3", answer(["a"], ""), ["a"]), ("4", "not json", ["a"])]
    df = q.parse_judgement(spark.createDataFrame(rows, "sample_id string, r string, e array<string>"), "r", "e")
    problems = {r.sample_id: r.problem for r in df.collect()}
    assert problems == {"1": None, "2": "answer.candidates", "3": "answer.silent", "4": "answer.candidates"}
    candidates = spark.createDataFrame([("1", "a", "訳"), ("1", "b", "訳2"), ("2", "a", "x")], "sample_id string, candidate_id string, output string")
    assert {(r.candidate_id, r.severity) for r in q.judged_outputs(df, candidates).collect()} == {("a", "none"), ("b", "none")}


def test_captions_of_documents(spark):
    rows = [("v", "1", 1, "l", 0, 0.0, 1.0, "t"), ("v", "2", 2, "l", 0, 0.5, 2.0, "t"), ("v", "2", 3, "m", 0, 0.0, 2.0, "t"), ("v", "4", 4, None, 0, 3.0, 2.5, None)]
    df = spark.createDataFrame(rows, "video_id string, id string, ordinal int, line_id string, line_index int, start_seconds double, end_seconds double, raw_text string")
    got = sorted((r.id, r.violation) for r in q.check_project(df).collect())
    assert got == [
        ("2", "caption.id"), ("2", "caption.id"), ("2", "caption.order"),
        ("4", "caption.line"), ("4", "caption.order"), ("4", "caption.raw"),
    ]


def test_retranslation(spark):
    rows = spark.createDataFrame([("1", "old", "x"), ("2", "old", "y")], "id string, ja string, ko string")
    changed = spark.createDataFrame([("2", None, "z"), ("3", "new", "q")], "id string, ja string, ko string")
    assert {tuple(r) for r in projects.upsert_by_id(rows, changed, ["id"]).collect()} == {("1", "old", "x"), ("2", None, "z")}
    errors = spark.createDataFrame([([("ocr", "1", 0.0, "a"), ("translation", "1", None, "b")],)], f"e array<{schemas.ERROR}>")
    fresh = F.array(F.struct(F.lit("translation").alias("phase"), F.lit("2").alias("subtitle_id"), F.lit(None).cast("double").alias("timestamp_seconds"), F.lit("c").alias("message")))
    assert [(e.phase, e.message) for e in errors.select(projects.replace_errors(F.col("e"), fresh).alias("e")).first().e] == [("ocr", "a"), ("translation", "c")]
