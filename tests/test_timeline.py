"""Goldens of runs, stabilisation, attempts and lookups."""

import random

import pytest
from pyspark.sql import functions as F

from cueweave import schemas
from cueweave.operators import ranges, timeline as tl


def sample(ts, text, status="subtitle", confidence=0.9, video="v", line="line-1", error=None):
    return (video, line, ts, status, text, [], confidence, error)


def runs(spark, rows, interval=0.2, end=None, size=1_000_000):
    out = tl.merge_runs(spark.createDataFrame(rows, schemas.SAMPLE), interval, end, target_rows=size)
    return sorted((r.line_id, round(r.start_seconds, 3), round(r.end_seconds, 3), r.raw_text) for r in out.collect())


def test_runs_golden(spark):
    rows = [
        sample(10.0, "드래곤 나왔다"), sample(10.2, "드래곤나왔다"), sample(10.4, "바론"), sample(10.6, "", "no_subtitle"),
        sample(10.8, "바론"), sample(11.0, "바론", "ocr_error", error="bad"), sample(11.2, "바론"), sample(11.4, " "),
    ]
    want = [("line-1", 10.0, 10.4, "드래곤 나왔다"), ("line-1", 10.4, 10.6, "바론"), ("line-1", 10.8, 11.0, "바론"), ("line-1", 11.2, 11.4, "바론")]
    assert runs(spark, rows) == want
    assert runs(spark, [sample(0.0, "가"), sample(0.2, "가")]) == [("line-1", 0.0, 0.4, "가")]
    assert runs(spark, [sample(0.0, "가"), sample(0.2, "가")], end=0.3) == [("line-1", 0.0, 0.3, "가")]
    errors = tl.sample_errors(spark.createDataFrame(rows, schemas.SAMPLE)).collect()
    assert [(e.timestamp_seconds, e.message) for e in errors] == [(11.0, "bad")]


def sequential_runs(rows, interval):
    """Plain reference loop for one line."""
    out, current, last = [], None, None
    for _, line, ts, status, text, *_ in rows:
        key = "".join(text.split()) if status == "subtitle" else ""
        if current and current[2] != key:
            out.append((line, current[0], ts, current[1]))
            current = None
        if key and not current:
            current = (ts, text, key)
        last = ts
    if current:
        out.append((line, current[0], last + interval, current[1]))
    return sorted((a, round(b, 3), round(max(b, c), 3), d) for a, b, c, d in out)


@pytest.mark.parametrize("size", [6, 1_000_000])
def test_runs_equal_a_loop_for_any_slice(spark, size):
    rng = random.Random(3)
    rows, want = [], []
    for line in ("line-1", "line-2"):
        mine = [
            sample(round(i * 0.2, 1), rng.choice(["가", "나", "나", " "]), rng.choice(["subtitle"] * 5 + ["no_subtitle", "ocr_error"]), line=line)
            for i in range(60 if line == "line-1" else 5)
        ]
        rows += mine
        want += sequential_runs(mine, 0.2)
    assert runs(spark, rows, size=size) == sorted(want)


def captions(spark, rows):
    data = [("v", "line-1", s, e, t, [t], c, t) for s, e, t, c in rows]
    return spark.createDataFrame(data, "video_id string, line_id string, start_seconds double, end_seconds double, raw_text string, raw_lines array<string>, confidence double, source_ko string")


@pytest.mark.parametrize("size", [2, 20_000])
def test_stabilize(spark, size):
    rows = [
        (0.0, 0.4, "안녕하세요 여러분들", 0.7), (0.4, 0.8, "안넝하세요 여러분들", 0.9), (0.8, 1.2, "안넝하세오 여러문들", 0.8),
        (1.2, 1.4, "3분 남았다", 0.9), (1.4, 2.2, "4분 남았다", 0.9),
        (5.0, 6.0, "4분 남았다", None), (6.1, 6.6, "4분남았다", 0.5), (9.0, 9.1, "번쩍", 0.9),
    ]
    out = sorted(tl.stabilize(captions(spark, rows), 0.2, 0.6, target_rows=size).collect(), key=lambda r: r.start_seconds)
    got = [(r.start_seconds, r.end_seconds, r.raw_text, r.confidence, len(r.variants or [])) for r in out]
    assert got == [(0.0, 1.2, "안넝하세요 여러분들", 0.9, 3), (1.4, 2.2, "4분 남았다", 0.9, 0), (5.0, 6.6, "4분남았다", 0.5, 2)]
    assert out[0].source_ko == "안넝하세요 여러분들" and out[0].variants[0].raw_text == "안녕하세요 여러분들"


def test_first_accepted(spark):
    rows = [
        ("a", 1, "", 0.9), ("a", 2, "드래곤", 0.8), ("a", 3, "바론", 0.99), ("b", 1, "x", 0.9), ("b", 2, "드래곤", 0.3), ("b", 3, "", None),
        ("c", 1, "ab", 0.4), ("c", 2, "abc", 0.4), ("c", 4, "드래곤", 0.9),
    ]
    df = spark.createDataFrame(rows, "id string, attempt int, raw_text string, confidence double")
    got = {r.id: (r.status, r.raw_text, r.confidence, r.call_count) for r in tl.first_accepted(df, ["id"]).collect()}
    assert got == {"a": ("completed", "드래곤", 0.8, 2), "b": ("error", "x", 0.9, 3), "c": ("error", "abc", 0.4, 2)}


def test_attempt_ledger(spark):
    rows = [
        ("a", 1, "  ", 0.9, None), ("a", 2, None, None, "E: x"), ("a", 3, " 드래곤 ", 0.8, None), ("b", 1, "x", 0.9, None), ("b", 2, "드래곤", 0.9, None),
        ("b", 3, "바론", 0.99, None), ("c", 1, None, None, None), ("c", 2, "가", 0.1, None), ("c", 2, "가", 0.1, None), ("c", 9, "드래곤", 0.9, None),
    ]
    df = spark.createDataFrame(rows, "id string, attempt int, raw_text string, confidence double, failure string")
    got = {r.id: r for r in tl.attempt_ledger(df, ["id"], error="failure").collect()}
    log = lambda k: [(a.attempt, a.raw_text, a.accepted, a.rejection_reason, a.error) for a in got[k].attempts]
    assert log("a") == [(1, "", False, "empty_ocr", None), (2, "", False, "ocr_exception", "E: x"), (3, "드래곤", True, None, None)]
    assert (got["a"].status, got["a"].raw_text, got["a"].call_count) == ("completed", "드래곤", 3)
    assert log("b") == [(1, "x", False, "low_information_ocr", None), (2, "드래곤", True, None, None)]
    assert log("c") == [(1, "", False, "empty_ocr", None), (2, "가", False, "low_information_ocr", None)]
    assert (got["c"].status, got["c"].raw_text, got["c"].confidence, got["c"].call_count) == ("error", "가", 0.1, 2)


def test_stabilize_cuts_at_gaps(spark):
    """Islands of three equal readings; slices far smaller than a key give the same captions as one pass."""
    rows = [(i + j * 0.1, i + j * 0.1 + 0.1, f"말{i % 3}" * 3, 0.5 + 0.1 * j) for i in range(40) for j in range(3)]
    out = {}
    for size in (7, 2, 1_000_000):
        found = tl.stabilize(captions(spark, rows), 0.2, 0.2, target_rows=size).collect()
        out[size] = sorted((round(r.start_seconds, 3), round(r.end_seconds, 3), r.raw_text, len(r.variants or []), round(r.confidence, 3)) for r in found)
    assert out[7] == out[2] == out[1_000_000]
    assert out[7] == [(float(i), round(i + 0.3, 3), f"말{i % 3}" * 3, 3, 0.7) for i in range(40)]


def test_numbered_frames_and_empty_ranges(spark):
    frames = spark.createDataFrame([("v", 10.0 + i * 0.1, i) for i in range(10)] + [("w", 90.0, 0)], "video_id string, pts double, n int")
    for size in (3, 1_000_000):
        out = tl.numbered_frames(frames, ["video_id"], 0.2, 0.6, 0.1, source_start=10.0, target_rows=size)
        assert sorted((r.n, r.frame_index) for r in out.collect()) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    report = {r.video_id: (r.frames, r.problem) for r in tl.range_report(frames.select("video_id"), out, ["video_id"]).collect()}
    assert report == {"v": (5, None), "w": (0, "range.empty")}


def test_ids_scores_and_checks(spark):
    df = spark.createDataFrame([("v", 2.0, 0, 3.0), ("v", 1.0, 1, 2.0), ("v", 1.0, 0, 2.0)], "video_id string, start_seconds double, line_index int, end_seconds double")
    got = {(r.start_seconds, r.line_index): r.id for r in tl.assign_ids(df).collect()}
    assert got == {(1.0, 0): "subtitle-00001", (1.0, 1): "subtitle-00002", (2.0, 0): "subtitle-00003"}
    bad = spark.createDataFrame([("v", 1, 0.0), ("v", 2, 0.4), ("v", 3, 0.2), ("v", 4, 0.2)], "video_id string, n int, ts double")
    assert [r.n for r in tl.order_violations(bad, ["video_id"], ["n"]).collect()] == [3]
    split = tl.split_by_duration(spark.createDataFrame([(0.0, 0.6), (0.0, 0.5), (1.0, 0.5)], "start_seconds double, end_seconds double"), 0.6)
    assert [r.reason for r in split.collect()] == [None, "shorter_than_minimum_duration", "shorter_than_minimum_duration"]


def test_point_lookup_is_half_open(spark):
    caps = spark.createDataFrame([("v", "a", 1, 0.0, 2.0), ("v", "b", 0, 1.0, 3.0), ("v", "c", 0, 1.0, 1000.0), ("v", "d", 0, 5.0, 5.0)], "video_id string, id string, line_index int, start_seconds double, end_seconds double")
    points = spark.createDataFrame([("v", i, t) for i, t in enumerate([0.0, 1.0, 2.0, 3.0, 999.99, 1000.0, 5.0])], "video_id string, p int, t double")
    got = {r.p: r.id for r in ranges.active_at(points, caps, ["video_id"], "p").collect()}
    assert got == {0: "a", 1: "b", 2: "b", 3: "c", 4: "c", 5: None, 6: "c"}


def test_overlap_join_equals_brute_force(spark):
    rng = random.Random(9)
    make = lambda n: [(i, round(s := rng.random() * 50, 3), round(s + rng.choice([0.01, 0.5, 3, 40]) * rng.random(), 3)) for i in range(n)]
    a, b = make(60), make(60)
    left = spark.createDataFrame([("k", *r) for r in a], "k string, a int, a0 double, a1 double")
    right = spark.createDataFrame([("k", *r) for r in b], "k string, b int, b0 double, b1 double")
    got = sorted((r.a, r.b) for r in ranges.overlap_join(left, right, ["k"], ("a0", "a1"), ("b0", "b1")).collect())
    assert got == sorted((i, j) for i, s, e in a for j, u, v in b if max(s, u) < min(e, v))


def test_simultaneous(spark):
    rows = [("v", "l1", 1, "a", 0.0, 2.0), ("v", "l2", 2, "b", 1.0, 3.0), ("v", "l2", 3, "c", 2.0, 4.0), ("w", "l2", 4, "d", 0.0, 9.0)]
    df = spark.createDataFrame(rows, "video_id string, line_id string, ordinal int, id string, start_seconds double, end_seconds double")
    got = [tuple(r) for r in ranges.simultaneous(df).collect()]
    assert got == [("v", "a", "b", 1.0, 2.0)]


def test_sampling_and_range(spark):
    frames = spark.createDataFrame([("v", 10.0 + i * 0.07, i) for i in range(10)], "video_id string, pts double, n int")
    out = tl.frame_range_filter(frames, 0.2, 0.5, 0.1, source_start=10.0)
    assert sorted(r.n for r in out.collect()) == [2, 3, 4, 5, 6, 7]
    first = tl.fixed_interval_sample(out, ["video_id"], "ts", 0.2)
    assert sorted(r.n for r in first.collect()) == [2, 3, 6]
    assert out.filter(F.col("ts") >= 0.5).count() == 0
