"""Greedy matching and interval quality against brute force."""

import random

import pytest

from cueweave.operators import matching as mt

SIDE = "line_id string, idx long, start_seconds double, end_seconds double"


def overlap(a, b):
    return max(0.0, min(a[1], b[1]) - max(a[0], b[0]))


def share(a, b):
    both = overlap(a, b)
    union = (a[1] - a[0]) + (b[1] - b[0]) - both
    return both / union if union > 0 else 0.0


def brute(truth, predicted):
    """All pairs, best first."""
    pairs = sorted(
        ((share(t[2:], p[2:]), t[1], p[1], t[0]) for t in truth for p in predicted if t[0] == p[0] and share(t[2:], p[2:]) >= 0.5), reverse=True
    )
    used_t, used_p, out = set(), set(), set()
    for _, t, p, line in pairs:
        if (line, t) not in used_t and (line, p) not in used_p:
            used_t.add((line, t))
            used_p.add((line, p))
            out.add((line, t, p))
    return out


def side(rng, n, grid):
    rows = []
    for i in range(n):
        start = rng.randrange(grid) / 2
        rows.append((rng.choice(["l1", "l2"]), i, start, start + rng.choice([0.0, 0.5, 1.0, 1.5, 2.0, 3.0])))
    return rows


@pytest.mark.parametrize("seed,n,grid", [(1, 40, 60), (2, 40, 6), (3, 25, 3)])
def test_greedy_equals_brute_force(spark, seed, n, grid):
    """Dense grids give many equal scores and copies of the same interval."""
    rng = random.Random(seed)
    truth, predicted = side(rng, n, grid), side(rng, n, grid)
    out = mt.greedy_match(spark.createDataFrame(truth, SIDE), spark.createDataFrame(predicted, SIDE), ["line_id"], target_rows=5 if seed == 3 else 1_000_000)
    assert {(r.line_id, r.t_idx, r.p_idx) for r in out.collect()} == brute(truth, predicted)


def test_copies_match_in_one_round(spark):
    truth = [("l", i, 0.0, 1.0) for i in range(30)]
    predicted = [("l", i, 0.0, 1.0) for i in range(20)]
    out = mt.greedy_match(spark.createDataFrame(truth, SIDE), spark.createDataFrame(predicted, SIDE), ["line_id"])
    assert {(r.line_id, r.t_idx, r.p_idx) for r in out.collect()} == {("l", 29 - i, 19 - i) for i in range(20)}


@pytest.mark.parametrize("size", [4, 1_000_000])
def test_long_chain(spark, size):
    """A chain of 300 candidates whose scores rise all along, the slowest case for rounds; cut to 12 where only rounds fit."""
    n = 300 if size > 4 else 12
    edges, at, width = [], 0.0, 100.0
    for i in range(n):
        edges.append((at, at + width))
        at += width * (0.28 - 0.1 * i / n)
    truth = [("l", i, *e) for i, e in enumerate(edges) if i % 2 == 0]
    predicted = [("l", i, *e) for i, e in enumerate(edges) if i % 2]
    out = mt.greedy_match(spark.createDataFrame(truth, SIDE), spark.createDataFrame(predicted, SIDE), ["line_id"], target_rows=size)
    assert {(r.line_id, r.t_idx, r.p_idx) for r in out.collect()} == brute(truth, predicted)


def test_partition_report(spark):
    shape = "partition_id string, method string, " + SIDE
    truth = spark.createDataFrame([("x", "l", 0, 0.0, 2.0), ("x", "l", 1, 5.0, 6.0), ("z", "l", 0, 0.0, 9.0)], "partition_id string, " + SIDE)
    claims = spark.createDataFrame([("x", "image", "l", 0, 0.1, 2.0), ("x", "image", "l", 1, 5.0, 6.0), ("y", "image", "l", 0, 0.0, 1.0)], shape)
    methods = spark.createDataFrame([("x", "image"), ("x", "legacy"), ("y", "image")], "partition_id string, method string")
    got = {(r.partition_id, r.method, r.block): (r.truth_count, r.prediction_count, r.matched_count, r.recall) for r in mt.partition_report(truth, claims, methods, ["line_id"]).collect()}
    assert got == {
        ("x", "image", "all"): (2, 2, 2, 1.0), ("x", "image", "primary"): (1, 2, 1, 1.0), ("x", "legacy", "all"): (2, 0, 0, 0.0),
        ("x", "legacy", "primary"): (1, 0, 0, 0.0), ("y", "image", "all"): (0, 1, 0, 0.0), ("y", "image", "primary"): (0, 1, 0, 0.0),
    }


@pytest.mark.parametrize("size", [6, 1_000_000])
def test_overlap_counts(spark, size):
    rng = random.Random(8)
    truth, predicted = side(rng, 50, 40), side(rng, 50, 40)
    got = {(r.line_id, r.idx): r.overlaps for r in mt.overlap_counts(spark.createDataFrame(truth, SIDE), spark.createDataFrame(predicted, SIDE), ["line_id"], size).collect()}
    assert got == {(t[0], t[1]): sum(p[0] == t[0] and overlap(t[2:], p[2:]) > 0 for p in predicted) for t in truth}


def test_report(spark):
    truth = [("l1", 0, 0.0, 2.0), ("l1", 1, 3.0, 5.0), ("l2", 2, 0.0, 2.0)]
    predicted = [("l1", 0, 0.2, 2.0), ("l1", 1, 1.9, 2.1), ("l1", 2, 3.0, 4.8)]
    t, p = spark.createDataFrame([("x", *r) for r in truth], "part string, " + SIDE), spark.createDataFrame([("x", *r) for r in predicted], "part string, " + SIDE)
    r = mt.interval_report(t, p, ["part", "line_id"], ["part"]).first()
    assert (r.truth_count, r.prediction_count, r.matched_count) == (3, 3, 2)
    assert (r.precision, r.recall) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert (r.oversegmentation_extra_count, r.merged_truth_extra_count) == (1, 0)
    assert r.start_error_median_seconds == pytest.approx(0.1) and r.end_error_p95_seconds == pytest.approx(0.2)
    left = mt.unmatched_truth(t, mt.greedy_match(t, p, ["part", "line_id"]), ["part", "line_id"])
    assert [x.idx for x in left.collect()] == [2]
    empty = mt.interval_report(t, p.limit(0), ["part", "line_id"], ["part"]).first()
    assert (empty.precision, empty.recall, empty.start_error_median_seconds) == (0.0, 0.0, None)
    kept = mt.primary_subset(spark.createDataFrame([("l", 0, 0.0, 1.2), ("l", 1, 0.0, 1.1)], SIDE))
    assert [x.idx for x in kept.collect()] == [0]
