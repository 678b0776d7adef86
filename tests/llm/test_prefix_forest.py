from __future__ import annotations

import math
import random

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from cueweave.llm import prefix_forest as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def brute(rows, k=5, every=10):
    """query -> [(id, score)] over all rows that take part."""
    kept = {(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    kept = sorted(kept)
    x = np.array([v for _, v in kept], float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(np.minimum(x @ x.T, 1), op.DIGITS)
    out = {}
    for a, (i, _) in enumerate(kept):
        if i % every == 0:
            out[i] = sorted((-s[a, b], j) for b, (j, _) in enumerate(kept) if j != i)[:k]
    return out


def normal(rng, d):
    return [rng.gauss(0, 1) for _ in range(d)]


def answered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((-round(r.score, op.DIGITS), r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    pairs = [(c in got.get(q, [])) for q, near in want.items() for c in near]
    return sum(pairs) / len(pairs)


def clustered(n, d=24):
    rng = random.Random(8)
    centre = normal(rng, d)
    rows = [(i, normal(rng, d)) for i in range(n)]
    rows += [(n + i, [c + 0.05 * e for c, e in zip(centre, normal(rng, d))]) for i in range(n // 3)]
    return rows + [(2 * n + i, centre) for i in range(n // 3)]


def test_recall_with_forced_prefixes(spark):
    """Cosines of the neighbours decide how far the trees ascend; a third of the rows are near copies, a third copies."""
    rows = clustered(900)
    got = answered(op.nearest(vectors(spark, rows), F.col("vec_id") % 10 == 0, block=64))
    want = brute(rows)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9


def test_root_is_exact(spark):
    rows = [(i, normal(random.Random(i), 16)) for i in range(300)]
    assert answered(op.nearest(vectors(spark, rows), F.col("vec_id") % 10 == 0, trees=2, block=50)) == brute(rows)


def test_prefixes_are_ascended_not_the_root(spark):
    """Close pairs in a large random table are found below prefixes, without meeting all entries."""
    rng = random.Random(2)
    rows = []
    for i in range(0, 1200, 6):
        v = normal(rng, 32)
        rows += [(i + j, [c + 0.2 * e for c, e in zip(v, normal(rng, 32))]) for j in range(6)]
    agree = op.agreement(op.DIRECTIONS)
    assert op.level(0.9, 32, 20, 0.1, agree) >= 4 and op.level(0.1, 32, 20, 0.1, agree) == 0
    got = answered(op.nearest(vectors(spark, rows), F.col("vec_id") % 10 == 0))
    assert recall(got, brute(rows)) >= 0.95


def test_ties_copies_and_odd_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(20)] + [(20, [2.0, 4.0, 6.0]), (21, [-1.0, 0.0, 0.0]), (0, same), (None, same)]
    rows += [(30, None), (40, []), (50, [0.0] * 3), (60, [math.nan, 1.0, 1.0]), (70, [None, 1.0, 1.0]), (80, [math.inf, 1.0, 1.0]), (90, [1.0])]
    got = answered(op.nearest(vectors(spark, rows), F.col("vec_id") % 10 == 0))
    assert {q: [c for _, c in near] for q, near in got.items()} == {0: [1, 2, 3, 4, 5], 10: [0, 1, 2, 3, 4], 20: [0, 1, 2, 3, 4]}


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_small_tables(spark, n):
    rows = [(10 * i, [1.0, float(i)]) for i in range(n)]
    out = op.nearest(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert answered(out) == {q: near for q, near in brute(rows).items() if near} if n else out.count() == 0


def test_clashing_columns(spark):
    rows = vectors(spark, [(i, normal(random.Random(i), 8)) for i in range(40)])
    clash = rows.select("*", *[F.lit(n).alias(n) for n in [*cases.CLASHING, "rep", "query", "cand", "low", "score", "block"]])
    assert answered(op.nearest(clash, F.col("vec_id") % 10 == 0)) == answered(op.nearest(rows, F.col("vec_id") % 10 == 0))
