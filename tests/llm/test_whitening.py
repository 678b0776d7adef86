from __future__ import annotations

import math
import random

import cases
import numpy as np
import pytest

from cueweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def expected(rows, weighted=True):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in kept], np.int64)
    fit = x if weighted else np.unique(x, axis=0)
    y = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(y.T @ y / len(fit))
    values, axes = values[::-1], axes[:, ::-1]
    z = (x - fit.mean(axis=0)) @ axes / np.sqrt(values)
    deviation = [sum((len(fit) * int(a) - int(s)) ** 2 for a, s in zip(row, fit.sum(axis=0))) for row in x]
    return [i for i, _ in kept], len(fit), deviation, z, values / values.sum()


def some(n, d=12, copies=5):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1 + 0.3 * j) for j in range(d)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(copies)] + [(None, rows[1][1]), (0, rows[0][1])]
    return rows + [(7, None), (8, []), (9, [None] * d), (10, [math.nan] * d), (11, [math.inf] + [0.0] * (d - 1)), (12, [1e20] * d), (13, [1.0])]


@pytest.mark.parametrize("weighted", [True, False])
@pytest.mark.parametrize("copies", [3, 400])
def test_against_numpy(spark, weighted, copies):
    rows = some(300, copies=copies)
    got = whitening.whiten(vectors(spark, rows), weighted=weighted).collect()
    ids, n, deviation, z, explained = expected([r for r in rows if r[1] and len(r[1]) == 12 and r[1][0] != 1e20], weighted)
    assert len(got) == 8 * len(ids)
    by = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - explained[r.component - 1]) < 1e-12
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    signs = {}
    for i, dev, row in zip(ids, deviation, z):
        for k in range(8):
            values = by[i, dev][k + 1]
            sign = signs.setdefault(k, 1 if values[0] * row[k] >= 0 else -1)
            assert all(abs(v - sign * row[k]) < 1e-8 for v in values)


def test_sums_and_deviations_beyond_doubles(spark):
    fit = whitening.Fit(3, [1 << 61, -(1 << 60)], np.ones(2), np.eye(2), 2.0)
    x = np.array([[1 << 52, 5], [0, 0]], np.int64)
    assert fit.deviations(x)[1] is None
    small = whitening.Fit(10**6, [10**11, 10**11], np.ones(2), np.eye(2), 2.0)
    assert small.deviations(np.array([[100_300, 99_000]], np.int64)) == [(10**6 * 300) ** 2 + (10**6 * 1000) ** 2]


def test_degenerate_tables(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        out = whitening.whiten(vectors(spark, rows))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0
    line = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (2, [2.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 6)) for r in line) == [(1, 1, 1.414214), (2, 1, 0.707107), (2, 1, 0.707107)]


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = vectors(spark, some(50))
    clash = rows.select("*", *[F.lit(n).alias(n) for n in [*cases.CLASHING, "x", "copies", "weight", "component"]])
    assert whitening.whiten(clash).count() == whitening.whiten(rows).count()
