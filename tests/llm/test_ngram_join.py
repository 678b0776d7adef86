from __future__ import annotations

import random
import re

import cases
import numpy as np
import pytest

from cueweave.llm import ngram_join


def sets_of(rows, size):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def expected(rows, size, num, den):
    sets, up = sets_of(rows, size), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return sorted((str(rows[i][0]), len(sets[i]), str(least[root(i)])) for i in range(len(rows)))


def shown(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def near_copies(rng):
    rows, n = [], 0
    for length in (4, 9, 14, 22, 45, 90, 250, 700):
        base = cases.words(rng, length, 10**6)
        for _ in range(10):
            w = list(base)
            for _ in range(rng.randint(0, max(1, length // 25))):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = cases.words(rng, rng.randrange(2), 10**6)
                w = w or ["x"]
            rows.append((n, " ".join(w)))
            n += 1
    return rows


@pytest.mark.parametrize("size, num, den", [(3, 9, 10), (5, 8, 10)])
def test_against_brute_force(spark, size, num, den):
    rows = near_copies(random.Random(size))
    passage = " ".join(cases.words(random.Random(9), 60, 10**6))
    rng = random.Random(10)
    rows += [(1000 + i, passage + " " + " ".join(cases.words(rng, 80, 10**6))) for i in range(40)]
    assert shown(ngram_join.components(cases.documents(spark, rows), size, num, den)) == expected(rows, size, num, den)


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    got = [r for r in ngram_join.components(docs).collect()]
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by_id[1] == [(0, 1)] and by_id[2] == [(0, 2)] and by_id[3] == [(0, 3)]
    assert by_id[4] == [(1, 4)] * 2 and by_id[None] == [(1, 4)]
    assert by_id[5][0][1] == by_id[6][0][1] == 5
    assert ngram_join.components(cases.nothing(spark)).count() == 0


def test_drop_keeps_one_of_each_and_columns(spark):
    text = " ".join(cases.words(random.Random(2), 80, 10**6))
    docs = cases.clashing(spark, [(3, text), (2, text + " tail"), (2, text + " tail"), (9, None), (8, ""), (7, "other words entirely here now")])
    out = ngram_join.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 7, 8, 9]


def test_sets_within_the_limit_share_a_signature():
    rng = np.random.default_rng(4)
    for num, den in ((9, 10), (8, 10)):
        for docs in (10, 10**9):
            for n in (1, 3, 9, 12, 19, 30, 60, 150, 400, 1500):
                for _ in range(20):
                    a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                    b = a
                    while True:  # change b as long as the pair stays linked
                        c = np.unique(np.concatenate([np.delete(b, rng.integers(len(b))) if len(b) > 1 else b, rng.integers(0, 1 << 63, rng.integers(0, 3)).astype(np.uint64)]))
                        same = len(np.intersect1d(a, c))
                        if den * same < num * (len(a) + len(c) - same):
                            break
                        b = c
                    shared = np.intersect1d(ngram_join.signatures(a, num, den, docs), ngram_join.signatures(b, num, den, docs))
                    assert len(shared) or np.array_equal(a, b)


def test_sets_of_one_hash_are_told_apart(spark):
    rows = spark.createDataFrame([("f", 0, 7, 1), ("f", 1, 7, 1), ("f", 2, 7, 2), ("f", 3, 8, 1)], "_file string, _row long, set long, check long")
    got = {r._row: r.set for r in ngram_join.told_apart(ngram_join.stored(rows, "rows")).collect()}
    assert got[0] == got[1] and len({got[0], got[2], got[3]}) == 3 and got[3] == 8


def test_bitmap_pages(spark):
    from pyspark.sql import functions as F

    join = ngram_join.Join(3, 9, 10, 100, 21)
    values = spark.range(500).select(F.xxhash64("id").alias("v"))
    bitmap = join.bitmap(values).value
    every = np.array([r.v for r in values.collect()], np.int64).view(np.uint64)
    assert len(bitmap) == 1 << 15 and join.known(bitmap, every).all()
    assert int(np.bitwise_count(bitmap).sum()) == len(np.unique(every & np.uint64((1 << 21) - 1)))


def test_sets_cut_together_are_those_of_each_text(monkeypatch):
    import pyarrow as pa

    from cueweave.llm import shingles

    rng = random.Random(8)
    texts = ["", None, " \t\n", "A b", "a", "x" * 100 + " Y " + "X" * 100 + " y", "é ß   Q\x85q 　 z", "a\x00 a", "a" * 8 + " " + "a" * 9 + " b"]
    texts += [" ".join(cases.words(rng, rng.randrange(60), 40)) for _ in range(80)]
    for stretch in (1, 300, 1 << 22):
        monkeypatch.setattr(shingles, "STRETCH", stretch)
        for size in (1, 3, 5):
            cut, hashes = [], {}
            for first, end, h, at in shingles.shingle_sets(pa.array(["left out", *texts]).slice(1), size):
                assert first == len(cut)
                cut += [h[a:b] for a, b in zip(at[:-1], at[1:])]
                one = ngram_join.all_signatures(h, at, 9, 10, 100)
                for i in range(end - first):
                    assert np.array_equal(np.sort(one[0][one[1][i] : one[1][i + 1]]), np.sort(ngram_join.signatures(h[at[i] : at[i + 1]], 9, 10, 100)))
            for mine, want in zip(cut, sets_of(list(enumerate(texts)), size), strict=True):
                assert len(mine) == len(want) and (np.diff(mine) > 0).all()
                for other, known in hashes.items():
                    assert len(np.intersect1d(mine, np.frombuffer(other, np.uint64))) == len(want & known)
                hashes[mine.tobytes()] = want
