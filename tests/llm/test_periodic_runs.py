from __future__ import annotations

import hashlib
import random
import re

import cases
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cueweave.llm import periodic_runs as op


def brute(w):
    """Runs by trying every period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some(rng):
    out = []
    for _ in range(rng.randrange(8)):
        base = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 14))]
        out += (base * rng.randrange(1, 9))[: rng.randrange(1, 100)]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = [some(rng) for _ in range(rng.randrange(1, 8))]
        assert op.runs([np.array(t, np.int64) for t in texts]) == [brute(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
def test_any_texts(texts):
    assert op.runs([np.array(t, np.int64) for t in texts]) == [brute(t) for t in texts]


def test_wavelet_tree():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 300, 500)
    tree = op.WaveletTree(values, 9)
    low = rng.integers(0, 500, 400)
    high = np.minimum(500, low + rng.integers(1, 80, 400))
    pivot = rng.integers(0, 512, 400)
    assert tree.below(low, high, pivot).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(low, high, pivot)]
    k = rng.integers(0, 1 << 20, 400) % (high - low)
    assert tree.smallest(low, high, k).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(low, high, k)]


def test_long_text_is_quick():
    """A text of 300,000 words with long and short periods; time and memory follow its length."""
    text = np.concatenate([np.arange(50_000), np.tile(np.arange(20_000), 6), np.tile([1, 2], 60_000), np.zeros(10_000, np.int64)])
    assert [r[1:] for r in op.runs([text])[0]] == [(120_000, 20_000), (120_000, 2), (10_000, 1)]


def changed(words, name):
    import zlib

    h = zlib.crc32(name.encode()) if name else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_rows(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{w}" for w in some(rng))) for i in range(120)]
    rows += [(r.doc_id, r.text) for r in cases.awkward(spark).collect()]
    got = op.periodic_runs(cases.documents(spark, rows), op.planted).collect()
    assert len(got) == len(rows)
    want = []
    for doc_id, text in rows:
        words = changed(re.findall(r"[^\x20\x09-\x0D]+", text or ""), None if doc_id is None else str(doc_id))
        known: dict = {}
        found = brute([known.setdefault(w, len(known)) for w in words]) if len(words) < 2_000 else None
        gone = {i for s, n, q in found or () for i in range(s + q, s + n)}
        want.append((str(doc_id), len(words), found, " ".join(w for i, w in enumerate(words) if i not in gone) if found is not None else None))
    mine = [(str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got]
    for a, b in zip(sorted(mine, key=repr), sorted(want, key=repr)):
        assert a[:2] == b[:2] and (b[2] is None or a == b)


def test_query_columns(spark, tmp_path):
    docs = cases.clashing(spark, [(1, "a b " * 9 + "c"), (2, None), (3, "x")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op.op11_periodic_runs(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (rows[2].n_runs, rows[2].start, rows[2].exponent_milli, rows[2].runs_sha256, rows[2].collapsed_sha256) == (0, None, None, empty, empty)
    words = changed(("a b " * 9 + "c").split(), "1")
    (start, length, period), *_ = sorted(brute([ord(w) for w in words]), key=lambda r: (-r[1], r[0], r[2]))
    assert (rows[1].start, rows[1].length, rows[1].period, rows[1].exponent_milli) == (start, length, period, 1000 * length // period)
    assert op.periodic_runs(cases.nothing(spark)).count() == 0
