from __future__ import annotations

import random

import cases

from cueweave.llm import packing


def brute(pieces, capacity):
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = [
            i for i, (room, sources, clusters) in enumerate(bins)
            if room >= length and (source is None or source not in sources) and (cluster is None or cluster not in clusters)
        ]
        best = min(fits, key=lambda i: (bins[i][0], i), default=None)
        if best is None:
            best = len(bins)
            bins.append([capacity, set(), set()])
        room, sources, clusters = bins[best]
        out.append((best, capacity - room))
        bins[best][0] -= length
        sources.add(source)
        clusters.add(cluster)
    return out


def test_best_fit_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([1, 10, 50, 300])
        pieces = [(rng.randint(0, capacity), rng.choice([None, "hot", "hot", *range(8)]), rng.choice([None, *range(40)])) for _ in range(rng.randrange(120))]
        pieces.sort(key=lambda p: -p[0])
        assert packing.best_fit(pieces, capacity) == brute(pieces, capacity)


def check(rows, lengths, capacity):
    """Every word is in one piece; bins hold no more than they may and neither source nor cluster twice."""
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append((r.bin_offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, length in lengths.items():
        at = 0
        for start, part in sorted(pieces[doc_id]):
            assert start == at
            at += part
        assert at == length


def test_pack_is_whole_in_any_number_of_shards(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 5, 30, 64, 65, 200]), rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(30)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, length long, source string, cluster long")
    for shard in (20, 4096):
        got = packing.pack(docs, 64, shard).collect()
        check(got, {r[0]: r[1] for r in rows}, 64)
        by_id = {r[0]: r for r in rows}
        seen = set()
        for g in got:
            _, _, source, cluster = by_id[g.doc_id]
            for key in ((g.bin_id, "s", source), (g.bin_id, "c", cluster)):
                assert key[2] is None or key not in seen
                seen.add(key)


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    got = packing.pack_documents(docs, 64).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    assert [r.length for r in got if r.doc_id == 2] == [1] and sum(r.length for r in got if r.doc_id == 5) == 60_001
    assert packing.pack_documents(cases.nothing(spark)).count() == 0
    assert packing.pack_documents(cases.clashing(spark, [(1, "a b")])).count() == 1
