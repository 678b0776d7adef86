from __future__ import annotations

import hashlib
import random
import re

import cases
import pytest

from cueweave.llm import decontaminate


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(docs, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    needles = {}
    for item, text in items:
        w = word.findall(lowered(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            needles.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w = word.findall(lowered(text))
        hit, found = set(), set()
        for n in {len(k) for k in needles}:
            for i in range(len(w) - n + 1):
                got = needles.get(tuple(w[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    found |= got
        names = ",".join(sorted(found))
        out.append((doc_id, len(w), len(hit), len(found), names, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def shown(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), ",".join(r["items"]), r.contaminated) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(cases.words(rng, rng.choice([1, 3, 8, 12, 13, 14, 30, 60]), 3000))) for i in range(30)] + [(30, None), (31, ""), (None, "Lone ITEM here")]
    items += [(32, items[4][1]), (33, "the the the the the the the the the the the the the the"), (34, items[7][1].upper())]
    docs = [(100, None), (101, ""), (102, "lone item HERE"), (103, "the " * 40)]
    for i in range(60):
        w = cases.words(rng, rng.randrange(0, 200), 3000)
        for _ in range(rng.randrange(3)):
            source = rng.choice(items)[1] or ""
            part = source.split(" ")
            a = rng.randrange(len(part))
            at = rng.randrange(len(w) + 1)
            w[at:at] = part[a : a + rng.choice([5, 12, 13, 20, 60])]
        docs.append((i, " ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert shown(decontaminate.contamination(cases.documents(spark, docs), bench)) == expected(docs, items)


def test_awkward_and_empty(spark):
    items = [(1, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = cases.awkward(spark)
    assert shown(decontaminate.contamination(docs, bench)) == expected([(r.doc_id, r.text) for r in docs.collect()], items)
    assert decontaminate.contamination(cases.nothing(spark), bench).count() == 0
    none = decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.filter("contaminated or n_hit > 0").count() == 0 and none.count() == docs.count()


def test_drop_keeps_columns(spark):
    docs = cases.clashing(spark, [(1, "clean text"), (2, "Bad Words"), (2, "Bad Words")])
    bench = spark.createDataFrame([(1, "bad words")], "item_id long, text string")
    out = decontaminate.drop_contaminated(docs, bench)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]


def test_every_long_shared_span_has_a_common_print():
    rng = random.Random(5)
    for _ in range(200):
        span = cases.words(rng, 13, 50)
        a, b = ([*cases.words(rng, rng.randrange(30), 50), *span, *cases.words(rng, rng.randrange(30), 50)] for _ in range(2))
        ga, gb = (decontaminate.grams(decontaminate.hash_words(w), 5) for w in (a, b))
        pa, pb = (set(g[decontaminate.winnow(g, 9)].tolist()) for g in (ga, gb))
        inside = set(decontaminate.grams(decontaminate.hash_words(span), 5).tolist())
        assert pa & pb & inside


def test_digest_of_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
