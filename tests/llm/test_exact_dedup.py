from __future__ import annotations

import random
import re

import cases
from pyspark.sql import functions as F

from cueweave.llm import exact_dedup


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    first = {k: min(v, key=lambda x: (x is not None, x or 0)) for k, v in groups.items()}
    return sorted((str(d), str(first[k]), len(v)) for k, v in groups.items() for d in v)


def shown(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in df.collect())


def test_awkward_rows(spark):
    docs = cases.awkward(spark)
    out = exact_dedup.exact_dedup(docs)
    assert shown(out) == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert out.filter("kept").count() == out.select("keep_id", "digest").distinct().count()


def test_weak_digest_compares_whole_texts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(cases.words(rng, 2, 4))) for i in range(60)]
    weak = exact_dedup.exact_dedup(cases.documents(spark, rows), digest=lambda t: F.length(t).cast("string"))
    assert shown(weak) == expected(rows)


def test_drop_copies_keeps_columns_and_clashing_names(spark):
    docs = cases.clashing(spark, [(3, "x  y"), (1, "x y"), (2, "z"), (2, "z")])
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_runs_on_one_state_equal_one_run(spark, tmp_path):
    """Digests collide within and across runs; the second run finds the smallest row in either."""
    rng = random.Random(12)
    first = [(10 + i, " ".join(cases.words(rng, 2, 3))) for i in range(30)]
    second = [(i if i % 2 else 100 + i, " ".join(cases.words(rng, 2, 3))) for i in range(30)] + [(None, first[0][1]), (11, first[3][1])]
    weak = {"digest": lambda t: F.length(t).cast("string"), "state": f"file://{tmp_path}/state"}
    assert shown(exact_dedup.exact_dedup(cases.documents(spark, first), **weak)) == expected(first)
    both = {}
    for row in expected(first + second):
        both.setdefault(row[0], set()).add(row)
    got = shown(exact_dedup.exact_dedup(cases.documents(spark, second), **weak))
    assert len(got) == len(second) and all(row in both[row[0]] for row in got)
    third = exact_dedup.exact_dedup(cases.documents(spark, [(5000, second[0][1])]), **weak)
    assert shown(third) == [r for r in expected(first + second + [(5000, second[0][1])]) if r[0] == "5000"]


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(cases.nothing(spark)).count() == 0
    assert exact_dedup.drop_copies(cases.nothing(spark)).count() == 0
