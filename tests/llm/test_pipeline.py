from __future__ import annotations

import random

import cases
import corpus_pipeline
from test_decontaminate import expected as contaminated
from test_ngram_join import expected as near

from cueweave.llm import common


def corpus(spark, folder):
    rng = random.Random(7)
    rows = []
    for i in range(120):
        rows.append((i, " ".join(cases.words(rng, rng.randint(40, 160), 2000)), "en", f"s{i % 3}"))
    rows += [(200 + i, rows[i][1].replace(" ", "  "), "en", "s1") for i in range(20)]
    rows += [(300 + i, rows[i][1] + " tail", "en", "s2") for i in range(20)]
    items = [(1, " ".join(cases.words(rng, 30, 2000))), (2, "tiny item")]
    rows += [(400, rows[50][1] + " " + items[0][1], "en", "s0"), (401, "tiny item", "en", "s0"), (402, None, None, None), (403, "...", "en", "s0")]
    cases.documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows, items = corpus(spark, folder)
    docs = common.table(spark, folder, "documents")
    columns, kept = docs.columns, {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            want = {i for i in kept if i not in (402, 403)}
        elif name == "exact_dedup":
            want = {i for i in kept if not 200 <= i < 220}
        elif name == "ngram_join":
            want = {int(c) for _, _, c in near(sorted(kept.items()), 5, 8, 10)}
        else:
            want = {d for d, *_, bad in contaminated(kept.items(), items) if not bad}
        assert set(got) == want, name
        kept = {i: kept[i] for i in want}
    pieces = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in pieces.collect()} == set(kept)
