from __future__ import annotations

import random

import cases
import numpy as np

from cueweave.llm import language_id

SYLLABLES = {"aa": "ka lo mi ru te", "bb": "sch ung ein ver ich", "cc": "ção nho lha mos rre"}


def text(lang, rng, n):
    parts = SYLLABLES[lang].split(" ")
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(spark, rng, n):
    rows = [(i, text(lang, rng, rng.randint(5, 60)), lang, "s") for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(n))]
    return cases.documents(spark, rows)


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    docs = corpus(spark, rng, 400)
    model = language_id.fit(language_id.training_rows(docs))
    assert sorted(set(model.langs)) == sorted(SYLLABLES)
    out = language_id.identify(docs, model)
    rows = out.filter(language_id.held_out(out["row.doc_id"])).select("row.lang", "lang_pred", "score", "rejected").collect()
    assert len(rows) > 50 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 and not r.rejected for r in rows)


def test_rejects_what_is_far_and_keeps_columns(spark):
    rng = random.Random(2)
    model = language_id.fit(language_id.training_rows(corpus(spark, rng, 300)))
    foreign = "это совершенно другой язык и его здесь никто не знает потому что он далеко " * 3
    docs = cases.clashing(spark, [(1, text("aa", rng, 30)), (2, foreign), (3, None), (4, "123 !!"), (5, ""), (6, text("bb", rng, 30)), (6, text("bb", rng, 30))])
    out = language_id.keep_known(docs, model)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 6, 6]
    found = {r["row"].doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (3, 4, 5))


def test_prediction_does_not_depend_on_label_or_partitions(spark):
    docs = corpus(spark, random.Random(3), 200)
    a = language_id.fit(language_id.training_rows(docs))
    b = language_id.fit(language_id.training_rows(docs.repartition(7)))
    assert a.langs == b.langs and np.allclose(a.centres, b.centres, atol=1e-5) and np.allclose(a.idf, b.idf)


def test_awkward_and_empty(spark):
    docs = cases.awkward(spark)
    model = language_id.fit(language_id.training_rows(docs))
    assert language_id.identify(docs, model).count() == docs.count()
    none = language_id.fit(language_id.training_rows(cases.nothing(spark)))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(cases.nothing(spark), model).count() == 0


def test_counts_of_texts_side_by_side():
    one, two = language_id.counts(["ab", "xyz ab"]), language_id.counts(["xyz ab", "ab"])
    assert (one[0] == two[1]).all() and (one[1] == two[0]).all()
    assert one[0].sum() == 4 + 3 + 2


LATIN = {"dd": "wa zi ngu mbe kwa pya", "ee": "szcz rzy owie dło ąk cki"}


def test_rejects_an_unseen_language_of_the_same_script(spark):
    rng = random.Random(4)
    docs = corpus(spark, rng, 600)
    model = language_id.fit(language_id.training_rows(docs))
    for lang, syllables in LATIN.items():
        parts = syllables.split(" ")
        unseen = [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)) for n in range(5, 400, 5)]
        got = [model.rejected(score, size) for _, score, size in model.score(unseen)]
        assert sum(got) >= 0.95 * len(got), lang
    seen = [text(lang, rng, n) for lang in SYLLABLES for n in range(2, 400, 5)]
    assert [t for t, (_, score, size) in zip(seen, model.score(seen)) if model.rejected(score, size)] == []


def test_limits_of_sparse_and_missing_lengths():
    got = language_id.limits({3: {200: 5}, 8: {400: 1, 700: 400}, 9: {500: 300}, 12: {900: 1}})
    assert sorted(got) == list(language_id.CLASSES)
    assert np.allclose([got[i] for i in (1, 3, 8, 9, 10, 12, 30)], [0.08, 0.16, 0.32, 0.4, 0.4, 0.4, 0.4])
    assert language_id.limits({}) == {}


def test_language_of_many_copies_has_centroids(spark):
    rng = random.Random(5)
    rows = [(i, text("aa", rng, 20), "aa", "s") for i in range(40)]
    for few in ("bb", "cc"):
        own = [text(few, rng, 20) for _ in range(3)]
        rows += [(i, own[i % 3], few, "s") for i in range(3000)]
    model = language_id.fit(cases.documents(spark, rows).select("text", "lang"), sample=10)
    assert sorted(set(model.langs)) == sorted(SYLLABLES)
