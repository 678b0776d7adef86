from __future__ import annotations

import random

import cases
import numpy as np
import public_tokenizers
import pytest

from cueweave.llm import common, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("top", [2, 5, 300, 49_408, 1 << 33, (1 << 60) - 1, (1 << 64) - 1])
def test_pack_round_trip(top):
    rng = np.random.default_rng(1)
    for n in (0, 1, 59, 60, 61, 500, 3000):
        ids = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
        small = np.where(rng.random(n) < 0.9, ids % np.uint64(9), ids)
        for a in (ids, small):
            words = token_files.pack(a)
            assert (token_files.unpack(words, n) == a).all()
            marks = token_files.offsets(words)
            if top < 1 << 60 and len(words):
                at = (len(marks) - 1) * token_files.STEP
                assert (token_files.unpack(words[at:], n - marks[-1]) == a[marks[-1] :]).all()


def test_remembered_words_equal_the_tokenizer():
    rng = random.Random(2)
    encoder = token_files.Encoder(PATH)
    assert encoder.by_word
    texts = ["".join(chr(rng.randrange(256)) for _ in range(200)) for _ in range(200)]
    texts += ["", " ", "don't I'VE ''s 12½³", "ÀÉß ñandú", "Привет ΣΑΣ e\u0301", "a<|endoftext|>b", "x\x85y\xa0z\x1cw"]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in encoder.encode(texts)] == want == [g.tolist() for g in encoder.encode(texts)]


def test_write_and_read(spark):
    docs = cases.clashing(spark, [(5, "five words are in here"), (-1, None), (3, ""), (7, "x " * 3000), (7, "again"), (2**40, "last")])
    folder = common.scratch(spark, "tokens")
    token_files.write_tokens(docs, PATH, folder, end_id=1, block_ids=8)
    rows = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [-1, 3, 5, 7, 7, 2**40]
    encoder, at = token_files.Encoder(PATH), 0
    texts = {-1: [""], 3: [""], 5: ["five words are in here"], 7: ["x " * 3000, "again"], 2**40: ["last"]}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids) and ids in [[*i.tolist(), 1] for i in encoder.encode(texts[r.doc_id])]
        at += r.n_tokens


def test_awkward_and_empty(spark):
    for docs in (cases.awkward(spark), cases.nothing(spark)):
        folder = common.scratch(spark, "tokens")
        token_files.write_tokens(docs, PATH, folder)
        assert token_files.read_tokens(spark, folder).count() == docs.count()


@pytest.mark.parametrize("block_ids", [8, 4000, 10**6])
def test_ranges_equal_the_whole(spark, block_ids):
    rng = random.Random(block_ids)
    docs = cases.documents(spark, [(i, " ".join(cases.words(rng, rng.randrange(300), 10**4))) for i in range(60)])
    folder = common.scratch(spark, "tokens")
    token_files.write_tokens(docs, PATH, folder, block_ids=block_ids)
    every = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)])
    n = len(every)
    for first, end in [(0, n), (0, 1), (n - 1, n), (n, n + 5), (5, 5), (n // 3, n // 2), *[sorted(rng.sample(range(n), 2)) for _ in range(4)]]:
        rows = sorted(token_files.read_range(spark, folder, first, end).collect(), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in rows) == every[first:end].tobytes()
        assert not rows or rows[0].start == first
