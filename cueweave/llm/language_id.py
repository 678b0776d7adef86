"""Language identification by nearest centroid (operator 1).

A text becomes a normalised TF-IDF vector of hashed letter n-grams (one to three letters, words bounded by blanks).
Document frequencies come from all training rows. Each language gets several centroids, by spherical k-means over a
bounded sample of its training rows. A text takes the language of the centroid with the largest cosine; its cosine is
its score. A text is rejected when it has no letter or when its cosine is below the limit for texts of its length,
which is ``SCALE`` times what all but one in a thousand training texts of that length reach. A length with few or no
training texts takes the least limit among the lengths around it that have enough together; below the shortest training text it
falls with the root of the length, as cosines do.

Defined results: a null text or one without a letter is ``und``, score 0, rejected; of centroids at one cosine the
first language in sorted order wins; without any training row everything is ``und``; repeated rows get one answer each;
other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import prepare, query, stored, table

#: Buckets of the hashed n-grams.
BUCKETS = 4096
#: Centroids of a language.
CLUSTERS = 4
#: Different training texts of a language that k-means sees, in expectation: the bound of the sample.
SAMPLE = 1000
#: Share of training texts of a length whose cosine lies below the unscaled limit, and the scale.
LOWEST, SCALE = 0.001, 0.8
#: Training texts that a limit rests on at least, and the length classes there are (bits of the length).
ENOUGH, CLASSES = 300, range(1, 33)
#: Rows that are turned into dense vectors at a time.
BLOCK = 128

_NO_LETTERS = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def counts(texts: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """Term counts: a row per text. Texts are laid end to end and hashed together."""
    rows = [f" {_NO_LETTERS.sub(' ', t.lower()).strip()} " for t in texts]
    size = np.array([len(r) for r in rows])
    codes = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(rows), dtype=np.int64) * buckets, size)
    last = np.repeat(np.cumsum(size), size)  # first position after the text
    total = np.zeros(len(rows) * buckets)
    h = np.zeros(len(codes), np.uint32)
    for n in range(3):
        if len(codes) <= n:
            break
        h = h[: len(codes) - n] * np.uint32(31) + codes[n:] * _MULTIPLIERS[n]
        mixed = h ^ (h >> np.uint32(15))
        mixed = (mixed * np.uint32(2246822519)) >> np.uint32(20) if buckets == 4096 else (mixed * np.uint32(2246822519)) % np.uint32(buckets)
        inside = np.arange(len(h)) + n < last[: len(h)]
        total += np.bincount((row[: len(h)] + mixed)[inside], minlength=len(total))
        h = h[: len(codes) - n]
    return total.reshape(len(rows), buckets)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Normalised rows of (1 + log count) * idf."""
    x = counts(texts, len(idf))
    np.log1p(x, out=x)
    x *= idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return (x / np.where(norm == 0, 1, norm)).astype(np.float32)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts at rows far from each other, ties to the first."""
    picked = [x.mean(axis=0)]
    near = x @ picked[0]
    centres = [x[int(np.argmin(near))]]
    while len(centres) < min(k, len(x)):
        near = np.maximum(near, x @ centres[-1])
        centres.append(x[int(np.argmin(near))])
    c = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.array([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    return c.astype(np.float32)


@dataclass
class Model:
    """Languages of the centroids, the centroids, idf, and the lowest cosine per length class."""

    langs: list[str]
    centres: np.ndarray
    idf: np.ndarray
    limits: dict[int, float]

    def score(self, texts: list[str]) -> Iterator[tuple[str, float, int]]:
        """Per text language, cosine and length class; the class is -1 without a letter."""
        for i in range(0, len(texts), BLOCK):
            block = texts[i : i + BLOCK]
            near = np.clip(vectors(block, self.idf) @ self.centres.T, 0, 1) if self.langs else np.zeros((len(block), 1))
            for t, k, s in zip(block, np.argmax(near, axis=1), near.max(axis=1)):
                if not self.langs or not _LETTER.search(t):
                    yield "und", 0.0, -1
                else:
                    yield self.langs[k], float(s), len(t).bit_length()

    def rejected(self, score: float, length: int) -> bool:
        return length < 0 or score < self.limits.get(length, 0.0)


def limits(bins: dict[int, dict[int, int]]) -> dict[int, float]:
    """Lowest cosine per length class from the counts of training texts by class and cosine in thousandths."""
    reached = {}
    for size, by in bins.items():
        below, least = 0, LOWEST * sum(by.values())
        for score in sorted(by):
            below += by[score]
            if below >= least:
                reached[size] = score
                break
    out = {}
    for size in CLASSES if reached else ():
        for reach in range(len(CLASSES)):
            around = [s for s in reached if abs(s - size) <= reach]
            if sum(sum(bins[s].values()) for s in around) >= ENOUGH or len(around) == len(reached):
                out[size] = SCALE * min(reached[s] for s in around) / 1000 * 0.5 ** (max(0, min(reached) - size) / 2)
                break
    return out


def fit(train: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE, buckets: int = BUCKETS) -> Model:
    """Model from ``train`` (text, lang). Only centroids, idf and limits, of fixed size per language, reach the driver."""
    prepare(train.sparkSession)
    train = train.filter("lang is not null and text is not null").select("text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(buckets, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), BLOCK):
                seen += (counts(texts[i : i + BLOCK], buckets) > 0).sum(axis=0)
            rows += len(texts)
        kinds = ["rows", *["bucket"] * buckets]
        keys = ["", *map(str, range(buckets))]
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys), pa.array([rows, *seen.tolist()], pa.int64())], ["kind", "key", "n"])

    found = train.select("text").mapInArrow(frequencies, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    rows = sum(r.n for r in found if r.kind == "rows")
    seen = np.zeros(buckets)
    for r in found:
        if r.kind == "bucket":
            seen[int(r.key)] = r.n
    idf = np.log((1 + rows) / (1 + seen)) + 1
    langs = {r.lang: r.n for r in train.groupBy("lang").agg(F.countDistinct(F.xxhash64("text")).alias("n")).collect()}
    if not langs:
        return Model([], np.zeros((0, buckets), np.float32), idf, {})

    # A share of the different texts of each language by their hash: the same rows for any partitioning and number of copies.
    share = F.create_map(*[F.lit(v) for lang, n in langs.items() for v in (lang, min(1.0, sample / n))])
    thin = train.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).dropDuplicates(["text", "lang"])

    def centre(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        c = k_means(vectors(sorted(rows["text"]), idf), clusters)
        return pd.DataFrame({"lang": key[0], "k": range(len(c)), "centre": [v.tolist() for v in c]})

    centres = sorted(thin.groupBy("lang").applyInPandas(centre, "lang string, k int, centre array<float>").collect(), key=lambda r: (r.lang, r.k))
    model = Model([r.lang for r in centres], np.array([r.centre for r in centres], np.float32), idf, {})

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(size, int(s * 1000)) for _, s, size in model.score(batch.column(0).to_pylist()) if size >= 0]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32())], ["size", "score"])

    bins: dict[int, dict[int, int]] = {}
    for r in train.select("text").mapInArrow(lengths, "size int, score int").groupBy("size", "score").count().collect():
        bins.setdefault(r["size"], {})[r["score"]] = r["count"]
    model.limits = limits(bins)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (any columns, with ``text``) as a struct ``row``, with lang_pred, score and rejected. One pass, no shuffle."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        got = list(m.score([t if isinstance(t, str) else "" for t in texts]))
        return pd.DataFrame({"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [m.rejected(g[1], g[2]) for g in got]})

    udf = F.pandas_udf(label, "lang_pred string, score double, rejected boolean")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), udf(F.col("text").cast("string")).alias("id"))
    return rows.select("row", "id.*")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` whose language is known, columns as they were."""
    return identify(docs, model).filter("not rejected").select("row.*")


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    return docs.filter(~held_out(F.col("doc_id"))).select("text", "lang")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
