"""Benchmark decontamination by winnowing (operator 2).

Of every ``WINDOW - K + 1`` consecutive k-gram hashes of a text the smallest is its fingerprint there, so any run of
``WINDOW`` words that a document shares with an item has a fingerprint that both kept. Documents and items meet on
fingerprints; each meeting is extended word by word to both sides, which says exactly which windows are shared. An item
of fewer words than a window is one window: it meets the documents on the hash of all its words.

Before the join a bitmap of fixed size, built from the fingerprints of the items, drops document fingerprints that no
item has; what passes by chance falls out in the join.

Defined results: a null text has no words; an item without words never matches; items with equal text are all named;
an item whose id is null is named as the empty string; repeated documents get a row each; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import SQL_LOWERED, located, prepare, query, stored, table, without

#: Words of a window, and of a hashed k-gram.
WINDOW, K = 13, 5
#: Size of the bitmap in bits, as a power of two: 1 MB whatever the benchmark holds.
BITS = 23
#: A document is contaminated if one word in so many is hit.
SHARE = 20
#: Words whose hash a worker remembers.
REMEMBERED = 1_000_000

# Fixed value: a word, before A-Z are lowered.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

_hashes: dict[str, int] = {}


def hash_words(words: list[str]) -> np.ndarray:
    """64-bit hashes of the words with A-Z lowered."""
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    known = _hashes
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w.translate(LOWER).encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; runs of different n do not meet."""
    if len(h) < n:
        return h[:0]
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = (out ^ h[j : len(h) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnow(g: np.ndarray, size: int) -> np.ndarray:
    """Positions of the smallest hash of each ``size`` consecutive ones, the first of equals."""
    if len(g) < size:
        return np.zeros(0, np.int64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(g, size).argmin(axis=1) + np.arange(len(g) - size + 1))


def around(words: list[str], at: int, n: int, margin: int) -> tuple[int, str]:
    """How many words before ``at`` are given, and the words from there to ``margin`` after the run."""
    first = max(0, at - margin)
    return at - first, " ".join(words[first : at + n + margin]).translate(LOWER)


def item_prints(items: DataFrame, window: int, k: int) -> DataFrame:
    """fp, n, before, words, items: where a fingerprint of n words stands in the items; equal surroundings once."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(text or "")
                if not words:
                    continue
                n = k if len(words) >= window else len(words)
                g = grams(hash_words(words), n)
                for at in winnow(g, window - k + 1) if n == k and len(words) >= window else [0]:
                    rows.append((g[at : at + 1].view(np.int64)[0].item(), n if len(words) >= window else -n, *around(words, int(at), n, window - n if len(words) >= window else 0), item))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))], ["fp", "n", "before", "words", "item"]
            )

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    out = rows.mapInArrow(prints, "fp long, n int, before int, words string, item string")
    return out.groupBy("fp", "n", "before", "words").agg(F.collect_set("item").alias("items"))


def bitmap_of(prints: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the fingerprints; at most 2^bits positions reach the driver."""
    out = np.zeros(1 << bits >> 3, np.uint8)
    at = prints.select(F.col("fp").bitwiseAND((1 << bits) - 1).cast("int").alias("p")).distinct().toPandas()["p"].to_numpy(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def document_prints(docs: DataFrame, bitmap: np.ndarray, short: list[int], window: int, k: int, bits: int) -> DataFrame:
    """Per document: _file, _row, doc_id, n_words, and its fingerprints that the bitmap has. One pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = docs.schema["doc_id"].dataType.simpleString()
    hit = pa.list_(pa.struct([("fp", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("before", pa.int32()), ("words", pa.string())]))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, mask = shared.value, np.uint64((1 << bits) - 1)

        def known(g: np.ndarray) -> np.ndarray:
            p = (g & mask).astype(np.int64)
            return (seen[p >> 3] >> (p & 7).astype(np.uint8)) & 1

        for batch in batches:
            sizes, hits = [], []
            for text in batch.column(3).to_pylist():
                words = WORD.findall(text or "")
                h, own = hash_words(words), []
                g = grams(h, k)
                kept = winnow(g, window - k + 1)
                for n, g, places, margin in [(k, g, kept, window - k), *((-n, grams(h, n), None, 0) for n in short)]:
                    places = np.arange(len(g)) if places is None else places
                    for at in places[known(g[places]).astype(bool)].tolist():
                        before, run = around(words, at, abs(n), margin)
                        own.append({"fp": g[at : at + 1].view(np.int64)[0].item(), "n": n, "at": at, "before": before, "words": run})
                sizes.append(len(words))
                hits.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(hits, hit)], ["_file", "_row", "doc_id", "n_words", "hits"])

    rows = docs.select("_file", "_row", "doc_id", "text")
    hits = "array<struct<fp:bigint,n:int,at:int,before:int,words:string>>"
    return rows.mapInArrow(prints, f"_file string, _row bigint, doc_id {kind}, n_words bigint, hits {hits}")


def extended(meetings: DataFrame, window: int) -> DataFrame:
    """Meetings (at, n, before, words, item_before, item_words, ..) as the hit words [start, end) of the document, if any."""
    keep = ["_file", "_row", "items"]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, starts, ends = [], [], []
            for i, (at, n, before, words, other_before, other) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3, 9)))):
                a, b, n, need = words.split(" "), other.split(" "), abs(n), window if n > 0 else -n
                if a[before : before + n] != b[other_before : other_before + n]:
                    continue
                left = right = 0
                while left < min(before, other_before) and a[before - left - 1] == b[other_before - left - 1]:
                    left += 1
                while before + n + right < len(a) and other_before + n + right < len(b) and a[before + n + right] == b[other_before + n + right]:
                    right += 1
                if left + n + right >= need:
                    take.append(i)
                    starts.append(at - left)
                    ends.append(at + n + right)
            got = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), got.column(2), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [*keep, "start", "end"])

    rows = meetings.select(*keep, "at", "n", "before", "words", "item_before", "item_words")
    return rows.mapInArrow(extend, "_file string, _row bigint, items array<string>, start int, end int")


def _contamination(docs: DataFrame, items: DataFrame, window: int, k: int, bits: int) -> DataFrame:
    prepare(docs.sparkSession)
    prints = stored(item_prints(items, window, k), "item-prints")
    short = sorted(-r.n for r in prints.filter("n < 0").select("n").distinct().collect())
    marked = stored(document_prints(docs, bitmap_of(prints, bits), short, window, k, bits), "document-prints")
    theirs = prints.select("fp", "n", "items", F.col("before").alias("item_before"), F.col("words").alias("item_words"))
    meetings = marked.select("_file", "_row", F.explode("hits").alias("h")).select("_file", "_row", "h.*").join(theirs, ["fp", "n"])
    spans = extended(meetings, window).groupBy("_file", "_row").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))

    def cover(acc, s):
        return F.struct(F.greatest(acc.upto, s.end).alias("upto"), (acc.n + F.greatest(F.lit(0), s.end - F.greatest(acc.upto, s.start))).alias("n"))

    none = F.array().cast("array<string>")
    out = marked.drop("hits").join(spans, ["_file", "_row"], "left").withColumns(
        {"n_hit": F.coalesce(F.aggregate("spans", zero, cover).n, F.lit(0)).cast("long"), "items": F.coalesce("items", none)}
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, bits: int = BITS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, spans of hit words, n_hit, items (ids, sorted) and contaminated, for ``items`` (item_id, text)."""
    return _contamination(located(docs), items, window, k, bits)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows, columns as they were."""
    docs = located(docs)
    return without(docs, _contamination(docs, items, WINDOW, K, BITS).filter("contaminated"))


@query(
    "op2_decontamination",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    n AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, n, w[i : i + n - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM n)),
    sizes AS (SELECT DISTINCT n FROM win),
    dw AS (SELECT doc_id, n, i, w[i : i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
    hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
    places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
    words AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
    named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id
    """.replace("{LOWERED}", SQL_LOWERED),
)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
