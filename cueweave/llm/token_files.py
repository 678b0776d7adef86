"""Token ids in word-aligned files (operator 7).

Texts are encoded in ascending doc_id order and packed with Simple-8b: a 64-bit word holds a selector in its top four
bits and below it as many ids of one width as fit, from 60 of one bit to one of 60 bits. Selector 0 is an escape: the
next word is one id of up to 64 bits. Words lie in blocks of whole documents, a row of a Parquet file each, with the
number of ids before every 1,024th word, so that any stretch of a block can be decoded by itself. Packing and decoding
work on whole arrays: all words of one selector at once.

Defined results: a null text is empty and has the end id only; rows of one doc_id follow each other in any order; an
empty table gives files without rows; other columns are never read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import broadcast_if_small
from .common import prepare, query, scratch, table, text_of

#: (ids, bits) of selectors 1 to 14; selector 0 is the escape.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([1, *[n for n, _ in SELECTORS]])
#: A block is closed when it has so many ids; a document is never split.
BLOCK_IDS = 1 << 17
#: Words between two entries of a block's offsets.
STEP = 1024
#: Words of text whose ids a worker remembers.
REMEMBERED = 1_000_000


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of non-negative ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    width = np.zeros(len(padded), np.uint8)
    rest = padded.copy()
    for shift in (32, 16, 8, 4, 2, 1):
        big = rest >= (np.uint64(1) << np.uint64(shift))
        width[big] += shift
        rest[big] >>= np.uint64(shift)
    width += rest > 0
    largest = {1: width}  # largest width of the next 2^k ids
    for k in (1, 2, 4, 8, 16):
        largest[2 * k] = np.maximum(largest[k], np.concatenate([largest[k][k:], np.zeros(k, np.uint8)]))
    selector = np.zeros(n, np.uint8)
    for s in range(len(SELECTORS), 0, -1):
        count, bits = SELECTORS[s - 1]
        half = 1 << (count.bit_length() - 1)
        run = np.maximum(largest[half][:n], largest[half][count - half : count - half + n])
        selector[run <= bits] = s
    starts, at, jump = [], 0, COUNTS[selector].tolist()
    while at < n:
        starts.append(at)
        at += jump[at]
    starts = np.array(starts)
    chosen = selector[starts]
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(chosen == 0)[:-1]])
    words = np.zeros(len(starts) + int((chosen == 0).sum()), np.uint64)
    words[place[chosen == 0] + 1] = padded[starts[chosen == 0]]
    for s, (count, bits) in enumerate(SELECTORS, 1):
        mine = chosen == s
        if mine.any():
            parts = padded[starts[mine][:, None] + np.arange(count)] << (np.arange(count) * bits).astype(np.uint64)
            words[place[mine]] = np.bitwise_or.reduce(parts, axis=1) | np.uint64(s << 60)
    return words


def heads(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words that are no escaped values, and their selectors."""
    selector = (words >> np.uint64(60)).astype(np.uint8)
    if (selector == 0).any():
        at, keep = 0, []
        for s in selector.tolist() if len(words) else []:
            keep.append(at <= 0)
            at = 1 if keep[-1] and s == 0 else 0
        places = np.flatnonzero(np.array(keep))
        return places, selector[places]
    return np.arange(len(words)), selector


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of Simple-8b words."""
    places, selector = heads(words)
    ends = np.cumsum(COUNTS[selector])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - COUNTS[selector]
    out[starts[selector == 0]] = words[places[selector == 0] + 1]
    for s, (count, bits) in enumerate(SELECTORS, 1):
        mine = selector == s
        if mine.any():
            parts = (words[places[mine]][:, None] >> (np.arange(count) * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
            out[starts[mine][:, None] + np.arange(count)] = parts
    return out[:n]


def offsets(words: np.ndarray) -> np.ndarray:
    """Number of ids before each ``STEP``-th word; an escaped value counts with its escape."""
    places, selector = heads(words)
    ids = np.zeros(len(words) + 1, np.int64)
    ids[places + 1] = COUNTS[selector]
    return np.cumsum(ids)[:-1][::STEP]


# A tokenizer of this shape encodes every word by itself, so words can be remembered.
WORD_SHAPE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
    "suffix": "</w>",
}
_LETTERS, _NUMBERS, _BLANKS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")
NOT_LATIN = re.compile("[^\x00-\xff]|<\\|")


class Encoder:
    """The tokenizer of a file; where words are independent, each distinct one is encoded once.

    Texts with letters beyond Latin-1, or with what may be a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shape = json.loads(self.tokenizer.to_str())
        steps = (shape.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (
            shape.get("normalizer") == WORD_SHAPE["normalizer"]
            and steps[0].get("pattern") == {"Regex": WORD_SHAPE["split"]}
            and shape["model"].get("end_of_word_suffix") == WORD_SHAPE["suffix"]
            and not shape.get("post_processor")
        )
        self.known: dict[str, bytes] = {}
        ends = [0] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.endswith(WORD_SHAPE["suffix"])
        self.ends = np.array(ends, bool)

    def learn(self, words: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):  # a word that the tokenizer cuts differently among others
            for w in words:
                self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32).tobytes()
            return
        raw = ids.tobytes()
        self.known.update(zip(words, (raw[4 * a : 4 * b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words = [LATIN_WORD.findall(t.lower()) if self.by_word and not NOT_LATIN.search(t) else None for t in texts]
        new = set().union(*filter(None, words)).difference(self.known)
        if new:
            self.learn(sorted(new))
        get = self.known.__getitem__
        out = []
        for t, w in zip(texts, words):
            if w is None:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(np.frombuffer(b"".join(map(get, w)), np.uint32))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Write ``docs`` (doc_id, text) as blocks of packed ids under ``folder``, in ascending doc_id order.

    Files and the rows of each follow the order; ``part`` numbers the files, ``block`` the rows of one; ``start`` is the number of ids before a block in its file.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("text"), F.monotonically_increasing_id().alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, done, keys, parts, size, enc = TaskContext.get().partitionId(), 0, 0, [], [], 0, encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        key_type = None

        def close() -> pa.RecordBatch:
            words = pack(np.concatenate([x for p in parts for x in (p, end)]))
            cols = [[part], [block], [done], [keys], [[len(p) + 1 for p in parts]], [size], [words.astype("<u8").tobytes()], [offsets(words).tolist()]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(key_type), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["part", "block", "start", "doc_ids", "sizes", "n_ids", "words", "offsets"])

        for batch in batches:
            key_type = batch.column(0).type
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                keys.append(key)
                parts.append(ids)
                size += len(ids) + 1
                if size >= block_ids:
                    yield close()
                    block, done, keys, parts, size = block + 1, done + size, [], [], 0
        if keys:
            yield close()

    schema = f"part int, block int, start bigint, doc_ids array<{kind}>, sizes array<bigint>, n_ids bigint, words binary, offsets array<bigint>"
    rows.mapInArrow(blocks, schema).write.parquet(folder)


def part_starts(rows: DataFrame) -> DataFrame:
    """part, part_start: ids before each file. Blocks know their place in their file; one row per file says where it starts."""
    sizes = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of the documents in ``folder``."""
    prepare(spark)
    rows = spark.read.parquet(folder)
    kind = rows.schema["doc_ids"].dataType.elementType.simpleString()
    before = part_starts(rows)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts = batch.column(0)[i].values, np.array(batch.column(1)[i].as_py(), np.int64)
                ids = unpack(np.frombuffer(batch.column(3)[i].as_py(), "<u8"), batch.column(2)[i].as_py()).astype("<u4")
                cuts = np.concatenate([[0], np.cumsum(counts)])
                data = [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                start = cuts[:-1] + batch.column(4)[i].as_py()
                yield pa.RecordBatch.from_arrays([keys, pa.array(start), pa.array(counts), pa.array(data, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    found = rows.join(broadcast_if_small(before), "part").select("doc_ids", "sizes", "n_ids", "words", (F.col("part_start") + F.col("start")).alias("start"))
    return found.mapInArrow(documents, f"doc_id {kind}, start bigint, n_tokens bigint, ids binary")


def read_range(spark: SparkSession, folder: str, first: int, end: int) -> DataFrame:
    """start, ids: the ids of the corpus from number ``first`` up to ``end``, a row per block that holds some of them.

    Only blocks that overlap the range are decoded, each from the last offset at or before it up to the next one behind it.
    """
    prepare(spark)
    rows = spark.read.parquet(folder)
    placed = rows.join(broadcast_if_small(part_starts(rows)), "part").withColumn("start", F.col("part_start") + F.col("start"))
    some = placed.filter((F.col("start") < end) & (F.col("start") + F.col("n_ids") > first)).select("start", "n_ids", "words", "offsets")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, out = [], []
            for start, size, words, marks in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = max(first - start, 0), min(end - start, size)
                words, marks = np.frombuffer(words, "<u8"), np.array([*marks, size], np.int64)
                low, high = int(np.searchsorted(marks, a, "right")) - 1, int(np.searchsorted(marks, b))
                upto = len(words) if high == len(marks) - 1 else high * STEP
                ids = unpack(words[low * STEP : upto], int(marks[high] - marks[low]))
                starts.append(start + a)
                out.append(ids[a - marks[low] : b - marks[low]].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(out, pa.binary())], ["start", "ids"])

    return some.mapInArrow(cut, "start bigint, ids binary")


@query("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
