"""Periodic runs in the words of a text by internal pattern matching (operator 11).

A run is a stretch of words with smallest period q, at least ``LEAST`` words and ``TIMES`` * q long, that no neighbouring
word extends. For the power of two B with q <= B < 2q a run of 4q words holds an aligned block of B words whose next or
previous occurrence lies inside the run, at distance q exactly: a nearer one would give the run a smaller period. So all
dyadic blocks ask for their occurrences in the windows of B words to both sides. Suffixes are sorted by doubling, which
gives each block its interval of the suffix array on the way; a wavelet tree over the suffix array answers which position
of the interval follows, or precedes, the block. Occurrences that near form an arithmetic progression, whose step is the
candidate period; a candidate is extended to both sides as far as the period holds. A multiple of q gives the same stretch,
so the smallest step of a stretch is its period.

Texts of one batch are laid end to end, and equal words of different texts are different symbols, so no block, and no
occurrence, crosses texts. Everything is a map over rows: nothing is shuffled, and a worker holds one text, or several
of together ``CHARS`` characters, at a time.

Defined results: a null text has no words; a text without a run has null figures, and the digest of the empty string for its
runs; runs of one length are reported by smallest start, then period; repeated rows get a row each; other columns are
never read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import prepare, query, table, text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")  # fixed value: a word
#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
#: Characters of the texts that are searched together; a longer text is searched alone.
CHARS = 1 << 20


class WaveletTree:
    """Counts and order statistics of ranges of an array of non-negative integers, for many ranges at once."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for bit in reversed(range(bits)):
            ones = (values >> bit) & 1 == 1
            packed = np.zeros((len(values) >> 6) + 1, np.uint64)
            packed.view(np.uint8)[: (len(values) + 7) >> 3] = np.packbits(ones, bitorder="little")
            before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            zeros = len(values) - int(before[-1])
            self.levels.append((bit, packed, before, zeros))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def ones(level: tuple[int, np.ndarray, np.ndarray, int], at: np.ndarray) -> np.ndarray:
        """How many ones stand before ``at`` on a level."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return level[2][word] + np.bitwise_count(level[1][word] & below)

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values of each range [low, high) are less than ``value``."""
        out = np.zeros(len(low), np.int64)
        for level in self.levels:
            a, b = self.ones(level, low), self.ones(level, high)
            one = (value >> level[0]) & 1 == 1
            out += np.where(one, (high - low) - (b - a), 0)
            low, high = np.where(one, level[3] + a, low - a), np.where(one, level[3] + b, high - b)
        return out

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with ``k`` smaller ones before it in each range [low, high)."""
        out = np.zeros(len(low), np.int64)
        for level in self.levels:
            a, b = self.ones(level, low), self.ones(level, high)
            zeros = (high - low) - (b - a)
            one = k >= zeros
            out += one.astype(np.int64) << level[0]
            k = np.where(one, k - zeros, k)
            low, high = np.where(one, level[3] + a, low - a), np.where(one, level[3] + b, high - b)
        return out


def suffixes(symbols: np.ndarray, levels: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Positions sorted by the 2^levels symbols that follow, and per level the aligned blocks that recur: position, and interval in that order.

    Positions with equal symbols form a group of the order, known by its first place; doubling splits the groups further,
    and touches only those of several positions.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    group = np.zeros(n + 1, np.int64)
    size = np.ones(n, np.int64)

    def number(places: np.ndarray, new: np.ndarray) -> None:
        """Group and size of the positions at ``places`` of the order, which hold whole groups; ``new`` marks where one begins."""
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(places)))
        group[order[places]] = np.repeat(places[first], counts)
        size[order[places]] = np.repeat(counts, counts)

    sorted_symbols = symbols[order]
    number(np.arange(n), np.append(True, sorted_symbols[1:] != sorted_symbols[:-1])[:n])
    group[n] = -1
    blocks = []
    for level in range(levels + 1):
        b = 1 << level
        at = np.arange(0, n, b)
        at = at[size[at] > 1]
        blocks.append((at, group[at], group[at] + size[at]))
        places = np.flatnonzero(size[order] > 1)
        if level == levels or not len(places):
            break
        at = order[places]
        following = group[np.minimum(at + b, n)]
        ranked = np.lexsort((following, group[at]))
        order[places] = at[ranked]
        own, following = group[at][ranked], following[ranked]
        number(places, np.append(True, (own[1:] != own[:-1]) | (following[1:] != following[:-1])))
    return order, blocks


def candidates(symbols: np.ndarray, position: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance, position and length of blocks that occur again at that distance, within a block's length; ``position`` counts within texts."""
    order, blocks = suffixes(symbols, levels)
    tree = WaveletTree(position[order], max(1, int(position.max(initial=0)).bit_length()))
    steps, places, lengths = [], [], []
    for level, (at, low, high) in enumerate(blocks):
        if not len(at):
            continue
        own = position[at]
        before = tree.below(low, high, own)
        for there, k in ((before + 1 < high - low, before + 1), (before > 0, before - 1)):
            found = tree.smallest(low[there], high[there], k[there])
            step = found - own[there]
            near = np.abs(step) <= 1 << level
            steps.append(np.abs(step[near]))
            places.append(at[there][near] + np.minimum(step[near], 0))
            lengths.append(np.full(int(near.sum()), 1 << level))
    if not steps:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(steps), np.concatenate(places), np.concatenate(lengths)


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many symbols two arrays have in common from their first on."""
    n, done, reach = min(len(a), len(b)), 0, 16
    while done < n:
        differ = a[done : min(n, done + reach)] != b[done : min(n, done + reach)]
        if differ.any():
            return done + int(differ.argmax())
        done, reach = done + reach, 2 * reach
    return n


def runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Per text, a list of symbols, its runs as (start, length, period), sorted."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if sizes.max(initial=0) < LEAST:
        return out
    starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    text = np.repeat(np.arange(len(texts)), sizes)
    plain = np.concatenate(texts)
    symbols = text * (int(plain.max()) + 1) + plain
    position = np.arange(len(symbols)) - starts[text]
    levels = max(0, (int(sizes.max()) // TIMES).bit_length())
    step, place, length = candidates(symbols, position, levels)
    owner = text[place] if len(place) else place
    found: dict[tuple[int, int, int], int] = {}
    last, reached = (-1, -1), -1
    for i in np.lexsort((place, step, owner)):
        d, at, doc = int(step[i]), int(place[i]), int(owner[i])
        if (doc, d) == last and at < reached:
            continue  # inside the stretch just extended
        begin, end = int(starts[doc]), int(starts[doc + 1])
        right = at + agreeing(symbols[at : end - d], symbols[at + d : end])
        left = at - agreeing(symbols[begin:at][::-1], symbols[begin + d : at + d][::-1])
        last, reached = (doc, d), right
        total = right + d - left
        if total >= max(LEAST, TIMES * d):
            key = (doc, left - begin, total)
            found[key] = min(found.get(key, d), d)
    for (doc, start, total), d in found.items():
        out[doc].append((start, total, d))
    for each in out:
        each.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    """The words without those that repeat an earlier period of some run, joined by one space."""
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return " ".join(w for w, k in zip(words, kept.tolist()) if k)


def groups(texts: list[list[str]]) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of together ``CHARS`` characters at most, or of one text."""
    begin = total = 0
    for i, words in enumerate(texts):
        chars = sum(map(len, words)) + len(words)
        if i > begin and total + chars > CHARS:
            yield begin, i
            begin, total = i, 0
        total += chars
    if begin < len(texts):
        yield begin, len(texts)


Planted = Callable[[list[str], str | None], list[str]]
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, change: Planted | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, runs (by start, then period) and collapsed.

    ``change`` maps the words and the decimal doc_id (null if it is) of a row to the words that are searched.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [WORD.findall(t) for t in batch.column(2).to_pylist()]
            if change:
                texts = [change(words, name) for words, name in zip(texts, batch.column(1).to_pylist())]
            for begin, end in groups(texts):
                part, known = texts[begin:end], {}
                codes = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in part]
                found = runs(codes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin), pa.array(map(len, part), pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r)) for r in each] for each in found], run),
                        pa.array([collapsed(words, each) for words, each in zip(part, found)], pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("name"), text_of().alias("text"))
    return rows.mapInArrow(find, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def planted(words: list[str], name: str | None) -> list[str]:
    """A tenth of the texts, by the checksum of their id, repeats a stretch of its own words up to its end."""
    h = zlib.crc32(name.encode()) if name is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query(
    "op11_periodic_runs",
    r"""
    WITH bytes AS (SELECT DISTINCT doc_id, [ord(c) FOR c IN string_split(doc_id::VARCHAR, '')] AS b FROM documents),
    steps AS (SELECT doc_id, list_concat([4294967295::BIGINT], flatten([[x::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN b])) AS s FROM bytes),
    sums AS (
        SELECT doc_id, xor(4294967295::BIGINT, list_reduce(s, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END)) AS h FROM steps
    ),
    t AS (
        SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w, h % 10 = 0 AS planted, h // 10 AS g
        FROM documents LEFT JOIN sums USING (doc_id)
    ),
    p AS (SELECT doc_id, w, planted AND len(w) > 0 AS planted, g % greatest(len(w), 1) AS a, g FROM t),
    words AS (
        SELECT doc_id, CASE WHEN planted THEN list_concat(w[1 : a], [w[a + 1 + i % (1 + (len(w) - a) // (3 + g % 8))] FOR i IN range(len(w) - a)]) ELSE w END AS w FROM p
    ),
    one AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM words),
    same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM one x JOIN one y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
    stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
    runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
    each AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
            first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS best
        FROM runs GROUP BY doc_id
    ),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (SELECT one.doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM one ANTI JOIN gone ON gone.doc_id = one.doc_id AND gone.i = one.i GROUP BY one.doc_id)
    SELECT words.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
        (1000 * best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM words LEFT JOIN each ON each.doc_id = words.doc_id LEFT JOIN kept ON kept.doc_id = words.doc_id
    """,
)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(table(spark, sf_dir, "documents"), planted)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), F.concat(r.period.cast("string"), F.lit("\n")))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed")
    out = out.withColumns({"start": F.col("best.start"), "length": -F.col("best.less"), "period": F.col("best.period")})
    return out.select(
        "doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
