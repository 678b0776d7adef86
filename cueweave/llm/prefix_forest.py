"""Nearest vectors by a forest of hash prefixes (operator 13).

Each of ``TREES`` trees gives a vector a hash string of ``SYMBOLS`` symbols; a symbol says which of ``DIRECTIONS`` random
directions, with its sign, is nearest to the vector, so close vectors share long prefixes. The strings of a tree are sorted
by a range exchange and cut into blocks of neighbouring entries, the sorted arrays of the forest.

A query first descends: in every tree it meets the entries around its own place, those with the longest common prefixes.
The k-th best cosine so far is a lower bound of the final one, and says how short a prefix must become until a vector at
least that near has been met in some tree with probability ``1 - MISS``: every symbol of two vectors agrees with a
probability that follows from their cosine. All trees then ascend to that prefix length together, at first no further than
to the shortest prefix below which they hold fewer entries than the table, and the query meets every entry there, however many.
A query whose k-th best cosine still asks for a shorter prefix ascends once more, to the root, which all trees share.
No list of candidates is cut; queries of one prefix are compared with a block by one product of matrices, and only the k
best of each block leave the task.

Equal vectors are one entry with their k + 1 smallest ids, which is all that the k nearest can need.

Defined results: rows without a vec_id, and vectors that are null, empty, zero, or hold a null or non-finite entry take no
part, nor do vectors of another length than most have; rows that repeat a vec_id with one vector count once, and a
candidate never has the query's vec_id; cosines that agree to twelve digits are ties, which go to the smaller vec_id;
an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import broadcast_if_small
from .common import prepare, query, stored, table
from .vectors import dimension, joined_back, usable

#: Trees, symbols of a string, directions of a symbol (twice as many values), and the chance of missing a vector as near as the k-th.
TREES, SYMBOLS, DIRECTIONS, MISS = 32, 20, 4, 0.1
#: Entries of a block, queries that are compared with a block at a time, and entries that a descent meets to each side.
BLOCK, TOGETHER, AROUND = 1024, 256, 32
#: Bytes of blocks that a worker gets at a time.
BATCH_BYTES = "4m"
#: Digits that decide about ties.
DIGITS = 12
FOUND = "query bigint, cand bigint, low bigint, score double"


def directions(tree: int, d: int, symbols: int, width: int) -> np.ndarray:
    """The random directions of a tree: the same for every task."""
    return np.random.default_rng([7, tree, d]).standard_normal((d, symbols * width))


def agreement(width: int, samples: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Cosines, and the probability that a symbol of two vectors at that cosine agrees."""
    rng = np.random.default_rng(11)
    x, z = rng.standard_normal((2, samples, width))
    grid = np.linspace(-1, 1, 201)
    own = symbols_of(x, width)
    share = [float((own == symbols_of(c * x + np.sqrt(max(0.0, 1 - c * c)) * z, width)).mean()) for c in grid]
    return grid, np.maximum.accumulate(share)


def symbols_of(x: np.ndarray, width: int) -> np.ndarray:
    """Symbols of projections, ``width`` to a symbol."""
    x = x.reshape(len(x), -1, width)
    best = np.abs(x).argmax(axis=2)
    negative = np.take_along_axis(x, best[:, :, None], 2)[:, :, 0] < 0
    return (2 * best + negative).astype(np.int64)


def level(score: float | None, trees: int, symbols: int, miss: float, agree: tuple[np.ndarray, np.ndarray]) -> int:
    """Longest prefix at which a vector at cosine ``score`` is missed with at most ``miss``; 0 if the root is cheaper or needed."""
    if score is None:
        return 0
    p = float(np.interp(score, *agree))
    for size in range(symbols, shortest(trees, symbols, agree) - 1, -1):
        if (1 - p**size) ** trees <= miss:
            return size
    return 0


def shortest(trees: int, symbols: int, agree: tuple[np.ndarray, np.ndarray]) -> int:
    """Shortest prefix below which the trees together hold fewer entries than the table, by chance; ``symbols`` + 1 if none is."""
    chance = float(np.interp(0.0, *agree))
    return next((size for size in range(1, symbols + 1) if trees * chance**size < 1), symbols + 1)


class Forest:
    """Shape of a forest over vectors of ``d`` entries."""

    def __init__(self, d: int, trees: int, symbols: int, width: int, miss: float, block: int) -> None:
        self.d, self.trees, self.symbols, self.width, self.miss, self.block = d, trees, symbols, width, miss, block
        self.bits = int(2 * width - 1).bit_length()

    def hashed(self, distinct: DataFrame) -> DataFrame:
        """``distinct`` (rep, low, asks, embedding) with its strings, one per tree."""
        kind = distinct.schema["embedding"].dataType.simpleString()

        def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes = [directions(t, self.d, self.symbols, self.width) for t in range(self.trees)]
            weights = 1 << (self.bits * np.arange(self.symbols - 1, -1, -1, dtype=np.int64))
            for batch in batches:
                x = units(batch.column(3), self.d)
                codes = np.stack([symbols_of(x @ p, self.width) @ weights for p in planes], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(codes), pa.list_(pa.int64()))], ["rep", "low", "asks", "embedding", "strings"])

        rows = distinct.select("rep", "low", "asks", "embedding")
        return rows.mapInArrow(string, f"rep bigint, low bigint, asks boolean, embedding {kind}, strings array<bigint>")

    def blocks(self, hashed: DataFrame) -> DataFrame:
        """The sorted arrays: block, tree, first, last, and the entries' strings, reps, lows, asks and vectors (end to end)."""
        entries = hashed.select(F.posexplode("strings").alias("tree", "string"), "rep", "low", "asks", "embedding")
        kind = hashed.schema["embedding"].dataType.simpleString()
        placed = entries.repartitionByRange("tree", "string", "rep").sortWithinPartitions("tree", "string", "rep")
        schema = f"block bigint, tree int, first bigint, last bigint, strings array<bigint>, reps array<bigint>, lows array<bigint>, asks array<boolean>, vectors {kind}"
        names = [part.split()[0] for part in schema.split(", ")]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, open_ = 0, []

            def closed(part: pa.Table) -> pa.RecordBatch:
                part = part.combine_chunks()
                column = {n: part.column(n).combine_chunks() for n in part.column_names}
                one = pa.array([0, part.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(one, column[n]) for n in ("string", "rep", "low", "asks")]
                vectors = pa.ListArray.from_arrays(pa.array([0, part.num_rows * self.d], pa.int32()), column["embedding"].flatten())
                head = [pa.array([(TaskContext.get().partitionId() << 32) + number]), pa.array([column["tree"][0].as_py()], pa.int32())]
                ends = [pa.array([column["string"][i].as_py()]) for i in (0, part.num_rows - 1)]
                return pa.RecordBatch.from_arrays([*head, *ends, *lists, vectors], names)

            def cut(last: bool) -> Iterator[pa.RecordBatch]:
                nonlocal number, open_
                rows = pa.Table.from_batches(open_)
                while rows.num_rows:
                    tree = rows.column("tree").to_numpy()
                    size = min(self.block, int(np.searchsorted(tree, tree[0], "right")))
                    if size == rows.num_rows < self.block and not last:
                        break
                    yield closed(rows.slice(0, size))
                    number, rows = number + 1, rows.slice(size)
                open_ = rows.to_batches()

            for batch in batches:
                open_.append(batch)
                if sum(b.num_rows for b in open_) >= self.block:
                    yield from cut(False)
            if open_:
                yield from cut(True)

        return placed.mapInArrow(pack, schema)

    def descended(self, blocks: DataFrame, k: int) -> DataFrame:
        """query, cand, low, score: the best that the asking entries of each block meet around their places."""

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    reps, lows, asks = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in range(3))
                    unit, out = units(batch.column(3)[row].values, self.d), []
                    for i in np.flatnonzero(asks):
                        begin, end = max(0, i - AROUND), i + AROUND + 1
                        out.append(best(reps[i : i + 1], unit[i : i + 1] @ unit[begin:end].T, reps[begin:end], lows[begin:end], k))
                    yield found(out)

        return blocks.select("reps", "lows", "asks", "vectors").mapInArrow(meet, FOUND)

    def visits(self, hashed: DataFrame, levels: DataFrame, blocks: DataFrame) -> DataFrame:
        """block, asked: which queries (rep, low and high string, vector) meet which block, at most about ``TOGETHER`` to a row."""
        own = hashed.join(levels, F.col("rep") == F.col("query")).select("rep", "embedding", "strings", "level")
        heads = blocks.select("block", "tree", "first", "last")
        rest = F.lit(self.symbols) - F.col("level")
        below = F.call_function("shiftleft", F.lit(1).cast("long"), (rest * self.bits).cast("int")) - 1
        top = self.bits * (self.symbols - 1)
        asked = own.filter("level > 0").select("rep", "embedding", F.posexplode("strings").alias("tree", "string"), below.alias("below"))
        low = F.col("string").bitwiseAND(F.bitwise_not("below"))
        asked = asked.select("rep", "embedding", "tree", low.alias("low"), (low + F.col("below")).alias("high"), F.shiftright("string", top).alias("start"))
        begins = heads.select("block", "tree", "first", "last", F.explode(F.sequence(F.shiftright("first", top), F.shiftright("last", top))).alias("start"))
        met = asked.join(broadcast_if_small(begins), ["tree", "start"]).filter("low <= last and high >= first").drop("start", "tree", "first", "last")
        met = stored(met, "forest-visits")
        sizes = met.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))
        ask = F.struct("rep", "low", "high", "embedding")
        met = met.join(broadcast_if_small(sizes), "block").groupBy("block", F.pmod(F.xxhash64("rep"), "parts").alias("part"))
        met = met.agg(F.collect_list(ask).alias("asked")).select("block", "asked")

        # The root: all queries of a part meet all blocks of one tree.
        root = own.filter("level = 0").select("rep", F.lit(0).cast("long").alias("low"), F.lit((1 << 62) - 1).cast("long").alias("high"), "embedding")
        n = -(-root.count() // TOGETHER)
        if not n:
            return met
        parts = stored(root.groupBy(F.pmod(F.xxhash64("rep"), F.lit(n)).alias("part")).agg(F.collect_list(ask).alias("asked")), "root-queries")
        every = heads.filter("tree = 0").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("part"))
        return met.unionByName(every.join(parts, "part").select("block", "asked"))

    def ascended(self, visits: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
        """query, cand, low, score: the best of each block below the prefixes that ``visits`` ask for."""

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    strings, reps, lows = (batch.column(c)[row].values.to_numpy() for c in range(3))
                    unit, out = units(batch.column(3)[row].values, self.d), []
                    asked = batch.column(4)[row].values
                    query, low, high = (asked.field(c).to_numpy() for c in range(3))
                    vectors = units(asked.field(3), self.d)
                    begin, end = np.searchsorted(strings, low), np.searchsorted(strings, high, "right")
                    order = np.lexsort((end, begin))
                    new = np.flatnonzero(np.append(True, (np.diff(begin[order]) != 0) | (np.diff(end[order]) != 0)))
                    for some in np.split(order, new[1:]):
                        a, b = begin[some[0]], end[some[0]]
                        out.append(best(query[some], vectors[some] @ unit[a:b].T, reps[a:b], lows[a:b], k))
                    yield found(out)

        rows = visits.join(blocks, "block").select("strings", "reps", "lows", "vectors", "asked")
        return rows.mapInArrow(meet, FOUND)


def units(vectors: pa.Array, d: int) -> np.ndarray:
    """Vectors, a list of each or end to end, scaled to length one."""
    x = vectors.flatten() if pa.types.is_list(vectors.type) else vectors
    x = x.to_numpy().reshape(-1, d).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best(query: np.ndarray, scores: np.ndarray, reps: np.ndarray, lows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best candidates of each query (a row of ``scores``) by rounded score, then smallest id, without the query itself."""
    scores = np.where(reps[None, :] == query[:, None], -np.inf, np.minimum(scores, 1.0))
    keys = np.round(scores, DIGITS)
    if scores.shape[1] > k:
        least = -np.partition(-keys, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero((keys >= least) & np.isfinite(keys))
    else:
        row, col = np.nonzero(np.isfinite(keys))
    order = np.lexsort((lows[col], -keys[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    row, col = row[kept], col[kept]
    return query[row], reps[col], lows[col], scores[row, col]


def found(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "cand", "low", "score"])


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k best candidates per query, each once."""
    once = rows.groupBy("query", "cand", "low").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.round("score", DIGITS).desc(), "low", "cand")
    return once.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)


def nearest(
    rows: DataFrame, asks: Column, k: int = 5, trees: int = TREES, symbols: int = SYMBOLS, width: int = DIRECTIONS, miss: float = MISS, block: int = BLOCK
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` vectors of ``rows`` (vec_id, embedding) nearest by cosine to each row that ``asks`` selects by vec_id."""
    prepare(rows.sparkSession)
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)  # a row is a whole block
    takes_part = F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda c: c != 0)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(takes_part)
    d = dimension(rows, "embedding")
    rows = rows.filter(F.size("embedding") == d)

    # Different vectors, and which of them each row has.
    distinct = rows.groupBy("embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"), F.max(asks.cast("int")).cast("boolean").alias("asks"))
    distinct = stored(distinct.withColumn("rep", F.monotonically_increasing_id()), "different-vectors")
    total = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    placed = joined_back(rows, distinct.select("embedding", "copies", "rep"), "embedding", "copies", total)
    placed = stored(placed.select("vec_id", "rep", "copies"), "placed-vectors")
    smallest = Window.partitionBy("rep").orderBy("vec_id")
    several = placed.filter("copies > 1").withColumn("at", F.dense_rank().over(smallest)).filter(F.col("at") <= k + 1)
    ids = several.groupBy("rep").agg(F.collect_set("vec_id").alias("ids")).unionByName(placed.filter("copies = 1").select("rep", F.array("vec_id").alias("ids")))

    # The forest: descend, then ascend.
    forest = Forest(d, trees, symbols, width, miss, block)
    hashed = stored(forest.hashed(distinct), "hash-strings")
    blocks = stored(forest.blocks(hashed), "forest-blocks")
    near = stored(top(forest.descended(blocks, k), k), "descended")
    agree = agreement(width)
    needed = [level((i - 100) / 100, trees, symbols, miss, agree) for i in range(201)]
    far = shortest(trees, symbols, agree)
    asking = hashed.filter("asks").select(F.col("rep").alias("query"))

    def ascent(near: DataFrame, asking: DataFrame, by_score: list[int], other: int) -> DataFrame:
        """query and the prefix that its k-th best cosine asks for."""
        at = F.floor(F.greatest(F.col("score"), F.lit(-1.0)) * 100).cast("int") + 100
        kth = near.filter(F.col("at") == k).select("query", F.array(*[F.lit(v) for v in by_score])[at].alias("level"))
        return asking.join(kth, "query", "left").select("query", F.coalesce("level", F.lit(other)).alias("level"))

    def searched(near: DataFrame, levels: DataFrame) -> DataFrame:
        met = forest.ascended(forest.visits(hashed, levels, blocks), blocks, k)
        return stored(top(near.drop("at").unionByName(met), k), "nearest-vectors")

    first = far if far <= symbols else 0
    levels = stored(ascent(near, asking, [v or first for v in needed], first), "forest-levels")
    best_reps = searched(near, levels)
    if first:
        again = ascent(best_reps, levels.filter(F.col("level") == first).select("query"), needed, 0)
        again = stored(again.filter("level = 0"), "forest-levels")
        best_reps = searched(best_reps, again)

    # Back to rows: a query's own copies are at cosine one.
    pairs = best_reps.select("query", "cand", "score").unionByName(asking.select("query", F.col("query").alias("cand"), F.lit(1.0).alias("score")))
    named = pairs.join(ids, F.col("cand") == F.col("rep")).select("query", "score", F.explode("ids").alias("vec_id"))
    named = named.groupBy("query").agg(F.collect_list(F.struct((-F.round("score", DIGITS)).alias("key"), "vec_id", "score")).alias("all"))
    own = placed.filter(asks).select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")).distinct()
    answers = stored(named.join(own.groupBy("query").agg(F.count(F.lit(1)).alias("copies")), "query"), "answers")
    out = joined_back(own, answers, "query", "copies", total)
    others = F.slice(F.array_sort(F.filter("all", lambda c: c.vec_id != F.col("query_id"))), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("at", "c"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score"))


@query("op13_nearest_vectors")
def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
