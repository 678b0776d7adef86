"""Best-fit packing with conflicts (operator 4).

Documents are cut into pieces of at most ``CAPACITY`` words (an end mark counts as one) and packed into bins of that
size. No bin holds two pieces of one source or of one duplicate cluster, so a training sequence never repeats a text or
mixes texts of one place. Pieces come in order of falling length; bins stand in lists by what is left in them, and each
carries a bitmap of its sources and one of its clusters. A piece takes the bin with the least sufficient room; where that
bin conflicts the search goes on to its successor until a bin is compatible, and opens a new bin if none is.

Pieces are dealt by hash into shards of about ``SHARD`` pieces, each packed by itself: memory and search are bounded by
the shard, and a hot source or cluster is spread over all shards. What sharding costs is at most the open bins of a shard.

Defined results: a text without words is one piece of its end mark; a null source or cluster conflicts with nothing;
pieces of one document are of one cluster and source and so lie in different bins; equal pieces go by doc_id, bins with
equal room by age; repeated rows are packed as rows of their own; other columns are never read.
"""

from __future__ import annotations

from bisect import insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import prepare, query, stored, table, text_of
from .exact_dedup import normalized

CAPACITY = 2048
SHARD = 4096


def best_fit(pieces: list[tuple[int, object, object]], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset in it) of each piece (length, source, cluster), taken in the order given."""
    bits: tuple[dict, dict] = ({}, {})
    carried: list[list[int]] = []  # bitmap of sources and of clusters of each bin
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    out = []
    for length, *keys in pieces:
        own = [0 if key is None else 1 << seen.setdefault(key, len(seen)) for key, seen in zip(keys, bits)]
        left, chosen, room = rooms >> length, None, 0
        while left and chosen is None:
            room = length + (left & -left).bit_length() - 1
            for b in by_room[room]:
                if not (carried[b][0] & own[0] or carried[b][1] & own[1]):
                    chosen = b
                    break
            left &= left - 1
        if chosen is None:
            chosen, room = len(carried), capacity
            carried.append([0, 0])
        else:
            by_room[room].remove(chosen)
            if not by_room[room]:
                rooms &= ~(1 << room)
        carried[chosen][0] |= own[0]
        carried[chosen][1] |= own[1]
        out.append((chosen, capacity - room))
        insort(by_room[room - length], chosen)
        rooms |= 1 << (room - length)
    return out


def word_count(text: Column) -> Column:
    bare = F.trim(normalized(text))
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1)


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Pieces of ``docs`` (doc_id, length, source, cluster) with their bins: doc_id, piece, start, length, bin_id, bin_offset.

    A document of a length that is no positive number has one empty piece.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    length = F.greatest(F.coalesce(F.col("length"), F.lit(0)), F.lit(0)).cast("long")
    cut = docs.select("doc_id", "source", "cluster", length.alias("whole"), F.monotonically_increasing_id().alias("row"))
    last = F.greatest(F.ceil(F.col("whole") / capacity) - 1, F.lit(0))
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("start", F.col("piece") * capacity)
    cut = cut.select(
        "doc_id", "piece", "start", F.least(F.lit(capacity), F.col("whole") - F.col("start")).alias("length"),
        F.xxhash64("source").alias("s"), F.col("source").isNotNull().alias("has_s"), F.xxhash64("cluster").alias("c"), F.col("cluster").isNotNull().alias("has_c"), "row",
    )
    cut = stored(cut, "pieces")
    shards = -(-cut.count() // shard) or 1
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        keys = [
            [key if has else None for key, has in zip(rows[k].to_pylist(), rows[h].to_pylist())] for k, h in (("s", "has_s"), ("c", "has_c"))
        ]
        got = best_fit(list(zip(rows["length"].to_pylist(), *keys)), capacity)
        number = rows["shard"][0].as_py() << 32
        return rows.select(["doc_id", "piece", "start", "length"]).append_column("bin_id", pa.array([number + b for b, _ in got], pa.int64())).append_column(
            "bin_offset", pa.array([o for _, o in got], pa.int64())
        )

    return cut.groupBy("shard").applyInArrow(place, f"doc_id {kind}, piece bigint, start bigint, length bigint, bin_id bigint, bin_offset bigint")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``docs`` (doc_id, text, source) packed by words, copies being one cluster."""
    text = text_of()
    return pack(docs.select("doc_id", (word_count(text) + 1).alias("length"), "source", F.xxhash64(normalized(text)).alias("cluster")), capacity)


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
