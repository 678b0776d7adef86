"""Exact deduplication with keyed state that never expires (operator 9).

A stream reads a log of (digest, row identity, content locator) and keeps one state entry per digest in RocksDB:
the smallest row and the number of rows. The state is the index of everything seen. The log and the stream's checkpoint
lie in the ``state`` folder, so a later run with it goes on from there. Rows whose digest was seen more than once are then
compared with the kept row byte by byte, so two texts with one digest never count as equal; texts of earlier runs are
read again where their locator says.

Defined results: a null text is the empty text; of equal texts the smallest (doc_id, locator) stays, where a null
doc_id comes first; rows that repeat a doc_id are rows of their own; with a state, groups span all runs so far, a run
returns its own rows, and rows that are given again count again; other columns are neither read nor changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import located, prepare, query, scratch, stored, table, text_of, without

#: State on disk, closed after each task, so that an executor holds the files of running tasks only.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


#: Columns of the log besides doc_id.
LOGGED = [StructField("_file", StringType()), StructField("_row", LongType()), StructField("digest", StringType()), StructField("run", StringType())]


def normalized(text: Column) -> Column:
    """Each run of blanks as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def first_seen(log: str, schema: StructType, spark: SparkSession, state: str) -> DataFrame:
    """One row per digest ever logged: the smallest row and how many there were. ``log`` is a folder of Parquet files."""
    before = {name: spark.conf.get(name) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        rows = spark.readStream.schema(schema).parquet(log)
        keyed = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "_file", "_row")).alias("first"), F.count(F.lit(1)).alias("n"))
        run = keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
        found = spark.read.format("statestore").load(state)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    value = [f.name for f in found.schema["value"].dataType.fields]
    return found.select(
        F.col("key.digest").alias("digest"), F.col(f"value.`{value[0]}`").alias("first"), F.col(f"value.`{value[1]}`").alias("n")
    )


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, digest, and ``_file`` and ``_row`` that identify it.

    ``digest`` maps the normalised text to a string; a weak one gives the same result, with more rows compared. With
    ``state``, a folder that lasts, rows that come from no file are kept there.
    """
    return _dedup(located(docs, f"{state}/texts" if state else None), digest, state)


def earlier_texts(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, _file, _row, digest) with ``norm``, read from the files that the locators name."""
    files = [r._file for r in rows.select("_file").distinct().collect()]
    if not files:
        return rows.withColumn("norm", F.lit(""))
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    return rows.join(spark.read.parquet(*files).select(*place, normalized(text_of()).alias("norm")), ["_file", "_row"]).select("doc_id", "_file", "_row", "digest", "norm")


def _dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "_file", "_row", normalized(text_of()).alias("norm"))
    run, base = uuid.uuid4().hex, state or scratch(spark, "dedup-state")
    log = f"{base}/log"
    docs.select("doc_id", "_file", "_row", digest(F.col("norm")).alias("digest"), F.lit(run).alias("run")).write.mode("append").parquet(log)
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *LOGGED])
    seen = stored(first_seen(log, schema, spark, f"{base}/checkpoint"), "dedup-index")
    every = spark.read.schema(schema).parquet(log)
    logged = every.filter(F.col("run") == run)

    # Full comparison: only rows whose digest came more than once travel with their text.
    twice = seen.filter("n > 1").select("digest", "first")
    hits = docs.withColumn("digest", digest(F.col("norm"))).join(twice, "digest")
    if state:
        met = twice.join(logged.select("digest").distinct(), "digest", "left_semi")
        before = stored(every.filter(F.col("run") != run).join(met.select("digest"), "digest").select("doc_id", "_file", "_row", "digest"), "dedup-earlier")
        hits = hits.unionByName(earlier_texts(spark, before).join(met, "digest"))
    hits = stored(hits, "dedup-hits")
    own = F.struct("doc_id", "_file", "_row")
    kept = hits.filter(own.eqNullSafe(F.col("first"))).select("digest", F.col("norm").alias("kept_norm"))
    if state:  # a row that was given again; written, so that the join below can still split a hot digest
        kept = stored(kept.dropDuplicates(["digest"]), "dedup-kept")
    other = stored(hits.join(kept, "digest").filter("norm != kept_norm").select("doc_id", "_file", "_row", "digest", "norm"), "dedup-collisions")
    again = other.groupBy("digest", "norm").agg(F.min(own).alias("first2"), F.count(F.lit(1)).alias("n2"))
    moved = other.join(again, ["digest", "norm"]).select("_file", "_row", "first2", "n2").dropDuplicates(["_file", "_row"])
    fewer = other.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))

    out = logged.join(seen.join(fewer, "digest", "left"), "digest").join(moved, ["_file", "_row"], "left")
    out = out.withColumns(
        {
            "first": F.coalesce("first2", "first"),
            "n": F.when(F.col("first2").isNotNull(), F.col("n2")).otherwise(F.col("n") - F.coalesce("less", F.lit(0))),
        }
    )
    return out.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), own.eqNullSafe(F.col("first")).alias("kept"), "digest", "_file", "_row"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    docs = located(docs)
    return without(docs, _dedup(docs).filter("not kept"))


@query(
    "op9_exact_dedup",
    r"""
    WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
        doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM t
    """,
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
