"""Shared folder, written intermediates, row hashes and the registry of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Rows that Python workers get at a time: texts have no length limit, so batches are kept short.
BATCH_ROWS = 500


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its SQL."""

    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and keep Arrow batches short."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that ``spark.checkpoint.dir`` names; it goes when the session ends.

    A local temporary folder is used only where none is named and the master is local, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="cueweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files: lineage is cut and lost executors cost no rework."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing that is still to be computed reads them."""
    for df in tables:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: DuckDB text of a column with A-Z lowered and null as empty, for SQL counterparts.
SQL_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def located(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, text, ``whole`` (all columns), and ``_file`` and ``_row``, which identify a row.

    Rows that come from no file are written first, below ``folder`` if one is named.
    """
    columns = [F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")]
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    try:
        return docs.select(*columns, *place)
    except AnalysisException:
        if folder is None:
            return stored(docs.select(*columns), "input").select("doc_id", "text", "whole", *place)
        path = f"{folder}/{uuid.uuid4().hex}"
        docs.select(*columns).write.parquet(path)
        return docs.sparkSession.read.parquet(path).select("doc_id", "text", "whole", *place)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs``, a result of ``located``, that are not in ``gone``, with their own columns."""
    return docs.join(gone.select("_file", "_row"), ["_file", "_row"], "left_anti").select("whole.*")
