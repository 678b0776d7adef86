"""Session helpers: settings the library relies on, and the one way lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "cueweave", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and UTC; keyword arguments use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_cueweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="cueweave-")) / "cueweave.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(str(archive))
    context._cueweave_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors and the driver see."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cueweave-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written files.

    The folder is the one the session names in ``spark.checkpoint.dir``. A folder of our
    own is only made where none is named and the master is local, as in tests.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_BATCH_BYTES, _BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Python workers get at most a few MB at a time: ten thousand texts, which have no length limit, take many times as much."""
    if int(spark.conf.get(_BATCH_SETTING).rstrip("b")) > _BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(_BATCH_BYTES))


def _path_of(spark: SparkSession, folder: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """Write a large ``df`` to the shared checkpoint folder as Parquet and continue from the files.

    Checkpoints hold plain rows, which take several times as much disk as these columns. The files go with ``discard``, or
    else when the session ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    where, system = _path_of(spark, folder)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` wrote, once nothing that is still to be computed reads them."""
    for df in tables:
        where, system = _path_of(df.sparkSession, df._folder)
        system.delete(where, True)


_PARTITION_BYTES = 64 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a compute-bound step all cores when its input is too small to fill them.

    Small inputs end up in one partition (one file, or one coalesced shuffle). Only where the
    planner's size estimate stays below one usual partition per core are rows spread, by ``keys``
    if given, so that the grouping or window that follows needs no further shuffle. Larger
    inputs are returned as they are, and so are those read straight from a file or more per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not keys and df._jdf.queryExecution().executedPlan().nodeName() != "AdaptiveSparkPlan" and len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *keys) if size < cores * _PARTITION_BYTES else df


BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a lookup table for broadcast after measuring it; a larger one is joined by shuffle.

    The planner cannot see the size of a table that comes out of a Python map or an aggregate,
    and would shuffle the big side before finding out.
    """
    row = F.octet_length(F.concat_ws("", *[F.col(c).cast("string") for c in df.columns]))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0))).first()
    return F.broadcast(df) if size + 64 * rows <= limit else df


PART_ROWS = 500_000


def distinct_in_parts(df: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Distinct rows of a table most of whose rows differ.

    A map-side table of them would hold nearly all rows of an input split and take memory as splits grow. Rows are shuffled
    as they are instead, into as many parts as keep each at about ``part_rows``; adaptive execution does not merge them.
    """
    return df.repartition(df.count() // part_rows + 1, *df.columns).distinct()


def join_on(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys``; without keys both sides have one row, which meets on a constant."""
    keys = list(keys)
    if keys:
        return a.join(b, keys, how)
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one", how).drop("_one")
