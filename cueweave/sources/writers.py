"""Sinks. Output is written beside its place and moved there when it is whole; a failed write leaves what was there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions import text as tx


def has_non_finite(value: Column, kind: T.DataType) -> Column | None:
    """Whether any double inside a value is NaN or infinite; None if it holds no double."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))
    if isinstance(kind, T.StructType):
        found = [has_non_finite(value[f.name], f.dataType) for f in kind.fields]
        found = [c for c in found if c is not None]
        if not found:
            return None
        out = found[0]
        for c in found[1:]:
            out = out | c
        return out
    if isinstance(kind, T.ArrayType):
        if has_non_finite(F.lit(None), kind.elementType) is None:
            return None
        return F.coalesce(F.exists(value, lambda item: has_non_finite(item, kind.elementType)), F.lit(False))
    if isinstance(kind, T.MapType):
        return has_non_finite(F.map_values(value), T.ArrayType(kind.valueType))
    return None


def replace_folder(df: DataFrame, path: str, write: Callable[[str], None]) -> None:
    """Run ``write`` on a new folder beside ``path``, then put it in the place of ``path``."""
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path
    mark = uuid.uuid4().hex
    place, fresh, old = at(path), at(f"{path.rstrip('/')}.new-{mark}"), at(f"{path.rstrip('/')}.old-{mark}")
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    try:
        write(fresh.toString())
    except Exception:
        files.delete(fresh, True)
        raise
    if files.exists(place) and not files.rename(place, old):
        raise OSError(f"cannot move {path}")
    if not files.rename(fresh, place):
        files.rename(old, place)
        raise OSError(f"cannot write {path}")
    files.delete(old, True)


def sink_json(df: DataFrame, path: str) -> None:
    """Write UTF-8 JSON lines; a NaN or an infinity fails the write."""
    bad = has_non_finite(F.struct(*df.columns), df.schema)
    if bad is not None:
        df = df.filter(F.when(bad, F.raise_error(F.lit("a double that JSON cannot hold"))).otherwise(True))
    replace_folder(df, path, lambda to: df.write.option("ignoreNullFields", False).json(to))


def join_tags(tags: Column | str) -> Column:
    return F.concat_ws("|", tags)


def details_rows(records: DataFrame, metadata: dict[str, str]) -> DataFrame:
    """The 23 flat columns of the per-record report."""
    truth = tx.normalize_text("ground_truth")
    raw = F.coalesce(F.col("raw_output"), F.lit(""))
    base = records.withColumn("_raw", raw).withColumn("_truth", truth).withColumn("_out", tx.normalize_text("_raw"))
    m = tx.row_metrics("_truth", "_out", normalize=False)
    head = [F.lit(metadata[k]).alias(k) for k in ("engine", "engine_version", "model_id", "preprocessing")]
    return base.select(
        *head, "image_id", "group_id", "timestamp_seconds", join_tags("tags").alias("tags"), "line_count", "ground_truth",
        F.col("_truth").alias("normalized_ground_truth"), F.col("_raw").alias("raw_output"), F.col("_out").alias("normalized_output"),
        m["edits"].alias("edit_distance"), m["characters"].alias("reference_characters"), m["exact"].alias("exact_match"),
        m["whitespace_free_edits"].alias("whitespace_free_edit_distance"),
        m["whitespace_free_characters"].alias("whitespace_free_reference_characters"),
        "confidence", "preprocessing_ms", "inference_ms", "total_ms", F.coalesce("error", F.lit("")).alias("error"),
    )


def sink_details_csv(details: DataFrame, path: str) -> None:
    """Write the per-record report; each file starts with a byte order mark and a header."""
    first, *rest = details.columns
    marked = details.withColumnRenamed(first, "\ufeff" + first)
    replace_folder(marked, path, lambda to: marked.write.csv(to, header=True, quote='"', escape='"'))
