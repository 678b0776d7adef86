"""Saved documents: migration, one-caption replacement and retranslation bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the older document version.
LEGACY_MINIMUM_MS = 1200
LEGACY_DETECTION_VERSION = "legacy-ocr-text-timeline-v1"
LEGACY_BOUNDARY = "legacy_saved_boundary"


def migrate_v1(projects: DataFrame) -> DataFrame:
    """Fill the fields that version 1 documents lack; boundaries and edits stay as they are."""
    old = F.col("schema_version") == 1
    fill = lambda value, default: F.when(old, F.coalesce(value, default)).otherwise(value)
    lit = F.lit

    def caption(c: Column) -> Column:
        legacy = F.struct(
            lit("legacy").alias("status"), lit(LEGACY_BOUNDARY).alias("start_reason"), lit(LEGACY_BOUNDARY).alias("end_reason"), lit(False).alias("needs_review")
        )
        ocr = c["ocr"]
        attempts = F.coalesce(ocr["attempts"], F.array().cast(_array_type(projects, "attempts")))
        return (
            c.withField("line_id", F.coalesce(c["line_id"], lit("line-1")))
            .withField("line_index", F.coalesce(c["line_index"], lit(0)))
            .withField("detection", F.coalesce(c["detection"], legacy))
            .withField("ocr", F.when(ocr.isNotNull(), ocr.withField("attempts", attempts)))
        )

    detection = F.struct(lit(LEGACY_DETECTION_VERSION).alias("version"), lit("ocr_text").alias("boundary_source"), lit(1).alias("migrated_from_schema_version"))
    p, size = F.col("processing"), F.greatest(lit(0), F.size("subtitles")).cast("long")
    processing = F.coalesce(p, lit(None).cast(projects.schema["processing"].dataType))
    counters = {
        "detection_count": size, "ocr_call_count": F.coalesce(p["sample_count"], lit(0).cast("long")), "translation_call_count": size,
        "dropped_intervals": F.array().cast(projects.schema["processing"].dataType["dropped_intervals"].dataType),
    }
    for name, default in counters.items():
        processing = processing.withField(name, fill(p[name], default))
    configuration, analysis = F.col("configuration"), F.col("analysis")
    return projects.withColumns({
        "subtitles": F.when(old, F.transform("subtitles", caption)).otherwise(F.col("subtitles")),
        "analysis": analysis.withField("minimum_display_duration_ms", fill(analysis["minimum_display_duration_ms"], lit(LEGACY_MINIMUM_MS))),
        "configuration": F.when(old & configuration.isNull(), F.struct(detection.alias("detection"))).otherwise(
            configuration.withField("detection", fill(configuration["detection"], detection))
        ),
        "processing": processing,
        "schema_version": F.when(old, lit(2)).otherwise(F.col("schema_version")),
    })


def _array_type(projects: DataFrame, name: str):
    return projects.schema["subtitles"].dataType.elementType["ocr"].dataType[name].dataType


def upsert_by_id(rows: DataFrame, changed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows with those of ``changed`` in place of the ones with the same key; no row is added."""
    key = list(key)
    values = [c for c in rows.columns if c not in key]
    fresh = changed.select(*key, F.struct(*values).alias("_new"))
    both = rows.join(fresh, key, "left")
    return both.select(*key, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in values])


def replace_errors(stored: Column, fresh: Column, phase: str = "translation") -> Column:
    """Old errors of the phase give way to fresh ones; others stay first."""
    kept = F.filter(stored, lambda e: ~e["phase"].eqNullSafe(F.lit(phase)))
    return F.concat(F.coalesce(kept, F.array().cast("array<struct<phase:string,subtitle_id:string,timestamp_seconds:double,message:string>>")), fresh)
