"""Corpus metrics of recognised text and counters of whole runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..session import spread
from .quantiles import exact_quantiles, figure_quantiles


def with_row_metrics(records: DataFrame, truth: str = "ground_truth", output: str = "raw_output") -> DataFrame:
    """Add the edit metrics of each row; texts are normalised once, before they are compared."""
    base = spread(records).withColumn("_t", tx.normalize_text(truth)).withColumn("_o", tx.normalize_text(F.coalesce(F.col(output), F.lit(""))))
    return base.withColumns(tx.row_metrics("_t", "_o", normalize=False)).drop("_t", "_o")


def corpus_metrics(scored: DataFrame, by: Sequence[str] = (), failed: Column | None = None) -> DataFrame:
    """Sums over ``with_row_metrics`` rows; error rates are ratios of sums, null without characters."""
    bad = F.coalesce(F.length("error") > 0, F.lit(False)) if failed is None else failed
    total = lambda c: F.sum(F.col(c).cast("long"))
    sums = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("image_count"), F.count_if(bad).alias("failure_count"),
        total("characters").alias("reference_characters"), total("edits").alias("edit_distance"),
        F.count_if("exact").alias("exact_matches"),
        total("whitespace_free_characters").alias("_bare_characters"), total("whitespace_free_edits").alias("_bare_edits"),
    )
    return (
        sums.withColumn("cer", tx.ratio(F.col("edit_distance"), F.col("reference_characters")))
        .withColumn("whitespace_free_cer", tx.ratio(F.col("_bare_edits"), F.col("_bare_characters")))
        .drop("_bare_characters", "_bare_edits")
    )


def metrics_by_tag(scored: DataFrame, tags: str = "tags", failed: Column | None = None) -> DataFrame:
    """The same sums per tag; a row counts once for each of its tags."""
    return corpus_metrics(scored.withColumn("tag", F.explode(F.array_distinct(tags))), ["tag"], failed)


def latency_stats(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Median and 95th percentile (linear) of each column, nulls skipped."""
    wanted = {c: {f"{c}_median": ("linear", 0.5), f"{c}_p95": ("linear", 0.95)} for c in columns}
    return figure_quantiles(rows, by, {c: c for c in columns}, wanted)


def dataset_summary(images: DataFrame, verified: Column | None = None) -> DataFrame:
    """Images, groups and verified truths over all and per tag (``tag`` null: over all)."""
    ok = (F.col("ground_truth_status") == "verified") if verified is None else verified
    base = images.select("group_id", "tags", ok.alias("_ok"))
    tagged = base.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("tags"))).alias("tag"), "group_id", "_ok")
    # One row per (tag, group) first, so that counting groups needs no distinct per tag.
    per_group = tagged.groupBy("tag", "group_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_ok").alias("_v"))
    return per_group.groupBy("tag").agg(
        F.sum("_n").alias("image_count"), F.count("group_id").alias("subtitle_group_count"), F.sum("_v").alias("verified_ground_truth_count")
    )


def line_ocr_summary(rows: DataFrame, latency: str = "ocr_ms") -> DataFrame:
    """Primary against auxiliary lines: groups, units, error rates, exact units, median time."""
    by = ["primary"]
    total = lambda c: F.sum(F.col(c).cast("long"))
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("units"), total("edits").alias("_e"), total("characters").alias("_c"),
        total("whitespace_free_edits").alias("_be"), total("whitespace_free_characters").alias("_bc"),
        F.count_if("exact").alias("exact_units"), F.count_if(F.col("whitespace_free_edits") == 0).alias("whitespace_free_exact_units"),
    )
    groups = rows.select(*by, "group_id").distinct().groupBy(*by).agg(F.count("group_id").alias("groups"))
    median = exact_quantiles(rows, by, latency, {"median_ocr_ms": ("linear", 0.5)})
    out = sums.join(groups, by, "left").join(median, by, "left")
    return out.select(
        *by, "groups", "units", tx.ratio(F.col("_e"), F.col("_c")).alias("cer"), tx.ratio(F.col("_be"), F.col("_bc")).alias("whitespace_free_cer"),
        "exact_units", "whitespace_free_exact_units", "median_ocr_ms",
    )


def two_line_diagnostics(rows: DataFrame) -> DataFrame:
    """Groups of two or more primary lines joined in reading order, next to the whole crop."""
    primary = rows.filter("primary and not diagnostic_only")
    whole = rows.filter("primary and diagnostic_only").groupBy("group_id").agg(F.min("id").alias("whole_crop_id"))
    lines = F.array_sort(F.collect_list(F.struct("reading_order", "id", "source_ko", "ocr_ko")))
    joined = primary.groupBy("group_id").agg(lines.alias("l")).filter(F.size("l") >= 2)
    text = lambda name: F.array_join(F.transform("l", lambda r: r[name]), "\n")
    combined = joined.select("group_id", F.transform("l", lambda r: r["id"]).alias("line_ids"), text("source_ko").alias("_r"), text("ocr_ko").alias("_p"))
    return combined.withColumns(tx.row_metrics("_r", "_p", normalize=False)).drop("_r", "_p").join(whole, "group_id", "left")


def job_counters(captions: DataFrame, errors: DataFrame, samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sample, observation, caption, call and error counts of each run and its final state."""
    by = list(by)
    out = (
        samples.groupBy(*by).agg(F.count(F.lit(1)).alias("line_observation_count"), F.count_if("first_line").alias("sample_count"))
        .join(captions.groupBy(*by).agg(
            F.count(F.lit(1)).alias("subtitle_count"), F.sum("ocr_calls").alias("ocr_call_count"), F.sum("translation_calls").alias("translation_call_count")
        ), by, "left")
        .join(errors.groupBy(*by).agg(F.count(F.lit(1)).alias("error_count")), by, "left")
        .na.fill(0)
    )
    return out.withColumn("detection_count", F.col("subtitle_count")).withColumn(
        "state", F.when(F.col("error_count") > 0, "completed_with_errors").otherwise("completed")
    )
