"""Faults that were found once: each must stay mended."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueweave.operators import frames, matching as mt, metrics as me, reviews as rv, terms as tm
from cueweave.sources import writers


def test_match_inside_a_kept_one_does_not_use_up_its_list(spark):
    rows = [(1, "a", 0, 4, ["x", "y"]), (1, "b", 2, 4, ["y", "x"]), (1, "c", 10, 12, ["y", "x"]), (1, "d", 20, 24, ["x", "y"]), (1, "e", 21, 23, ["x", "y", "x"])]
    matches = spark.createDataFrame(rows, "text_id int, source_id string, start int, end int, target_ids array<string>").withColumn("source_type", F.lit("official_name"))
    got = tm.distinct_targets(matches, F.lit(8)).orderBy("rank").collect()
    assert [(r.source_id, r["rank"]) for r in got] == [("a", 1), ("c", 2), ("e", 3)]


def test_reports_without_groups(spark):
    rows = spark.createDataFrame([(1.0, 4.0), (3.0, None), (5.0, 8.0)], "a double, b double")
    assert tuple(me.latency_stats(rows, [], ["a", "b"]).first()) == pytest.approx((3.0, 4.8, 6.0, 7.8))
    side = spark.createDataFrame([("v", 1, 0.0, 2.0), ("v", 2, 5.0, 9.0)], "v string, idx int, start_seconds double, end_seconds double")
    report = mt.interval_report(side, side.filter("idx = 1"), ["v"], []).first()
    assert (report.truth_count, report.prediction_count, report.matched_count, report.recall) == (2, 1, 1, 0.5)


def test_damaged_result_stays_pending(spark):
    jobs = spark.createDataFrame([("a",), ("b",)], "job string")
    results = spark.createDataFrame([("a", "ok", True), ("b", "ok", False)], "job string, status string, intact boolean")
    assert [r.job for r in rv.pending_jobs(jobs, results, ["job"]).collect()] == ["b"]


def test_failed_csv_write_leaves_the_old_one(spark, folder):
    path = f"file://{folder}/report"
    writers.sink_details_csv(spark.createDataFrame([("old",)], "a string"), path)
    with pytest.raises(Exception):
        writers.sink_details_csv(spark.createDataFrame([("new",)], "a string").select(F.raise_error(F.col("a")).cast("string").alias("a")), path)
    assert spark.read.csv(path, header=True).first()[0] == "old"
    writers.sink_details_csv(spark.createDataFrame([("new",)], "a string"), path)
    assert spark.read.csv(path, header=True).first()[0] == "new"


def test_otsu_separates_dark_from_bright():
    gray = np.array([[10, 12, 11], [200, 210, 205]], np.uint8)
    assert frames.otsu_image(gray).tolist() == [[255] * 3, [0] * 3]
    assert frames.otsu_image(np.full((2, 2), 7, np.uint8)).shape == (2, 2)
