"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest
from oracle import compare, connect

from cueweave.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


CUT = (
    "merge_runs timeline_totals stabilize stabilize_gap confirmed_runs assign_ids adjacent_stability stability_summary order_violations session_gap interval_iou "
    "greedy_match fragmentation_counts interval_report latency_stats nearest_rank condition_summary line_summary overlap_violations near_text_pairs row_cer "
    "mask_overlap dice_shift temporal_pairs open_tail primary_subset min_duration_split interval_report_overall latency_overall"
).split()


@pytest.mark.parametrize("name", CUT)
def test_query_equals_sql_when_every_key_is_cut(spark, con, name):
    """The same queries with so small a limit that most keys are cut into slices."""
    spark.conf.set("spark.cueweave.targetRows", "7")
    spark.conf.set("spark.cueweave.foldRows", "7")
    try:
        assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) is None
    finally:
        spark.conf.unset("spark.cueweave.targetRows")
        spark.conf.unset("spark.cueweave.foldRows")
