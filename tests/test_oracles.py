"""Every registered query runs; those with an oracle equal DuckDB row for row."""

from __future__ import annotations

import pytest

import chronoband.plans  # noqa: F401
from chronoband.plans.registry import ORACLES, QUERIES
from tests.compare import difference
from tests.conftest import SMALL

SLOW_WITHOUT_ORACLE = {"d12_cluster_report", "a17_diagnostic_summary"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    assert difference(QUERIES[name](spark, SMALL), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW_WITHOUT_ORACLE))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


# queries whose groups are split once they exceed the chunk size
CHUNKED = ["aligned_error", "i5_akima_null_outside", "w1_causal_mean", "w3_causal_ema", "w16_repair_linear",
           "w23_segments_by_time_and_index", "l4_count_window_edge", "l6_time_window_grid", "l7_rf_image_index",
           "x1_random", "x5_alternating_by_experiment", "a1_ppg_features", "n15_label_derangement"]


@pytest.mark.parametrize("name", CHUNKED)
def test_equals_oracle_in_chunks(spark, duck, chunked, name):
    chunked(30)
    assert difference(QUERIES[name](spark, SMALL), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["d1_d4_distances", "m1_regression_metrics"])
def test_equals_oracle_in_large_chunks(spark, duck, chunked, name):
    chunked(400)
    assert difference(QUERIES[name](spark, SMALL), duck, ORACLES[name]) is None
