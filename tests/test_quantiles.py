"""Quantiles of many columns at once, in both plans."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoband.operators.metrics import regression
from chronoband.operators.ordered import column_quantiles


@pytest.mark.parametrize("rows", [100_000, 20])
def test_many_columns(spark, chunked, rows):
    chunked(rows)
    rng = np.random.default_rng(6)
    data = [(None if k % 3 == 0 else k % 3, float(np.round(rng.normal(), 1)), None if k % 5 == 0 else float(k), None if k % 3 == 1 else 2.5) for k in range(200)]
    df = spark.createDataFrame(data, "g int, x double, y double, z double")
    wanted = {"x50": ("x", 0.5), "y10": ("y", 0.1), "x90": ("x", 0.9), "z50": ("z", 0.5), "neg": (-F.col("x"), 0.25), "again": ("x", 0.5)}
    got = {r.g: r for r in column_quantiles(df, ["g"], wanted, also={"n": F.count(F.lit(1))}).collect()}
    assert set(got) == {None, 1, 2}
    for g, r in got.items():
        own = [row for row in data if row[0] == g]
        of = lambda k: np.array([row[k] for row in own if row[k] is not None])
        want = [np.quantile(of(1), 0.5), np.quantile(of(2), 0.1), np.quantile(of(1), 0.9), np.quantile(-of(1), 0.25), np.quantile(of(1), 0.5)]
        assert np.allclose([r.x50, r.y10, r.x90, r.neg, r.again], want) and r.n == len(own)
        assert r.z50 == (None if g == 1 else 2.5)


def test_one_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").cast("double").alias("y_true"), (F.col("id") * 1.1).alias("y_pred"))
    for keys in ([], ["g"]):
        plan = regression(df, keys)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
