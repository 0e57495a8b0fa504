"""Column profiles against exact values, baseline models against a closed form."""

from __future__ import annotations

import datetime
import json

import numpy as np
from pyspark.sql import functions as F

from chronoband.operators import models as ML
from chronoband.sources import tables as S


def test_column_profiles(spark):
    rows = [(k, f"n{k % 300}", float(k % 97), None if k % 4 else datetime.date(2026, 1, 1 + k % 28), [k]) for k in range(5000)]
    df = spark.createDataFrame(rows, "id long, name string, x double, day date, a array<long>").repartition(6)
    got = {r.column: r for r in S.column_profiles({"t": df, "none": df.limit(0)}, {"t": ["id"]}).collect() if r.table == "t"}
    assert set(got) == set(df.columns) and all(r.n_rows == 5000 for r in got.values())
    assert got["day"].n_null == 3750 and got["id"].n_null == 0
    for c, n in (("id", 5000), ("name", 300), ("x", 97), ("a", 5000)):
        assert abs(got[c].n_distinct - n) <= max(3, 0.08 * n)   # four times the sketch's deviation
    assert abs(got["id"].median - 2499.5) <= 5000 / S.QUANTILE_ACCURACY + 1 and got["name"].median is None
    assert (got["id"].lowest, got["id"].highest) == ("0", "4999") and (got["day"].lowest, got["day"].highest) == ("2026-01-01", "2026-01-25")
    assert got["id"].head == ["0", "1", "2", "3", "4"] and got["name"].head == [f"n{k}" for k in range(5)] and json.loads(got["a"].head[1]) == {"a": [1]}
    none = [r for r in S.column_profiles({"none": df.limit(0)}).collect()]
    assert len(none) == 5 and all(r.n_rows == 0 and r.lowest is None and r.head == [] for r in none)


def test_one_pass_per_table(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    plan = S.column_profiles({"t": df})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") <= 4 and "Window" not in plan


def test_decoded_preview(spark):
    blob = np.arange(12, dtype="<i4").tobytes().hex()
    df = spark.createDataFrame([(2, "0x" + blob, 12), (1, "zz!", 3), (3, blob, None)], "id long, data string, count long")
    got = S.decoded_preview(df, "data", "count", ["id"], 2, 4).collect()
    assert [(r.id, r.data_len, r.dtype, r.preview) for r in got] == [(1, None, None, None), (2, 48, "i4", [0, 1, 2, 3])]


def test_models(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.1, 400)
    rows = [(k, "train" if k % 4 else "test", [float(v) for v in x[k]], float(y[k])) for k in range(400)] + [(900, "test", None, 1.0), (901, "train", None, 1.0), (902, "train", [0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id long, split string, f array<double>, y double")
    got = ML.compared(df, "f", "y", folder=str(tmp_path)).collect()
    assert len(got) == 2 * len(rows) and {r.model for r in got} == set(ML.MODELS)
    assert all((r.y_pred is None) == (r.f is None) for r in got)
    train = np.array([k for k in range(400) if k % 4])
    a = np.column_stack([x, np.ones(400)])
    w = np.linalg.lstsq(a[train], y[train], rcond=None)[0]
    linear = {r.id: r.y_pred for r in got if r.model == "linear" and r.id < 400}
    assert max(abs(linear[k] - (a @ w)[k]) for k in range(400)) < 1e-4
    trees = [(r.y_pred - r.y) ** 2 for r in got if r.model == "gbt" and r.split == "test" and r.f]
    assert np.mean(trees) < np.var(y) / 2
