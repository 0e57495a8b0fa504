"""Distances in long form against NumPy on whole arrays."""

from __future__ import annotations

import datetime
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoband.operators import drift, ordered


def plain(a, b, bins=20):
    """(ks, wasserstein, energy, psi) of two samples."""
    a, b = np.sort(np.asarray(a, float)), np.sort(np.asarray(b, float))
    points = np.unique(np.concatenate([a, b]))
    gap = np.searchsorted(a, points, "right") / len(a) - np.searchsorted(b, points, "right") / len(b)
    width = np.append(np.diff(points), 0)
    edges = np.unique(np.percentile(np.concatenate([a, b]), np.linspace(0, 100, bins + 1)))
    psi = 0.0
    if len(edges) >= 3:
        p, q = (np.maximum(np.histogram(x, edges)[0] / len(x), 1e-6) for x in (a, b))
        psi = float(((q - p) * np.log(q / p)).sum())
    return np.abs(gap).max(), (np.abs(gap) * width).sum(), math.sqrt(2 * (gap * gap * width).sum()), psi


def samples(rng):
    base = np.round(rng.normal(size=400), 1)  # many ties
    return {
        "near": np.round(rng.normal(size=300), 1), "shifted": rng.normal(3, 1, 200), "inside": rng.uniform(-0.1, 0.1, 50), "around": rng.normal(0, 9, 70),
        "one": [0.35], "same": base, "left": base - 50, "right": base + 50, "constant": [1.0] * 30}, base


@pytest.mark.parametrize("rows", [100_000, 60])
def test_against_whole_arrays(spark, chunked, rows):
    chunked(rows)
    sides, base = samples(np.random.default_rng(1))
    data = [(k, "base", float(x) * s) for k, s in (("a", 1.0), (None, 10.0)) for x in base]
    data += [(k, name, float(x) * s) for k, s in (("a", 1.0), (None, 10.0)) for name, xs in sides.items() for x in xs]
    data += [("a", "near", None), ("a", None, 1.0), ("only base", "base", 1.0), ("only target", "near", 1.0)]
    df = spark.createDataFrame(data, "k string, side string, x double").repartition(5)
    got = {(r.k, r.target): r for r in drift.distances(df, ["k"], "x", "side", "base").collect()}
    assert set(got) == {(k, name) for k in ("a", None) for name in sides}
    for (k, name), r in got.items():
        s = 1.0 if k else 10.0
        want = plain(base * s, np.asarray(sides[name], float) * s)
        assert np.allclose((r.ks_stat, r.wasserstein, r.energy_distance, r.psi), want, atol=1e-6), (k, name, r, want)
        assert (r.n_base, r.n_target) == (len(base), len(sides[name]))


def test_values_are_sorted_once(spark, chunked, monkeypatch):
    """However large a key: the counts and their stretches are written out, and what the stretches found."""
    chunked(60)
    made = []
    for module in (drift, ordered):
        monkeypatch.setattr(module, "materialise", lambda df, real=module.materialise: made.append(1) or real(df))
    sides, base = samples(np.random.default_rng(2))
    df = spark.createDataFrame([("base", float(x)) for x in base] + [(n, float(x)) for n, xs in sides.items() for x in xs], "side string, x double").withColumn("k", F.lit(1))
    assert drift.distances(df, ["k"], "x", "side", "base").count() == len(sides) and len(made) == 3


def test_constant_base_and_empty(spark):
    df = spark.createDataFrame([("base", 2.0)] * 5 + [("t", 2.0)] * 3 + [("u", 3.0)] * 3, "side string, x double").withColumn("k", F.lit(1))
    got = {r.target: (r.ks_stat, r.wasserstein, round(r.energy_distance, 9), r.psi) for r in drift.distances(df, ["k"], "x", "side", "base").collect()}
    assert got["t"] == (0, 0, 0, 0) and got["u"][:3] == (1, 1, round(math.sqrt(2), 9)) and abs(got["u"][3] - plain([2.0] * 5, [3.0] * 3)[3]) < 1e-6
    assert drift.distances(df.where("x > 9"), ["k"], "x", "side", "base").count() == 0


def test_ten_years_of_days(spark):
    """The plan does not grow with the days, and the report has a row for each."""
    day = datetime.date(2015, 1, 1)
    df = spark.range(3650 * 4).select(
        F.date_add(F.lit(day), (F.col("id") / 4).cast("int")).alias("day"), F.sin("id").alias("x"),
        F.when(F.col("id") < 4000, "train").when(F.col("id") < 8000, "val").otherwise("test").alias("split"))
    start = time.time()
    report = drift.shift_report(df, "split", "day", ["x"], ["x"])
    planned = time.time() - start
    rows = report.collect()
    assert planned < 60 and len(rows) == 2 + (3650 - 1000)
    assert {r.target_split for r in rows} == {"val", "test"} and {r.scope for r in rows} == {"global", "by_date"}
    one = next(r for r in rows if r.target == str(day + datetime.timedelta(days=2000)))
    assert one.target_split == "test" and one.n_target == 4
    assert np.allclose((one.ks_stat, one.wasserstein), plain(np.sin(np.arange(4000)), np.sin(np.arange(8000, 8004)))[:2])


def test_split_shift_with_centroids(spark):
    rng = np.random.default_rng(2)
    rows = [("s", "train" if k % 3 else "test", float(rng.normal()), ("rise", "flat", "fall")[k % 3 if k % 2 else 0],
             [float(k), float(-k)] if k % 5 else None) for k in range(90)]
    df = spark.createDataFrame(rows, "strategy string, split string, value double, phase string, pc array<double>")
    (r,) = drift.split_shift(df, "strategy", "split", "value", "phase", "pc").collect()
    of = lambda s: np.array([x[4] for x in rows if x[1] == s and x[4]])
    assert abs(r.pca_centroid_distance - np.linalg.norm(of("train").mean(0) - of("test").mean(0))) < 1e-9
    assert r.phase_js_distance > 0 and abs(r.wasserstein - plain([x[2] for x in rows if x[1] == "train"], [x[2] for x in rows if x[1] == "test"])[1]) < 1e-9
