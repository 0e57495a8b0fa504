"""Windows over whole spectra against the bins as series of their own."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoband.operators import array_windows as W
from chronoband.operators import smooth

METHODS = [("moving_average", {"width": 4}), ("median", {"width": 5}), ("median", {"width": 4}), ("gaussian", {"sigma": 1.3}), ("ema", {"alpha": 0.4}),
           ("savgol", {"width": 9, "poly": 3}), ("savgol", {"width": 3, "poly": 3})]


def spectra(spark, bins, sizes=(1, 3, 40, 7)):
    rng = np.random.default_rng(bins)
    rows = [(g, k, [float(x) for x in rng.normal(size=bins)]) for g, n in enumerate(sizes) for k in range(n)]
    rows += [(None, k, [float(k)] * bins) for k in range(6)]
    rng.shuffle(rows)
    return spark.createDataFrame([(None if g is None else int(g), int(k), p) for g, k, p in rows], "g int, t long, power array<double>").repartition(4)


def table(df):
    rows = {(r.g, r.t): r.power for r in df.collect()}
    return sorted(rows, key=str), np.array([rows[k] for k in sorted(rows, key=str)], dtype=float)


def by_bins(df, method, args, outliers=None, how=None):
    return table(smooth._smooth_cells(df, ["g"], ["t"], ["g", "t"], method, args, outliers, 1.5, how, "power", 100))


@pytest.mark.parametrize(("method", "args"), METHODS)
def test_equal_to_bins(spark, chunked, method, args):
    df = spectra(spark, 5)
    keys, want = by_bins(df, method, args)
    for rows in (100_000, 13):
        chunked(rows)
        got = table(smooth.smooth_spectra(df, ["g"], ["t"], method, args))
        assert got[0] == keys and np.allclose(got[1], want, rtol=0, atol=1e-10)


@pytest.mark.parametrize(("flag", "how"), [("zscore", "mean"), ("zscore", "median"), ("iqr", "clip"), ("iqr", "median"), ("iqr", "mean"), ("zscore", "clip")])
def test_outliers_equal_to_bins(spark, flag, how):
    df = spectra(spark, 4)
    keys, want = by_bins(df, "none", None, flag, how)
    got = table(smooth.smooth_spectra(df, ["g"], ["t"], outliers=flag, threshold=1.5, repair_how=how))
    assert got[0] == keys and np.allclose(got[1], want, rtol=0, atol=1e-10)


@pytest.mark.parametrize(("method", "args"), METHODS)
def test_any_cut_into_batches(method, args):
    rng = np.random.default_rng(3)
    for size in (2, 4, 60):
        x = rng.normal(size=(size, 3))
        rows = W.METHODS[method](**args)
        rows.start(0, size)
        whole = rows.feed(x)
        for cut in (1, 2, 7):
            rows.start(0, size)
            assert np.allclose(np.concatenate([rows.feed(x[k:k + cut]) for k in range(0, size, cut)]), whole, atol=1e-12)


def test_wide_spectra_keep_their_rows(spark):
    """1 001 bins: no cell is exploded for a window, the plan has no Generate."""
    df = spectra(spark, 1001, (30,))
    out = smooth.smooth_spectra(df, ["g"], ["t"], "moving_average", {"width": 3})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    keys, got = table(out)
    rows = {(r.g, r.t): r.power for r in df.collect()}
    for k, p in zip(keys, got, strict=True):
        past = [rows[k[0], t] for t in range(max(0, k[1] - 2), k[1] + 1)]
        assert np.allclose(p, np.mean(past, axis=0))


def test_ragged_and_missing_bins_go_bin_by_bin(spark):
    rows = [(1, 0, [1.0, 2.0]), (1, 1, [3.0]), (1, 2, [5.0, None]), (1, 3, None)]
    df = spark.createDataFrame(rows, "g int, t long, power array<double>")
    got = {r.t: r.power for r in smooth.smooth_spectra(df, ["g"], ["t"], "moving_average", {"width": 2}).collect()}
    assert got == {0: [1.0, 2.0], 1: [2.0], 2: [4.0, 2.0]}
    none = df.where("t > 9")
    assert smooth.smooth_spectra(none, ["g"], ["t"], "median").count() == 0


def test_wrong_arguments(spark):
    df = spark.range(1).select(F.lit(1).alias("g"), F.col("id").alias("t"), F.array(F.lit(1.0)).alias("power"))
    with pytest.raises(ValueError, match="unknown repair"):
        smooth.smooth_spectra(df, ["g"], ["t"], outliers="iqr", repair_how="guess")
    with pytest.raises(ValueError, match="alpha"):
        W.Exponential(0.0)
