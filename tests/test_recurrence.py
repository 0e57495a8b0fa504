"""Blocks of a recurrence against its rows one after another."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoband.operators import recurrence as R


def by_batches(coef, u, new, starts, sizes, seeded=True):
    at, parts = 0, []
    for n in sizes:
        frame = {"_u": u[at:at + n], "_new": new[at:at + n]}
        if seeded:
            frame["_start"] = [list(s) for s in starts[at:at + n]]
        parts.append(pd.DataFrame(frame))
        at += n
    return np.concatenate([b["_s"].to_numpy() for b in R._stream(list(coef), seeded)(iter(parts))])


@pytest.mark.parametrize("coef", [[0.7], [0.0], [0.5, 0.2, 0.1], [1.2, -0.5], list(np.full(70, 0.01))])
def test_blocks_equal_rows(monkeypatch, coef):
    monkeypatch.setattr(R, "SIDE_BY_SIDE", 0)
    rng = np.random.default_rng(len(coef))
    n, k = 1500, len(coef)
    u, new = rng.normal(size=n), rng.random(n) < 0.02
    new[0] = True
    new[700:720] = True  # runs of one row
    new[900:1400] = False
    starts = rng.normal(size=(n, k))
    want, _ = R.stepped(u, new, list(starts), coef, np.zeros(k))
    for sizes in ([n], [1, 63, 64, 65, 130, n - 323], [7] * (n // 7) + [n % 7]):
        assert np.allclose(by_batches(coef, u, new, starts, sizes), want, rtol=0, atol=1e-9)


@pytest.mark.parametrize("coef", [[0.7], [0.5, 0.2, 0.1]])
def test_short_runs_are_the_loop_bit_for_bit(coef):
    rng = np.random.default_rng(5)
    n, k = 1200, len(coef)
    u, new, starts = rng.normal(size=n), rng.random(n) < 0.05, rng.normal(size=(n, len(coef)))
    new[0], u[333] = True, np.nan
    want, _ = R.stepped(u, new, list(starts), coef, np.zeros(k))
    for sizes in ([n], [1, 399, 400, 400], [3] * (n // 3)):
        assert np.array_equal(by_batches(coef, u, new, starts, sizes), want, equal_nan=True)


@pytest.mark.parametrize("side", [0, 512])
def test_rows_that_are_not_finite(monkeypatch, side):
    """They spoil what follows in their run and nothing before, in blocks too."""
    monkeypatch.setattr(R, "SIDE_BY_SIDE", side)
    u, new = np.arange(300.0), np.zeros(300, bool)
    new[[0, 200]] = True
    u[120] = np.nan
    starts = np.zeros((300, 1))
    got = by_batches([0.5], u, new, starts, [100, 150, 50])
    want, _ = R.stepped(np.nan_to_num(u), new, list(starts), [0.5], np.zeros(1))
    assert np.isnan(got[120:200]).all() and np.allclose(got[:120], want[:120]) and np.allclose(got[200:], want[200:])


def test_responses():
    driven, started = R.responses([0.5, 0.25], 4)
    assert driven[3].tolist() == [0.375, 0.5, 0.5, 1.0]
    assert started[:, 0].tolist() == [0.5, 0.5, 0.375, 0.3125] and started[:, 1].tolist() == [0.25, 0.125, 0.125, 0.09375]


@pytest.mark.parametrize("rows", [40, 100_000])
def test_long_series_in_chunks(spark, chunked, rows):
    chunked(rows)
    frame = spark.range(700).select(F.lit(1).alias("g"), "id", F.sin("id").alias("x"))
    got = [r["ema"] for r in R.ema(frame, ["g"], ["id"], "x", 0.2).orderBy("id").collect()]
    s, want = None, []
    for x in np.sin(np.arange(700)):
        s = x if s is None else 0.2 * x + 0.8 * s
        want.append(s)
    assert np.allclose(got, want, atol=1e-12)
