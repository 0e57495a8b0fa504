"""Both plans of the ordered operators give the same rows when groups or times are NULL or tied."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronoband.operators import normalise, ordered, recurrence, splits

ROWS = [(g, None if k % 17 == 0 else (k // 3) * 1000, k, float((k * 37) % 23)) for g in ("a", None, "b") for k in range(100)]
ROWS += [("burst", 5_000 + k % 3, 1000 + k, float(k % 7)) for k in range(200)]


@pytest.fixture()
def table(spark):
    return spark.createDataFrame(ROWS, "g string, us bigint, id bigint, x double").withColumn("id", F.col("id") * 7 + F.length(F.coalesce("g", F.lit("")))
                                                                                              ).repartition(5)


def both(chunked, make):
    out = []
    for rows in (10_000, 30):
        chunked(rows)
        out.append(sorted((tuple(r) for r in make().collect()), key=str))
    return out


def rounded(df, c):
    return df.withColumn(c, F.round(c, 8)).select("g", "us", "id", c)


def test_time_frames_keep_every_row(table, chunked):
    small, large = both(chunked, lambda: rounded(ordered.time_framed(table, ["g"], "us", 4000, {
        "s": lambda w: F.sum("x").over(w.rangeBetween(-4000, 0))}), "s"))
    assert small == large and len(small) == len(ROWS)


def test_recurrences_keep_null_groups(table, chunked):
    small, large = both(chunked, lambda: rounded(recurrence.ema(table, ["g"], ["us", "id"], "x", 0.3), "ema"))
    assert small == large and len(small) == len(ROWS)


def test_quantiles_of_null_groups(table, chunked):
    small, large = both(chunked, lambda: rounded(ordered.with_quantiles(table, ["g"], "x", {"q": 0.3}), "q"))
    assert small == large and all(r[3] is not None for r in small)


def test_frames_and_scans(table, chunked):
    small, large = both(chunked, lambda: rounded(ordered.framed(table, ["g"], ["us", "id"], 4, 0, {
        "m": lambda w: F.avg("x").over(w.rowsBetween(-4, 0))}), "m"))
    assert small == large and len(small) == len(ROWS)
    small, large = both(chunked, lambda: rounded(ordered.scanned(table, ["g"], ["us", "id"], total={"t": F.col("x")}), "t"))
    assert small == large and len(small) == len(ROWS)


def test_derangement_keeps_null_groups(table, chunked):
    small, large = both(chunked, lambda: splits.deranged(table, "id", ["x"], group=["g"]).select("g", "us", "id", "x"))
    assert small == large and len(small) == len(ROWS)


def test_shuffled_aux_keeps_null_groups(spark, chunked):
    rows = [(g, k, [float(k), -float(k)]) for g in ("a", None) for k in range(40)]
    df = spark.createDataFrame([(g, 100 * (g is None) + k, a) for g, k, a in rows], "g string, id bigint, aux array<double>")
    small, large = both(chunked, lambda: normalise.shuffle_aux(df, ["g"], "id", ["ppg_red", "note"], "features").select("g", "id", "aux"))
    assert small == large and len(small) == 80
