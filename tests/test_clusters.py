"""Clusters against plain NumPy."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoband.operators import clusters as L
from chronoband.plans import drift
from tests.conftest import SMALL


def blobs(spark, seed=1, n=300):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0], [9, 9, 9.0]])
    x = centres[np.arange(n) % 4] + rng.normal(0, 0.5, (n, 3))
    rows = [(k, [float(v) for v in x[k]], ("rise", "flat")[k % 2], k % 4) for k in range(n)]
    return x, spark.createDataFrame(rows, "id long, features array<double>, phase string, exp int").repartition(6)


def test_all_restarts_step_together(spark):
    """A step of many restarts is each restart's own step."""
    x, df = blobs(spark)
    rng = np.random.default_rng(3)
    centres = rng.normal(4, 4, (5, 4, 3))
    centres[2, 1] = [500.0, 500.0, 500.0]  # gets no rows and stays
    new, cost = L.lloyd_step(df.select("features"), centres)
    for r in range(5):
        far = ((x[:, None] - centres[r][None]) ** 2).sum(2)
        near = far.argmin(1)
        want = np.array([x[near == k].mean(0) if (near == k).any() else centres[r, k] for k in range(4)])
        assert np.allclose(new[r], want) and np.isclose(cost[r], far.min(1).sum())


def counted(df):
    """``df`` and an accumulator of the rows that were read of it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    return df.mapInArrow(run, df.schema), seen


def test_a_step_reads_its_rows_once(spark):
    x, df = blobs(spark)
    rows, seen = counted(df.select("features"))
    L.lloyd_step(rows, np.random.default_rng(3).normal(4, 4, (5, 4, 3)))
    assert seen.value == len(x)


def test_a_cluster_report_reads_its_rows_once(spark):
    x, df = blobs(spark)
    rows, seen = counted(df)
    assert {r.kind for r in L.cluster_report(rows, "id", "phase", "exp").collect()} == {"phase", "experiment", "whole"}
    assert seen.value == len(x)


def test_kmeans_finds_the_blobs(spark):
    x, df = blobs(spark)
    out = L.kmeans(df.unionByName(spark.createDataFrame([(999, None, None, None)], df.schema)), 4).collect()
    found = {r.id: r.cluster for r in out}
    assert found.pop(999) is None
    assert len({(k % 4, c) for k, c in found.items()}) == 4  # each blob is one cluster


def test_kmeans_with_few_rows(spark):
    df = spark.createDataFrame([(k, [float(k % 2)]) for k in range(6)], "id long, features array<double>")
    assert {r.cluster for r in L.kmeans(df, 5).collect()} <= set(range(5))
    assert L.kmeans(df.where("id > 99"), 2).count() == 0


def plain_sums(x, labels):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2) + 1e-12)
    np.fill_diagonal(far, 0)
    kinds = np.unique(labels)
    return {(i, c): (far[i, labels == c].sum(), int((labels == c).sum() - (labels[i] == c))) for i in range(len(x)) for c in kinds}


def plain_silhouette(x, labels):
    sums, scores = plain_sums(x, labels), []
    for i in range(len(x)):
        own = sums[i, labels[i]]
        a = own[0] / own[1] if own[1] else 0.0
        b = min(t / n for (k, c), (t, n) in sums.items() if k == i and c != labels[i])
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


@pytest.mark.parametrize("block", [7, 64, 512])
def test_pair_sums_by_tiles(spark, block):
    x, df = blobs(spark, 2, 90)
    labels = np.arange(90) % 4
    labels[5] = 7  # alone in its cluster
    df = df.withColumn("cluster", F.when(F.col("id") == 5, 7).otherwise(F.col("exp")))
    got = {(r.key, r.cluster): (r.total, r.n) for r in L.pair_sums(df, "id", most=None, block=block).collect()}
    want = plain_sums(x, labels)
    assert set(got) == set(want) and all(np.isclose(got[k][0], want[k][0]) and got[k][1] == want[k][1] for k in want)


def test_silhouette(spark):
    x, df = blobs(spark, 4, 80)
    s = L.silhouette(df, "id", cluster="exp").first()
    assert np.isclose(s.silhouette, plain_silhouette(x, np.arange(80) % 4)) and s.n_rows == 80
    few = L.silhouette(df, "id", cluster="exp", most=30).first()
    assert few.n_rows == 30 and 0.5 < few.silhouette <= 1
    assert L.silhouette(df.withColumn("exp", F.lit(1)), "id", cluster="exp").first().silhouette is None


def test_report(spark):
    x, df = blobs(spark, 5, 120)
    rows = L.cluster_report(df, "id", "phase", "exp").collect()
    for kind in ("phase", "experiment"):
        shares = {}
        for r in rows:
            if r.kind == kind:
                shares.setdefault(r.cluster, []).append(r.value)
        assert len(shares) == 4 and all(np.isclose(sum(v), 1) for v in shares.values())
    assert {r.name for r in rows if r.kind == "whole"} == {"silhouette", "n_rows"}
    assert all(r.value == 1 for r in rows if r.kind == "experiment")


def test_pairs_are_not_shuffled(spark):
    """Rows are shuffled once per side: no exchange holds a tile, and near rows keep their digits far from the origin."""
    plan = L.pair_sums(blobs(spark, 3, 60)[1].withColumn("cluster", F.col("exp")), "id", most=None, block=10)._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "RoundRobinPartitioning" not in plan and "mapInPandas" not in plan
    rng = np.random.default_rng(1)
    x = 1e6 + rng.normal(size=(40, 3))
    x[20:] = x[:20] + 1e-5
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, features array<double>, cluster int")
    got = {(r.key, r.cluster): r.total for r in L.pair_sums(df, "id", most=None, block=8).collect()}
    want = plain_sums(x, np.arange(40) % 2)
    assert all(np.isclose(got[k], want[k][0], rtol=1e-9, atol=0) for k in want)


def test_the_report_scores_every_row(spark):
    """More rows than the silhouette's own bound: its value and number are those of all of them."""
    n = L.SILHOUETTE_ROWS + 300
    x, df = blobs(spark, 6, n)
    rows = L.cluster_report(df, "id", "phase", "exp").collect()
    whole = {r.name: r.value for r in rows if r.kind == "whole"}
    assert whole["n_rows"] == n and np.isclose(whole["silhouette"], plain_silhouette(x, np.arange(n) % 4))


def test_rows_that_share_a_key_are_no_pairs(spark):
    """Blocks of every parity, a block of one row and keys that repeat."""
    rng = np.random.default_rng(8)
    x, labels, keys = rng.normal(size=(70, 5)), rng.integers(0, 3, 70), np.arange(70) // 2
    df = spark.createDataFrame([(int(k), v.tolist(), int(c)) for k, v, c in zip(keys, x, labels)], "id long, features array<double>, cluster int")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2) + 1e-12)
    want = {}
    for i in range(70):
        for c in range(3):
            at = (labels == c) & (keys != keys[i])
            t, n = want.get((keys[i], labels[i], c), (0.0, 0))
            want[keys[i], labels[i], c] = t + far[i, at].sum(), n + int(at.sum())
    for block in (1, 3, 9, 100):
        got = {(r.key, r.own, r.cluster): (r.total, r.n) for r in L.pair_sums(df, "id", most=None, block=block).collect()}
        assert set(got) == set(want) and all(np.isclose(got[k][0], want[k][0]) and got[k][1] == want[k][1] for k in want)


def test_the_summary_samples_no_rows(spark, monkeypatch):
    """The clusters of the diagnostic summary are scored on every row that the report has."""
    def sampled(*_):
        raise AssertionError("rows were sampled")
    monkeypatch.setattr(L, "fixed_sample", sampled)
    found = json.loads(drift.summary(spark, SMALL).first().summary)["cluster_stats"]
    assert found["n_rows"] == drift.master(spark, SMALL).count() and -1 <= found["silhouette"] <= 1
