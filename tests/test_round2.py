"""Draws that do not move with the partitions, unreadable files, components at any width."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chronoband.functions import fusion
from chronoband.operators import clusters
from chronoband.sources import binary


def test_draws_follow_the_key(spark):
    df = spark.range(50).select(F.col("id").alias("k"), F.array(F.lit(1.0), F.lit(2.0)).alias("a"))
    made = lambda parts: {r.k: r.b for r in df.repartition(parts).select("k", fusion.augment(F.col("a"), F.col("k"), 7).alias("b")).collect()}
    assert made(2) == made(9)
    values = np.array(list(made(3).values()))
    assert abs(values[:, 0].mean() - 1) < 0.1 and values[:, 0].std() > 0.02


def test_unreadable_files_are_rejects(spark):
    files = spark.createDataFrame([("file:/no/such/file.bin", 500)], "path string, length bigint")
    rows = binary.blocks(files, "spectrum").collect()
    assert [(r.path, r.stop, r.error.split(":")[0]) for r in rows] == [("file:/no/such/file.bin", 0, "unreadable")]


def test_components_are_centred(spark):
    rng = np.random.default_rng(3)
    for width in (8, 300):
        x = rng.normal(5, 1, (60, width))
        df = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>")
        pc = np.array([r.pc for r in clusters.two_components(df).collect()])
        assert np.abs(pc.mean(axis=0)).max() < 1e-8
        s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
        assert np.allclose(sorted(pc.var(axis=0) * 60, reverse=True), s[:2] ** 2)
