"""The driver's tables seen as sensor data, for Spark and for the oracles.

* ``series``: events, one user is one recording;
* ``knots`` / ``targets``: purchases as the sparse reference, views as the clock;
* ``cells`` / ``spectra``: embeddings, 64 bins per row;
* ``predictions``: lineitem rows as (true, predicted) pairs in mmol/L.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoband.functions import timekeys as K

HOUR = 3_600_000_000
BINS = 64


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def series(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    us = K.micros(F.col("ts"))
    return e.select("event_id", F.col("user_id").alias("exp_id"), us.alias("us"),
                    (us / F.lit(HOUR)).alias("t"), "value", "event_type")


def targets(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).filter("event_type = 'view'").drop("event_type", "value")


def knots(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).filter("event_type = 'purchase'").select(
        "exp_id", F.col("t").alias("kt"), F.col("value").alias("y"), F.col("event_id").alias("kid"))


def spectra(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("power"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    wild = F.col("l_partkey") % 50
    y = F.lit(2.0) + F.lit(0.4) * F.col("l_quantity")
    p = F.lit(2.0) + F.when(F.col("l_returnflag") == "R", F.lit(0.4) * wild).otherwise(
        F.lit(0.3) * F.col("l_quantity") + F.lit(0.1) * wild)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
                     "l_shipdate", y.alias("y_true"), p.alias("y_pred"))


SERIES = """series AS (SELECT event_id, user_id AS exp_id, epoch_us(ts) AS us,
  epoch_us(ts) / 3600000000.0::DOUBLE AS t, value, event_type FROM events)"""
TARGETS = "targets AS (SELECT event_id, exp_id, us, t FROM series WHERE event_type = 'view')"
KNOTS = """knots AS (SELECT exp_id, t AS kt, value AS y, event_id AS kid FROM series
  WHERE event_type = 'purchase')"""
CELLS = """cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
  generate_subscripts(embedding, 1) - 1 AS bin FROM embeddings)"""
PREDICTIONS = """predictions AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
  l_linestatus, l_shipdate, 2.0::DOUBLE + 0.4::DOUBLE * l_quantity AS y_true,
  2.0::DOUBLE + CASE WHEN l_returnflag = 'R' THEN 0.4::DOUBLE * (l_partkey % 50)
    ELSE 0.3::DOUBLE * l_quantity + 0.1::DOUBLE * (l_partkey % 50) END AS y_pred FROM lineitem)"""


def rounded(c, places: int = 6):
    """Round and drop the sign of zero, as the oracles do."""
    return F.round(c, places) + F.lit(0.0)
