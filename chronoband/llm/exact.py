"""Exact duplicates with the heavy hitters split off.

A Misra-Gries summary of the digests (Spark's ``approx_top_k``, one bounded
sketch per task, merged) names every digest that can hold more than
``1 / counters`` of the rows.  The candidates are counted exactly; the verified
winners are at most ``counters`` rows, so they are broadcast and their copies
are settled where they are read.  What is left has no group above that share
and takes one ordinary shuffle on the digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoband.llm.common import ascii_lower, materialise, text_or_empty

COUNTERS = 1024


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest key stays; of repeated rows with that key one stays;
    null keys come last and stay only in groups without any other key.  Other
    columns are not read.  An empty table gives an empty result.
    """
    digests = materialise(docs.select(F.col(key).alias("_id"), F.sha2(ascii_lower(text_or_empty(text)), 256).alias("_sha")))
    winners = heavy_hitters(digests, counters)
    rest = digests.join(F.broadcast(winners.select("_sha")), "_sha", "left_anti")
    group = Window.partitionBy("_sha")
    light = rest.select(
        "_id", "_sha", F.max("_id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(group.orderBy(F.desc_nulls_last("_id"))) == 1).alias("kept"))
    heavy = digests.join(F.broadcast(winners), "_sha").select("_id", "_sha", "keep_id", "group_size")
    last = F.col("_id").eqNullSafe(F.col("keep_id"))
    dropped = heavy.where(~last).withColumn("kept", F.lit(False))
    staying = heavy.where(last).withColumn("kept", F.row_number().over(Window.partitionBy("_sha").orderBy("_id")) == 1)
    out = light.unionByName(dropped).unionByName(staying)
    return out.select(F.col("_id").alias(key), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def heavy_hitters(digests: DataFrame, counters: int) -> DataFrame:
    """Digests with more than ``1 / counters`` of all rows, counted exactly; at most ``counters`` rows."""
    top = digests.agg(F.expr(f"approx_top_k(_sha, {counters}, {8 * counters})").alias("top"))
    candidates = top.select(F.explode("top.item").alias("_sha"))
    counted = (digests.join(F.broadcast(candidates), "_sha")
               .groupBy("_sha").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    total = digests.count()
    return materialise(counted.where(F.col("group_size") * counters > total))
