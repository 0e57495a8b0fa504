"""Outlier masks and their repair, per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoband.functions import arrays as A
from chronoband.operators.ordered import attach, group_sizes, indexed, quantiles, scanned

IQR_FACTOR = 1.5


def flag_zscore(df: DataFrame, group: Sequence[str], value: str, threshold: float = 3.0, out: str = "outlier") -> DataFrame:
    s = df.groupBy(*group).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    return attach(df, s, group).withColumn(
        out, F.abs((F.col(value) - F.col("_mu")) / (F.col("_sd") + 1e-8)) > threshold).drop("_mu", "_sd")


def flag_iqr(df: DataFrame, group: Sequence[str], value: str, out: str = "outlier", peak: int | None = None) -> DataFrame:
    q = quantiles(df, group, value, [0.25, 0.75], "_q", peak)
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    return attach(df, q, group).withColumn(
        out, (F.col(value) < lo - IQR_FACTOR * (hi - lo)) | (F.col(value) > hi + IQR_FACTOR * (hi - lo))).drop("_q")


def flag(df, group, value, how: str, threshold: float = 3.0, peak: int | None = None, out: str = "outlier") -> DataFrame:
    """The interquartile rule keeps its fixed factor whatever the threshold."""
    if how == "zscore":
        return flag_zscore(df, group, value, threshold, out)
    if how == "iqr":
        return flag_iqr(df, group, value, out, peak)
    return df.withColumn(out, F.lit(False))


def row_zscore(a: Column, threshold: float = 3.0) -> Column:
    """Mask along the frequency axis of one row."""
    return A.let(F.struct(A.mean(a).alias("m"), A.std(a).alias("s")), lambda z: F.transform(
        a, lambda x: F.abs((x - z["m"]) / (z["s"] + 1e-8)) > threshold))


def repair_linear(df, group, order, value, mask, out="repaired", peak=None) -> DataFrame:
    """Straight line over the row number between normal neighbours, flat at the ends."""
    d = indexed(df, group, order, "_pos", "_size", peak)
    point = F.when(~F.col(mask), F.struct(F.col("_pos").alias("i"), F.col(value).alias("v")))
    d = scanned(d, group, order, last={"_l": point}, first={"_r": point},
                total={"_seen": F.when(F.col(mask), 0).otherwise(1)}, peak=peak, rn="_pos")
    normal = df.groupBy(*group).agg(F.count_if(~F.col(mask)).alias("_normal"))
    d = attach(d, normal, group)
    lt, rt = F.col("_l"), F.col("_r")
    line = lt["v"] + (F.col("_pos") - lt["i"]) * (rt["v"] - lt["v"]) / (rt["i"] - lt["i"])
    fixed = F.when(lt.isNull(), rt["v"]).when(rt.isNull(), lt["v"]).otherwise(line)
    return d.withColumn(out, F.when(F.col(mask) & (F.col("_normal") > 1), fixed).otherwise(F.col(value))).drop(
        "_pos", "_size", "_l", "_r", "_seen", "_normal")


def repair_central(df, group, value, mask, how="median", out="repaired", peak=None) -> DataFrame:
    normal = df.filter(~F.col(mask))
    if how == "median":
        s = quantiles(normal, group, value, [0.5], "_q", peak).select(*group, F.col("_q")[0].alias("_v"))
    else:
        s = normal.groupBy(*group).agg(F.avg(value).alias("_v"))
    return attach(df, s, group).withColumn(out, F.when(F.col(mask), F.col("_v")).otherwise(F.col(value))).drop("_v")


def repair_clip(df, group, value, mask, out="repaired", peak=None) -> DataFrame:
    """Clip the whole series to the bounds of its normal values, if it has outliers."""
    q = quantiles(df.filter(~F.col(mask)), group, value, [0.25, 0.75], "_q", peak)
    any_bad = df.groupBy(*group).agg(F.bool_or(mask).alias("_any"))
    d = attach(attach(df, q, group), any_bad, group)
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    clipped = F.least(F.greatest(F.col(value), lo - IQR_FACTOR * (hi - lo)), hi + IQR_FACTOR * (hi - lo))
    return d.withColumn(out, F.when(F.col("_any"), clipped).otherwise(F.col(value))).drop("_q", "_any")


def repair(df, group, order, value, mask, how: str = "interpolate", peak: int | None = None) -> DataFrame:
    if peak is None:
        peak = group_sizes(df, group)[0]
    if how == "interpolate":
        return repair_linear(df, group, order, value, mask, peak=peak)
    if how in ("median", "mean"):
        return repair_central(df, group, value, mask, how, peak=peak)
    if how == "clip":
        return repair_clip(df, group, value, mask, peak=peak)
    raise ValueError(f"unknown repair: {how}")


def filled(df, group, order, values: Sequence[str], peak: int | None = None, zero: bool = True) -> DataFrame:
    """Forward fill, then the leading gap from the right, then 0 for an empty series."""
    last = {f"_f_{v}": F.col(v) for v in values}
    first = {f"_b_{v}": F.col(v) for v in values}
    d = scanned(df, group, order, last=last, first=first, peak=peak)
    for v in values:
        tail = [F.lit(0.0)] if zero else []
        d = d.withColumn(v, F.coalesce(F.col(f"_f_{v}"), F.col(f"_b_{v}"), *tail)).drop(f"_f_{v}", f"_b_{v}")
    return d
