"""Errors of predictions: one combined aggregation, ranks from ``quantiles``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoband.functions import arrays as A
from chronoband.functions import clinical as C
from chronoband.operators.ordered import attach, column_quantiles, group_sizes, indexed

TINY = 1e-8


def regression(df: DataFrame, keys: Sequence[str] = (), true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    keys = list(keys)
    d = df.withColumn("_e", F.col(pred) - F.col(true)).withColumn("_a", F.abs("_e"))
    peak = group_sizes(d, keys)[0]
    y, e, a = F.col(true), F.col("_e"), F.col("_a")
    also = {
        "mae": F.avg("_a"), "mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)),
        "r2": 1 - F.avg(e * e) / F.when(F.var_pop(true) > 0, F.var_pop(true)), "pearson_corr": F.corr(true, pred),
        "mape": F.avg(F.abs(e / (y + TINY))) * 100, "mape_abs": F.avg(a / (F.abs(y) + TINY)) * 100,
        "mean_error": F.avg("_e"), "std_error": F.stddev_pop("_e"), "max_error": F.max("_a"), "min_error": F.min("_a"),
        "n_samples": F.count(F.lit(1))}
    wanted = {"median_error": ("_e", 0.5), "q25_error": ("_a", 0.25), "q50_error": ("_a", 0.5), "q75_error": ("_a", 0.75), "q95_error": ("_a", 0.95)}
    return column_quantiles(d, keys, wanted, peak, also)


def with_zone(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return df.withColumn("zone", C.zone(C.mgdl(F.col(true)), C.mgdl(F.col(pred))))


def zone_shares(df: DataFrame, keys: Sequence[str] = (), true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Percent of samples in each of the five zones, empty ones included."""
    z = with_zone(df, true, pred)
    n = F.count(F.lit(1))
    wide = z.groupBy(*keys).agg(*[(F.count_if(F.col("zone") == k) / n * 100).alias(k) for k in C.ZONES],
                                *[F.count_if(F.col("zone") == k).alias(f"_n_{k}") for k in C.ZONES])
    rows = F.array(*[F.struct(F.lit(k).alias("zone"), F.col(f"_n_{k}").alias("n"), F.col(k).alias("percent")) for k in C.ZONES])
    return wide.select(*keys, F.inline(rows))


def zone_points(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    z = with_zone(df, true, pred)
    return z.select("zone", F.col(true).alias("actual_mmol_per_l"), F.col(pred).alias("predicted_mmol_per_l"),
                    C.mgdl(F.col(true)).alias("actual_mg_per_dl"), C.mgdl(F.col(pred)).alias("predicted_mg_per_dl"))


# fixed value: rounded factor used by the A+B report only
REPORT_MGDL = 18.0


def ab_and_mard(df: DataFrame, keys: Sequence[str] = (), true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    t, p = F.col(true), F.col(pred)
    z = C.zone(t * F.lit(REPORT_MGDL), p * F.lit(REPORT_MGDL))
    return df.groupBy(*keys).agg((F.avg(z.isin("A", "B").cast("double")) * 100).alias("ab_percent"),
                                 (F.avg(F.abs(p - t) / t) * 100).alias("mard"))


def error_bands(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    band = C.error_band(F.abs(F.col(pred) - F.col(true)))
    n = df.select(band.alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.col("n") / n.agg(F.sum("n").alias("t")).scalar() * 100)


def by_value_range(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """All ranges appear; an empty one has MAE 0."""
    r, a = C.value_range(F.col(true)), F.abs(F.col(pred) - F.col(true))
    wide = df.agg(*[F.coalesce(F.avg(F.when(r == k, a)), F.lit(0.0)).alias(f"m{i}") for i, k in enumerate(C.VALUE_RANGES)],
                  *[F.count_if(r == k).alias(f"n{i}") for i, k in enumerate(C.VALUE_RANGES)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("value_range"), F.col(f"m{i}").alias("mae"),
                                                   F.col(f"n{i}").alias("n")) for i, k in enumerate(C.VALUE_RANGES)])))


def residuals(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    d = df.withColumn("residual", F.col(pred) - F.col(true))
    d = attach(d, d.agg(F.stddev_pop("residual").alias("_sd")), [])
    d = d.withColumn("standardised", F.col("residual") / F.col("_sd")).drop("_sd")
    return d.withColumn("scale_location", F.sqrt(F.abs("standardised")))


def loss(error: Column, kind: str, delta: float = 1.0) -> Column:
    a = F.abs(error)
    if kind == "mse":
        return error * error
    if kind == "mae":
        return a
    if kind == "huber":
        return F.when(a <= delta, 0.5 * error * error).otherwise(delta * (a - 0.5 * delta))
    raise ValueError(f"unknown loss: {kind}")


def losses(df: DataFrame, keys: Sequence[str] = (), delta: float = 1.0, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    e = F.col(pred) - F.col(true)
    return df.groupBy(*keys).agg(*[F.avg(loss(e, k, delta)).alias(k) for k in ("mse", "mae", "huber")])


def history_slope(history: Column) -> Column:
    """Least-squares slope over positions 0..n-1; 0 for a single value."""
    def fit(m):
        zero = F.struct(F.lit(0.0).alias("i"), F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
        mid = (F.size(history) - 1) / 2
        return F.aggregate(history, zero, lambda acc, y: F.struct(
            (acc["i"] + 1).alias("i"), (acc["n"] + (acc["i"] - mid) * (y - m)).alias("n"),
            (acc["d"] + (acc["i"] - mid) * (acc["i"] - mid)).alias("d")), lambda s: s["n"] / (s["d"] + TINY))
    return F.when(F.size(history) < 2, F.lit(0.0)).otherwise(A.let(A.mean(history), fit))


def warmed(weight: float, epoch: Column, warmup: int) -> Column:
    """Weight that grows linearly over the first ``warmup`` epochs."""
    return F.lit(weight) * F.least(epoch / F.lit(float(warmup)), F.lit(1.0))


def history_loss(df: DataFrame, keys: Sequence[str], pred: str, true: str, history: str, smoothness: float = 0.1,
                 trend: float = 0.05, kind: str = "mse", delta: float = 1.0) -> DataFrame:
    """Main loss plus jump from the last history value plus distance from its trend."""
    h = F.col(history)
    last = F.element_at(h, -1)
    jump = F.col(pred) - last
    off = F.when(F.size(h) < 2, F.lit(0.0)).otherwise(F.col(pred) - (last + history_slope(h)))
    parts = df.groupBy(*keys).agg(F.avg(loss(F.col(pred) - F.col(true), kind, delta)).alias("main_loss"),
                                  F.avg(jump * jump).alias("smoothness_loss"), F.avg(off * off).alias("trend_loss"))
    return parts.withColumn("total_loss", F.col("main_loss") + smoothness * F.col("smoothness_loss") + trend * F.col("trend_loss"))


def batch_mae(df: DataFrame, order: Sequence, batch: int, every: int, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    d = indexed(df, [], order, "_rn", "_n")
    step = F.floor((F.col("_rn") - 1) / (batch * every)).cast("long").alias("step")
    return d.groupBy(step).agg(F.avg(F.abs(F.col(pred) - F.col(true))).alias("mae"), F.count(F.lit(1)).alias("n"))


def nan_batches(df: DataFrame, order: Sequence, batch: int, values: Sequence[str]) -> DataFrame:
    """Batches with a missing value are skipped; how many, and how many rows they held."""
    bad = F.lit(False)
    for v in values:
        bad = bad | F.col(v).isNull() | F.isnan(v)
    d = indexed(df.withColumn("_bad", bad), [], order, "_rn", "_n")
    b = d.groupBy(F.floor((F.col("_rn") - 1) / batch).alias("batch")).agg(
        F.bool_or("_bad").alias("bad"), F.count_if("_bad").alias("bad_rows"), F.count(F.lit(1)).alias("n"))
    return b.agg(F.count(F.lit(1)).alias("batches"), F.count_if("bad").alias("skipped"),
                 F.sum("bad_rows").alias("bad_rows"), F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("rows_lost"))


def best_epoch(df: DataFrame, run: Sequence[str], epoch: str, score: str) -> DataFrame:
    """Smallest score, first epoch on a tie; combined before the shuffle."""
    row = F.min_by(F.struct(*df.columns), F.struct(score, epoch)).alias("_r")
    return df.groupBy(*run).agg(row).select("_r.*")


def top_k(df: DataFrame, score: Column, k: int, *tie: str) -> DataFrame:
    return df.withColumn("_s", score).orderBy(F.col("_s").desc(), *tie).limit(k).drop("_s")


def best_per_group(df: DataFrame, group: Sequence[str], score: str, *tie: str) -> DataFrame:
    row = F.min_by(F.struct(*df.columns), F.struct(-F.col(score), *tie)).alias("_r")
    return df.groupBy(*group).agg(row).select("_r.*")
