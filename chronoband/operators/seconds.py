"""Per-second features of fast sensors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoband.operators.ordered import attach, column_quantiles, indexed, quantiles

# fixed values: converter counts at which the pulse signal clips
CLIP_LOW, CLIP_HIGH = 2, 4093


def clip_flag(raw: Column) -> Column:
    return ((raw <= CLIP_LOW) | (raw >= CLIP_HIGH)).cast("double")


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def _sample_std(c: str | Column) -> Column:
    """Sample deviation; a lone row gives 0."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def _per_bucket(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column],
                ranks: Mapping[str, tuple[str, float]]) -> DataFrame:
    out = column_quantiles(df, keys, ranks, also=aggs)
    return out.select(*[c if c not in ranks else F.coalesce(c, F.lit(0.0)).alias(c) for c in out.columns])


def ppg_features(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Input columns raw, filter, hr, hrv, peak; ``keys`` = recording and second."""
    return _per_bucket(df, keys, {
        "ppg_raw_mean_1s": F.avg("raw"), "ppg_raw_std_1s": _sample_std("raw"),
        "ppg_filter_std_1s": _sample_std("filter"), "ppg_peak_rate_1s": F.avg("peak"),
        "ppg_clip_frac_1s": F.avg(clip_flag(F.col("raw"))),
    }, {"ppg_raw_p2_1s": ("raw", 0.02), "ppg_raw_p98_1s": ("raw", 0.98),
        "ppg_hr_median_1s": ("hr", 0.5), "ppg_hrv_median_1s": ("hrv", 0.5)})


def imu_features(df: DataFrame, group: Sequence[str], bucket: str) -> DataFrame:
    """Input columns acc_x..gyr_z; the static part of the acceleration is its median."""
    d = df.withColumn("acc_norm", norm3(F.col("acc_x"), F.col("acc_y"), F.col("acc_z"))).withColumn(
        "gyro_norm", norm3(F.col("gyr_x"), F.col("gyr_y"), F.col("gyr_z")))
    q = quantiles(d, group, "acc_norm", [0.5], "_q")
    d = attach(d, q, group).withColumn("acc_dynamic", F.col("acc_norm") - F.col("_q")[0]).drop("_q")
    return d.groupBy(*group, bucket).agg(
        F.avg("acc_norm").alias("icm_acc_norm_mean_1s"),
        F.sqrt(F.avg(F.col("acc_dynamic") * F.col("acc_dynamic"))).alias("icm_acc_dynamic_rms_1s"),
        _sample_std("acc_norm").alias("icm_acc_norm_std_1s"),
        F.sqrt(F.avg(F.col("gyro_norm") * F.col("gyro_norm"))).alias("icm_gyro_energy_1s"),
        _sample_std("gyro_norm").alias("icm_gyro_std_1s"),
    )


def raw_slots(df: DataFrame, keys: Sequence[str], order: Sequence, value: str | Sequence[str], slots: int, out: str = "slots",
              fill: bool = True) -> DataFrame:
    """Fixed number of raw values per bucket: all of them, zero-filled, or an even
    pick when there are more.  Only picked rows are gathered.  Without ``fill``
    the zeros at the end are left out.

    Several values are picked alike in one pass; their arrays are named
    ``out_value``.
    """
    several = not isinstance(value, str)
    names = {v: f"{out}_{v}" if several else out for v in (value if several else [value])}
    d = indexed(df, keys, order, "_rn", "_n")
    p, n = F.col("_rn") - 1, F.col("_n")
    step = (n - 1) / F.lit(slots - 1)
    near = F.floor(p / step).cast("long")

    def lands(i):
        return F.when(i >= slots - 1, n - 1).otherwise(F.floor(i * step)) == p

    picked = F.when(n <= slots, p).when(p == n - 1, F.lit(slots - 1).cast("long")).when(
        lands(near), near).when(lands(near + 1), near + 1)
    d = d.withColumn("_slot", picked).filter(F.col("_slot").isNotNull())
    cells = F.map_from_entries(F.collect_list(F.struct("_slot", F.struct(*[
        F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(f"v{k}") for k, v in enumerate(names)]).alias("v"))))
    d = d.groupBy(*keys).agg(cells.alias("_m"))
    most = F.lit(slots - 1).cast("long") if fill else F.array_max(F.map_keys("_m"))
    places = F.sequence(F.lit(0).cast("long"), most)

    def filled(k: int) -> Column:
        return F.transform(places, lambda i: F.coalesce(F.col("_m")[i][f"v{k}"], F.lit(0.0)))
    return d.select(*keys, *[filled(k).alias(o) for k, o in enumerate(names.values())])
