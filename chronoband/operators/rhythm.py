"""Sampling gaps, slopes, phases, continuous segments, pulse signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoband.operators.ordered import attach, column_quantiles, framed, group_sizes, indexed, quantiles, scanned
from chronoband.operators.smooth import centred_median

PHASES = ("rise", "flat", "fall")


def with_gap(df, group, order, ts, out="gap", peak=None, rn=None) -> DataFrame:
    """Time since the previous row; NULL on the first."""
    return framed(df, group, order, 1, 0, {out: lambda w: F.col(ts) - F.lag(ts).over(w)}, peak, rn)


def gap_report(df, group: Sequence[str], order, ts, nominal: float, peak=None) -> DataFrame:
    """Rows, span, median interval, rate and number of gaps over twice the nominal interval."""
    if peak is None:
        peak = group_sizes(df, group)[0]
    g = with_gap(df, group, order, ts, peak=peak)
    base = g.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.max(ts) - F.min(ts)).alias("span"),
        F.count_if(F.col("gap") > 2 * nominal).alias("n_gaps"))
    q = quantiles(g, group, "gap", [0.5], "_q", peak).select(*group, F.col("_q")[0].alias("gap_median"))
    return attach(base, q, group).withColumn(
        "rate", F.when(F.col("gap_median") > 0, 1 / F.col("gap_median")).otherwise(F.lit(25.0)))


def gradient(df, group, order, ts, value, scale=60.0, out="slope", peak=None, rn=None) -> DataFrame:
    """Second-order slope on an uneven grid, one-sided at the ends."""
    d = framed(df, group, order, 1, 1, {
        "_tp": lambda w: F.lag(ts).over(w), "_vp": lambda w: F.lag(value).over(w),
        "_tn": lambda w: F.lead(ts).over(w), "_vn": lambda w: F.lead(value).over(w)}, peak, rn)
    a, b = F.col(ts) - F.col("_tp"), F.col("_tn") - F.col(ts)
    v = F.col(value)
    inner = (a * a * F.col("_vn") + (b * b - a * a) * v - b * b * F.col("_vp")) / (a * b * (a + b))
    slope = F.when(F.col("_tp").isNull(), (F.col("_vn") - v) / b).when(
        F.col("_tn").isNull(), (v - F.col("_vp")) / a).otherwise(inner)
    return d.withColumn(out, slope * F.lit(scale)).drop("_tp", "_vp", "_tn", "_vn")


def phases(df, group, order, ts, value, smooth_window=5, quantile=0.7, floor=0.0, scale=60.0, peak=None) -> DataFrame:
    """Smoothed value, slope, per-group threshold and rise / flat / fall."""
    if peak is None:
        peak = group_sizes(df, group)[0]
    width = max(smooth_window, 3)
    width += 1 - width % 2
    d = indexed(df, group, order, "_pos", "_size", peak)
    d = centred_median(d, group, order, value, width, "smooth", peak, "_pos")
    d = gradient(d, group, order, ts, "smooth", scale, "slope", peak, "_pos").drop("_pos", "_size")
    q = quantiles(d, group, F.abs("slope"), [quantile], "_q", peak)
    thr = q.select(*group, F.greatest(F.col("_q")[0], F.lit(float(floor))).alias("threshold"))
    d = attach(d, thr, group)
    return d.withColumn("phase", F.when(F.col("slope") > F.col("threshold"), "rise").when(
        F.col("slope") < -F.col("threshold"), "fall").otherwise("flat"))


def segments(df, group, order, ts, index: str | None = None, factor=5.0, jump=2, out="segment", peak=None) -> DataFrame:
    """Number continuous stretches from 0.  A stretch ends on a gap over ``factor``
    times the median positive gap, on a step back in time, or on a jump of the
    split index beyond ``jump``."""
    if peak is None:
        peak = group_sizes(df, group)[0]
    exprs = {"_gap": lambda w: F.col(ts) - F.lag(ts).over(w)}
    if index:
        exprs["_step"] = lambda w: F.abs(F.col(index) - F.lag(index).over(w))
    d = indexed(df, group, order, "_pos", "_size", peak)
    d = framed(d, group, order, 1, 0, exprs, peak, "_pos")
    q = quantiles(d.filter(F.col("_gap") > 0), group, "_gap", [0.5], "_q", peak)
    limit = q.select(*group, (F.col("_q")[0] * F.lit(factor)).alias("_limit"))
    d = attach(d, limit, group)
    cut = (F.col("_gap") > F.coalesce(F.col("_limit"), F.lit(factor))) | (F.col("_gap") < 0)
    if index:
        cut = cut | (F.col("_step") > jump)
    d = d.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("long"))
    d = scanned(d, group, order, total={out: F.col("_cut")}, peak=peak, rn="_pos")
    return d.drop("_pos", "_size", "_gap", "_step", "_limit", "_cut")


def index_gaps(df, group, order, ts, index, peak=None) -> DataFrame:
    """Time ranges skipped where the split index jumps by more than one."""
    d = framed(df, group, order, 0, 1, {
        "gap_end": lambda w: F.lead(ts).over(w), "_i": lambda w: F.lead(index).over(w)}, peak)
    return d.filter(F.col("_i") - F.col(index) > 1).withColumn("gap_start", F.col(ts)).drop("_i")


# fixed values: calibration of the ratio of ratios, and its clip range
SPO2_A, SPO2_B, SPO2_LOW, SPO2_HIGH = 110.0, 25.0, 70.0, 100.0


def spo2(df, group, order, red, ir, out="spo2", peak=None) -> DataFrame:
    """Oxygen saturation from the ratio of ratios over 100 rows, then a 50-row mean."""
    if peak is None:
        peak = group_sizes(df, group)[0]
    d = indexed(df, group, order, "_pos", "_size", peak)
    frame = lambda w: w.rowsBetween(-50, 49)
    d = framed(d, group, order, 50, 49, {
        "_ra": lambda w: F.stddev_pop(red).over(frame(w)), "_rd": lambda w: F.avg(red).over(frame(w)),
        "_ia": lambda w: F.stddev_pop(ir).over(frame(w)), "_id": lambda w: F.avg(ir).over(frame(w)),
        "_m": lambda w: F.count(F.lit(1)).over(frame(w))}, peak, "_pos")
    ratio = (F.col("_ra") / F.col("_rd")) / (F.col("_ia") / F.col("_id"))
    value = F.least(F.greatest(F.lit(SPO2_A) - F.lit(SPO2_B) * ratio, F.lit(SPO2_LOW)), F.lit(SPO2_HIGH))
    valid = (F.col("_m") > 10) & (F.col("_rd") > 0) & (F.col("_id") > 0) & (F.col("_ia") > 0)
    d = d.withColumn("_v", F.when(valid, value).otherwise(F.lit(0.0)))
    d = framed(d, group, order, 25, 24, {out: lambda w: F.sum("_v").over(w.rowsBetween(-25, 24)) / F.lit(50.0)}, peak, "_pos")
    return d.drop("_pos", "_size", "_ra", "_rd", "_ia", "_id", "_m", "_v")


def heart_rate(df, group, order, peak_mark, rate_hz, window_s=10, out="heart_rate", peak=None) -> DataFrame:
    """Rate from peak marks within ``window_s`` on both sides, then a 3-second mean."""
    if peak is None:
        peak = group_sizes(df, group)[0]
    reach = int(window_s * rate_hz) - 1
    width = int(rate_hz * 3)
    ahead = (width - 1) // 2
    d = indexed(df, group, order, "_pos", "_size", peak)
    mark = F.when(F.col(peak_mark) & (F.col("_pos") > 1), F.col("_pos"))
    frame = lambda w: w.rowsBetween(-reach, reach)
    d = framed(d, group, order, reach, reach, {
        "_c": lambda w: F.count(mark).over(frame(w)), "_a": lambda w: F.min(mark).over(frame(w)),
        "_b": lambda w: F.max(mark).over(frame(w))}, peak, "_pos")
    hr = F.when(F.col("_c") > 1, F.lit(60.0 * rate_hz) * (F.col("_c") - 1) / (F.col("_b") - F.col("_a"))).otherwise(F.lit(0.0))
    d = d.withColumn("_hr", hr)
    d = framed(d, group, order, width - 1 - ahead, ahead, {
        out: lambda w: F.sum("_hr").over(w.rowsBetween(-(width - 1 - ahead), ahead)) / F.lit(float(width))}, peak, "_pos")
    return d.drop("_pos", "_size", "_c", "_a", "_b", "_hr")


def running_error(df, order, error, most=100, out="running_mean") -> DataFrame:
    """Mean of the next ``min(most, n // 10)`` absolute errors, where all exist."""
    n = df.count()
    width = max(1, min(most, n // 10))
    d = indexed(df, [], order, "_pos", "_size", n)
    d = framed(d, [], order, 0, width - 1, {
        out: lambda w: F.avg(F.abs(error)).over(w.rowsBetween(0, width - 1))}, n, "_pos")
    return d.filter(F.col("_pos") <= F.col("_size") - width + 1).drop("_pos", "_size")


def without_bias(df, group, values: Sequence[str], suffix="_centred", peak=None) -> DataFrame:
    """Value minus the median of its axis."""
    if peak is None:
        peak = group_sizes(df, group)[0]
    middle = column_quantiles(df, group, {f"_m_{v}": (v, 0.5) for v in values}, peak)
    d = attach(df, middle, list(group))
    return d.select(*df.columns, *[(F.col(v) - F.col(f"_m_{v}")).alias(v + suffix) for v in values])
