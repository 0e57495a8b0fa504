"""Causal smoothing along time, two-sided smoothing along the frequency axis."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoband.functions import arrays as A
from chronoband.operators.array_windows import smoothed_rows
from chronoband.operators.ordered import attach, framed, indexed, matched, quantiles
from chronoband.operators.recurrence import ema

# ---- time axis: scalar series, past only -----------------------------------


def causal_mean(df, group, order, value, width=5, out="smooth", peak=None):
    return framed(df, group, order, width - 1, 0,
                  {out: lambda w: F.avg(value).over(w.rowsBetween(-(width - 1), 0))}, peak)


def causal_median(df, group, order, value, width=5, out="smooth", peak=None):
    return framed(df, group, order, width - 1, 0,
                  {out: lambda w: F.percentile(value, F.lit(0.5)).over(w.rowsBetween(-(width - 1), 0))}, peak)


def centred_median(df, group, order, value, width, out="smooth", peak=None, rn=None):
    """Odd width, at least 3; shrinks at both ends."""
    width = max(width, 3)
    half = width // 2
    return framed(df, group, order, half, half,
                  {out: lambda w: F.percentile(value, F.lit(0.5)).over(w.rowsBetween(-half, half))}, peak, rn)


def causal_gaussian(df, group, order, value, sigma=2.0, out="smooth", peak=None):
    """Weights of the last ``int(4*sigma)`` rows, renormalised at the start."""
    if sigma <= 0:
        return df.withColumn(out, F.col(value))
    reach = int(4 * sigma)
    if reach < 1:
        raise ValueError("sigma too small for a causal window")
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(reach)]

    def expr(w):
        num, den = F.lit(0.0), F.lit(0.0)
        for k, g in enumerate(weights):
            x = F.lag(value, k).over(w) if k else F.col(value)
            num = num + F.coalesce(x * F.lit(g), F.lit(0.0))
            den = den + F.when(x.isNotNull(), F.lit(g)).otherwise(F.lit(0.0))
        return num / den
    return framed(df, group, order, reach - 1, 0, {out: expr}, peak)


def savgol_weights(length: int, order: int, at: int) -> np.ndarray:
    """Weights of the least-squares polynomial through ``length`` points, read at index ``at``."""
    x = np.arange(length, dtype=float) - at
    return np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0]


def causal_savgol_weights(length: int, order: int) -> np.ndarray:
    """Weights over the newest rows when the newest value is repeated to the right."""
    odd = length if length % 2 else length - 1
    half = odd // 2
    c = savgol_weights(odd, order, half)
    return np.append(c[:half], c[half:].sum())


def causal_savgol(df, group, order, value, width=11, poly=3, out="smooth", peak=None):
    """Polynomial smoothing of past rows; short starts use the mean, short series stay."""
    if width <= poly:
        width = poly + 2
    least = poly + 2
    d = indexed(df, group, order, "_pos", "_size", peak)
    d = framed(d, group, order, width - 1, 0,
               {"_f": lambda w: F.collect_list(value).over(w.rowsBetween(-(width - 1), 0))}, peak, "_pos")
    m = F.size("_f")
    smooth = F.when(m < least, A.mean(F.col("_f")))
    for length in range(least, width + 1):
        g = causal_savgol_weights(length, poly)
        tail = F.slice("_f", -len(g), len(g))
        smooth = smooth.when(m == length, A.dot(tail, A.literal(g)))
    return d.withColumn(out, F.when(F.col("_size") < least, F.col(value)).otherwise(smooth)).drop("_pos", "_size", "_f")


def inward_window(df, group, order, value, width=5, how="median", out="smooth", peak=None):
    """Full-width window that slides inward at both ends; short series stay as they are."""
    d = indexed(df, group, order, "_pos", "_size", peak)
    reach = width - 1
    d = framed(d, group, order, reach, reach,
               {"_f": lambda w: F.collect_list(value).over(w.rowsBetween(-reach, reach))}, peak, "_pos")
    i, n = F.col("_pos") - 1, F.col("_size")
    start = F.least(F.greatest(i - width // 2, F.lit(0)), n - width)
    seen = F.greatest(i - reach, F.lit(0))
    part = F.slice("_f", (start - seen + 1).cast("int"), width)
    value_of = A.median(part) if how == "median" else A.mean(part)
    return d.withColumn(out, F.when(n < width, F.col(value)).otherwise(value_of)).drop("_pos", "_size", "_f")


TIME_METHODS: Mapping[str, Callable[..., DataFrame]] = {
    "moving_average": causal_mean,
    "ema": ema,
    "gaussian": causal_gaussian,
    "savgol": causal_savgol,
    "median": causal_median,
}

# ---- frequency axis: one array per row -------------------------------------


def _odd(width: int) -> int:
    return width if width % 2 else width + 1


def _neighbours(a: Column, i: Column, half: int) -> list[Column]:
    """Elements i-half..i+half, 0 beyond the ends."""
    return [F.coalesce(F.when(i + k >= 0, F.get(a, i + k)), F.lit(0.0)) for k in range(-half, half + 1)]


def frequency_mean(a: Column, width: int = 5) -> Column:
    if width < 2:
        return a
    width = _odd(width)

    def one(x, i):
        acc = F.lit(0.0)
        for v in _neighbours(a, i, width // 2):
            acc = acc + v
        return acc / F.lit(float(width))
    return F.transform(a, one)


def frequency_median(a: Column, width: int = 5) -> Column:
    if width < 2:
        return a
    width = _odd(width)
    half = width // 2
    return F.transform(a, lambda x, i: F.get(F.array_sort(F.array(*_neighbours(a, i, half))), half))


def frequency_ema(a: Column, alpha: float = 0.3) -> Column:
    """Fold over (previous, output); the output array only ever grows at its end."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    seed = F.struct(F.lit(None).cast("double").alias("s"), F.array().cast("array<double>").alias("o"))

    def step(acc, x):
        s = F.when(acc["s"].isNull(), x).otherwise(F.lit(alpha) * x + F.lit(1 - alpha) * acc["s"])
        return A.let(s, lambda v: F.struct(v.alias("s"), F.array_append(acc["o"], v).alias("o")))
    return F.aggregate(a, seed, step, lambda acc: acc["o"])


def frequency_gaussian(a: Column, sigma: float = 2.0) -> Column:
    """Radius ``int(4*sigma+0.5)``, mirrored edges (edge value repeated)."""
    if sigma <= 0:
        return a
    radius = int(4 * sigma + 0.5)
    g = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    g = g / g.sum()
    n = F.size(a)

    def one(x, i):
        acc = F.lit(0.0)
        for k, w in zip(range(-radius, radius + 1), g):
            j = F.pmod(i + k, 2 * n)
            acc = acc + F.lit(float(w)) * F.get(a, F.when(j < n, j).otherwise(2 * n - 1 - j))
        return acc
    return F.transform(a, one)


def frequency_savgol(a: Column, width: int = 11, poly: int = 3) -> Column:
    """Polynomial smoothing; the edge windows' fit is read off at the edge bins."""
    if width <= poly:
        width = poly + 2
    width = _odd(width)
    half = width // 2
    n = F.size(a)
    centre = A.literal(savgol_weights(width, poly, half))
    left = F.array(*[A.literal(savgol_weights(width, poly, i)) for i in range(half)])
    right = F.array(*[A.literal(savgol_weights(width, poly, half + 1 + i)) for i in range(half)])

    def one(x, i):
        start = F.least(F.greatest(i - half, F.lit(0)), n - width)
        weights = F.when(i < half, F.get(left, i)).when(
            i >= n - half, F.get(right, i - (n - half))).otherwise(centre)
        return A.dot(F.slice(a, start + 1, width), weights)
    return F.when(n < width, a).otherwise(F.transform(a, one))


FREQUENCY_METHODS: Mapping[str, Callable[..., Column]] = {
    "moving_average": frequency_mean,
    "ema": frequency_ema,
    "gaussian": frequency_gaussian,
    "savgol": frequency_savgol,
    "median": frequency_median,
}

# ---- spectra: bins as series ------------------------------------------------


def explode_bins(df: DataFrame, keys: Sequence[str], power: str = "power") -> DataFrame:
    return df.select(*keys, F.posexplode(power).alias("bin", "x"))


def collect_bins(df: DataFrame, keys: Sequence[str], value: str = "x", out: str = "power") -> DataFrame:
    """Back to one array per row; the array holds one row's bins only."""
    cells = F.array_sort(F.collect_list(F.struct("bin", F.col(value).alias("x"))))
    return df.groupBy(*keys).agg(F.transform(cells, lambda c: c["x"]).alias(out))


def bin_arrays(stats: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per group from one per (group, bin): an array over the bins of each column."""
    packed = F.array_sort(F.collect_list(F.struct("bin", *columns)))
    return stats.groupBy(*group).agg(packed.alias("_b")).select(*group, *[F.col(f"_b.{c}").alias(c) for c in columns])


def _marked(df: DataFrame, group: Sequence[str], power: str, how: str, threshold: float, peak: int) -> tuple[DataFrame, Callable[[Column, Column], Column]]:
    """Rows with per-bin statistics as arrays, and the test of a value at a bin.  Cells are only aggregated, rows keep their arrays."""
    from chronoband.operators.outliers import IQR_FACTOR

    cells = explode_bins(df, group, power)
    if how == "zscore":
        stats = cells.groupBy(*group, "bin").agg(F.avg("x").alias("_mu"), F.stddev_pop("x").alias("_sd"))
        d = attach(df, bin_arrays(stats, group, ["_mu", "_sd"]), group)
        return d, lambda x, i: F.abs((x - F.get("_mu", i)) / (F.get("_sd", i) + 1e-8)) > threshold
    q = quantiles(cells, [*group, "bin"], "x", [0.25, 0.75], "_q", peak)
    q = q.select(*group, "bin", F.col("_q")[0].alias("_q1"), F.col("_q")[1].alias("_q3"))
    d = attach(df, bin_arrays(q, group, ["_q1", "_q3"]), group)
    lo, hi = (lambda i: F.get("_q1", i)), (lambda i: F.get("_q3", i))
    return d, lambda x, i: (x < lo(i) - IQR_FACTOR * (hi(i) - lo(i))) | (x > hi(i) + IQR_FACTOR * (hi(i) - lo(i)))


def _repaired(d: DataFrame, group: Sequence[str], power: str, bad: Callable[[Column, Column], Column], how: str, peak: int) -> DataFrame:
    """Outliers replaced by the mean or median of the bin's normal values, or all values of the bin clipped to their bounds."""
    from chronoband.operators.outliers import IQR_FACTOR

    normal = explode_bins(d.withColumn("_n", F.transform(power, lambda x, i: F.when(~bad(x, i), x))), group, "_n").where("x IS NOT NULL")
    if how == "mean":
        stats = normal.groupBy(*group, "bin").agg(F.avg("x").alias("_v"))
    elif how == "median":
        stats = quantiles(normal, [*group, "bin"], "x", [0.5], "_q", peak).select(*group, "bin", F.col("_q")[0].alias("_v"))
    else:
        q = quantiles(normal, [*group, "bin"], "x", [0.25, 0.75], "_q", peak)
        lo, hi = F.col("_q")[0], F.col("_q")[1]
        stats = q.select(*group, "bin", (lo - IQR_FACTOR * (hi - lo)).alias("_lo"), (hi + IQR_FACTOR * (hi - lo)).alias("_hi"))
        hit = d.select(*group, F.posexplode(F.transform(power, bad)).alias("bin", "x")).groupBy(*group, "bin").agg(F.bool_or("x").alias("_any"))
        stats = matched(hit, stats, [*group, "bin"], "left")
        d = attach(d, bin_arrays(stats, group, ["_any", "_lo", "_hi"]), group)
        return d.withColumn(power, F.transform(power, lambda x, i: F.when(
            F.get("_any", i), F.least(F.greatest(x, F.get("_lo", i)), F.get("_hi", i))).otherwise(x)))
    # a bin without normal values has no row; its place is kept
    every = d.select(*group, F.posexplode(power).alias("bin", "x")).groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("_c"))
    d = attach(d, bin_arrays(matched(every, stats, [*group, "bin"], "left"), group, ["_v"]), group)
    return d.withColumn(power, F.transform(power, lambda x, i: F.when(bad(x, i), F.get("_v", i)).otherwise(x)))


def smooth_spectra(df: DataFrame, group: Sequence[str], order: Sequence[str], time_method: str = "none",
                   time_args: Mapping | None = None, frequency_method: str = "none",
                   frequency_args: Mapping | None = None, outliers: str | None = None, threshold: float = 3.0,
                   repair_how: str | None = None, power: str = "power") -> DataFrame:
    """Outliers, then time, then frequency; the order is part of the result.

    Spectra of one width without gaps keep their rows: bins are aggregated for
    statistics and smoothed as arrays.  Ragged spectra, spectra with missing
    bins and repair along the rows go bin by bin; rows without bins drop out.
    """
    keys = [*dict.fromkeys([*group, *order])]
    for name, known in ((time_method, TIME_METHODS), (frequency_method, FREQUENCY_METHODS)):
        if name != "none" and name not in known:
            raise ValueError(f"unknown smoothing: {name}")
    if repair_how not in (None, "interpolate", "median", "mean", "clip"):
        raise ValueError(f"unknown repair: {repair_how}")
    out = df.select(*keys, A.doubles(power).alias(power))
    if outliers or time_method != "none":
        width = F.size(power)
        gap = width.isNull() | (width < 1) | F.exists(power, lambda x: x.isNull() | F.isnan(x))
        counts = out.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min(width).alias("lo"), F.max(width).alias("hi"), F.bool_or(gap).alias("gap"))
        peak, lo, hi, gaps = counts.agg(F.max("n"), F.min("lo"), F.max("hi"), F.bool_or("gap")).first()
        peak = int(peak or 0)
        if lo == hi and not gaps and not (outliers and repair_how == "interpolate"):
            if outliers in ("zscore", "iqr") and repair_how:
                marked, bad = _marked(out, group, power, outliers, threshold, peak)
                out = _repaired(marked, group, power, bad, repair_how, peak).select(*keys, power)
            if time_method != "none":
                out = smoothed_rows(out, group, order, power, time_method, time_args or {}, peak)
        else:
            out = _smooth_cells(out, group, order, keys, time_method, time_args, outliers, threshold, repair_how, power, peak)
    if frequency_method != "none":
        out = out.withColumn(power, FREQUENCY_METHODS[frequency_method](F.col(power), **(frequency_args or {})))
    return out


def _smooth_cells(df: DataFrame, group: Sequence[str], order: Sequence[str], keys: list[str], time_method: str, time_args: Mapping | None,
                  outliers: str | None, threshold: float, repair_how: str | None, power: str, peak: int) -> DataFrame:
    """Every bin a series of its own."""
    from chronoband.operators.outliers import flag, repair

    long, series = explode_bins(df, keys, power), [*group, "bin"]
    if outliers:
        long = flag(long, series, "x", outliers, threshold, peak)
        if repair_how:
            long = repair(long, series, order, "x", "outlier", repair_how, peak).drop("x").withColumnRenamed("repaired", "x")
    if time_method != "none":
        long = TIME_METHODS[time_method](long, series, order, "x", out="_s", peak=peak, **(time_args or {}))
        long = long.drop("x").withColumnRenamed("_s", "x")
    return collect_bins(long, keys, "x", power)
