"""Summary tables: recordings, days, ranges, boxes, the master table, the JSON summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoband.functions import spectrum as P
from chronoband.operators import align, rhythm, splits
from chronoband.operators.ordered import attach, framed, group_sizes, indexed, quantiles


def recording_metadata(df: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg(label).alias("label_mean"), F.stddev_pop(label).alias("label_std"),
        F.min(label).alias("label_min"), F.max(label).alias("label_max"))


def audit(samples: DataFrame, labels: DataFrame, group: Sequence[str], ts: str, label_ts: str, value: str,
          tie: Sequence, label_tie: Sequence, phase_args: dict | None = None) -> DataFrame:
    """Per recording: sizes, median intervals, alignment error, phase threshold, label range."""
    group = list(group)
    n_s, n_l = group_sizes(samples, group)[0], group_sizes(labels, group)[0]
    s = samples.groupBy(*group).agg(F.count(F.lit(1)).alias("n_spectrum"), F.min(ts).alias("start_time"), F.max(ts).alias("end_time"))
    g = labels.groupBy(*group).agg(F.count(F.lit(1)).alias("n_labels"), F.min(value).alias("label_min"),
                                   F.max(value).alias("label_max"), F.avg(value).alias("label_mean"))

    def median_gap(df, order, t, peak, name):
        d = rhythm.with_gap(df, group, order, t, peak=peak)
        return quantiles(d, group, "gap", [0.5], "_q", peak).select(*group, F.col("_q")[0].alias(name))
    out = s.join(g, group)
    out = out.join(median_gap(samples, [ts, *tie], ts, n_s, "spectrum_dt_median"), group, "left")
    out = out.join(median_gap(labels, [label_ts, *label_tie], label_ts, n_l, "label_dt_median"), group, "left")
    e = align.nearest_error(samples, labels, group, ts, label_ts, "_e", tie)
    q = quantiles(e, group, "_e", [0.5, 0.95], "_q", n_s).select(
        *group, F.col("_q")[0].alias("align_error_median"), F.col("_q")[1].alias("align_error_p95"))
    out = out.join(q, group, "left")
    ph = rhythm.phases(labels, group, [label_ts, *label_tie], label_ts, value, peak=n_l, **(phase_args or {}))
    return out.join(ph.groupBy(*group).agg(F.max("threshold").alias("phase_threshold")), group, "left")


def part_ranges(df: DataFrame, split: str, label: str, ts: str, tie: str) -> DataFrame:
    """Range, mean and the values at the first and last time of every part."""
    first = F.min_by(label, F.struct(ts, tie))
    last = F.max_by(label, F.struct(ts, tie))
    return df.filter(F.col(split).isNotNull()).groupBy(split).agg(
        F.count(F.lit(1)).alias("n"), F.min(label).alias("label_min"), F.max(label).alias("label_max"),
        F.avg(label).alias("label_mean"), F.stddev_pop(label).alias("label_std"), F.min(ts).alias("t_start"),
        F.max(ts).alias("t_end"), first.alias("first_label"), last.alias("last_label"), (last - first).alias("change"))


def day_summary(df: DataFrame, keys: Sequence[str], label: str, slope: str, power: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.min(label).alias("label_min"), F.max(label).alias("label_max"),
        F.avg(label).alias("label_mean"), F.stddev_samp(label).alias("label_std"), F.avg(slope).alias("slope_mean"),
        F.stddev_samp(slope).alias("slope_std"), F.avg(power).alias("power_mean"), F.stddev_samp(power).alias("power_std"))


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers (outermost value within 1.5 IQR) and points beyond."""
    keys = list(keys)
    q = quantiles(df, keys, value, [0.25, 0.5, 0.75], "_q").select(
        *keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    v, iqr = F.col(value), F.col("q3") - F.col("q1")
    inside = v.between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return attach(df, q, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_beyond"))


def power_statistics(df: DataFrame, power: str = "power") -> DataFrame:
    """Extremes, mean and 5th/95th percentile over all cells, and the bin that is
    most often the lowest of its row (smallest bin on ties)."""
    cells = df.select(F.explode(power).alias("x"))
    base = cells.agg(F.min("x").alias("power_min"), F.max("x").alias("power_max"), F.avg("x").alias("power_mean"))
    q = quantiles(cells, [], "x", [0.05, 0.95], "_q").select(F.col("_q")[0].alias("p5"), F.col("_q")[1].alias("p95"))
    low = df.groupBy(P.min_bin(F.col(power))["bin"].alias("b")).agg(F.count(F.lit(1)).alias("n"))
    mode = low.agg(F.min_by("b", F.struct(-F.col("n"), F.col("b"))).alias("most_frequent_min_bin"))
    return attach(attach(base, q, []), mode, [])


def mean_spectrum(cells: DataFrame, group: str, bin: str = "bin", value: str = "x") -> DataFrame:
    return cells.groupBy(group, bin).agg(F.avg(value).alias("mean_power"))


def share_of_total(df: DataFrame, name: str, amount: str) -> DataFrame:
    s = df.groupBy(name).agg(F.sum(amount).alias("amount"))
    return s.withColumn("percent", F.col("amount") / s.agg(F.sum("amount").alias("t")).scalar() * 100)


def master_table(df: DataFrame, exp: str, day: str, ts: str, tie: Sequence[str], power: str = "power",
                 train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Sample ids in recording order, dense day order, split by whole days, band powers."""
    d = indexed(df, [], [exp, ts, *tie], "sample_id", "_n").drop("_n").withColumn("sample_id", F.col("sample_id") - 1)
    d = splits.three_way_dates(d, day, ts, train, val).withColumnRenamed("split", "split_label")
    days = indexed(d.select(day).distinct(), [], [day], "date_order", "_n").drop("_n")
    d = attach(d, days, [day]).withColumn("_p", P.third_powers(F.col(power)))
    return d.select("*", *[F.col(f"_p.{c}").alias(f"spec_{c}_power") for c in ("total", "low", "mid", "high")]).drop("_p")


def union_recordings(parts: Sequence[DataFrame], keys: Sequence[str], out: str = "exp_index") -> DataFrame:
    """Union of users' recordings with one consecutive index over (user, recording)."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    ids = indexed(whole.select(*keys).distinct(), [], list(keys), out, "_n").drop("_n")
    return attach(whole, ids.withColumn(out, F.col(out) - 1), list(keys))


def summary_json(samples: DataFrame, distances: DataFrame, effects: DataFrame, split_shift: DataFrame, exp: str,
                 label: str, phase: str, error: str, top: int = 20, days: DataFrame | None = None, clusters: DataFrame | None = None,
                 audit_rows: DataFrame | None = None) -> DataFrame:
    """One row holding the diagnostic summary; every input is an aggregate already.

    ``days`` is a ``day_summary`` by day and split, ``clusters`` has (name,
    value), ``audit_rows`` a row per recording.
    """
    q = quantiles(samples, [], error, [0.5, 0.95], "_q")
    base = samples.agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct(exp).alias("n_experiments"),
                       F.min(label).alias("lo"), F.max(label).alias("hi"))
    ratio = samples.groupBy(phase).agg(F.count(F.lit(1)).alias("n"))
    ratio = ratio.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(phase, F.lit("")).alias("phase"), "n")))).alias("phase_counts"))
    worst = split_shift.agg(F.max_by("strategy", F.struct("wasserstein", "strategy")).alias("worst_split"))
    best = effects.orderBy(F.col("abs_effect").desc(), "bin").limit(top).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("abs_effect")).alias("rank"), "bin", "effect"))).alias("effects"))
    shift = distances.filter("scope = 'global'").groupBy("variable").agg(
        F.max_by(F.struct("target", "psi", "wasserstein"), F.struct("psi", "target")).alias("s"))
    shift = shift.agg(F.array_sort(F.collect_list(F.struct("variable", F.col("s.target").alias("target_split"),
                                                           F.col("s.psi").alias("psi"), F.col("s.wasserstein").alias("wasserstein")))).alias("shifts"))
    d = base
    for part in (q, ratio, worst, best, shift):
        d = attach(d, part, [])
    fields = [
        "n_samples", "n_experiments", F.array("lo", "hi").alias("label_range"), F.col("_q")[0].alias("align_error_median"),
        F.col("_q")[1].alias("align_error_p95"),
        F.transform_values("phase_counts", lambda k, v: v / F.col("n_samples")).alias("phase_ratio"),
        F.col("worst_split").alias("worst_split_by_wasserstein"),
        F.transform("effects", lambda e: F.struct(e["bin"].alias("spectral_index"), e["effect"].alias("effect"))).alias("top_effects"),
        F.col("shifts").alias("global_top_shift_variables")]
    if days is not None:
        mean_of = lambda s: F.avg(F.when(F.col("split") == s, F.col("label_mean")))
        n = days.groupBy("split").agg(F.sum("n_samples").alias("n"))
        n = n.where("split IS NOT NULL").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("split_counts"))
        d = attach(attach(d, days.agg(F.countDistinct("day").alias("days"), mean_of("train").alias("train_mean"), mean_of("test").alias("test_mean")), []), n, [])
        fields.append(F.struct("days", "split_counts", F.col("train_mean").alias("train_label_mean"), F.col("test_mean").alias("test_label_mean")).alias("day_highlights"))
    if clusters is not None:
        d = attach(d, clusters.where("value IS NOT NULL").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("cluster_stats")), [])
        fields.append("cluster_stats")
    if audit_rows is not None:
        d = attach(d, audit_rows.agg(F.array_sort(F.collect_list(F.struct("*"))).alias("audit_rows")), [])
        fields.append("audit_rows")
    return d.select(F.to_json(F.struct(*fields)).alias("summary"))
