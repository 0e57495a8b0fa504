"""History windows: by count, by time, label histories, RF images.

A window never crosses its group.  The row it belongs to is never part of a
count or time window.  Count windows stay lazy (``sample`` and ``start``
positions) until something needs their content.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoband.functions import arrays as A
from chronoband.operators.ordered import attach, framed, group_sizes, indexed, time_framed

PADDINGS = ("drop", "zero", "repeat", "edge")
# fixed value: history used when nothing has been seen yet
EMPTY_HISTORY_VALUE = 5.0


def _check(padding: str) -> None:
    if padding not in PADDINGS:
        raise ValueError(f"unknown padding: {padding}")


def _first_of_group(df, group, value: str, peak=None, rn="_pos") -> DataFrame:
    first = df.filter(F.col(rn) == 1).select(*group, F.col(value).alias("_edge"))
    return attach(df, first, group)


def count_windows(df: DataFrame, group: Sequence[str], order: Sequence, value: str, width: int,
                  padding: str = "drop", zero: Column | None = None, out: str = "history",
                  peak: int | None = None) -> DataFrame:
    """The ``width`` rows before each row.

    ``drop`` loses the first ``width`` rows of a group, the paddings only the
    first.  ``zero`` is the padding element (0.0 unless values are arrays);
    ``repeat`` and ``edge`` both repeat the first value of the group.
    """
    _check(padding)
    if peak is None:
        peak = group_sizes(df, group)[0]
    d = indexed(df, group, order, "_pos", "_size", peak)
    if padding in ("repeat", "edge"):
        d = _first_of_group(d, group, value)
    d = framed(d, group, order, width, 0, {out: lambda w: F.collect_list(value).over(w.rowsBetween(-width, -1))}, peak, "_pos")
    if padding == "drop":
        d = d.filter(F.col("_pos") > width)
    else:
        fill = F.col("_edge") if padding != "zero" else (zero if zero is not None else F.lit(0.0))
        d = d.filter(F.col("_pos") > 1).withColumn(out, A.pad_front(F.col(out), width, fill))
    return d.drop("_pos", "_size", "_edge")


def window_index(df: DataFrame, group: Sequence[str], order: Sequence, width: int, peak=None) -> DataFrame:
    """Lazy form: ``start`` and ``stop`` (exclusive) positions inside the group."""
    d = indexed(df, group, order, "stop", "_size", peak)
    return d.filter(F.col("stop") > width).withColumn("start", F.col("stop") - width).drop("_size")


def time_windows(df: DataFrame, group: Sequence[str], us: str, value: str, label: str, reach_us: int,
                 step_us: int | None = None, padding: str = "drop", zero: float = 0.0,
                 peak: int | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Values and labels of ``[t - reach, t)``, all at one length.

    With ``step_us`` the window is read at ``t - reach, t - reach + step, ...``
    (nearest sample).  Only empty windows count as missing; the others are cut
    to the newest values or padded with their own first one.  An empty window
    is padded instead of dropped when asked, with the padded label history.
    ``tie`` orders rows of one time: it says which is a group's first.
    """
    _check(padding)
    if peak is None:
        peak = group_sizes(df, group)[0]
    keep = F.struct(F.col(us).alias("us"), F.col(value).alias("v"), F.col(label).alias("y"))
    d = indexed(df, group, [us, *tie], "_pos", "_size", peak)
    if padding in ("repeat", "edge"):
        d = _first_of_group(d, group, value)
        y0 = d.filter(F.col("_pos") == 1).select(*group, F.col(label).alias("_edge_y"))
        d = attach(d, y0, group)
    d = time_framed(d, group, us, reach_us, {
        "_w": lambda w: F.array_sort(F.collect_list(keep).over(w.rangeBetween(-reach_us, -1)))}, peak)
    if padding == "drop":
        d = d.filter(F.size("_w") > 0)
    if step_us:
        grid = F.sequence(F.col(us) - F.lit(reach_us), F.col(us) - 1, F.lit(step_us).cast("long"))
        near = A.let(F.transform("_w", lambda s: s["us"]), lambda ts: F.transform(
            grid, lambda g: A.nearest(F.col("_w"), ts, g, "us")))
        sampled = F.when(F.size("_w") > 0, near).otherwise(F.slice("_w", 1, 0))
        width = int(reach_us / step_us)
    else:
        sampled = F.col("_w")
        width = int(d.agg(F.max(F.size("_w"))).first()[0] or 1)
    def pad_value(w):
        """What stands in for missing rows: the window's own oldest, else by mode."""
        oldest = F.get(w, 0)
        no_time = F.lit(None).cast("long").alias("us")
        if padding == "drop":
            return oldest
        if padding == "zero":
            return F.coalesce(oldest, F.struct(no_time, F.lit(zero).alias("v"), F.lit(zero).alias("y")))
        return F.coalesce(oldest, F.struct(no_time, F.col("_edge").alias("v"), F.col("_edge_y").alias("y")))

    if padding in ("repeat", "edge"):
        d = d.filter((F.size("_w") > 0) | (F.col("_pos") > 1))
    newest = lambda w: F.slice(w, F.greatest(F.size(w) - width + 1, F.lit(1)), width)
    # one expression, so a filter pushed below it does not multiply the grid look-ups
    d = d.withColumn("_w", A.let(sampled, lambda w: A.pad_front(newest(w), width, pad_value(w))))
    return d.select(*df.columns, F.transform("_w", lambda s: s["v"]).alias("history"),
                    F.transform("_w", lambda s: s["y"]).alias("label_history"))


def label_history(df: DataFrame, group: Sequence[str], order: Sequence, label: str, n: int, aligned: bool = True,
                  padding: str = "edge", out: str = "label_history", peak=None) -> DataFrame:
    """Last ``n`` labels; without (aligned) or with the current one."""
    lo, hi = (-n, -1) if aligned else (-(n - 1), 0)
    d = framed(df, group, order, n, 0, {out: lambda w: F.collect_list(label).over(w.rowsBetween(lo, hi))}, peak)
    fill = F.coalesce(F.get(F.col(out), 0), F.col(label)) if padding == "edge" else F.lit(0.0)
    return d.withColumn(out, A.pad_front(F.col(out), n, fill))


def history_from_window(history: Column, n: int, aligned: bool = True) -> Column:
    """Label history taken from a time window.  The aligned form skips the newest
    value and, when the window is not longer than ``n``, comes out one short."""
    size = F.size(history)
    keep = F.least(F.lit(n), size)
    if not aligned:
        return F.slice(history, size - keep + 1, keep)
    start = F.greatest(size - (keep + 1), F.lit(0))
    return F.slice(history, start + 1, size - 1 - start)


def rf_image_index(df: DataFrame, group: Sequence[str], us: str, sample: str, label: str, reach_us: int,
                   min_samples: int = 2, peak=None) -> DataFrame:
    """Rows with a full closed window ``[t - reach, t]``: first sample and mean label."""
    first = df.groupBy(*group).agg(F.min(us).alias("_t0"), F.count(F.lit(1)).alias("_n"))
    frame = lambda w: w.rangeBetween(-reach_us, 0)
    d = time_framed(df, group, us, reach_us, {
        "start": lambda w: F.min_by(sample, F.struct(us, sample)).over(frame(w)),
        "mean_label": lambda w: F.avg(label).over(frame(w)),
        "_m": lambda w: F.count(F.lit(1)).over(frame(w))}, peak)
    d = attach(d, first, group)
    return d.filter((F.col("_t0") <= F.col(us) - reach_us) & (F.col("_n") >= min_samples)
                    & (F.col("_m") >= min_samples)).drop("_t0", "_n", "_m")


def rf_image(df: DataFrame, group: Sequence[str], us: str, power: str, reach_us: int, time_bins: int,
             out: str = "image", peak=None) -> DataFrame:
    """Spectra of ``[t - reach, t]`` resampled to ``time_bins`` rows by straight lines
    whose weights stay within 0..1."""
    keep = F.struct(F.col(us).alias("us"), F.col(power).alias("v"))
    d = time_framed(df, group, us, reach_us, {
        "_w": lambda w: F.array_sort(F.collect_list(keep).over(w.rangeBetween(-reach_us, 0)))}, peak)
    size = F.size("_w")

    def row(b):
        g = F.col(us) - F.lit(float(reach_us)) + b * F.lit(reach_us / (time_bins - 1))
        before = F.size(F.filter("_w", lambda s: s["us"] < g))
        right = F.least(F.greatest(before, F.lit(1)), size - 1)

        def blend(pair):
            a, z = pair["a"], pair["z"]
            share = F.least(F.greatest((g - a["us"]) / F.greatest(z["us"] - a["us"], F.lit(1)), F.lit(0.0)), F.lit(1.0))
            return F.zip_with(a["v"], z["v"], lambda x, y: x * (1 - share) + y * share)
        return A.let(F.struct(F.get(F.col("_w"), right - 1).alias("a"), F.get(F.col("_w"), right).alias("z")), blend)

    single = F.array_repeat(F.get(F.col("_w"), 0)["v"], time_bins)
    image = F.transform(F.sequence(F.lit(0), F.lit(time_bins - 1)), row)
    return d.withColumn(out, F.when(size == 1, single).otherwise(image)).drop("_w")


def resampled_history(df: DataFrame, group: Sequence[str], us: str, value: str, n: int, step_us: int,
                      reach_us: int, out: str = "history", peak=None) -> DataFrame:
    """``n`` values at ``t - n*step, ..., t - step``, each from the nearest past sample;
    the empty-history constant when nothing is within ``reach_us``."""
    keep = F.struct(F.col(us).alias("us"), F.col(value).alias("v"))
    d = time_framed(df, group, us, reach_us, {
        "_w": lambda w: F.array_sort(F.collect_list(keep).over(w.rangeBetween(-reach_us, -1)))}, peak)
    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col(us) - (F.lit(n) - i) * F.lit(step_us).cast("long"))
    near = A.let(F.transform("_w", lambda s: s["us"]), lambda ts: F.transform(
        grid, lambda g: A.nearest(F.col("_w"), ts, g, "us")["v"]))
    return d.withColumn(out, F.when(F.size("_w") == 0, F.array_repeat(F.lit(EMPTY_HISTORY_VALUE), n)).otherwise(near)).drop("_w")


def thinned(df: DataFrame, order: Sequence, most: int) -> DataFrame:
    """At most ``most`` rows at evenly spread positions (a report, not a skew guard)."""
    d = indexed(df, [], order, "_rn", "_n")
    p, n = F.col("_rn") - 1, F.col("_n")
    step = (n - 1) / F.lit(float(most - 1))
    near = F.floor(p / step)

    def lands(i):
        return F.floor(i * step) == p
    keep = (n <= most) | (p == n - 1) | (lands(near) & (near < most - 1)) | (lands(near + 1) & (near + 1 < most - 1))
    return d.filter(keep).drop("_rn", "_n")


def fixed_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows, the same ones every time: smallest hashes of key and seed."""
    return df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))).orderBy("_h", key).limit(n).drop("_h")


def window_overlap(df: DataFrame, group: Sequence[str], order: Sequence, width: int, split: str, peak=None) -> DataFrame:
    """How many history rows of each test window belong to train (leakage report)."""
    d = framed(df, group, order, width, 0, {
        "train_rows": lambda w: F.sum((F.col(split) == "train").cast("long")).over(w.rowsBetween(-width, -1))}, peak)
    return d.filter(F.col(split) == "test").withColumn("train_rows", F.coalesce("train_rows", F.lit(0)))
