"""Time alignment: as-of joins and interpolation at the clock of another series.

An as-of join is a union of both series, ordered once, with the last (next)
reference carried onto each target; cost is one shuffle of both inputs and no
pairs are formed.  Interpolators turn knots into one polynomial per interval
(windows over the few knots), carry it to the targets and evaluate it there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoband.operators.ordered import attach, framed, group_sizes, indexed, scanned
from chronoband.session import rows_per_chunk

METHODS = ("linear", "nearest", "pchip", "akima", "makima", "cubic")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key in ``order``; combined before the shuffle, so a hot key is cheap."""
    rank = F.struct(*order)
    row = F.min_by(F.struct(*df.columns), rank).alias("_row")
    return df.groupBy(*keys).agg(row).select("_row.*")


def union_peak(left: DataFrame, right: DataFrame, group: Sequence[str]) -> int:
    """Upper bound for the largest group of both inputs together."""
    return group_sizes(left, group)[0] + group_sizes(right, group)[0]


def as_of(targets: DataFrame, refs: DataFrame, group: Sequence[str], t_time: str, r_time: str,
          payload: Column, tie: Sequence = (), peak: int | None = None) -> DataFrame:
    """Every target row with ``prev`` (payload of the last reference at or before
    it) and ``next`` (of the first one after it)."""
    group = list(group)
    left = targets.select(*group, F.col(t_time).alias("_t"), F.lit(1).alias("_k"),
                          F.struct("*").alias("_row"))
    right = refs.select(*group, F.col(r_time).alias("_t"), F.lit(0).alias("_k"), payload.alias("_p"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = ["_t", "_k", *[F.col("_row")[c] for c in tie]]
    if peak is None:
        peak = union_peak(targets, refs, group)
    done = scanned(both, group, order, last={"prev": F.col("_p")}, first={"next": F.col("_p")}, peak=peak)
    return done.filter(F.col("_k") == 1).select("_row.*", "prev", "next")


def nearest_error(targets: DataFrame, refs: DataFrame, group: Sequence[str], t_time: str, r_time: str,
                  out: str = "align_error", tie: Sequence = ()) -> DataFrame:
    """Distance to the nearest reference."""
    j = as_of(targets, refs, group, t_time, r_time, F.col(r_time), tie)
    return j.withColumn(out, F.least(F.col(t_time) - F.col("prev"), F.col("next") - F.col(t_time))).drop("prev", "next")


def _sign(c: Column) -> Column:
    return F.signum(c)


def _edge_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    d = ((F.lit(2.0) * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
    return (
        F.when(_sign(d) != _sign(m0), F.lit(0.0))
        .when((_sign(m0) != _sign(m1)) & (F.abs(d) > F.lit(3.0) * F.abs(m0)), F.lit(3.0) * m0)
        .otherwise(d)
    )


def _pchip_slope() -> Column:
    c = F.col
    w1, w2 = F.lit(2.0) * c("h") + c("h_1"), c("h") + F.lit(2.0) * c("h_1")
    flat = (_sign(c("m")) != _sign(c("m_1"))) | (c("m") == 0) | (c("m_1") == 0)
    inner = F.when(flat, F.lit(0.0)).otherwise((w1 + w2) / (w1 / c("m_1") + w2 / c("m")))
    return (
        F.when(c("rn") == 1, _edge_slope(c("h"), c("h1"), c("m"), c("m1")))
        .when(c("rn") == c("n"), _edge_slope(c("h_1"), c("h_2"), c("m_1"), c("m_2")))
        .otherwise(inner)
    )


def _akima_secants() -> dict[str, Column]:
    """Secants around a knot, two ghosts beyond each end."""
    c, two, three = F.col, F.lit(2.0), F.lit(3.0)
    first, second = c("rn") == 1, c("rn") == 2
    last, before_last = c("rn") == c("n"), c("rn") == c("n") - 1
    return {
        "a": F.when(first, three * c("m") - two * c("m1")).when(second, two * c("m_1") - c("m")).otherwise(c("m_2")),
        "b": F.when(first, two * c("m") - c("m1")).otherwise(c("m_1")),
        "c": F.when(last, two * c("m_1") - c("m_2")).otherwise(c("m")),
        "d": F.when(last, three * c("m_1") - two * c("m_2")).when(before_last, two * c("m") - c("m_1")).otherwise(c("m1")),
    }


def knot_polynomials(knots: DataFrame, group: Sequence[str], time: str, value: str, method: str,
                     peak: int | None = None) -> DataFrame:
    """One cubic per interval: ``poly`` = struct(t0, c0..c3, knot, first, last).

    Knots must have unique times inside a group.  With too few of them the
    method steps down: akima (5) to pchip (3) to linear (2) to a constant.
    """
    if method not in METHODS:
        raise ValueError(f"unknown interpolation: {method}")
    group = list(group)
    if peak is None:
        peak = group_sizes(knots, group)[0]
    k = knots.select(*group, F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("y"))
    if method == "cubic":
        return _cubic_polynomials(k, group, peak)
    k = indexed(k, group, ["t"], peak=peak)
    k = framed(k, group, ["t"], 0, 1, {"_n": lambda w: F.lead(F.struct("t", "y")).over(w)}, peak, "rn")
    k = k.withColumn("h", F.col("_n.t") - F.col("t")).withColumn("m", (F.col("_n.y") - F.col("y")) / F.col("h")).drop("_n")
    if method in ("pchip", "akima", "makima"):
        k = framed(k, group, ["t"], 2, 2, {
            "h_1": lambda w: F.lag("h", 1).over(w), "h_2": lambda w: F.lag("h", 2).over(w),
            "m_1": lambda w: F.lag("m", 1).over(w), "m_2": lambda w: F.lag("m", 2).over(w),
            "h1": lambda w: F.lead("h", 1).over(w), "m1": lambda w: F.lead("m", 1).over(w),
        }, peak, "rn")
        slope = _pchip_slope()
        if method != "pchip":
            s = _akima_secants()
            k = k.select("*", *[v.alias(f"s_{n}") for n, v in s.items()])
            k = k.withColumn("f1", F.abs(F.col("s_d") - F.col("s_c"))).withColumn("f2", F.abs(F.col("s_b") - F.col("s_a")))
            top = k.groupBy(*group).agg(F.max(F.when(F.col("n") >= 5, F.col("f1") + F.col("f2"))).alias("_top"))
            k = attach(k, top, group)
            f12 = F.col("f1") + F.col("f2")
            aki = F.when(f12 > F.lit(1e-9) * F.col("_top"),
                         (F.col("f1") * F.col("s_b") + F.col("f2") * F.col("s_c")) / f12
                         ).otherwise(F.lit(0.5) * (F.col("s_a") + F.col("s_d")))
            slope = F.when(F.col("n") >= 5, aki).otherwise(slope)
        k = k.withColumn("d", F.when(F.col("n") >= 3, slope))
        k = framed(k, group, ["t"], 0, 1, {"d1": lambda w: F.lead("d").over(w)}, peak, "rn")
        h, m, d0, d1 = F.col("h"), F.col("m"), F.col("d"), F.col("d1")
        curved = F.col("n") >= 3
        c1 = F.when(curved, d0).otherwise(m)
        c2 = F.when(curved, (F.lit(3.0) * m - F.lit(2.0) * d0 - d1) / h).otherwise(F.lit(0.0))
        c3 = F.when(curved, (d0 + d1 - F.lit(2.0) * m) / (h * h)).otherwise(F.lit(0.0))
    else:
        c1, c2, c3 = F.col("m"), F.lit(0.0), F.lit(0.0)
    k = k.withColumn("_c", F.struct(F.col("t").alias("t0"), F.col("y").alias("c0"), c1.alias("c1"),
                                    c2.alias("c2"), c3.alias("c3")))
    # the last knot repeats the final interval, which is what extrapolation to the right uses
    k = framed(k, group, ["t"], 1, 0, {"_l": lambda w: F.lag("_c").over(w)}, peak, "rn")
    only = F.struct(F.col("t").alias("t0"), F.col("y").alias("c0"), F.lit(0.0).alias("c1"),
                    F.lit(0.0).alias("c2"), F.lit(0.0).alias("c3"))
    coef = F.when(F.col("rn") < F.col("n"), F.col("_c")).when(F.col("n") == 1, only).otherwise(F.col("_l"))
    poly = F.struct(*[coef[x].alias(x) for x in ("t0", "c0", "c1", "c2", "c3")], F.col("t").alias("knot"),
                    (F.col("rn") == F.col("n")).alias("last"), F.col("n").alias("n"))
    return k.select(*group, "t", "y", poly.alias("poly"))


# A spline slope depends on knots k steps away by less than 2**-k, so a chunk
# solved with this many borrowed knots on each side is exact in double precision.
SPLINE_HALO = 64


def _spline_slopes(t: np.ndarray, y: np.ndarray, left_end: bool, right_end: bool) -> np.ndarray:
    """Knot slopes of the not-a-knot cubic spline (tridiagonal elimination)."""
    n = len(t)
    h, m = np.diff(t), np.diff(y) / np.diff(t)
    if n == 2:
        return np.array([m[0], m[0]])
    if n == 3:
        # one parabola through three points
        c = (m[1] - m[0]) / (t[2] - t[0])
        return m[0] + c * (2 * t - t[0] - t[1])
    lower, diag, upper, rhs = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
    lower[1:-1], diag[1:-1], upper[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    rhs[1:-1] = 3 * (h[1:] * m[:-1] + h[:-1] * m[1:])
    if left_end:
        s = t[2] - t[0]
        diag[0], upper[0] = h[1], s
        rhs[0] = ((h[0] + 2 * s) * h[1] * m[0] + h[0] ** 2 * m[1]) / s
    else:
        rhs[0] = m[0]
    if right_end:
        s = t[-1] - t[-3]
        diag[-1], lower[-1] = h[-2], s
        rhs[-1] = (h[-1] ** 2 * m[-2] + (2 * s + h[-1]) * h[-2] * m[-1]) / s
    else:
        rhs[-1] = m[-1]
    for i in range(1, n):
        f = lower[i] / diag[i - 1]
        diag[i] -= f * upper[i - 1]
        rhs[i] -= f * rhs[i - 1]
    d = np.empty(n)
    d[-1] = rhs[-1] / diag[-1]
    for i in range(n - 2, -1, -1):
        d[i] = (rhs[i] - upper[i] * d[i + 1]) / diag[i]
    return d


def _cubic_polynomials(k: DataFrame, group: list[str], peak: int | None) -> DataFrame:
    """Spline coefficients per chunk of knots; chunks borrow ``SPLINE_HALO`` knots."""
    size = max(rows_per_chunk(k.sparkSession), 2 * SPLINE_HALO)
    k = indexed(k, group, ["t"], peak=peak)
    own = F.floor((F.col("rn") - 1) / size).cast("long")
    k = k.withColumn("_own", own)
    homes = F.array(
        F.col("_own"),
        F.when(F.col("rn") > (F.col("_own") + 1) * size - SPLINE_HALO, F.col("_own") + 1),
        F.when((F.col("rn") <= F.col("_own") * size + SPLINE_HALO + 1) & (F.col("_own") > 0), F.col("_own") - 1),
    )
    k = k.withColumn("_home", F.explode(F.filter(homes, lambda x: x.isNotNull())))
    names = ("t0", "c0", "c1", "c2", "c3")
    keys = [*group, "_home"]
    schema = T.StructType([*[f for f in k.schema.fields if f.name not in ("_own", "_home", "rn")],
                           *[T.StructField(x, T.DoubleType()) for x in names], T.StructField("last", T.BooleanType())])

    def solve(t, y, rn, n):
        c = np.zeros((len(t), 5))
        c[:, 0], c[:, 1] = t, y
        if len(t) >= 2:
            h, m = np.diff(t), np.diff(y) / np.diff(t)
            c[:-1, 2] = m
            if n >= 4:
                d = _spline_slopes(t, y, rn[0] == 1, rn[-1] == n)
                c[:-1, 2] = d[:-1]
                c[:-1, 3] = (3 * m - 2 * d[:-1] - d[1:]) / h
                c[:-1, 4] = (d[:-1] + d[1:] - 2 * m) / h ** 2
            c[-1] = c[-2]
        return c

    def per_run(batches):
        """Rows arrive sorted by key; a run may continue in the next batch."""
        held = None
        for b in _with_end(batches):
            if b is not None:
                held = b if held is None else pd.concat([held, b], ignore_index=True)
            if held is None or not len(held):
                continue
            before = held[keys].shift()
            same = ((held[keys] == before) | (held[keys].isna() & before.isna())).all(axis=1).to_numpy().copy()
            same[:1] = False
            starts = np.flatnonzero(~same)
            stop = len(held) if b is None else starts[-1]
            if stop == 0:
                continue
            done, held = held.iloc[:stop], held.iloc[stop:].reset_index(drop=True)
            t, y, rn, n = (done[x].to_numpy() for x in ("t", "y", "rn", "n"))
            cuts = [*starts[starts < stop], stop]
            c = np.concatenate([solve(t[a:z], y[a:z], rn[a:z], n[a]) for a, z in zip(cuts, cuts[1:])])
            out = done[[*group, "t", "y", "n"]].copy()
            for i, name in enumerate(names):
                out[name] = c[:, i]
            out["last"] = rn == n
            yield out[(done["_own"] == done["_home"]).to_numpy()][schema.names]

    placed = k.repartition(*keys).sortWithinPartitions(*keys, "rn")
    solved = placed.mapInPandas(per_run, schema)
    poly = F.struct(*names, F.col("t").alias("knot"), "last", "n")
    return solved.select(*group, "t", "y", poly.alias("poly"))


def _with_end(batches):
    yield from batches
    yield None


def poly_at(p: Column, t: Column) -> Column:
    x = t - p["t0"]
    return p["c0"] + x * (p["c1"] + x * (p["c2"] + x * p["c3"]))


def interpolate(targets: DataFrame, knots: DataFrame, group: Sequence[str], t_time: str, k_time: str,
                value: str, method: str = "linear", outside: str = "extrapolate", out: str = "interp",
                tie: Sequence = (), min_knots: int = 1) -> DataFrame:
    """``value`` of the knots at every target time.

    ``outside``: ``extrapolate`` by the end polynomials, or ``null``.  Groups
    with fewer than ``min_knots`` knots give NULL; one knot gives a constant.
    """
    if method == "nearest":
        pair = F.struct(F.col(k_time).cast("double").alias("t"), F.col(value).cast("double").alias("y"))
        j = as_of(targets, knots, group, t_time, k_time, pair, tie)
        t = F.col(t_time)
        pick = F.when(F.col("prev").isNull(), F.col("next.y")).when(F.col("next").isNull(), F.col("prev.y")).when(
            t - F.col("prev.t") <= F.col("next.t") - t, F.col("prev.y")).otherwise(F.col("next.y"))
        exact = F.col("prev.t") == t
        inside = (F.col("prev").isNotNull() & F.col("next").isNotNull()) | exact
        return j.withColumn(out, pick if outside == "extrapolate" else F.when(inside, pick)).drop("prev", "next")
    few, many = group_sizes(knots, group)[0], group_sizes(targets, group)[0]
    polys = knot_polynomials(knots, group, k_time, value, method, few)
    j = as_of(targets, polys, group, t_time, "t", F.col("poly"), tie, few + many)
    t = F.col(t_time)
    p = F.coalesce(F.col("prev"), F.col("next"))
    y = poly_at(p, t)
    if outside == "null":
        single = p["n"] == 1
        inside = F.col("prev").isNotNull() & (~F.col("prev.last") | (F.col("prev.knot") == t))
        y = F.when(single | inside, y)
    if min_knots > 1:
        y = F.when(p["n"] >= min_knots, y)
    return j.withColumn(out, y).drop("prev", "next")


def align_labels(spectrum: DataFrame, labels: DataFrame, group: Sequence[str], ts: str, label_ts: str,
                 value: str, method: str = "pchip", trim: bool = False, tie: Sequence = (),
                 label_order: Sequence = ()) -> DataFrame:
    """Label at every spectrum time: de-duplicate, optionally trim to the range of
    the spectrum, interpolate; groups with fewer than two labels drop out."""
    group = list(group)
    knots = keep_first(labels, [*group, label_ts], list(label_order) or [label_ts])
    if trim:
        span = spectrum.groupBy(*group).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
        knots = attach(knots, span, group, "inner").filter(
            F.col(label_ts).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    out = interpolate(spectrum, knots, group, ts, label_ts, value, method, "extrapolate", "label", tie, 2)
    return out.filter(F.col("label").isNotNull())


def grid_downsample(df: DataFrame, group: Sequence[str], ts: str, step: float, tie: Sequence,
                    peak: int | None = None) -> DataFrame:
    """Rows nearest to the grid ``t0, t0+step, ...`` (end excluded), each once.

    A row only competes for the grid points between its neighbours' mid-points,
    so both neighbours decide and no grid is joined.
    """
    group = list(group)
    d = framed(df, group, [ts, *tie], 1, 1, {
        "_p": lambda w: F.lag(ts).over(w), "_x": lambda w: F.lead(ts).over(w)}, peak)
    span = df.groupBy(*group).agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    d = attach(d, span, group)
    t, t0, t1 = F.col(ts), F.col("_t0"), F.col("_t1")
    # grid points g with g > mid(prev, t) and g <= mid(t, next): the earlier row wins a tie
    low = F.when(F.col("_p").isNull(), F.lit(0.0)).otherwise(F.floor(((F.col("_p") + t) / 2 - t0) / step) + 1)
    high = F.when(F.col("_x").isNull(), F.ceil((t1 - t0) / step)).otherwise(F.floor(((F.col("_x") + t) / 2 - t0) / step))
    last_grid = F.ceil((t1 - t0) / step) - 1
    keep = (F.greatest(low, F.lit(0)) <= F.least(high, last_grid)) & ((F.col("_p").isNull()) | (F.col("_p") < t))
    return d.filter(keep).drop("_p", "_x", "_t0", "_t1")
