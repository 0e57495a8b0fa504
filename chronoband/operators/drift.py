"""Distances between the distribution of a base and those of other sides.

Everything is long: a row per key, side and distinct value.  One range shuffle
cuts the values of a key, all sides together, into stretches of bounded size;
what a stretch needs from those before it are counts, a row per stretch and
target.  Inside a stretch the base gets prefix integrals of its distribution
function F and of F squared.  Between two values of a target its own function is
a constant g, so the integrals of ``|F - g|`` and ``(F - g)**2`` are differences
of prefix integrals, split where F passes g.  Quantiles of base and target
together come from ranks, each found in the stretch that holds it.  The work is
the rows of the base plus those of all targets, and the plan is the same for two
targets and for every day of ten years.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chronoband.functions import arrays as A
from chronoband.functions.tails import ks_pvalue
from chronoband.operators.ordered import attach, indexed, matched
from chronoband.operators.rhythm import PHASES
from chronoband.session import materialise, rows_per_chunk

PSI_BINS = 20
PSI_FLOOR = 1e-6
SHARE_FLOOR = 1e-6


def distances(df: DataFrame, keys: Sequence[str], value: str, side: str, base: str, targets: Sequence[str] | None = None,
              bins: int = PSI_BINS) -> DataFrame:
    """One row per key and target present: sizes, KS statistic and asymptotic p,
    Wasserstein-1, energy distance, population stability index.

    Targets are the sides named, or all but the base.  Rows without a value or a
    side are left out; keys need both sides.
    """
    keys = list(keys)
    both = [*keys, "target"]
    known = F.col(side).isNotNull() if targets is None else F.col(side).isin(base, *targets)
    d = df.filter(known & F.col(value).isNotNull())
    counts = materialise(d.groupBy(*keys, F.col(side).cast("string").alias("target"), F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("c")))                  # the range shuffle reads it twice
    parts = max(1, -(-counts.count() // rows_per_chunk(df.sparkSession)))
    cells = materialise(counts.repartitionByRange(parts, *keys, "v").withColumn("_part", F.spark_partition_id()))
    met = cells.groupBy(*keys, "_part").cogroup(_carried(cells, keys, base).groupBy(*keys, "_part"))
    kept = [f for f in cells.schema.fields if f.name in both]
    found = materialise(met.applyInArrow(_stretch(both, bins), T.StructType([*kept, *_FOUND])))
    out = found.groupBy(*both).agg(
        F.max("nb").alias("n_base"), F.max("nt").alias("n_target"), F.max("ks").alias("ks_stat"), F.sum("w").alias("wasserstein"),
        F.sqrt(2 * F.sum("e")).alias("energy_distance"))
    out = out.withColumn("ks_pvalue", ks_pvalue(F.col("ks_stat"), F.col("n_base"), F.col("n_target")))
    return matched(out, _psi(found, both, bins), both, "left").withColumn("psi", F.coalesce("psi", F.lit(0.0)))


def _carried(cells: DataFrame, keys: list[str], base: str) -> DataFrame:
    """A row per stretch and target of its key: borders of the stretch, counts of base and target before it and in all."""
    both = [*keys, "target"]
    own, before = F.col("target") == base, lambda w: w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    here = cells.groupBy(*both, "_part").agg(F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    every = Window.partitionBy(*keys)
    stretch = here.groupBy(*keys, "_part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("b"))
    stretch = stretch.select(*[F.col(c).alias(c) for c in (*keys, "_part")], "lo", F.coalesce(F.lead("lo").over(every.orderBy("_part")), "hi").alias("hi"), "b",
                             F.coalesce(F.sum("b").over(before(every)), F.lit(0)).alias("b0"), F.sum("b").over(every).alias("nb")).filter("nb > 0")
    # columns of their own: all of these tables come from one
    theirs = here.filter(~own).select(*[F.col(c).alias(c) for c in (*both, "_part")], F.col("n").alias("t"))
    whole = theirs.groupBy(*both).agg(F.sum("t").alias("nt")).select(*[F.col(c).alias(c) for c in both], "nt")
    wide = matched(stretch, whole, keys).select(*[F.col(c).alias(c) for c in (*both, "_part")], "lo", "hi", "b0", "nb", "nt")
    wide = matched(wide, theirs, [*both, "_part"], "left").withColumn("t", F.coalesce("t", F.lit(0)))
    return wide.select(*[F.col(c).alias(c) for c in (*both, "_part")], "lo", "hi", "b0", "nb", "nt", "t",
                       F.coalesce(F.sum("t").over(before(Window.partitionBy(*both))), F.lit(0)).alias("t0"))


#: a value at one of the ranks next to an edge, with the rows of base and target below and up to it
_RANK = T.StructType([T.StructField("j", T.IntegerType()), T.StructField("upper", T.IntegerType()), T.StructField("v", T.DoubleType()),
                      *[T.StructField(c, T.LongType()) for c in ("b_below", "b_upto", "t_below", "t_upto")]])
_FOUND = [T.StructField("nb", T.LongType()), T.StructField("nt", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("ks", "w", "e")],
          T.StructField("ranks", T.ArrayType(_RANK))]


def _first_beyond(values: np.ndarray, running: np.ndarray, other: np.ndarray, other_running: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first of ``values`` at which both running counts together exceed each rank, infinite where none does; by bisection."""
    lo, hi = np.zeros(len(ranks), np.int64), np.full(len(ranks), len(values))
    while (lo < hi).any():
        at = np.minimum((lo + hi) // 2, len(values) - 1)
        enough = running[at + 1] + other_running[np.searchsorted(other, values[at], "right")] > ranks
        lo, hi = np.where((lo < hi) & ~enough, at + 1, lo), np.where((lo < hi) & enough, at, hi)
    return np.append(values, np.inf)[lo]


def _stretch(both: list[str], bins: int):
    """Per target: largest gap and both integrals over a stretch [lo, hi), and the wanted ranks among base and target that lie in it."""
    def run(cells: pa.Table, carried: pa.Table) -> pa.Table:
        n = carried.num_rows
        col = lambda name: carried.column(name).to_numpy()
        ks, w, e, sizes, ranks = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, np.int64), []
        if n:
            lo, hi, b0, nb, nt, t0 = col("lo")[0], col("hi")[0], int(col("b0")[0]), int(col("nb")[0]), col("nt"), col("t0")
            v, c = cells.column("v").to_numpy(), cells.column("c").to_numpy()
            who = pc.fill_null(pc.index_in(cells.column("target"), value_set=carried.column("target").combine_chunks()), -1).to_numpy()
            own = who < 0
            order = np.argsort(v[own], kind="stable")
            bv, cb = v[own][order], np.append(b0, b0 + np.cumsum(c[own][order]))
            # the base's share from each of these points on, and its integrals up to them
            points, level = np.append(lo, bv), cb / nb
            width = np.diff(np.append(points, hi))
            i1, i2 = np.append(0.0, np.cumsum(level * width)), np.append(0.0, np.cumsum(level * level * width))
            # every target starts at the border with what it had before
            tw, tv, tc = np.append(who[~own], np.arange(n)), np.append(v[~own], np.full(n, -np.inf)), np.append(c[~own], t0)
            order = np.lexsort((tv, tw))
            tw, tv, tc = tw[order], tv[order], tc[order]
            start = np.searchsorted(tw, np.arange(n + 1))
            ct = np.cumsum(tc)
            ct -= (ct - tc)[start[:-1]][tw]
            a, g = np.maximum(tv, lo), ct / nt[tw]
            b = np.append(a[1:], hi)
            b[start[1:] - 1] = hi
            wide = b > a
            tk, a, b, g = tw[wide], a[wide], b[wide], g[wide]
            ia, ib = np.searchsorted(points, a, "right") - 1, np.searchsorted(points, b, "left") - 1
            np.maximum.at(ks, tk, np.maximum(np.abs(level[ia] - g), np.abs(level[ib] - g)))
            q = np.clip(np.append(points, hi)[np.searchsorted(level, g)], a, b)     # where the base reaches the target's share
            iq = np.searchsorted(points, q, "right") - 1
            upto = lambda total, height, x, i: total[i] + height[i] * (x - points[i])
            a1, q1, b1 = (upto(i1, level, x, i) for x, i in ((a, ia), (q, iq), (b, ib)))
            a2, b2 = (upto(i2, level * level, x, i) for x, i in ((a, ia), (b, ib)))
            flat, gap = ia == ib, np.abs(level[ia] - g)
            part_w = np.where(flat, gap * (b - a), g * (q - a) - (q1 - a1) + (b1 - q1) - g * (b - q))
            part_e = np.where(flat, gap * gap * (b - a), b2 - a2 - 2 * g * (b1 - a1) + g * g * (b - a))
            np.add.at(w, tk, np.maximum(part_w, 0.0))
            np.add.at(e, tk, np.maximum(part_e, 0.0))

            step = (nb + nt - 1)[:, None] * np.arange(bins + 1)[None, :]
            lower, more = step // bins, step % bins > 0
            wanted = np.stack((lower, lower + more), axis=2).reshape(n, -1)
            first = (b0 + t0)[:, None]
            inside = (wanted >= first) & (wanted < first + (cb[-1] - b0 + col("t"))[:, None])
            sizes = inside.sum(axis=1)
            for k in np.flatnonzero(sizes):
                mine, running = tv[start[k] + 1:start[k + 1]], ct[start[k]:start[k + 1]]
                slot = np.flatnonzero(inside[k])
                r = wanted[k, slot]
                x = np.fmin(_first_beyond(bv, cb, mine, running, r), _first_beyond(mine, running, bv, cb, r))
                ranks.append((slot // 2, slot % 2, x, cb[np.searchsorted(bv, x)], cb[np.searchsorted(bv, x, "right")],
                              running[np.searchsorted(mine, x)], running[np.searchsorted(mine, x, "right")]))
        kind = to_arrow_type(_RANK)
        parts = [np.concatenate([r[i] for r in ranks]) if ranks else np.empty(0) for i in range(len(_RANK))]
        flat = pa.StructArray.from_arrays([pa.array(p).cast(f.type) for p, f in zip(parts, kind, strict=True)], fields=list(kind))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), flat)
        kept = carried.select(both + ["nb", "nt"])
        for name, x in (("ks", pa.array(ks)), ("w", pa.array(w)), ("e", pa.array(e)), ("ranks", lists)):
            kept = kept.append_column(name, x)
        return kept
    return run


def _psi(found: DataFrame, both: list[str], bins: int) -> DataFrame:
    """Shares of base and target between the edges; the last bin includes its right edge.

    An edge lies between the values of two ranks that follow each other, so what
    is below it is what is below, or up to, the first of them.
    """
    ranks = found.select(*both, "nb", "nt", F.inline("ranks"))
    side = lambda upper, c: F.max(F.when(F.col("upper") == upper, c))
    here = F.struct("v", "b_below", "b_upto", "t_below", "t_upto")
    edge = ranks.groupBy(*both, "nb", "nt", "j").agg(side(0, here).alias("lo"), side(1, F.col("v")).alias("hi"))
    rest = F.pmod((F.col("nb") + F.col("nt") - 1) * F.col("j"), F.lit(bins))
    edge = edge.withColumn("at", F.col("lo.v") + (F.col("hi") - F.col("lo.v")) * (rest / F.lit(float(bins))))
    below = lambda s: F.when(F.col("at") > F.col("lo.v"), F.col(f"lo.{s}_upto")).otherwise(F.col(f"lo.{s}_below"))
    per = edge.groupBy(*both, "nb", "nt").agg(F.array_sort(F.collect_set(F.struct(F.col("at").alias("v"), below("b").alias("b"), below("t").alias("c")))).alias("x"))  # at most bins + 1 edges
    closed = F.struct(F.element_at("x", -1)["v"].alias("v"), F.col("nb").alias("b"), F.col("nt").alias("c"))
    per = per.withColumn("_edges", F.size("x")).withColumn("x", F.concat(F.slice("x", 1, F.size("x") - 1), F.array(closed)))

    def term(i):
        share = lambda f, n: F.greatest((F.get(F.col("x"), i + 1)[f] - F.get(F.col("x"), i)[f]) / n, F.lit(PSI_FLOOR))
        return A.let(F.struct(share("b", F.col("nb")).alias("p"), share("c", F.col("nt")).alias("q")),
                     lambda s: (s["q"] - s["p"]) * F.ln(s["q"] / s["p"]))
    psi = F.when(F.col("_edges") < 3, F.lit(0.0)).otherwise(
        A.total(F.transform(F.sequence(F.lit(0), F.greatest(F.size("x") - 2, F.lit(0))), term)))
    return per.select(*both, psi.alias("psi"))


def unpivot(df: DataFrame, ids: Sequence[str], variables: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])
    return df.select(*ids, F.inline(cells))


def shift_report(df: DataFrame, split: str, day: str, variables: Sequence[str], day_variables: Sequence[str]) -> DataFrame:
    """Train against validation and test, and train against every other day: scope, variable, target, target_split and the distances.

    A day's split is the one its samples have (the first in order, should they differ).
    """
    whole = unpivot(df.filter(F.col(split).isin("train", "val", "test")), [split], variables).select(
        F.lit("global").alias("scope"), "variable", F.col(split).alias("_side"), "value")
    side = df.withColumn("_side", F.when(F.col(split) == "train", F.lit("train")).otherwise(F.concat(F.lit("day "), F.col(day).cast("string"))))
    each = unpivot(side, ["_side"], day_variables).select(F.lit("by_date").alias("scope"), "variable", "_side", "value")
    found = distances(whole.unionByName(each), ["scope", "variable"], "value", "_side", "train")
    days = df.filter(F.col(split) != "train").groupBy(F.concat(F.lit("day "), F.col(day).cast("string")).alias("target")).agg(F.min(split).alias("_split"))
    named = matched(found, days, ["target"], "left")
    return named.withColumn("target_split", F.coalesce("_split", "target")).withColumn("target", F.regexp_replace("target", "^day ", "")).drop("_split")


def phase_js(df: DataFrame, keys: Sequence[str], split: str, phase: str) -> DataFrame:
    """Jensen-Shannon distance of the phase shares of train and test."""
    part = lambda s, p: F.count_if((F.col(split) == s) & (F.col(phase) == p))
    n = df.groupBy(*keys).agg(*[part(s, p).alias(f"{s}_{p}") for s in ("train", "test") for p in PHASES])

    def shares(s):
        total = sum((F.col(f"{s}_{p}") for p in PHASES[1:]), F.col(f"{s}_{PHASES[0]}"))
        raw = [F.greatest(F.col(f"{s}_{p}") / total, F.lit(SHARE_FLOOR)) for p in PHASES]
        whole = sum(raw[1:], raw[0])
        return [r / whole for r in raw]
    div = F.lit(0.0)
    for p, q in zip(shares("train"), shares("test")):
        m = (p + q) / 2
        div = div + p * F.ln(p / m) + q * F.ln(q / m)
    return n.select(*keys, F.sqrt(F.greatest(div / 2, F.lit(0.0))).alias("phase_js_distance"))


def split_shift(df: DataFrame, strategy: str, split: str, value: str, phase: str, pc: str | None = None) -> DataFrame:
    """A row per strategy: the distances of train and test, of their phase shares and, with components ``pc``, of their centroids.

    Centroids are of the samples that have components.
    """
    out = distances(df, [strategy], value, split, "train", ["test"])
    out = matched(out, phase_js(df, [strategy], split, phase), [strategy], "left")
    if pc is None:
        return out
    side = lambda s, j: F.avg(F.when(F.col(split) == s, F.col(pc)[j]))
    apart = F.sqrt(sum((F.pow(side("train", j) - side("test", j), 2) for j in range(2)), F.lit(0.0)))
    return matched(out, df.groupBy(strategy).agg(apart.alias("pca_centroid_distance")), [strategy], "left")


def ecdf(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence) -> DataFrame:
    d = indexed(df, list(keys), [value, *tie], "_rn", "_n")
    return d.withColumn("ecdf", F.col("_rn") / F.col("_n")).drop("_rn", "_n")


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Equal-width counts and density; the last bin is closed, empty bins are kept out."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    d = attach(df.filter(F.col(value).isNotNull()), span, keys)
    wide = (F.col("_hi") - F.col("_lo")) / bins
    i = F.when(wide > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / wide), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")
    return d.groupBy(*keys, i.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(wide > 0, 1 / (F.col("_n") * wide))).alias("_d")).withColumn("density", F.col("n") * F.col("_d")).drop("_d")


def cohens_d(cells: DataFrame, group: str, a: str, b: str, bin: str = "bin", value: str = "x") -> DataFrame:
    """Effect size per bin between two groups, pooled sample variance."""
    s = cells.filter(F.col(group).isin(a, b)).groupBy(bin).pivot(group, [a, b]).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    n1, n2 = F.col(f"{a}_n"), F.col(f"{b}_n")
    pooled = F.sqrt(((n1 - 1) * F.col(f"{a}_v") + (n2 - 1) * F.col(f"{b}_v")) / (n1 + n2 - 2 + 1e-12))
    d = F.when((n1 < 2) | (n2 < 2) | n1.isNull() | n2.isNull(), F.lit(0.0)).otherwise(
        (F.col(f"{a}_m") - F.col(f"{b}_m")) / (pooled + 1e-12))
    return s.select(bin, d.alias("effect"), F.abs(d).alias("abs_effect"))


def shares(df: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """Counts and ratios of a category inside its key; both tables are combined first."""
    n = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("count"))
    t = n.groupBy(*keys).agg(F.sum("count").alias("_t"))
    return attach(n, t, list(keys)).withColumn("ratio", F.col("count") / F.greatest(F.col("_t"), F.lit(1))).drop("_t")


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Row-normalised table with fixed columns, 0 where a pair never occurs."""
    wide = df.groupBy(row).pivot(column, list(values)).count().na.fill(0)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return wide.select(row, *[(F.col(v) / total).alias(v) for v in values])
