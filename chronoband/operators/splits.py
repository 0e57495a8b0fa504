"""Train / validation / test assignment as a ``split`` column.

Seeded strategies order rows by ``md5(key:seed)``: exact sizes, the same answer
on every run and cluster size, and checkable in any SQL engine.  Sizes come
from one count; positions come from ``indexed``, which splits large groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoband.operators.ordered import attach, indexed, matched

DB_FILE_TRAIN_SHARE = 0.8


def hashed(key: Column | str, seed: int) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def check_ratios(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("ratios must sum to 1")
    if min(train, val, test) < 0:
        raise ValueError("ratios must not be negative")


def _ceil_share(n: int | Column, share: float):
    """Rows of a share, rounded up with a guard against binary noise."""
    if isinstance(n, int):
        return math.ceil(round(n * share, 9))
    return F.ceil(F.round(n * F.lit(share), 9))


def random(df: DataFrame, key: str, train=0.7, val=0.15, test=0.15, seed=42, group: Sequence[str] = ()) -> DataFrame:
    """Test takes the ceiling of its share, validation the ceiling of its share of the rest."""
    check_ratios(train, val, test)
    d = indexed(df, list(group), [hashed(key, seed), F.col(key)], "_rn", "_n")
    n_test = _ceil_share(F.col("_n"), test)
    share = val / (train + val) if val > 0 else 0.0
    n_val = _ceil_share(F.col("_n") - n_test, share) if val > 0 else F.lit(0)
    return d.withColumn("split", F.when(F.col("_rn") <= n_test, "test").when(
        F.col("_rn") <= n_test + n_val, "val").otherwise("train")).drop("_rn", "_n")


def temporal(df: DataFrame, order: Sequence, train=0.7, val=0.15, test=0.15) -> DataFrame:
    """Cut by position in ``order`` (recordings one after the other, each by time)."""
    check_ratios(train, val, test)
    d = indexed(df, [], order, "_rn", "_n")
    a, b = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(train + val))
    return d.withColumn("split", F.when(F.col("_rn") <= a, "train").when(
        F.col("_rn") <= b, "val").otherwise("test")).drop("_rn", "_n")


def _largest_remainder(counts: DataFrame, bins: list[str], share_of: Column, wanted: Column, out: str) -> DataFrame:
    """Distribute ``wanted`` rows over bins in proportion to ``share_of``, largest
    remainders first; the table has one row per bin."""
    every = Window.partitionBy()
    exact = share_of * wanted / F.sum(share_of).over(every)
    d = counts.withColumn("_base", F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    spare = wanted - F.sum("_base").over(every)
    rank = F.row_number().over(Window.orderBy(F.col("_rest").desc(), *bins))
    return d.withColumn(out, (F.col("_base") + F.when(rank <= spare, 1).otherwise(0)).cast("long")).drop("_base", "_rest")


def stratified(df: DataFrame, key: str, label: str, train=0.7, val=0.15, test=0.15, seed=42, n_bins=5) -> DataFrame:
    """Equal-width label bins keep their shares in every part."""
    check_ratios(train, val, test)
    if test == 0 or val == 0:
        raise ValueError("stratified needs both a validation and a test share")
    lo, hi = df.agg(F.min(label), F.max(label)).first()
    edges = [lo + i * (hi - lo) / n_bins for i in range(n_bins)]
    bin_no = F.lit(0)
    for e in edges[1:]:
        bin_no = bin_no + (F.col(label) >= F.lit(float(e))).cast("int")
    d = indexed(df.withColumn("bin", bin_no), ["bin"], [hashed(key, seed), F.col(key)], "_rn", "_n")
    counts = d.groupBy("bin").agg(F.count(F.lit(1)).alias("_c"))
    n = F.sum("_c").over(Window.partitionBy())
    counts = counts.withColumn("_want", _ceil_share(n, test))
    counts = _largest_remainder(counts, ["bin"], F.col("_c"), F.col("_want"), "_test")
    counts = counts.withColumn("_left", F.col("_c") - F.col("_test")).withColumn(
        "_want", _ceil_share(F.sum("_c").over(Window.partitionBy()) - F.col("_want"), val / (train + val)))
    counts = _largest_remainder(counts, ["bin"], F.col("_left"), F.col("_want"), "_val")
    d = attach(d, counts.select("bin", "_test", "_val"), ["bin"])
    return d.withColumn("split", F.when(F.col("_rn") <= F.col("_test"), "test").when(
        F.col("_rn") <= F.col("_test") + F.col("_val"), "val").otherwise("train")).drop("_rn", "_n", "_test", "_val", "bin")


def by_experiment(df: DataFrame, exp: str, train=0.7, val=0.15, test=0.15, seed=42) -> DataFrame:
    """Whole recordings.  At least one goes to validation even with a zero share."""
    check_ratios(train, val, test)
    e = indexed(df.select(exp).distinct(), [], [hashed(exp, seed), F.col(exp)], "_rn", "_n")
    a = F.greatest(F.floor(F.col("_n") * F.lit(train)), F.lit(1))
    b = a + F.greatest(F.floor(F.col("_n") * F.lit(val)), F.lit(1))
    e = e.select(exp, F.when(F.col("_rn") <= a, "train").when(F.col("_rn") <= b, "val").otherwise("test").alias("split"))
    return attach(df, e, [exp])


def _segments(df, group, order, n_splits) -> DataFrame:
    """Segment number from 0; remainder rows belong to the last one; NULL when a
    group has fewer rows than segments."""
    d = indexed(df, list(group), order, "_rn", "_n")
    size = F.floor(F.col("_n") / n_splits)
    return d.withColumn("_seg", F.when(size >= 1, F.least(F.floor((F.col("_rn") - 1) / size), F.lit(n_splits - 1))))


def _held_out(ordinal: Column, use_val: bool) -> Column:
    """Every third held-out segment, starting with the first, validates."""
    return F.when(ordinal % 3 == 1, "val").otherwise("test") if use_val else F.lit("test")


def alternating(df: DataFrame, order: Sequence, group: Sequence[str] = (), n_splits=10, use_val=True) -> DataFrame:
    d = _segments(df, group, order, n_splits)
    s = F.col("_seg")
    return d.withColumn("split", F.when(s % 2 == 0, "train").when(
        s.isNotNull(), _held_out(F.floor((s + 1) / 2), use_val))).drop("_rn", "_n", "_seg")


def hybrid_alternating(df: DataFrame, order: Sequence, group: Sequence[str] = (), n_splits=10, use_val=True) -> DataFrame:
    """First half of the segments trains, the second half alternates."""
    d = _segments(df, group, order, n_splits)
    half = n_splits // 2
    s, late = F.col("_seg"), F.col("_seg") - half
    return d.withColumn("split", F.when((s < half) | (late % 2 == 0), "train").when(
        s.isNotNull(), _held_out(F.floor((late + 1) / 2), use_val))).drop("_rn", "_n", "_seg")


def _day_table(df: DataFrame, day: str) -> DataFrame:
    """One row per civil day, a bounded table: windows over it stay small."""
    return df.groupBy(day).agg(F.count(F.lit(1)).alias("_c"))


def by_date(df: DataFrame, day: str, train=0.7, val=0.15, test=0.15) -> DataFrame:
    """Whole days in order, cut where the running row count reaches its target;
    every wanted part keeps at least one day."""
    check_ratios(train, val, test)
    days = _day_table(df, day)
    w, every = Window.orderBy(day), Window.partitionBy()
    days = days.select(day, F.row_number().over(w).alias("_i"), F.count(F.lit(1)).over(every).alias("_n"),
                       F.sum("_c").over(w).alias("_cum"), F.sum("_c").over(every).alias("_total"))
    keep_test, keep_val = int(test > 0), int(val > 0)
    cut1 = F.count_if(F.col("_cum") < F.col("_total") * F.lit(train)).over(every) + 1
    cut2 = F.count_if(F.col("_cum") < F.col("_total") * F.lit(train + val)).over(every) + 1
    days = days.withColumn("_a", F.greatest(F.lit(1), F.least(cut1, F.greatest(F.lit(1), F.col("_n") - keep_test - keep_val))))
    if val > 0:
        low = F.col("_a") + 1
        days = days.withColumn("_b", F.greatest(low, F.least(cut2, F.greatest(low, F.col("_n") - keep_test))))
    else:
        days = days.withColumn("_b", F.col("_a"))
    part = F.when(F.col("_i") <= F.col("_a"), "train").when(F.col("_i") <= F.col("_b"), "val").otherwise("test")
    return attach(df, days.select(day, part.alias("split")), [day])


def _half_even(x: Column) -> Column:
    return F.bround(x, 0)


def date_random_days(days: DataFrame, day: str, train=0.7, val=0.15, test=0.15, seed: Column | int = 42,
                     train_days: int | None = None, run: Sequence[str] = ()) -> DataFrame:
    """Assignment of days: a seeded draw trains, the rest is cut in date order."""
    check_ratios(train, val, test)
    run = list(run)
    seed = F.lit(seed) if isinstance(seed, int) else seed
    h = F.md5(F.concat(F.col(day).cast("string"), F.lit(":"), seed.cast("string")))
    w = Window.partitionBy(*run)
    d = days.withColumn("_h", h).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn(
        "_i", F.row_number().over(w.orderBy("_h", day)))
    wanted = F.lit(train_days) if train_days is not None else _half_even(F.col("_n") * F.lit(train))
    most = F.greatest(F.lit(1), F.col("_n") - 1 - int(val > 0))
    d = d.withColumn("_train", F.col("_i") <= F.greatest(F.lit(1), F.least(wanted, most)))
    left = F.sum((~F.col("_train")).cast("long")).over(w)
    pos = F.row_number().over(Window.partitionBy(*run, "_train").orderBy(day))
    d = d.withColumn("_left", left).withColumn("_pos", pos)
    if val > 0:
        n_val = F.greatest(F.lit(1), F.least(_half_even(F.col("_left") * F.lit(val / (val + test))), F.col("_left") - 1))
        rest = F.when(F.col("_pos") <= n_val, "val").otherwise("test")
    else:
        rest = F.lit("test")
    return d.withColumn("split", F.when(F.col("_train"), "train").otherwise(rest)).drop("_h", "_n", "_i", "_train", "_left", "_pos")


def by_date_random(df: DataFrame, day: str, train=0.7, val=0.15, test=0.15, seed=42, train_days=None) -> DataFrame:
    days = df.select(day).distinct()
    return attach(df, date_random_days(days, day, train, val, test, seed, train_days), [day])


def repeated_date_random(df: DataFrame, day: str, repeats: int, train=0.7, val=0.15, test=0.15, seed=42, train_days=None) -> DataFrame:
    """Rows and days per part for every repeat; only the day table is multiplied."""
    days = _day_table(df, day).withColumn("run", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    d = date_random_days(days, day, train, val, test, F.col("run") + seed, train_days, ["run"])
    return d.groupBy("run", "split").agg(F.count(F.lit(1)).alias("n_days"), F.sum("_c").alias("n_rows"),
                                         F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def max_day_train_min_day_test(df: DataFrame, day: str) -> DataFrame:
    """Fullest day trains, emptiest tests; equal days fall back to first and last.
    All other rows stay unassigned."""
    every = Window.partitionBy()
    days = _day_table(df, day).select(
        day, F.min_by(day, F.struct(-F.col("_c"), F.col(day))).over(every).alias("_big"),
        F.min_by(day, F.struct(F.col("_c"), F.col(day))).over(every).alias("_small"),
        F.min(day).over(every).alias("_a"), F.max(day).over(every).alias("_z"))
    same = F.col("_big") == F.col("_small")
    tr = F.when(same, F.col("_a")).otherwise(F.col("_big"))
    te = F.when(same, F.col("_z")).otherwise(F.col("_small"))
    part = F.when(F.col(day) == tr, "train").when(F.col(day) == te, "test")
    return attach(df, days.select(day, part.alias("split")), [day])


def by_file_temporal(df: DataFrame, file: Sequence[str], order: Sequence, share=DB_FILE_TRAIN_SHARE) -> DataFrame:
    """First part of every source file by time; both parts keep a row."""
    d = indexed(df, list(file), order, "_rn", "_n")
    cut = F.greatest(F.lit(1), F.least(F.floor(F.col("_n") * F.lit(share)), F.col("_n") - 1))
    return d.withColumn("split", F.when(F.col("_rn") <= cut, "train").otherwise("test")).drop("_rn", "_n")


def cross_user(df: DataFrame, user: str, train_user, test_user, order: Sequence, ratio=1.0) -> DataFrame:
    """One user trains, the first share of another one tests."""
    if not 0 < ratio <= 1:
        raise ValueError("ratio must be in (0, 1]")
    two = df.filter(F.col(user).isin(train_user, test_user))
    d = indexed(two, [user], order, "_rn", "_n")
    keep = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(ratio))) if ratio < 1 else F.col("_n")
    return d.withColumn("split", F.when(F.col(user) == train_user, "train").when(F.col("_rn") <= keep, "test")).drop("_rn", "_n")


def per_user_random(df: DataFrame, user: str, key: str, test=0.15, seed=42) -> DataFrame:
    if not 0 < test < 1:
        raise ValueError("test share must be in (0, 1)")
    return random(df, key, 1 - test, 0.0, test, seed, [user])


def deranged(df: DataFrame, key: str, columns: Sequence[str], seed=42, group: Sequence[str] = ()) -> DataFrame:
    """Give every row the ``columns`` of another row: each takes those of its
    successor in hash order, the last those of the first.  No row keeps its own."""
    group = list(group)
    d = indexed(df, group, [hashed(key, seed), F.col(key)], "_rn", "_n")
    donor = d.select(*group, F.when(F.col("_rn") == 1, F.col("_n")).otherwise(F.col("_rn") - 1).alias("_rn"),
                     *[F.col(c).alias(f"_d_{c}") for c in columns])
    out = matched(d.drop(*columns), donor, [*group, "_rn"]).withColumnsRenamed({f"_d_{c}": c for c in columns})
    return out.select(*df.columns)


def label_shuffle(df: DataFrame, key: str, label: str, train=0.7, val=0.15, test=0.15, seed=42) -> DataFrame:
    """Control: labels moved to other rows, then a random split."""
    return random(deranged(df, key, [label], seed), key, train, val, test, seed)


# ---- diagnostic splits: ceiling rule, at least one on each side --------------


def _ceil_cut(n: Column, share: float) -> Column:
    return F.greatest(F.lit(1), F.least(F.ceil(F.round(n * F.lit(share), 9)), n - 1))


def diagnostic_random(df, key, train=0.7, seed=42) -> DataFrame:
    d = indexed(df, [], [hashed(key, seed), F.col(key)], "_rn", "_n")
    return d.withColumn("split", F.when(F.col("_rn") <= _ceil_cut(F.col("_n"), train), "train").otherwise("test")).drop("_rn", "_n")


def diagnostic_by_first_time(df, unit: str, ts: str, train=0.7) -> DataFrame:
    """Days or recordings in the order of their first row."""
    u = df.groupBy(unit).agg(F.min(ts).alias("_t"))
    u = indexed(u, [], ["_t", unit], "_rn", "_n")
    cut = F.when(F.col("_n") <= 1, F.col("_n")).otherwise(_ceil_cut(F.col("_n"), train))
    return attach(df, u.select(unit, F.when(F.col("_rn") <= cut, "train").otherwise("test").alias("split")), [unit])


def diagnostic_alternating(df, group: Sequence[str], order: Sequence, n_segments=10) -> DataFrame:
    k = max(int(n_segments), 2)
    d = indexed(df, list(group), order, "_rn", "_n")
    seg = F.least(F.floor((F.col("_rn") - 1) * (F.lit(float(k)) / F.col("_n"))), F.lit(k - 1))
    return d.withColumn("split", F.when(F.col("_n") < 4, "train").when(seg % 2 == 0, "train").otherwise("test")).drop("_rn", "_n")


def three_way_dates(df, day: str, ts: str, train=0.7, val=0.15) -> DataFrame:
    """Days by first row, floor rule, special cases for one and two days."""
    every = Window.partitionBy()
    days = df.groupBy(day).agg(F.min(ts).alias("_t"))
    days = days.select(day, F.row_number().over(Window.orderBy("_t", day)).alias("_i"), F.count(F.lit(1)).over(every).alias("_n"))
    n = F.col("_n")
    a = F.greatest(F.lit(1), F.floor(n * F.lit(train)))
    b = F.greatest(F.lit(0), F.floor(n * F.lit(val)))
    days = days.withColumn("_a", a).withColumn("_b", F.when(a + b >= n, F.greatest(F.lit(0), n - a - 1)).otherwise(b))
    spilled = F.col("_a") + F.col("_b") >= n
    days = days.withColumn("_c", F.when(spilled, n - 1).otherwise(F.col("_a"))).withColumn(
        "_v", F.when(spilled, F.lit(0)).otherwise(F.col("_b")))
    part = (F.when(n == 1, "train").when(n == 2, F.when(F.col("_i") == 1, "train").otherwise("test"))
            .when(F.col("_i") <= F.col("_c"), "train").when(F.col("_i") <= F.col("_c") + F.col("_v"), "val").otherwise("test"))
    return attach(df, days.select(day, part.alias("split")), [day])


STRATEGIES: Mapping[str, Callable[..., DataFrame]] = {
    "random": random,
    "temporal": temporal,
    "stratified": stratified,
    "experiment": by_experiment,
    "alternating": alternating,
    "hybrid_alternating": hybrid_alternating,
    "date": by_date,
    "date_random": by_date_random,
    "max_day_train_min_day_test": max_day_train_min_day_test,
    "db_file_temporal_80_20": by_file_temporal,
    "cross_user": cross_user,
    "multi_user_independent": per_user_random,
    "label_shuffle_debug": label_shuffle,
}


def split(df: DataFrame, strategy: str, **args) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown split strategy: {strategy}")
    return STRATEGIES[strategy](df, **args)


def shuffled(df: DataFrame, key: str, seed: int, parts: Sequence[str] = ("split",)) -> DataFrame:
    """Seeded order inside each part, for the sink: rows spread by hash, then sorted."""
    return df.withColumn("_h", hashed(key, seed)).repartition(*parts, F.substring("_h", 1, 3)).sortWithinPartitions(
        *parts, "_h").drop("_h")
