"""Scalers fitted on one part and applied to all, and aux shuffles for controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoband.functions import arrays as A
from chronoband.functions import fusion as U
from chronoband.operators.ordered import attach, column_quantiles, indexed, matched

SCALERS = ("standard", "minmax", "robust")


def fit_scalar(df: DataFrame, power: str = "power", first: int | None = None) -> DataFrame:
    """One mean and one population deviation over all cells (one row: mu, sd).
    Cells are exploded inside the scan stage and combined before the shuffle."""
    a = F.slice(power, 1, first) if first else F.col(power)
    cells = df.select(F.explode(A.doubles(a)).alias("x"))
    s = cells.agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    return s.select("mu", F.when(F.col("sd") < 1e-8, 1.0).otherwise(F.col("sd")).alias("sd"))


def apply_scalar(df: DataFrame, stats: DataFrame, power: str = "power", first: int | None = None) -> DataFrame:
    d = attach(df, stats, [])
    scaled = lambda a: F.transform(a, lambda x: (x - F.col("mu")) / F.col("sd"))
    a = A.doubles(power)
    if first:
        head, tail = U.split_features(a, first)
        out = F.concat(scaled(head), tail)
    else:
        out = scaled(a)
    return d.withColumn(power, out).drop("mu", "sd")


def normalise(df: DataFrame, power: str = "power", split: str = "split", first: int | None = None) -> DataFrame:
    """Fit on the train part only."""
    return apply_scalar(df, fit_scalar(df.filter(F.col(split) == "train"), power, first), power, first)


def aux_zscore(df: DataFrame, group: Sequence[str], aux: str = "aux") -> DataFrame:
    """Per group and feature; only centred when the deviation is tiny; missing becomes 0."""
    cells = df.select(*group, F.posexplode(aux).alias("i", "x"))
    s = cells.groupBy(*group, "i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    s = s.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("_z"))
    d = attach(df, s, group)
    z = F.zip_with(aux, "_z", lambda x, q: F.coalesce(
        (x - q["m"]) / F.when(q["s"] > 1e-8, q["s"]).otherwise(1.0), F.lit(0.0)))
    return d.withColumn(aux, z).drop("_z")


def scale_columns(df: DataFrame, columns: Sequence[str], how: str, fit_on: Column | None = None) -> DataFrame:
    """Per-column scaler with constants guarded."""
    if how not in SCALERS:
        raise ValueError(f"unknown scaler: {how}")
    base = df.filter(fit_on) if fit_on is not None else df
    if how == "robust":
        marks = {f"_{tag}_{c}": (c, p) for c in columns for tag, p in (("a", 0.25), ("m", 0.5), ("b", 0.75))}
        d = attach(df, column_quantiles(base, [], marks), [])
        for c in columns:
            span = F.col(f"_b_{c}") - F.col(f"_a_{c}")
            d = d.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.when(span == 0, 1.0).otherwise(span))
        return d.drop(*marks)
    aggs = []
    for c in columns:
        if how == "standard":
            aggs += [F.avg(c).alias(f"_a_{c}"), F.stddev_pop(c).alias(f"_b_{c}")]
        else:
            aggs += [F.min(c).alias(f"_a_{c}"), (F.max(c) - F.min(c)).alias(f"_b_{c}")]
    d = attach(df, base.agg(*aggs), [])
    for c in columns:
        d = d.withColumn(c, (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_b_{c}") == 0, 1.0).otherwise(F.col(f"_b_{c}")))
    return d.drop(*[f"_{x}_{c}" for c in columns for x in "ab"])


def scale_for_distance(df: DataFrame, features: str = "features") -> DataFrame:
    """Every position of a feature array to ``(x - mean) / (sd + 1e-12)``."""
    cells = df.select(F.posexplode(features).alias("i", "x"))
    s = cells.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    s = s.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("_z"))
    d = attach(df, s, [])
    return d.withColumn(features, F.zip_with(features, "_z", lambda x, z: (x - z["m"]) / (z["s"] + 1e-12))).drop("_z")


def name_seed(base: int, name: Column) -> Column:
    """Seed of a recording: base plus the character codes of its name."""
    chars = F.filter(F.split(name.cast("string"), ""), lambda c: c != "")
    return F.lit(base) + F.aggregate(chars, F.lit(0), lambda s, c: s + F.ascii(c))


def shuffle_groups(names: Sequence[str], mode: str) -> list[list[int]]:
    if mode == "rows":
        return [list(range(len(names)))]
    if mode == "features":
        return [[i] for i in range(len(names))]
    if mode == "sensor_groups":
        found: dict[str, list[int]] = {}
        for i, n in enumerate(names):
            found.setdefault(U.sensor_group_of(n), []).append(i)
        return list(found.values())
    raise ValueError(f"unknown shuffle: {mode}")


def shuffle_aux(df: DataFrame, group: Sequence[str], key: str, names: Sequence[str], mode: str = "sensor_groups",
                seed: Column | int = 42, aux: str = "aux") -> DataFrame:
    """Move aux values between rows of a group, feature groups independently: the
    row at position k by key receives the values at position k by hash."""
    group, groups = list(group), shuffle_groups(names, mode)
    s = F.lit(seed) if isinstance(seed, int) else seed
    parts = F.array(*[F.struct(F.lit(g).alias("g"), U.pick(F.col(aux), ix).alias("v")) for g, ix in enumerate(groups)])
    cells = df.select(*group, key, s.alias("_seed"), F.explode(parts).alias("p")).select(
        *group, key, "_seed", F.col("p.g").alias("_g"), F.col("p.v").alias("_v"))
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("_seed").cast("string"), F.col("_g").cast("string")))
    give = indexed(cells.withColumn("_h", h), [*group, "_g"], ["_h", key], "_rn", "_n").select(*group, "_g", "_rn", "_v")
    take = indexed(cells.select(*group, "_g", key), [*group, "_g"], [key], "_rn", "_n").select(*group, "_g", "_rn", key)
    moved = matched(take, give, [*group, "_g", "_rn"]).groupBy(*group, key).agg(
        F.map_from_entries(F.collect_list(F.struct("_g", "_v"))).alias("_m"))
    where = {i: (g, j) for g, ix in enumerate(groups) for j, i in enumerate(ix)}
    rebuilt = F.array(*[F.get(F.col("_m")[where[i][0]], where[i][1]) for i in range(len(names))])
    return matched(df.drop(aux), moved.select(*group, key, rebuilt.alias(aux)), [*group, key]).select(*df.columns)
