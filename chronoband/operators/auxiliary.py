"""All auxiliary channels on the spectrum clock: align, fill, scale.

One as-of join per sensor carries every channel of it.  Fast sensors use the
bracketing pair directly (straight line, nothing outside their range); slow
ones carry one polynomial per channel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoband.operators import seconds
from chronoband.operators.align import as_of, keep_first, knot_polynomials, poly_at
from chronoband.operators.ordered import attach, group_sizes, matched
from chronoband.operators.outliers import filled
from chronoband.operators.rhythm import without_bias

MODES = ("raw", "engineered", "both", "segment_raw")
MOTIONS = ("raw", "processed", "both")
# fixed values: slots a second has for each column
PULSE_SLOTS, MOTION_SLOTS = 256, 128
MOTION_AXES = ("acc_x", "acc_y", "acc_z", "gyr_x", "gyr_y", "gyr_z")


@dataclass(frozen=True)
class Sensor:
    """``channels`` maps table columns to feature names, in output order."""

    table: DataFrame
    time: str
    channels: Mapping[str, str]
    rapid: bool = False


def bracketed(targets: DataFrame, sensor: Sensor, group: Sequence[str], ts: str, tie: Sequence, peak: int | None = None) -> DataFrame:
    pay = F.struct(F.col(sensor.time).cast("double").alias("t"), *[F.col(c).cast("double").alias(c) for c in sensor.channels])
    j = as_of(targets, sensor.table, group, ts, sensor.time, pay, tie, peak)
    p, n, t = F.col("prev"), F.col("next"), F.col(ts)
    share = (t - p["t"]) / (n["t"] - p["t"])
    made = [F.when(p["t"] == t, p[c]).otherwise(p[c] + share * (n[c] - p[c])).alias(f) for c, f in sensor.channels.items()]
    return j.select(*targets.columns, *made)


def curved(targets: DataFrame, sensor: Sensor, group: Sequence[str], ts: str, tie: Sequence, method: str) -> DataFrame:
    group, few = list(group), group_sizes(sensor.table, group)[0]
    polys = None
    for i, c in enumerate(sensor.channels):
        k = knot_polynomials(sensor.table, group, sensor.time, c, method, few).select(*group, "t", F.col("poly").alias(f"p{i}"))
        polys = k if polys is None else polys.join(k, [*group, "t"])
    names = [f"p{i}" for i in range(len(sensor.channels))]
    j = as_of(targets, polys, group, ts, "t", F.struct(*names), tie)
    t, made = F.col(ts), []
    for name, feature in zip(names, sensor.channels.values()):
        p = F.coalesce(F.col("prev"), F.col("next"))[name]
        before = F.col("prev")[name]
        inside = before.isNotNull() & (~before["last"] | (before["knot"] == t))
        made.append(F.when((p["n"] == 1) | inside, poly_at(p, t)).alias(feature))
    return j.select(*targets.columns, *made)


def align_sensors(targets: DataFrame, sensors: Sequence[Sensor], group: Sequence[str], ts: str, tie: Sequence[str],
                  method: str = "pchip", normalise: bool = True) -> DataFrame:
    """Feature columns of all sensors, gap-free, z-scored per recording."""
    d, names = targets, []
    for s in sensors:
        clean = keep_first(s.table.select(*group, s.time, *s.channels), [*group, s.time], list(s.channels))
        s = Sensor(clean, s.time, s.channels, s.rapid)
        d = bracketed(d, s, group, ts, tie) if s.rapid or method == "linear" else curved(d, s, group, ts, tie, method)
        names += list(s.channels.values())
    d = filled(d, group, [ts, *tie], names)
    if not normalise:
        return d
    stats = d.groupBy(*group).agg(*[F.avg(n).alias(f"_m_{n}") for n in names], *[F.stddev_pop(n).alias(f"_s_{n}") for n in names])
    d = attach(d, stats, list(group))
    for n in names:
        sd = F.when(F.col(f"_s_{n}") > 1e-8, F.col(f"_s_{n}")).otherwise(1.0)
        d = d.withColumn(n, F.coalesce((F.col(n) - F.col(f"_m_{n}")) / sd, F.lit(0.0)))
    return d.drop(*[f"_{x}_{n}" for n in names for x in "ms"])


def standard_sensors(tables: Mapping[str, DataFrame], group: Sequence[str], ts: str = "ts", mode: str = "raw",
                     motion: str = "raw") -> list[Sensor]:
    """Sensors in their fixed feature order for the given modes.

    ``tables``: environment, pulse, skin, motion; absent ones are left out.
    Segments are no sensors on a clock: see ``aligned_auxiliary``.
    """
    if mode not in MODES or mode == "segment_raw":
        raise ValueError(f"no sensors for the aux feature mode: {mode}")
    if motion not in MOTIONS:
        raise ValueError(f"unknown motion features: {motion}")
    out: list[Sensor] = []
    if "environment" in tables:
        out.append(Sensor(tables["environment"], ts, {c: f"bme_{c}" for c in ("temperature_c", "pressure_hpa", "humidity_pct")}))
    pulse = tables.get("pulse")
    by_second = lambda t: t.withColumn("second", F.floor(ts).cast("long"))
    if pulse is not None and mode in ("raw", "both"):
        columns = ["raw"] if "raw" in pulse.columns else ["red", "ir"]
        out.append(Sensor(pulse, ts, {c: f"ppg_{c}" for c in columns}))
    if pulse is not None and mode in ("engineered", "both"):
        f = seconds.ppg_features(by_second(pulse), [*group, "second"])
        out.append(Sensor(f, "second", {c: c for c in f.columns if c.startswith("ppg_")}))
    if "skin" in tables:
        out.append(Sensor(tables["skin"], ts, {"temperature_c": "t117_temperature_c"}))
    imu = tables.get("motion")
    if imu is not None and mode in ("raw", "both"):
        if motion in ("raw", "both"):
            out.append(Sensor(imu, ts, {c: f"icm_{c}" for c in MOTION_AXES}, rapid=True))
        if motion in ("processed", "both"):
            centred = without_bias(imu, group, MOTION_AXES)
            out.append(Sensor(centred, ts, {f"{c}_centred": f"icm_{c}_proc" for c in MOTION_AXES}, rapid=True))
    if imu is not None and mode in ("engineered", "both"):
        f = seconds.imu_features(by_second(imu), group, "second")
        out.append(Sensor(f, "second", {c: c for c in f.columns if c.startswith("icm_")}, rapid=True))
    return out


def scaled_arrays(df: DataFrame, group: Sequence[str], arrays: Mapping[str, int]) -> DataFrame:
    """Every place of array columns to its z-score in the group; only centred where the deviation is below 1e-8.

    ``arrays`` tells the length of each; the rows' arrays have no nulls and may be
    shorter, nought stands for the places behind (a null array has none).  Rows
    and statistics travel short: the places no row of a group fills have mean
    and deviation nought and are only written at the end.
    """
    group, names = list(group), list(arrays)
    rows = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    lists = F.array(*[F.struct(F.lit(k).alias("_k"), F.col(a).alias("_a")) for k, a in enumerate(names)])
    cells = df.select(*group, F.inline(lists)).select(*group, "_k", F.posexplode("_a").alias("_i", "_x")).groupBy(*group, "_k", "_i").agg(
        F.count(F.lit(1)).alias("_m"), F.avg("_x").alias("_mu"), F.var_pop("_x").alias("_var"))
    # the moments of the values met with those of the noughts
    share = F.col("_m") / F.col("_rows")
    spread = F.sqrt(F.col("_var") * share + F.col("_mu") * F.col("_mu") * share * (F.col("_rows") - F.col("_m")) / F.col("_rows"))
    place = F.struct("_i", (F.col("_mu") * share).alias("_mu"), F.when(spread > 1e-8, spread).otherwise(1.0).alias("_sd"))
    each = matched(cells, rows, group).groupBy(*group).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("_k") == k, place))).alias(f"_z{k}") for k in range(len(names))])
    d = attach(df, each, group)

    def scores(a: str, z: Column) -> Column:
        return F.transform(z, lambda p, i: (F.coalesce(F.get(a, i), F.lit(0.0)) - p["_mu"]) / p["_sd"])
    for k, (a, length) in enumerate(arrays.items()):
        z = F.coalesce(f"_z{k}", F.array().cast(each.schema[f"_z{k}"].dataType))
        d = d.withColumn(a, F.concat(scores(a, z), F.array_repeat(F.lit(0.0), F.lit(length) - F.size(z))))
    return d.drop(*[f"_z{k}" for k in range(len(names))])


def segment_features(targets: DataFrame, tables: Mapping[str, DataFrame], group: Sequence[str], ts: str, order: Sequence[str],
                     pulse_slots: int = PULSE_SLOTS, motion_slots: int = MOTION_SLOTS, normalise: bool = True) -> DataFrame:
    """The raw values of each target's own second as arrays of fixed length, ``ppg_<column>_seg`` and ``icm_<column>_seg``.

    Pulse and motion only.  A second without values has zeros; one with more
    than the slots is picked evenly.  Columns a table lacks are left out.
    ``order`` is the order inside a second, columns of the sensor tables.
    """
    d, made, group = targets.withColumn("_second", F.floor(ts).cast("long")), {}, list(group)
    pulse, imu = tables.get("pulse"), tables.get("motion")
    kinds = []
    if pulse is not None:
        kinds.append((pulse, "ppg", ["raw"] if "raw" in pulse.columns else [c for c in ("red", "ir") if c in pulse.columns], pulse_slots))
    if imu is not None:
        kinds.append((imu, "icm", [c for c in MOTION_AXES if c in imu.columns], motion_slots))
    for table, prefix, columns, slots in kinds:
        if not columns:
            continue
        keys = [*group, "_second"]
        s = seconds.raw_slots(table.withColumn("_second", F.floor(ts).cast("long")), keys, order, columns, slots, prefix, fill=False)
        d = attach(d, s, keys)
        for c in columns:
            made[f"{prefix}_{c}_seg"] = slots
            d = d.withColumnRenamed(f"{prefix}_{c}", f"{prefix}_{c}_seg")
    d = d.drop("_second")
    if normalise:
        return scaled_arrays(d, group, made)
    for a, slots in made.items():
        short = F.coalesce(a, F.array().cast("array<double>"))
        d = d.withColumn(a, F.concat(short, F.array_repeat(F.lit(0.0), F.lit(slots) - F.size(short))))
    return d


def aligned_auxiliary(targets: DataFrame, tables: Mapping[str, DataFrame], group: Sequence[str], ts: str, tie: Sequence[str], mode: str = "raw",
                      motion: str = "raw", method: str = "pchip", normalise: bool = True, order: Sequence[str] | None = None) -> DataFrame:
    """Auxiliary features of every target in one of the ``MODES``: a column per feature, or an array per column of segments."""
    if mode == "segment_raw":
        return segment_features(targets, tables, group, ts, order or [ts], normalise=normalise)
    return align_sensors(targets, standard_sensors(tables, group, ts, mode, motion), group, ts, tie, method, normalise)


def join_raw_slots(targets: DataFrame, raw: DataFrame, group: Sequence[str], ts: str, order: Sequence, value: str,
                   slots: int, out: str) -> DataFrame:
    """Raw values of the target's own second in fixed slots; zeros when it has none."""
    keys = [*group, "_second"]
    r = raw.withColumn("_second", F.floor(ts).cast("long"))
    s = seconds.raw_slots(r, keys, order, value, slots, out)
    t = targets.withColumn("_second", F.floor(ts).cast("long")).join(s, keys, "left")
    return t.withColumn(out, F.coalesce(out, F.array_repeat(F.lit(0.0), slots))).drop("_second")
