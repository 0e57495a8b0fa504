"""Landed sensor tables: range scans, merges, aliases, profiles, discovery."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoband.operators.align import keep_first
from chronoband.operators.ordered import attach
from chronoband.sources.binary import blob_type, payload, unpacked

# fixed values: other names of sensor columns
ALIASES: Mapping[str, Mapping[str, str]] = {
    "environment": {"temperature": "temperature_c", "temp": "temperature_c", "t": "temperature_c",
                    "pressure": "pressure_hpa", "p": "pressure_hpa", "humidity": "humidity_pct", "h": "humidity_pct"},
    "pulse": {"heart_rate": "heart_rate_bpm", "hr": "heart_rate_bpm", "spo2": "spo2_percent", "hrv": "hrv_ms"},
    "skin": {"temperature": "temperature_c", "temp": "temperature_c", "t": "temperature_c"},
    "motion": {"gyro_x": "gyr_x", "gyro_y": "gyr_y", "gyro_z": "gyr_z", "accel_x": "acc_x", "accel_y": "acc_y",
               "accel_z": "acc_z", "gx": "gyr_x", "gy": "gyr_y", "gz": "gyr_z", "ax": "acc_x", "ay": "acc_y", "az": "acc_z"},
}
TIME_NAMES = ("ts", "timestamp", "time", "t")


def scan(df: DataFrame, ts: str, start=None, stop=None, columns: Sequence[str] | None = None) -> DataFrame:
    """Closed time range on the stored column, so the filter reaches the file scan."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start))
    if stop is not None:
        df = df.filter(F.col(ts) <= F.lit(stop))
    return df.select(*columns) if columns else df


def merged(parts: Mapping[str, DataFrame], keys: Sequence[str], order: Sequence[str] = (), source: str = "file_source") -> DataFrame:
    """Union of several files without repeated keys; the earlier file wins."""
    whole = None
    for name, df in parts.items():
        d = df.withColumn(source, F.lit(name))
        whole = d if whole is None else whole.unionByName(d, allowMissingColumns=True)
    return keep_first(whole, keys, [source, *order])


def shaped(df: DataFrame, wanted: Mapping[str, str], aliases: Mapping[str, str] | None = None) -> DataFrame:
    """``wanted`` columns with their types; other names are mapped, absent ones are NULL."""
    have = {c.lower(): c for c in df.columns}
    other = {}
    for src, dst in (aliases or {}).items():
        if src in have and dst not in have:
            other.setdefault(dst, have[src])
    return df.select(*[(F.col(have[c]) if c in have else F.col(other[c]) if c in other else F.lit(None)).cast(t).alias(c)
                       for c, t in wanted.items()])


def time_column(columns: Sequence[str]) -> str | None:
    have = {c.lower(): c for c in columns}
    return next((have[c] for c in TIME_NAMES if c in have), None)


def table_role(name: str, columns: Sequence[str]) -> str | None:
    """What a table holds, from its name and columns."""
    n, c = name.lower(), {x.lower() for x in columns}
    if {"data", "count"} <= c and c & {"ts", "timestamp"}:
        return "spectrum"
    if "ppg" in n or {"red", "ir"} <= c:
        return "pulse"
    if "env_bme" in n or (c & {"pressure", "p"} and c & {"humidity", "h"}):
        return "environment"
    if "imu_icm" in n or {"ax", "ay", "az", "gx", "gy", "gz"} <= c or (
            any(x.startswith("acc") for x in c) and any(x.startswith("gyr") for x in c)):
        return "motion"
    if "env_temp" in n or c & {"temperature", "temp", "t"}:
        return "skin"
    return None


def profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns, role, time column and schema of each table, as one table."""
    out = None
    for name, df in tables.items():
        p = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
            F.lit(table_role(name, df.columns)).alias("role"), F.lit(time_column(df.columns)).alias("time_column"),
            F.lit(df.schema.json()).alias("schema"))
        out = p if out is None else out.unionByName(p)
    return out


#: relative error of distinct counts and the accuracy of quantile sketches
DISTINCT_ERROR, QUANTILE_ACCURACY = 0.02, 1000


def column_profiles(tables: Mapping[str, DataFrame], order: Mapping[str, Sequence[str]] | None = None, head_rows: int = 5) -> DataFrame:
    """A row per table and column: table, column, type, n_rows, n_null, n_distinct, lowest, highest, median, head.

    One pass per table.  ``n_distinct`` and ``median`` come from sketches that
    are merged between tasks (2 % and one thousandth of the ranks); ``median`` is
    of numbers only.  ``head`` has the column's values in the first rows by the
    order given for the table, kept by a bounded aggregate.  Nested columns and
    binaries are shown by their text.
    """
    out = None
    for name, df in tables.items():
        aggs, rows = [F.count(F.lit(1)).alias("n")], []
        by = [F.col(c) for c in (order or {}).get(name, ())]
        shown = {c: F.col(f"`{c}`").cast("string") if not isinstance(df.schema[c].dataType, T.ArrayType | T.StructType | T.MapType) else F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns}
        for i, f in enumerate(df.schema.fields):
            c, number = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType)
            plain = not isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType | T.BinaryType)
            aggs += [F.count_if(c.isNull()).alias(f"null{i}"), F.approx_count_distinct(shown[f.name], DISTINCT_ERROR).alias(f"distinct{i}"),
                     (F.min(c).cast("string") if plain else F.lit(None).cast("string")).alias(f"low{i}"),
                     (F.max(c).cast("string") if plain else F.lit(None).cast("string")).alias(f"high{i}"),
                     (F.percentile_approx(c, 0.5, QUANTILE_ACCURACY).cast("double") if number else F.lit(None).cast("double")).alias(f"median{i}")]
            rows.append(F.struct(F.lit(name).alias("table"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("n").alias("n_rows"),
                                 F.col(f"null{i}").alias("n_null"), F.col(f"distinct{i}").alias("n_distinct"), F.col(f"low{i}").alias("lowest"), F.col(f"high{i}").alias("highest"),
                                 F.col(f"median{i}").alias("median"), _heads(i).alias("head")))
        values = F.struct(*[shown[c].alias(f"c{i}") for i, c in enumerate(df.columns)])
        if by:
            top = df.select(F.struct(*by).alias("_by"), values.alias("_v")).orderBy("_by").limit(head_rows).agg(
                F.transform(F.array_sort(F.collect_list(F.struct("_by", "_v"))), lambda r: r["_v"]).alias("top"))
        else:
            top = df.select(values.alias("_v")).limit(head_rows).agg(F.collect_list("_v").alias("top"))
        p = attach(df.agg(*aggs), top, []).select(F.inline(F.array(*rows)))
        out = p if out is None else out.unionByName(p)
    return out


def _heads(i: int) -> Column:
    return F.transform("top", lambda r: r[f"c{i}"])


def decoded_preview(df: DataFrame, data: str, count: str, order: Sequence[str], rows: int = 50, values: int = 10) -> DataFrame:
    """The head of a table of packed arrays: its columns, ``data_len``, the guessed ``dtype`` and the first ``values`` of each."""
    top = head(df, order, rows).withColumn("_blob", payload(F.col(data)))
    top = top.withColumn("data_len", F.length("_blob")).withColumn("dtype", blob_type(F.col("data_len"), F.col(count)))
    return top.withColumn("preview", F.slice(unpacked(F.col("_blob"), F.col("dtype")), 1, values)).drop("_blob")


def head(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def effective_ranges(config: DataFrame, data: DataFrame, keys: Sequence[str], ts: str, start: str = "start_ts",
                     stop: str = "end_ts") -> DataFrame:
    """Configured range cut to the data's own; recordings without overlap drop out."""
    span = data.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    out = attach(config, span, keys, "inner").withColumn("from_ts", F.greatest(F.col(start), F.col("_lo"))).withColumn(
        "to_ts", F.least(F.col(stop), F.col("_hi"))).drop("_lo", "_hi")
    return out.filter(F.col("from_ts") < F.col("to_ts"))


def chosen(df: DataFrame, names: Sequence[str] | str, *columns: str) -> DataFrame:
    """Recordings whose name or folder is listed; ``all`` keeps everything."""
    if names == "all":
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).isin(list(names))
    return df.filter(hit)


def missing(config: DataFrame, listing: DataFrame, on: str) -> DataFrame:
    """Configured inputs that do not exist."""
    return config.select(on).distinct().join(listing.select(on), on, "left_anti")


def require_inputs(config: DataFrame, listing: DataFrame, on: str) -> None:
    """Stop before the job starts; names the first few missing inputs."""
    gone = [r[0] for r in missing(config, listing, on).limit(5).collect()]
    if gone:
        raise FileNotFoundError(f"missing inputs, for example: {gone}")


def time_slice(df: DataFrame, group: Sequence[str], ts: str, length: float, offset: float = 0.0) -> DataFrame:
    """Closed slice from the start of each series; the whole series if it is shorter."""
    offset = max(offset, 0.0)
    span = df.groupBy(*group).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    d = attach(df, span, list(group))
    begin = F.col("_lo") + offset
    whole = (F.col("_hi") - F.col("_lo")) <= length
    inside = F.col(ts).between(begin, begin + length)
    return d.filter((begin < F.col("_hi")) & (whole | inside)).drop("_lo", "_hi")


def discovered(files: DataFrame, spans: DataFrame, user: str) -> DataFrame:
    """Pair spectrum files with a label source of the same folder or the root folder:
    label tables first, then JSON; files without one drop out.

    ``files``: path, folder, root, kind (spectrum / labels / json); ``spans``: path,
    min_ts, max_ts in Unix seconds.
    """
    src = files.filter(F.col("kind").isin("labels", "json")).select(
        F.col("folder").alias("l_folder"), F.col("path").alias("label_path"), F.when(F.col("kind") == "labels", 0).otherwise(1).alias("rank"))
    src = src.groupBy("l_folder", "rank").agg(F.min("label_path").alias("label_path"))   # at most two per folder
    near = files.filter("kind = 'spectrum'").select("path", "folder", "root")
    # the label source sits in the file's folder or, for label tables, in the root
    places = near.select("path", F.explode(F.array_distinct(F.array(
        F.struct(F.col("folder").alias("l_folder"), F.lit(0).alias("far")),
        F.struct(F.col("root").alias("l_folder"), F.lit(1).alias("far"))))).alias("p")).select("path", "p.l_folder", "p.far")
    pairs = places.join(src, "l_folder").filter((F.col("rank") == 0) | (F.col("far") == 0))
    best = pairs.groupBy("path").agg(F.min_by("label_path", F.struct("rank", "far", "label_path")).alias("label_path"))
    civil = F.timestamp_seconds(F.col("min_ts") + 8 * 3600)
    return near.join(best, "path").join(spans, "path").select(
        "path", "label_path", F.date_format(civil, "yyyy-MM-dd HH:mm:ss").alias("start_time"),
        F.date_format(F.timestamp_seconds(F.col("max_ts") + 8 * 3600), "yyyy-MM-dd HH:mm:ss").alias("end_time"),
        F.concat(F.date_format(civil, "MMddHHmm"), F.lit("_" + user)).alias("experiment_name"))
