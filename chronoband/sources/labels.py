"""Label readings and recording configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoband.functions import timekeys as K

ARRAYS_SCHEMA = "times array<string>, username string, values array<double>"
OBJECTS_SCHEMA = "array<struct<time: string, value: double>>"
CONFIG_SCHEMA = ("experiment_name string, db_path string, db_files array<string>, glucose_db_path string, "
                 "json_path string, start_time string, end_time string")


def from_table(df: DataFrame, time: str, value: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Readings in Unix seconds with their civil time."""
    t = F.col(time).cast("double")
    return df.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).select(
        *keep, t.alias("ts"), F.col(value).cast("double").alias("glucose"), K.epoch_to_civil(F.col(time)).alias("civil"))


def from_arrays(df: DataFrame, text: str, keep: tuple[str, ...] = (), start: float | None = None, stop: float | None = None) -> DataFrame:
    """``{"times": [...], "values": [...]}`` documents, civil times, optional range."""
    d = df.select(*keep, F.from_json(text, ARRAYS_SCHEMA).alias("j"))
    d = d.select(*keep, F.inline(F.arrays_zip(F.col("j.times").alias("time"), F.col("j.values").alias("value"))))
    d = d.select(*keep, K.civil_to_epoch(F.col("time")).alias("ts"), F.col("value").alias("glucose"))
    if start is not None:
        d = d.filter(F.col("ts") >= start)
    if stop is not None:
        d = d.filter(F.col("ts") <= stop)
    return d.filter(F.col("ts").isNotNull())


def from_objects(df: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``[{"time": "MM.dd HH:mm", "value": ...}, ...]`` documents of the assumed year."""
    d = df.select(*keep, F.inline(F.from_json(text, OBJECTS_SCHEMA)))
    return d.select(*keep, K.short_civil(F.col("time")).alias("datetime"), F.col("value").alias("glucose"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file, for the two readers above."""
    return spark.read.option("wholetext", "true").text(path).select(F.col("value").alias("document"), F.input_file_name().alias("path"))


def _under(folder: str, path: Column) -> Column:
    return F.when(path.isNull() | (path == "") | path.startswith("/") | path.contains("://"), path).otherwise(
        F.concat(F.lit(folder.rstrip("/") + "/"), path))


def config(df: DataFrame, text: str, folder: str) -> DataFrame:
    """Recording configurations: relative paths hang under ``folder``, defaults filled."""
    c = df.select(F.inline(F.from_json(text, f"array<struct<{CONFIG_SCHEMA}>>")))
    return c.select("experiment_name", _under(folder, F.col("db_path")).alias("db_path"),
                    F.coalesce(F.transform("db_files", lambda f: _under(folder, f)), F.array(_under(folder, F.col("db_path")))).alias("db_files"),
                    _under(folder, F.col("glucose_db_path")).alias("glucose_db_path"),
                    F.coalesce(_under(folder, F.col("json_path")), F.lit("")).alias("json_path"), "start_time", "end_time")
