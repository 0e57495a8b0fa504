"""What the text operators share: ASCII lower case, stable ids, files in the shared folder."""

from __future__ import annotations

import gc
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoband.session import materialise, scratch_path

__all__ = ["ascii_lower", "documents", "materialise", "release", "scratch_path", "stored", "table", "text_or_empty"]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other letter."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder once and read it back: later jobs and retries reread the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and checkpoints that no table refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
