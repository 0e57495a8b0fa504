"""Writers.  Every sink is a distributed write; nothing is gathered first."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoband.operators.splits import hashed

LAYOUTS = ("plain", "late_fusion", "history")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", parts: Sequence[str] = (), mode: str = "overwrite") -> None:
    """parquet, json or csv (with header), partitioned by folder columns."""
    if fmt not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown format: {fmt}")
    w = df.write.mode(mode).partitionBy(*parts) if parts else df.write.mode(mode)
    w = w.option("header", "true") if fmt == "csv" else w
    w.format(fmt).save(path)


def append_records(df: DataFrame, path: str) -> None:
    """One JSON line per trial, added to what is there."""
    df.write.mode("append").json(path)


def feature_batches(df: DataFrame, layout: str, key: str, n_spectrum: int | None = None, seed: int = 42) -> DataFrame:
    """Trainer rows in seeded order inside each split: ranges of (split, hash), as many as the session has shuffle partitions."""
    f = F.col("features")
    if layout == "plain":
        cols = [f]
    elif layout in ("late_fusion", "history"):
        n = F.lit(n_spectrum)
        cols = [F.slice(f, 1, n_spectrum).alias("spectrum"), F.slice(f, n_spectrum + 1, F.greatest(F.size(f) - n, F.lit(0))).alias("aux")]
        if layout == "history":
            cols.append(F.col("label_history"))
    else:
        raise ValueError(f"unknown layout: {layout}")
    return df.select(key, "split", *cols, "label", hashed(key, seed).alias("shuffle_key")).repartitionByRange(
        "split", "shuffle_key").sortWithinPartitions("split", "shuffle_key")


def matrix_files(df: DataFrame, order: Sequence[str], features: str) -> DataFrame:
    """NumPy ``.npy`` content as rows, one per Arrow batch; ``committed.write_matrix`` stores one file per partition."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                buf = io.BytesIO()
                np.save(buf, np.stack(b[features].to_numpy()).astype(np.float32))
                yield pd.DataFrame({"first_key": [int(b[order[-1]].iloc[0])], "n_rows": [len(b)], "content": [buf.getvalue()]})
    return df.select(*order, features).sortWithinPartitions(*order).mapInPandas(pack, "first_key long, n_rows long, content binary")
