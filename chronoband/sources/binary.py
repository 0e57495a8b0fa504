"""Recorder files: spectrum records and tagged auxiliary records.

``recorder`` has the data source that reads files in one pass.  Here is the
strict form: files are listed without reading them, cut into blocks of whole
records by tasks that each find the borders of one range, and the blocks are
decoded in parallel.  Files with a wrong header end up in the reject table
instead of failing the job.  A file that cannot be read is named there too, but
reading its records fails: rows that are missing must not look like a result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoband.sources.recorder import (AUX_RECORDS, AUX_SCHEMA, BLOCK_BYTES, LAYOUTS, MOST_RANGES, ROWS_PER_BATCH, SKIPPED_COUNT, SPECTRUM_SCHEMA,
                                         TAG_ENVIRONMENT, TAG_MOTION, TAG_PULSE, TAG_SKIN, Layout, Walk, aux_batch, first_border, has_header, open_file,
                                         run_blocks, spectrum_batch)

BLOCK_SCHEMA = "path string, start long, stop long, error string"
FOUND_SCHEMA = "path string, length long, k long, start long, stop long, whole boolean, error string"


def listed(spark: SparkSession, folder: str | list[str], pattern: str = "*") -> DataFrame:
    """path and length of every file; the glob ignores case, the content is not read."""
    glob = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern)
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
            .load(folder).select("path", "length").dropDuplicates(["path"]))


def _found(layout: Layout, block: int, strict: bool):
    """Each byte range of a file (path, length, k): where its records start and end, and whether they go on to the next range.

    An unreadable file is a reject, or if ``strict`` the end of the task, which is then tried again.
    """
    def row(path: str, size: int, k: int) -> tuple:
        try:
            with open_file(path) as f:
                if f.size() < size:
                    raise OSError(f"{path} had {size} bytes when it was listed and has {f.size()} now")
                if not has_header(f, layout):
                    return path, size, k, 0, 0, False, "bad header"
                low = layout.header + k * block
                start = low if k == 0 else first_border(f, size, layout, low)
                if start is None:
                    return path, size, k, low, low, False, None
                walk = Walk(f, size, layout, start, low + block).to_end()
                return path, size, k, start, walk.end, walk.whole, None
        except OSError as e:
            if strict:
                raise
            return path, size, k, 0, 0, False, f"unreadable: {type(e).__name__}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [row(path, int(size), int(k)) for path, size, k in zip(b["path"], b["length"], b["k"])]
            yield pd.DataFrame(rows, columns=["path", "length", "k", "start", "stop", "whole", "error"])
    return run


def _chained(layout: Layout, block: int):
    """Ranges of one file in order: each must start where the one before it ended, else it is walked again from there."""
    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("k")
        first = b.iloc[0]
        if pd.notna(first["error"]):
            return pd.DataFrame([(first["path"], 0, 0, first["error"])], columns=["path", "start", "stop", "error"])
        rows, at = [], layout.header
        for path, size, k, start, stop, whole in zip(b["path"], b["length"], b["k"], b["start"], b["stop"], b["whole"]):
            if start != at:
                with open_file(path) as f:
                    walk = Walk(f, int(size), layout, at, layout.header + (int(k) + 1) * block).to_end()
                start, stop, whole = at, walk.end, walk.whole
            if stop > start:
                rows.append((path, start, stop, None))
            at = stop
            if not whole:
                break
        return pd.DataFrame(rows, columns=["path", "start", "stop", "error"])
    return run


def blocks(files: DataFrame, kind: str, block: int = BLOCK_BYTES) -> DataFrame:
    """(path, start, stop, error): whole records from border to border, as a reader would meet them that stops for good at the first damage.

    All ranges of a file are searched at once.  The first starts behind the
    header, a later one has to start where the one before it ended; the file's
    ranges (a row per ``block`` bytes, or a run of them in large folders, see
    ``run_blocks``) are held against each other, so no border rests on a guess.
    """
    return _blocks(files, kind, block, strict=False)[0]


def _blocks(files: DataFrame, kind: str, block: int, strict: bool) -> tuple[DataFrame, int]:
    """The blocks and how many tasks they are worth; the rows are few and small, so their number must not decide that."""
    layout = LAYOUTS[kind]
    size = files.agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files")).first()
    step = block * run_blocks(size.bytes or 0, block)
    tasks = -(-(size.bytes or 0) // step) + min(size.files, MOST_RANGES) or 1
    last = F.greatest(F.floor((F.col("length") - layout.header - 1) / step), F.lit(0))
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("k"))
    found = ranges.repartition(tasks, "path", "k").mapInPandas(_found(layout, step, strict), FOUND_SCHEMA)
    return found.groupBy("path").applyInPandas(_chained(layout, step), BLOCK_SCHEMA), tasks


def spectrum_records(data: bytes) -> tuple[list, list, list]:
    """Times, counts and powers; stops at a short tail, drops skipped records."""
    if len(data) >= 10:
        n = struct.unpack_from("<H", data, 8)[0]
        if n != SKIPPED_COUNT:
            kind = np.dtype([("t", "<f8"), ("n", "<u2"), ("p", "<i4", (n,))])
            whole = np.frombuffer(data, kind, len(data) // kind.itemsize)
            if len(whole) and (whole["n"] == n).all():
                rest = data[len(whole) * kind.itemsize:]
                # a short rest cannot hold another full record of this width, maybe a narrower one
                t, c, p = spectrum_records(rest) if len(rest) >= 10 else ([], [], [])
                return [*whole["t"].tolist(), *t], [*whole["n"].tolist(), *c], [*list(whole["p"]), *p]
    times, counts, powers, at = [], [], [], 0
    while at + 10 <= len(data):
        t, n = struct.unpack_from("<dH", data, at)
        at += 10
        if n == SKIPPED_COUNT:
            continue
        if at + 4 * n > len(data):
            break
        times.append(t)
        counts.append(n)
        powers.append(np.frombuffer(data, "<i4", n, at))
        at += 4 * n
    return times, counts, powers


def aux_records(data: bytes) -> tuple[list, list, list]:
    """Tags, times and values; stops at an unknown tag or a short record."""
    tags, times, values, at = [], [], [], 0
    while at < len(data):
        fmt = AUX_RECORDS.get(data[at])
        if fmt is None or at + 1 + struct.calcsize(fmt) > len(data):
            break
        t, *v = struct.unpack_from(fmt, data, at + 1)
        tags.append(data[at])
        times.append(t)
        values.append([float(x) for x in v])
        at += 1 + struct.calcsize(fmt)
    return tags, times, values


def _decode(kind: str):
    layout, batch = LAYOUTS[kind], spectrum_batch if kind == "spectrum" else aux_batch
    every = lambda t: np.ones(len(t), dtype=bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                with open_file(r["path"]) as f:
                    walk = Walk(f, r["stop"], layout, r["start"], r["stop"])
                    for data, starts in walk:
                        for k in range(0, len(starts), ROWS_PER_BATCH):
                            yield batch(r["path"], data, starts[k:k + ROWS_PER_BATCH], every)
                    if walk.end != r["stop"]:
                        raise OSError(f"{r['path']} has changed: its records went on to {r['stop']} and end at {walk.end} now")
    return run


def _records(files: DataFrame, kind: str, block: int) -> DataFrame:
    found, tasks = _blocks(files, kind, block, strict=True)
    good = found.filter("error IS NULL").repartition(tasks, "path", "start")
    return good.mapInArrow(_decode(kind), SPECTRUM_SCHEMA if kind == "spectrum" else AUX_SCHEMA)


def read_spectrum(files: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """All records of the files; fails if one cannot be read or is shorter than it was listed."""
    return _records(files, "spectrum", block)


def read_aux(files: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """As ``read_spectrum``."""
    return _records(files, "aux", block)


def rejects(files: DataFrame, kind: str) -> DataFrame:
    return blocks(files, kind).filter("error IS NOT NULL").select("path", "error")


def demultiplexed(aux: DataFrame) -> dict[str, DataFrame]:
    """Four typed tables; a negative heart rate is missing."""
    def pick(tag: int, **columns: Column) -> DataFrame:
        return aux.filter(F.col("tag") == tag).select("file_source", "ts", *[c.alias(k) for k, c in columns.items()])
    v = lambda i: F.get(F.col("v"), i)
    return {
        "environment": pick(TAG_ENVIRONMENT, temperature_c=v(0), pressure_hpa=v(1), humidity_pct=v(2)),
        "pulse": pick(TAG_PULSE, red=v(0).cast("int"), ir=v(1).cast("int"),
                      heart_rate_bpm=F.when(v(2) >= 0, v(2)).cast("smallint"), spo2_percent=v(3).cast("tinyint")),
        "skin": pick(TAG_SKIN, temperature_c=v(0)),
        "motion": pick(TAG_MOTION, acc_x=v(0), acc_y=v(1), acc_z=v(2), gyr_x=v(3), gyr_y=v(4), gyr_z=v(5)),
    }


# ---- values packed inside a table column -------------------------------------

def payload(text: Column) -> Column:
    """Bytes of a hex text (``0x`` and blanks allowed) or, failing that, base64 text."""
    hexed = F.regexp_replace(F.regexp_replace(F.trim(text), "^0[xX]", ""), r"\s+", "")
    is_hex = hexed.rlike("^([0-9A-Fa-f]{2})+$")
    return F.when(is_hex, F.unhex(hexed)).otherwise(F.try_to_binary(F.trim(text), F.lit("base64")))


def blob_type(length: Column, count: Column) -> Column:
    """Element type from byte length and count; without a count the first type that
    gives 8 to 4096 elements."""
    sized = F.when(length == count * 2, "i2").when(length == count * 4, "i4").when(length == count * 8, "f8")
    free = (F.when((length % 2 == 0) & (length / 2).between(8, 4096), "i2")
            .when((length % 4 == 0) & (length / 4).between(8, 4096), "i4")
            .when((length % 8 == 0) & (length / 8).between(8, 4096), "f8"))
    return F.when(count > 0, sized).otherwise(free)


def unpacked(blob: Column, kind: Column) -> Column:
    """Array of a blob with NumPy element type ``kind``; NULL if it does not fit."""
    @F.pandas_udf("array<double>")
    def run(b: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for x, t in zip(b, k):
            size = np.dtype("<" + t).itemsize if t else 0
            out.append(np.frombuffer(x, "<" + t).astype(float) if x is not None and size and len(x) % size == 0 else None)
        return pd.Series(out, dtype=object)
    return run(blob, kind)


def modal_length(df: DataFrame, array: str) -> DataFrame:
    """Keep rows whose array has the most common length (shorter on ties)."""
    n = df.groupBy(F.size(array).alias("_w")).agg(F.count(F.lit(1)).alias("_c"))
    mode = n.agg(F.min_by("_w", F.struct(-F.col("_c"), F.col("_w"))).alias("_mode"))
    return df.filter(F.size(array) == mode.scalar())
