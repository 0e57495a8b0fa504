"""Line duplicates: range-partitioned hashes in, compressed keep bitmaps out.

Every line becomes (128-bit key hash, document, position).  The hashes are
range-partitioned and sorted by hash, document and position, so the copies of a
line form one run.  The range key goes on with the document, therefore a line
found in a third of all documents spreads over many partitions; a run that
crosses partition borders is resolved through a table with two rows per
partition.  Runs are streamed: a task holds at most the occurrences seen before
the document threshold is reached.  No text is shuffled here; the result is a
bitmap per document that loses lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoband.llm.common import ascii_lower, materialise, text_or_empty

STRIPPED = " \t\n\x0b\x0c\r"
ORDER = ["h1", "h2", "_id", "_tag"]


def line_key(line: Column) -> Column:
    """What makes two lines equal: no white space at the ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(STRIPPED)))


def tag(text: str) -> Column:
    """Tells rows apart that share an id but not their text."""
    return F.xxhash64(text_or_empty(text))


def hashed_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    lines = F.split(text_or_empty(text), "\n", -1)
    spread = docs.select(F.col(key).alias("_id"), tag(text).alias("_tag"), lines.alias("_lines"))
    spread = spread.select("_id", "_tag", F.size("_lines").alias("_n"), F.posexplode("_lines").alias("_pos", "_line"))
    spread = spread.select("_id", "_tag", "_n", "_pos", line_key(F.col("_line")).alias("_key")).where("_key <> ''")
    return spread.select(F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), "_key").alias("h2"), "_id", "_tag", "_n", "_pos")


def _marks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and document columns as integers; a null id is told by its own column."""
    h1, h2, own = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "_tag"))
    ids = batch.column(batch.schema.get_field_index("_doc")).to_numpy(zero_copy_only=False)
    return h1, h2, ids, own


def _starts(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before it; the first row always does."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _edge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last run of a partition with their numbers of documents."""
    runs: list[list] = []  # [h1, h2, documents, last document], at most the first and the newest
    pid = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        pid = batch.column(batch.schema.get_field_index("_pid"))[0].as_py()
        h1, h2, ids, own = _marks(batch)
        new_run, new_doc = _starts(h1, h2), _starts(h1, h2, ids, own)
        at = np.flatnonzero(new_run)
        docs = np.add.reduceat(new_doc.astype(np.int64), at)
        for k in sorted({0, len(at) - 1}):
            last = (at[k + 1] if k + 1 < len(at) else len(h1)) - 1
            tail = (ids[last], own[last])
            if k == 0 and runs and (runs[-1][0], runs[-1][1]) == (h1[0], h2[0]):
                runs[-1][2] += int(docs[0]) - (runs[-1][3] == (ids[0], own[0]))
                runs[-1][3] = tail
            else:
                runs = runs[:1] + [[h1[at[k]], h2[at[k]], int(docs[k]), tail]]
    yield pa.RecordBatch.from_pydict({
        "pid": pa.array([pid] * len(runs), pa.int32()), "h1": pa.array([int(r[0]) for r in runs], pa.int64()),
        "h2": pa.array([int(r[1]) for r in runs], pa.int64()), "n_docs": pa.array([r[2] for r in runs], pa.int64())})


def _drops(crossing: dict[tuple[int, int], tuple[int, int]], min_docs: int, keep_first: bool):
    """Stream a sorted partition; give the occurrences to drop.

    ``crossing``: runs that cross a border, with their documents and the partition they start in.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # hash of the open run
        docs, settled, rare, last, held, first = 0, False, False, None, [], True
        for batch in batches:
            if not batch.num_rows:
                continue
            pid = batch.column(batch.schema.get_field_index("_pid"))[0].as_py()
            h1, h2, ids, own = _marks(batch)
            new_doc = _starts(h1, h2, ids, own)
            at = np.append(np.flatnonzero(_starts(h1, h2)), len(h1))
            size = np.diff(at)
            plain = np.add.reduceat(new_doc.astype(np.int64), at[:-1])
            drop = np.repeat(plain >= min_docs, size)
            if keep_first:
                drop[at[:-1]] = False
            for k in {0, len(size) - 1}:  # runs that may go on beyond the batch are settled one by one
                a, b = int(at[k]), int(at[k + 1])
                drop[a:b] = False
                hash_ = (int(h1[a]), int(h2[a]))
                if hash_ != now:
                    docs, last, held = 0, None, []
                    whole = crossing.get(hash_)
                    settled = whole is not None and whole[0] >= min_docs
                    rare = whole is not None and not settled
                    first = whole is None or whole[1] == pid
                    now = hash_
                if rare:
                    continue
                docs += int(plain[k]) - (last == (ids[a], own[a]))
                last = (ids[b - 1], own[b - 1])
                skip = int(keep_first and first)
                first = False
                if settled or docs >= min_docs:
                    settled = True
                    drop[a + skip:b] = True
                    yield from held
                    held = []
                elif b - a > skip:
                    held.append(batch.slice(a + skip, b - a - skip).select(["_id", "_tag", "_n", "_pos"]))
            if drop.any():
                yield batch.select(["_id", "_tag", "_n", "_pos"]).filter(pa.array(drop))
    return run


@F.pandas_udf(T.BinaryType())
def _bitmap(n: pd.Series, dropped: pd.Series) -> pd.Series:
    out = []
    for size, gone in zip(n, dropped, strict=True):
        keep = np.ones(size, dtype=bool)
        keep[np.asarray(gone, dtype=np.int64)] = False
        out.append(zlib.compress(np.packbits(keep).tobytes(), 6))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def kept_lines(n: pd.Series, bitmap: pd.Series) -> pd.Series:
    """A flag per line from a keep bitmap."""
    return pd.Series([np.unpackbits(np.frombuffer(zlib.decompress(b), dtype=np.uint8), count=size).astype(bool)
                      for size, b in zip(n, bitmap, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 2,
                 keep_first: bool = True) -> DataFrame:
    """Per document that loses lines: key, text_tag, n_lines, n_dropped, keep_bitmap (zlib over packed bits).

    A line is dropped when its key (ends stripped, A-Z lower-cased) is found in
    at least ``min_docs`` documents; with ``keep_first`` its first occurrence by
    document and position stays.  Lines without any character but white space
    are never dropped.  Null text is one empty line.  Repeated rows count as one
    document; rows that share an id but not the text are told apart by
    ``text_tag``.  A null id sorts first.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    hashes = materialise(hashed_lines(docs, key, text))
    kind = dict(hashes.dtypes)["_id"]
    # the id also as a plain comparable value, with null told apart
    hashes = hashes.withColumn("_doc", F.coalesce(F.col("_id").cast("string"), F.lit("\0null")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = materialise(hashes.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER, "_pos"))
    ordered = ordered.withColumn("_pid", F.spark_partition_id())
    edges = ordered.mapInArrow(_edge_runs, "pid int, h1 bigint, h2 bigint, n_docs bigint")
    crossing = {(r.h1, r.h2): (r.n_docs, r.pid) for r in edges.groupBy("h1", "h2").agg(
        F.sum("n_docs").alias("n_docs"), F.min("pid").alias("pid"), F.count(F.lit(1)).alias("parts"))
        .where("parts > 1").collect()}  # fewer than partitions
    drops = ordered.mapInArrow(_drops(crossing, min_docs, keep_first), f"_id {kind}, _tag bigint, _n int, _pos int")
    by_doc = drops.groupBy("_id", "_tag", "_n").agg(F.array_sort(F.collect_set("_pos")).alias("_gone"))
    return by_doc.select(F.col("_id").alias(key), F.col("_tag").alias("text_tag"), F.col("_n").alias("n_lines"),
                         F.size("_gone").alias("n_dropped"), _bitmap("_n", "_gone").alias("keep_bitmap"))


def without_lines(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``row`` (a row of ``docs`` whole), ``text`` without the dropped lines, ``n_lines`` and ``n_dropped``.

    Null text stays null; a text that loses every line becomes empty.
    """
    gone = bitmaps.select(F.col(key).alias("b_id"), F.col("text_tag").alias("b_tag"), F.col("n_dropped").alias("b_dropped"),
                          kept_lines("n_lines", "keep_bitmap").alias("keep"))
    rows = docs.select(F.struct("*").alias("row"), tag(text).alias("tag"))
    joined = rows.join(gone, F.col(f"row.`{key}`").eqNullSafe(F.col("b_id")) & (F.col("tag") == F.col("b_tag")), "left")
    lines = F.split(F.col(f"row.`{text}`"), "\n", -1)
    shorter = F.concat_ws("\n", F.zip_with(lines, "keep", lambda line, keep: F.when(keep, line)))
    return joined.select("row", F.when(F.col("keep").isNull(), F.col(f"row.`{text}`")).otherwise(shorter).alias("text"),
                         F.coalesce(F.size(lines), F.lit(1)).alias("n_lines"),
                         F.coalesce("b_dropped", F.lit(0)).alias("n_dropped"))
