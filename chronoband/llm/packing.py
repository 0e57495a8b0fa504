"""Concatenate and cut: documents in fixed windows of token ids.

First pass: each task tokenizes its rows once, and writes the ids with the
row's start inside the partition.  The partition totals (one row per task) are
summed up in order and give every partition its global offset.  Second pass: a
document's place is partition offset plus own start, so every row is cut at the
window borders on its own, without a shuffle; a window that crosses partitions
is met by records on both sides that carry the same sequence id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoband.llm.common import stored, text_or_empty
from chronoband.llm.tokens import encoder

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def _tokenized(tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        stop = np.array([end], dtype="<u4")
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                few = batch.slice(lo, 256)
                keys = few.column(0)
                ids = [np.concatenate((x, stop.astype(x.dtype))) for x in encode(few.column(1).to_pylist())]
                lengths = np.array([len(x) for x in ids], dtype=np.int64)
                ends = start + np.cumsum(lengths)
                yield pa.RecordBatch.from_pydict({
                    "key": keys, "part": pa.array(np.full(len(ids), part), pa.int32()), "local": pa.array(ends - lengths, pa.int64()),
                    "n": pa.array(lengths, pa.int64()), "width": pa.array([x.dtype.itemsize for x in ids], pa.int32()),
                    "ids": pa.array([x.tobytes() for x in ids], pa.binary())})
                start = int(ends[-1])
    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, place, width, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
                n = len(ids)
                cuts = [0, *range(window - place % window, n, window), n]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    piece = ids[a:b].tobytes()
                    rows.append((key, a, b - a, zlib.crc32(piece), n, (place + a) // window, (place + a) % window, piece))
            names = [x.split()[0] for x in PIECE.split(", ")]
            kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)
    return run


def packed_pieces(docs: DataFrame, tokenizer: str, end: int, window: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in windows: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (u32).

    All documents one after another, each with the end id, make one stream that
    is cut every ``window`` ids; only the last sequence is shorter and wants
    padding.  Null text counts as empty: a piece with the end id alone.
    Repeated rows are packed as often as they come.  The key must be an integer
    and may be null.  An empty table gives no piece.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("key"), text_or_empty(text).alias("text"))
    done = stored(rows.mapInArrow(_tokenized(tokenizer, end), "key bigint, part int, local bigint, n bigint, width int, ids binary"), "packing")
    totals = done.groupBy("part").agg(F.max(F.col("local") + F.col("n")).alias("total"))  # one row per task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("of"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = done.join(F.broadcast(bases), F.col("part") == F.col("of"))
    placed = placed.select("key", (F.col("base") + F.col("local")).alias("place"), "width", "ids")
    pieces = placed.mapInArrow(_cut(window), PIECE)
    return pieces.withColumnRenamed("doc_id", key)


def sequences(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whole windows: sequence_id, n_tokens, ids (u32), pieces in order.  A window has few pieces, so groups are small."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", F.col(key), "start", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(ordered.alias("pieces"))
    joined = F.aggregate("pieces", F.lit(b""), lambda whole, piece: F.concat(whole, piece.ids))
    return grouped.select("sequence_id", F.aggregate("pieces", F.lit(0).cast("bigint"), lambda n, p: n + p.length).alias("n_tokens"),
                          joined.alias("ids"), F.transform("pieces", lambda p: p.dropFields("ids")).alias("pieces"))
