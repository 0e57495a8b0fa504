"""Token-id files: frequency-ranked ids in a byte-aligned code with separate control bytes.

A file holds blocks of whole documents in ascending key order.  Within a block
the ids are replaced by their frequency ranks, so the most common 256 take one
byte; a control byte tells the widths (1 to 4 bytes) of four ranks, and the rank
bytes follow in a stream of their own.  A reader looks the widths up in a table
of 256 rows and the ids up in the block's rank table: no loop over ids.

Layout, all little-endian: ``MAGIC``, then per block the header (documents,
ids, table entries, data bytes as u64), keys as i64, null flags as u8, lengths
as u32, the rank table as u32, control bytes, data bytes.

Texts are range-partitioned by key once and each task tokenizes its range
straight into its file in the shared folder, under a name no other attempt
uses; the manifest, which names the files that count, is checkpointed.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoband.llm.common import materialise, scratch_path, text_or_empty
from chronoband.llm.tokens import encoder

MAGIC = b"TOKENIDS1\n"
BLOCK_IDS = 1 << 20
#: ids below are counted in an array of that size, larger ones by sorting
LARGEST_COUNTED = 1 << 22
HEADER = struct.Struct("<4Q")
#: widths[c]: the four widths that control byte c tells
WIDTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(ids: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
    """Rank table, control bytes and data bytes of a run of ids."""
    if len(ids) and int(ids.max()) >= LARGEST_COUNTED:
        values, ids, counts = np.unique(ids, return_inverse=True, return_counts=True)
    else:
        counts = np.bincount(ids)
        values = np.arange(len(counts), dtype=np.uint32)
    order = np.argsort(-counts, kind="stable")[:np.count_nonzero(counts)]
    rank_of = np.zeros(len(counts), dtype=np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    ranks = rank_of[ids.reshape(-1)]
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    quads = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    quads[:len(ranks)] = extra
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    ends = np.cumsum(extra + 1, dtype=np.int64)
    begin = ends - extra - 1
    data = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    data[begin] = ranks & 0xFF
    for more in (1, 2, 3):
        wide = np.flatnonzero(extra >= more)
        data[begin[wide] + more] = ranks[wide] >> (8 * more) & 0xFF
    return values[order].astype("<u4"), control.tobytes(), data.tobytes()


def unpack(table: np.ndarray, control: bytes, data: bytes, n: int) -> np.ndarray:
    widths = WIDTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    begin = np.cumsum(widths, dtype=np.int64) - widths
    stream = np.frombuffer(data, dtype=np.uint8)
    ranks = stream[begin].astype(np.uint32)
    for more in (1, 2, 3):
        wide = np.flatnonzero(widths > more)
        ranks[wide] |= stream[begin[wide] + more].astype(np.uint32) << np.uint32(8 * more)
    return table[ranks]


def write_block(out, keys: list[int | None], parts: list[np.ndarray]) -> int:
    ids = np.concatenate(parts).astype(np.uint32) if parts else np.empty(0, np.uint32)
    table, control, data = pack(ids)
    out.write(HEADER.pack(len(keys), len(ids), len(table), len(data)))
    out.write(np.array([0 if k is None else k for k in keys], dtype="<i8").tobytes())
    out.write(np.array([k is None for k in keys], dtype=np.uint8).tobytes())
    out.write(np.array([len(p) for p in parts], dtype="<u4").tobytes())
    out.write(table.tobytes() + control + data)
    return len(ids)


def read_blocks(source) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Keys, lengths and ids of block after block."""
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id file")
    while head := source.read(HEADER.size):
        docs, n, entries, size = HEADER.unpack(head)
        keys = np.frombuffer(source.read(8 * docs), dtype="<i8")
        null = np.frombuffer(source.read(docs), dtype=np.uint8)
        lengths = np.frombuffer(source.read(4 * docs), dtype="<u4")
        table = np.frombuffer(source.read(4 * entries), dtype="<u4")
        control, data = source.read(-(-n // 4)), source.read(size)
        yield [None if gone else int(k) for k, gone in zip(keys, null, strict=True)], lengths, unpack(table, control, data, n)


def _writer(folder: str, tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        system, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        keys, parts, held, total = [], [], 0, 0
        stop = np.array([end], dtype=np.uint32)
        out = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                few = batch.slice(lo, 64)
                texts = few.column(1).to_pylist()
                for key, ids in zip(few.column(0).to_pylist(), encode(texts), strict=True):
                    if out is None:
                        system.create_dir(root, recursive=True)
                        out = system.open_output_stream(path)
                        out.write(MAGIC)
                    keys.append(key)
                    parts.append(np.concatenate((ids, stop)))
                    held += len(ids) + 1
                    if held >= BLOCK_IDS:
                        total += write_block(out, keys, parts)
                        keys, parts, held = [], [], 0
        if keys:
            total += write_block(out, keys, parts)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [path.removeprefix(root + "/")],
                                              "n_ids": pa.array([total], pa.int64())})
    return run


def write_tokens(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text",
                 folder: str | None = None) -> tuple[DataFrame, str]:
    """Write the files; give the manifest (part, file, n_ids, base: ids in all files before) and the folder.

    Files and the documents in them ascend by key; null keys come first, rows
    that repeat a key follow one another.  Null text counts as empty and gives
    the end id alone.  An empty table gives no file.  The folder grows with the
    data and is the caller's to remove.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    rows = docs.select(F.col(key).cast("bigint").alias("key"), text_or_empty(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "key").sortWithinPartitions("key", F.xxhash64("text"))
    manifest = materialise(ordered.mapInArrow(_writer(folder, tokenizer, end), "part int, file string, n_ids bigint"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), folder


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_input_stream(f"{root}/{file}") as source:
                    for keys, lengths, ids in read_blocks(source):
                        ends = np.cumsum(lengths, dtype=np.int64)
                        raw, at = ids.astype("<u4").tobytes(), 4 * np.append(0, ends)
                        cut = [raw[at[k]:at[k + 1]] for k in range(len(keys))]
                        yield pa.RecordBatch.from_pydict({
                            "key": pa.array(keys, pa.int64()), "start": pa.array(base + ends - lengths, pa.int64()),
                            "n_tokens": pa.array(lengths, pa.int64()), "ids": pa.array(cut, pa.binary())})
                        base += int(ends[-1]) if len(ends) else 0
    return run


def read_tokens(manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Documents of the files: key, start (ids of all documents before), n_tokens, ids (u32, little-endian)."""
    files = manifest.select("file", "base").repartition(max(1, manifest.count()))
    rows = files.mapInArrow(_reader(folder), "key bigint, start bigint, n_tokens bigint, ids binary")
    return rows.withColumnRenamed("key", key)
