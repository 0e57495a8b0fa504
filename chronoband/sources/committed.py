"""Sinks with a commit protocol: what a failed or repeated task wrote is never seen.

Every attempt of a task writes files of its own into the job's staging folder
and reports them in its commit message.  Spark hands the driver the messages of
the attempts that count; only their files are moved to their final names, then
the manifest that readers go by is replaced in one move, then the staging
folder goes, and with it the files of all other attempts.  A job that fails
leaves the target as it was.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from chronoband.sources.recorder import file_system

HEADER = 128
MANIFEST = "_manifest.json"
COPY_BYTES = 8 << 20
ROWS_PER_RANGE = 65_536


def npy_header(kind: str, rows: int, width: int | None) -> bytes:
    """A version 1.0 header of fixed length, so that it can be put in place once the rows are counted."""
    shape = f"({rows},)" if width is None else f"({rows}, {width})"
    text = f"{{'descr': '{kind}', 'fortran_order': False, 'shape': {shape}, }}"
    return b"\x93NUMPY\x01\x00" + (HEADER - 10).to_bytes(2, "little") + text.ljust(HEADER - 11).encode() + b"\n"


class NpyFile:
    """A ``.npy`` file whose number of rows is known only at its end."""
    def __init__(self, fs: pafs.FileSystem, path: str, kind: str, matrix: bool):
        self.fs, self.path, self.kind, self.width, self.rows = fs, path, kind, None if not matrix else 0, 0
        self.out = fs.open_output_stream(path)
        self.out.write(b"\0" * HEADER)

    def add(self, values: np.ndarray) -> None:
        if self.width is not None:
            if self.rows and values.shape[1] != self.width:
                raise ValueError(f"rows of {values.shape[1]} values after rows of {self.width}")
            self.width = values.shape[1]
        self.out.write(np.ascontiguousarray(values, self.kind).tobytes())
        self.rows += len(values)

    def close(self) -> None:
        self.out.close()
        header = npy_header(self.kind, self.rows, self.width)
        if isinstance(self.fs, pafs.LocalFileSystem):
            with open(self.path, "r+b") as f:
                f.write(header)
            return
        whole = f"{self.path}.whole"  # stores without writes in place
        with self.fs.open_input_stream(self.path) as body, self.fs.open_output_stream(whole) as out:
            body.read(HEADER)
            out.write(header)
            while piece := body.read(COPY_BYTES):
                out.write(piece)
        self.fs.delete_file(self.path)
        self.fs.move(whole, self.path)


@dataclass
class Written(ds.WriterCommitMessage):
    """What one attempt wrote: file names in the staging folder by kind, rows, width, the partition it stands for."""
    files: dict[str, str]
    rows: int
    width: int
    partition: int


@dataclass
class Staged(ds.DataSourceArrowWriter):
    path: str
    overwrite: bool
    options: dict
    job: str = field(default_factory=lambda: os.urandom(8).hex())

    def staging(self) -> tuple[pafs.FileSystem, str, str]:
        fs, inner = file_system(self.path)
        return fs, inner, f"{inner}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, _, folder = self.staging()
        fs.create_dir(folder)
        task = TaskContext.get()
        stem = f"{folder}/{task.partitionId():05d}-{os.urandom(6).hex()}"
        return self.encode(fs, stem, iterator, task.partitionId())

    def encode(self, fs: pafs.FileSystem, stem: str, iterator: Iterator[pa.RecordBatch], partition: int) -> Written:
        raise NotImplementedError

    def abort(self, messages: list[Written | None]) -> None:
        fs, _, folder = self.staging()
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)

    def commit(self, messages: list[Written | None]) -> None:
        fs, inner, folder = self.staging()
        fs.create_dir(folder)
        before = manifest(self.path)
        trial = self.options.get("trial")
        if trial is not None and not self.overwrite and any(f.get("trial") == trial for f in before["files"]):
            self.abort(messages)  # this trial is in the target already
            return
        files = [] if self.overwrite else list(before["files"])
        first = sum(f["rows"] for f in files)
        for m in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition):
            names = {}
            for kind, staged in m.files.items():
                names[kind] = f"{self.job}-{os.path.basename(staged).split('-')[0]}.{kind}"
                fs.move(staged, f"{inner}/{names[kind]}")
            files.append({"files": names, "rows": m.rows, "width": m.width, "first": first, "trial": trial})
            first += m.rows
        with fs.open_output_stream(f"{folder}/manifest") as out:
            out.write(json.dumps({"files": files}).encode())
        fs.move(f"{folder}/manifest", f"{inner}/{MANIFEST}")
        if self.overwrite:
            for f in before["files"]:
                for name in f["files"].values():
                    fs.delete_file(f"{inner}/{name}")
        fs.delete_dir(folder)


def manifest(path: str) -> dict:
    """The committed files of a target; none where nothing was committed."""
    fs, inner = file_system(path)
    if fs.get_file_info(f"{inner}/{MANIFEST}").type == pafs.FileType.NotFound:
        return {"files": []}
    with fs.open_input_stream(f"{inner}/{MANIFEST}") as f:
        return json.loads(f.read())


class MatrixWriter(Staged):
    def encode(self, fs: pafs.FileSystem, stem: str, iterator: Iterator[pa.RecordBatch], partition: int) -> Written:
        keys, rows = NpyFile(fs, f"{stem}.keys.npy", "<i8", False), NpyFile(fs, f"{stem}.npy", "<f4", True)
        for batch in iterator:
            if batch.num_rows:
                values = batch.column(1)
                width = np.diff(values.offsets.to_numpy())
                if values.null_count or (width != width[0]).any():
                    raise ValueError("a matrix needs arrays of one length and no nulls")
                rows.add(values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, int(width[0])))
                keys.add(batch.column(0).to_numpy(zero_copy_only=False))
        keys.close()
        rows.close()
        return Written({"keys.npy": keys.path, "npy": rows.path}, rows.rows, rows.width or 0, partition)


class RecordWriter(Staged):
    def encode(self, fs: pafs.FileSystem, stem: str, iterator: Iterator[pa.RecordBatch], partition: int) -> Written:
        n, path = 0, f"{stem}.jsonl"
        with fs.open_output_stream(path) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write((json.dumps(row, default=str, ensure_ascii=False) + "\n").encode())
                    n += 1
        return Written({"jsonl": path}, n, 0, partition)


@dataclass
class Rows(ds.InputPartition):
    files: dict
    start: int
    stop: int
    width: int
    first: int

    def __post_init__(self):
        super().__init__(self.first + self.start)


class MatrixReader(ds.DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Rows]:
        found = [Rows(f["files"], k, min(k + ROWS_PER_RANGE, f["rows"]), f["width"], f["first"])
                 for f in manifest(self.path)["files"] for k in range(0, f["rows"], ROWS_PER_RANGE)]
        return found or [Rows({}, 0, 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        p = partition
        fs, inner = file_system(self.path)

        def part(kind: str, dtype: str, width: int) -> np.ndarray:
            with fs.open_input_file(f"{inner}/{p.files[kind]}") as f:
                size = np.dtype(dtype).itemsize * width
                return np.frombuffer(f.read_at((p.stop - p.start) * size, HEADER + p.start * size), dtype)
        if p.stop > p.start:
            n = p.stop - p.start
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.width), pa.array(part("npy", "<f4", p.width)))
            yield pa.RecordBatch.from_arrays([pa.array(p.first + p.start + np.arange(n)), pa.array(part("keys.npy", "<i8", 1)), values],
                                             names=["position", "key", "features"])


class MatrixSource(ds.DataSource):
    """``format("matrix")``: a ``.npy`` of float32 rows and one of their keys per partition; reads back (position, key, features)."""
    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("position", T.LongType()), T.StructField("key", T.LongType()), T.StructField("features", T.ArrayType(T.FloatType()))])

    def reader(self, schema: T.StructType) -> MatrixReader:
        return MatrixReader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options["path"], overwrite, {k.lower(): v for k, v in self.options.items()})


class RecordSource(ds.DataSource):
    """``format("records")``, to write: JSON lines.  With the option ``trial`` a trial that is in the target is not added again."""
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("value", T.StringType())])

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], overwrite, {k.lower(): v for k, v in self.options.items()})


def write_matrix(df: DataFrame, path: str, key: str, features: str, order: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Rows in the order of ``order`` (the key if empty) over all files, one ``.npy`` per partition.

    ``key`` is a BIGINT; arrays are not null and of one length per file.  An
    empty table commits an empty target.
    """
    df.sparkSession.dataSource.register(MatrixSource)
    by = list(order) or [key]
    kept = [c for c in by if c != key]
    placed = df.select(df[key].cast("long").alias("key"), df[features].cast("array<float>").alias("features"), *[df[c].alias(f"_{c}") for c in kept])
    keys = ["key" if c == key else f"_{c}" for c in by]
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("key", "features")
    placed.write.format("matrix").mode(mode).option("path", path).save()


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(position, key, features) of a committed matrix; long files are read in ranges of rows."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("matrix").load(path)


def append_trial(df: DataFrame, path: str, trial: str) -> None:
    """Add the rows of a trial as JSON lines, once: a second call for the same trial changes nothing."""
    df.sparkSession.dataSource.register(RecordSource)
    df.write.format("records").mode("append").option("path", path).option("trial", trial).save()


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed JSON lines of all trials."""
    names = [f"{path}/{f['files']['jsonl']}" for f in manifest(path)["files"]]
    return spark.read.schema(schema).json(names) if names else spark.createDataFrame([], schema)
