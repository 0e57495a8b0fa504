"""Recorder files as a Spark data source: one long file is read by many tasks.

A file is planned as byte ranges without reading it.  A task finds the first
record border of its range by itself.  Offsets are tried all at once: from each
one a chain of records is followed, every one needing a known kind, a length
that fits and a credible time.  The true border always passes, so a single
survivor is the border.  If several pass (zero-filled payloads look like short
records) or the file ends too soon to tell, the task looks further back until
one offset is certain, at worst the header, and walks on from there.

A record belongs to the range it starts in.  Where a file is damaged the range
ends and later ranges go on; ``binary.blocks`` is the strict form that ends the
whole file there.
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

BLOCK_BYTES = 64 << 20
#: above so many ranges neighbours share a task, up to ``BLOCK_BYTES`` of a file
MOST_RANGES = 256
READ_BYTES = 8 << 20
ROWS_PER_BATCH = 2048

# fixed values: file layout, little-endian
SPECTRUM_MAGIC = b"SPECDATA"
SPECTRUM_HEADER = 20
SKIPPED_COUNT = 0xFFFF
AUX_MAGIC = b"AUXDATA"
AUX_HEADER = 16
TAG_ENVIRONMENT, TAG_PULSE, TAG_SKIN, TAG_MOTION = 0x10, 0x11, 0x12, 0x13
AUX_RECORDS = {
    TAG_ENVIRONMENT: "<dfff",
    TAG_PULSE: "<diihBB",
    TAG_SKIN: "<df",
    TAG_MOTION: "<dffffff",
}
SPECTRUM_SCHEMA = T.StructType([T.StructField("file_source", T.StringType()), T.StructField("ts", T.DoubleType()),
                                T.StructField("num_points", T.IntegerType()), T.StructField("power", T.ArrayType(T.IntegerType()))])
AUX_SCHEMA = T.StructType([T.StructField("file_source", T.StringType()), T.StructField("tag", T.IntegerType()),
                           T.StructField("ts", T.DoubleType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

#: times that a recorder may write; nought marks a skipped record
LEAST_TIME, MOST_TIME = 1e-6, 1e13
_AUX_LENGTHS = np.zeros(256, dtype=np.int64)
#: per tag the values behind the time: (type, offset in the record)
_AUX_FIELDS: dict[int, list[tuple[str, int]]] = {}
for _tag, _format in AUX_RECORDS.items():
    _AUX_LENGTHS[_tag] = 1 + struct.calcsize(_format)
    _AUX_FIELDS[_tag] = [(f"<{'i1' if c == 'b' else 'u1' if c == 'B' else {'i': 'i4', 'h': 'i2', 'f': 'f4', 'd': 'f8'}[c]}", 1 + struct.calcsize("<" + _format[1:k + 2]) - struct.calcsize("<" + c))
                         for k, c in enumerate(_format[1:]) if k]


def _at_every_byte(data: bytes, kind: str, offset: int, count: int) -> np.ndarray:
    if count <= 0:
        return np.empty(0, kind)
    return np.ndarray((count,), kind, data, offset, (1,))


def _credible(times: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        size = np.abs(times)
        return (size == 0) | (size >= LEAST_TIME) & (size <= MOST_TIME)


@dataclass(frozen=True)
class Layout:
    """Where a kind of file has its records: ``head`` bytes tell the length of one, none is longer than ``longest``."""
    kind: str
    magic: bytes
    header: int
    head: int
    longest: int
    chain: int

    def at_every_byte(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(may a record start here, its length) for every offset with a whole head."""
        count = max(0, len(data) - self.head + 1)
        if self.kind == "spectrum":
            n = _at_every_byte(data, "<u2", 8, count).astype(np.int64)
            return _credible(_at_every_byte(data, "<f8", 0, count)), 10 + 4 * np.where(n == SKIPPED_COUNT, 0, n)
        length = _AUX_LENGTHS[np.frombuffer(data, np.uint8)[:count]]
        return (length > 0) & _credible(_at_every_byte(data, "<f8", 1, count)), length

    def length(self, data: bytes, at: int) -> int:
        """Length of the record at an offset with a whole head; 0 for none."""
        if self.kind == "spectrum":
            n = data[at + 8] | data[at + 9] << 8
            return 10 if n == SKIPPED_COUNT else 10 + 4 * n
        return int(_AUX_LENGTHS[data[at]])


SPECTRUM = Layout("spectrum", SPECTRUM_MAGIC, SPECTRUM_HEADER, 10, 10 + 4 * (SKIPPED_COUNT - 1), 12)
AUX = Layout("aux", AUX_MAGIC, AUX_HEADER, 9, int(_AUX_LENGTHS.max()), 64)
LAYOUTS = {x.kind: x for x in (SPECTRUM, AUX)}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Any file system Arrow knows; Spark writes local paths with one slash."""
    if "://" not in path:
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def open_file(path: str):
    fs, inner = file_system(path)
    return fs.open_input_file(inner)


def listed_files(folder: str, pattern: str) -> list[tuple[str, int]]:
    """(path, length) of the files below a folder, or of one file; the glob ignores case, no content is read."""
    fs, inner = file_system(folder)
    info = fs.get_file_info(inner)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    lead = folder[:len(folder) - len(inner)] if folder.endswith(inner) else ""
    return sorted((lead + i.path, i.size) for i in found if i.is_file and fnmatch.fnmatchcase(i.base_name.lower(), pattern.lower()))


def run_blocks(length: int, block: int) -> int:
    """How many neighbouring ranges of ``block`` bytes a task takes when all files together have ``length`` bytes.

    One for up to ``MOST_RANGES`` ranges; beyond that tasks grow, not their number, until they have ``BLOCK_BYTES``.
    """
    return max(1, min(-(-length // (block * MOST_RANGES)), BLOCK_BYTES // block))


def has_header(f, layout: Layout) -> bool:
    f.seek(0)
    head = f.read(layout.header)
    return len(head) == layout.header and head.rstrip(b"\0").startswith(layout.magic)


class Walk:
    """Whole records that start in ``[start, stop)``, in pieces (bytes, offsets in them).

    Afterwards ``end`` is the offset behind the last one and ``whole`` tells
    that the walk went on to ``stop`` or to the end of the file, where a record
    may be cut short.
    """
    def __init__(self, f, size: int, layout: Layout, start: int, stop: int):
        self.f, self.size, self.layout, self.stop = f, size, layout, min(stop, size)
        self.end, self.whole = start, True

    def __iter__(self) -> Iterator[tuple[bytes, list[int]]]:
        while self.end < self.stop:
            base = self.end
            self.f.seek(base)
            data = self.f.read(min(self.size - base, max(READ_BYTES, self.layout.longest), self.stop - base + self.layout.longest))
            at, starts, limit, damaged = 0, [], min(len(data), self.stop - base), False
            while at < limit and at + self.layout.head <= len(data):
                length = self.layout.length(data, at)
                if not length:
                    damaged = True
                    break
                if at + length > len(data):
                    break
                starts.append(at)
                at += length
            self.end = base + at
            if starts:
                yield data, starts
            if damaged:
                self.whole = False
                return
            if not starts:  # what is left is shorter than a record
                return

    def to_end(self) -> Walk:
        for _ in self:
            pass
        return self


def certain_border(data: bytes, layout: Layout) -> int | None:
    """The only offset among the first ``longest`` from which a whole chain of records can be followed, if there is one."""
    may, length = layout.at_every_byte(data)
    if not len(may):
        return None
    starts = np.flatnonzero(may[:layout.longest])
    at = starts + length[starts]
    for _ in range(layout.chain - 1):
        if (at >= len(may)).any():
            return None
        going = may[at]
        starts, at = starts[going], at[going]
        at = at + length[at]
        if not len(starts):
            return None
    return int(starts[0]) if len(starts) == 1 else None


def meeting_border(data: bytes, layout: Layout) -> int | None:
    """An offset that every chain from the first ``longest`` offsets passes: one of them starts at a border, so it is a border, though not the first."""
    may, length = layout.at_every_byte(data)
    at = np.flatnonzero(may[:layout.longest])
    while len(at) > 1:
        behind = at < at[-1]
        at[behind] += length[at[behind]]
        if at.max() >= len(may):
            return None
        at = np.unique(at[may[at]])
    if not len(at):
        return None
    met = end = int(at[0])
    for _ in range(layout.chain):
        if end >= len(may) or not may[end]:
            return None
        end += int(length[end])
    return met


def first_border(f, size: int, layout: Layout, at: int) -> int | None:
    """The first record border at or after ``at``; None if the records end before."""
    span = layout.longest * (layout.chain + 1)
    probe, back = at, span
    while probe > layout.header:
        f.seek(probe)
        data = f.read(min(span, size - probe))
        found = certain_border(data, layout)
        if found is None and probe < at:
            met = meeting_border(data, layout)
            found = met if met is not None and probe + met <= at else None
        if found is not None:
            break
        probe, back = max(layout.header, at - back), 2 * back
    else:
        found = layout.header - probe
    end = Walk(f, size, layout, probe + found, at).to_end().end
    return end if end >= at else None


def spectrum_batch(path: str, data: bytes, starts: list[int], keep) -> pa.RecordBatch:
    at = np.array(starts, dtype=np.int64)
    t, n = _at_every_byte(data, "<f8", 0, len(data) - 7)[at], _at_every_byte(data, "<u2", 8, len(data) - 9)[at].astype(np.int64)
    chosen = (n != SKIPPED_COUNT) & keep(t)
    at, t, n = at[chosen], t[chosen], n[chosen]
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    # the place of every value: its record's first value and its own number
    where = np.repeat(at + 10, n) + 4 * (np.arange(offsets[-1]) - np.repeat(offsets[:-1], n))
    values = _at_every_byte(data, "<i4", 0, max(0, len(data) - 3))[where] if len(where) else np.empty(0, np.int32)
    power = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
    return pa.RecordBatch.from_pydict({"file_source": pa.array([path] * len(t), pa.string()), "ts": pa.array(t), "num_points": pa.array(n.astype(np.int32)), "power": power})


def aux_batch(path: str, data: bytes, starts: list[int], keep) -> pa.RecordBatch:
    at = np.array(starts, dtype=np.int64)
    tags = np.frombuffer(data, np.uint8)[at]
    t = _at_every_byte(data, "<f8", 1, len(data) - 8)[at]
    chosen = keep(t)
    at, tags, t = at[chosen], tags[chosen], t[chosen]
    width = np.zeros(256, dtype=np.int64)
    for tag, fields in _AUX_FIELDS.items():
        width[tag] = len(fields)
    offsets = np.concatenate([[0], np.cumsum(width[tags])])
    values = np.empty(offsets[-1])
    for tag, fields in _AUX_FIELDS.items():
        mine = np.flatnonzero(tags == tag)
        for k, (kind, offset) in enumerate(fields if len(mine) else ()):
            size = np.dtype(kind).itemsize
            values[offsets[mine] + k] = _at_every_byte(data, kind, offset, len(data) - offset - size + 1)[at[mine]]
    v = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
    return pa.RecordBatch.from_pydict({"file_source": pa.array([path] * len(t), pa.string()), "tag": pa.array(tags.astype(np.int32)), "ts": pa.array(t), "v": v})


@dataclass
class Range(ds.InputPartition):
    """Bytes [start, stop) of a file of ``size`` bytes."""
    path: str
    start: int
    stop: int
    size: int

    def __post_init__(self):
        super().__init__((self.path, self.start))


class RecorderReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.kind, self.columns = options["path"], options.get("kind", "spectrum"), schema.fieldNames()
        self.pattern, self.block = options.get("pattern", "*"), int(options.get("blockbytes", BLOCK_BYTES))
        self.low, self.high = (-np.inf, True), (np.inf, True)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Bounds on ``ts`` drop records before their values are decoded; all else is left to Spark."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("ts",) or not isinstance(value, float) or not np.isfinite(value):
                yield f
            elif isinstance(f, ds.GreaterThan | ds.GreaterThanOrEqual):
                self.low = max(self.low, (value, isinstance(f, ds.GreaterThanOrEqual)), key=lambda b: (b[0], not b[1]))
            elif isinstance(f, ds.LessThan | ds.LessThanOrEqual):
                self.high = min(self.high, (value, isinstance(f, ds.LessThanOrEqual)), key=lambda b: (b[0], b[1]))
            elif isinstance(f, ds.EqualTo):
                self.low = max(self.low, (value, True), key=lambda b: (b[0], not b[1]))
                self.high = min(self.high, (value, True), key=lambda b: (b[0], b[1]))
            else:
                yield f

    def keep(self, t: np.ndarray) -> np.ndarray:
        """Spark orders NaN above all numbers."""
        (low, with_low), (high, with_high) = self.low, self.high
        above = np.isnan(t) | (t >= low if with_low else t > low)
        return above & (np.isinf(high) | (t <= high if with_high else t < high))

    def partitions(self) -> list[Range]:
        layout, files = LAYOUTS[self.kind], listed_files(self.path, self.pattern)
        step = self.block * run_blocks(sum(size for _, size in files), self.block)
        out = [Range(path, start, min(start + step, size), size) for path, size in files for start in range(layout.header, size, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p, layout = partition, LAYOUTS[self.kind]
        if not p.size:
            return
        batch = spectrum_batch if self.kind == "spectrum" else aux_batch
        with open_file(p.path) as f:
            if not has_header(f, layout):
                return
            start = p.start if p.start == layout.header else first_border(f, p.size, layout, p.start)
            if start is None:
                return
            for data, starts in Walk(f, p.size, layout, start, p.stop):
                for k in range(0, len(starts), ROWS_PER_BATCH):
                    made = batch(p.path, data, starts[k:k + ROWS_PER_BATCH], self.keep)
                    if made.num_rows:
                        yield made.select(self.columns)


class RecorderSource(ds.DataSource):
    """``spark.read.format("recorder")``: options path, kind (spectrum or aux), pattern, blockBytes, columns (comma-separated; all if absent).

    A file with a wrong header gives no rows; ``binary.rejects`` names those.
    """
    @classmethod
    def name(cls) -> str:
        return "recorder"

    def schema(self) -> T.StructType:
        kind = self.options.get("kind", "spectrum")
        if kind not in LAYOUTS:
            raise ValueError(f"unknown kind of recorder file: {kind}")
        whole = SPECTRUM_SCHEMA if kind == "spectrum" else AUX_SCHEMA
        chosen = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else whole.fieldNames()
        return T.StructType([whole[c] for c in chosen])

    def reader(self, schema: T.StructType) -> RecorderReader:
        return RecorderReader({k.lower(): v for k, v in self.options.items()}, schema)


def read_recorder(spark: SparkSession, folder: str, kind: str = "spectrum", pattern: str = "*", block: int = BLOCK_BYTES,
                  columns: list[str] | None = None) -> DataFrame:
    """Records of all files below ``folder``; see ``RecorderSource``.  Filters on ``ts`` are pushed into the reading tasks."""
    spark.dataSource.register(RecorderSource)
    reader = spark.read.format("recorder").option("kind", kind).option("pattern", pattern).option("blockBytes", str(block))
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(folder)
