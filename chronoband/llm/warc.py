"""Web archive files and a two-level capture index over them.

Writing: captures are ordered by their reversed-host key (``com,example)/path``)
and each task writes its range as one archive of gzip members, one per record.
A payload that occurs again is written once, as the response of the smallest
page id; the others are revisits that name it.

Index: a task that has written an archive also writes the index lines of its
range, already sorted, in gzip blocks of ``BLOCK_LINES`` lines, and returns one
directory row per block (first key, place).  The directory is sparse: to find a
URL, binary-search it for the blocks that can hold the key, read those blocks by
range, binary-search their lines and read the records by range.

Every file gets a name no other attempt uses; the directory, which names the
files that count, is checkpointed, so a task that is run again leaves at most a
file nobody reads.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoband.llm.common import materialise, scratch_path

BLOCK_LINES, STEP = 512, 64
SMALLEST_SHARED = 100
BROADCAST_DIGESTS = 100_000
LEVEL = 6
#: fixed values of the WARC format
VERSION, CRLF = b"WARC/1.1", b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
URN = "urn:page:"

DIRECTORY = "first_key string, last_key string, archive string, index_file string, start bigint, size bigint, lines int"
RECORD = ("page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, "
          "payload binary")


def reversed_host_key(url: str | None) -> str:
    """``http://www.a.example.com:80/b?c`` as ``com,example,a)/b?c``; what has no host sorts by its own text; null is empty."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url or ""
    if not host:
        return (url or "").strip()
    host = host.removeprefix("www.")
    odd = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + odd + ")" + (parts.path or "/") + query


@F.pandas_udf(T.StringType())
def _key(url: pd.Series) -> pd.Series:
    return url.map(reversed_host_key)


def _header(fields: list[tuple[str, str]]) -> bytes:
    clean = [(n, re.sub(r"[\r\n]+", " ", v)) for n, v in fields]
    return CRLF.join([VERSION, *(f"{n}: {v}".encode() for n, v in clean)]) + CRLF * 2


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    revisit = refers_to is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"),
              ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("X-Payload-Length", str(len(payload)))]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    body = b"" if revisit else payload
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    return gzip.compress(_header(fields) + body + CRLF * 2, LEVEL, mtime=0)


def parse(member: bytes) -> dict:
    """Fields of ``RECORD`` from one gzip member; the payload's digest and length are taken from it where it has one."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(CRLF * 2)
    version, *lines = head.split(CRLF)
    if version != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.decode().split(": ", 1) if b": " in line else (line.decode().rstrip(":"), "") for line in lines)

    def page(name: str) -> int | None:
        digits = fields.get(name, "").removeprefix(f"<{URN}").removesuffix(">")
        return int(digits) if digits else None
    body = rest[:int(fields["Content-Length"])]
    revisit = fields["WARC-Type"] == "revisit"
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
    if not revisit:
        found = hashlib.sha256(body).hexdigest()
        if (found, len(body)) != (digest, size):
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
            "refers_to": page("WARC-Refers-To"), "payload_digest": digest, "payload_bytes": size, "payload": None if revisit else body}


def _writer(folder: str, block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder)
        stem = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        archive = index = None
        lines: list[tuple[str, str]] = []
        blocks: list[tuple] = []
        at = placed = 0

        def close_block() -> None:
            nonlocal lines, placed
            data = gzip.compress("\n".join(line for _, line in lines).encode(), LEVEL, mtime=0)
            index.write(data)
            blocks.append((lines[0][0], lines[-1][0], f"{stem}.warc.gz", f"{stem}.idx.gz", placed, len(data), len(lines)))
            placed += len(data)
            lines = []

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                few = batch.slice(lo, 64)
                for key, page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in few.columns), strict=True):
                    if archive is None:
                        system.create_dir(root, recursive=True)
                        archive = system.open_output_stream(f"{root}/{stem}.warc.gz", compression=None)
                        index = system.open_output_stream(f"{root}/{stem}.idx.gz", compression=None)
                    member = record(page_id, url, html.encode(), digest, refers)
                    archive.write(member)
                    lines.append((key, json.dumps([key, at, len(member)], ensure_ascii=False)))
                    at += len(member)
                    if len(lines) == block_lines:
                        close_block()
        if archive is not None:
            if lines:
                close_block()
            archive.close()
            index.close()
        names = [x.split()[0] for x in DIRECTORY.split(", ")]
        kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.int32()]
        columns = list(zip(*blocks, strict=True)) if blocks else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)
    return run


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None,
                   smallest: int = SMALLEST_SHARED, block_lines: int = BLOCK_LINES) -> tuple[DataFrame, str]:
    """Write archives and index; give the directory (a row per index block, see ``DIRECTORY``) and the folder.

    Null html is an empty payload, null url an empty one.  Of equal payloads of
    at least ``smallest`` bytes the one with the smallest page id is the
    response; rows that repeat that id are responses too, and so is a row
    without an id.  An empty table writes no file.  The folder grows with the
    data and is the caller's to remove.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(_key(F.col(url)).alias("key"), F.col(key).cast("bigint").alias("page_id"),
                        F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), body.alias("html"),
                        F.sha2(body, 256).alias("digest"))
    # counted from a scan of its own: only digests that occur again go on; where they are few the html is not shuffled for them
    again = materialise(pages.where(F.octet_length(body) >= smallest).groupBy(F.sha2(body, 256).alias("again"))
             .agg(F.min(F.col(key).cast("bigint")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    again = F.broadcast(again) if again.count() <= BROADCAST_DIGESTS else again
    rows = rows.join(again, F.col("digest") == F.col("again"), "left")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    rows = rows.select("key", "page_id", "url", "html", "digest", refers.alias("refers_to"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    return materialise(ordered.mapInArrow(_writer(folder, block_lines), DIRECTORY)), folder


def _fetch(folder: str):
    """Records of index blocks; where a column names wanted keys only theirs, found by binary search."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)
        for batch in batches:
            for block in batch.to_pylist():
                with system.open_input_file(f"{root}/{block['index_file']}") as index:
                    index.seek(block["start"])
                    lines = [json.loads(x) for x in gzip.decompress(index.read(block["size"])).decode().split("\n")]
                if "wanted" in block:
                    keys, found = [x[0] for x in lines], []
                    for wanted in block["wanted"]:
                        found += lines[bisect.bisect_left(keys, wanted):bisect.bisect_right(keys, wanted)]
                    lines = found
                rows, held = [], 0
                with system.open_input_file(f"{root}/{block['archive']}") as archive:
                    for _, at, size in lines:
                        archive.seek(at)
                        rows.append(parse(archive.read(size)))
                        held += rows[-1]["payload_bytes"]
                        if held > 1 << 22:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)
    return run


def read_archives(directory: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives, by way of the index (see ``RECORD``); a revisit has no payload."""
    return directory.mapInArrow(_fetch(folder), RECORD)


def lookup(directory: DataFrame, folder: str, urls: DataFrame, url: str = "url") -> DataFrame:
    """Every record captured under any of ``urls``: directory, then blocks, then records by range.

    Every ``STEP``-th first key of the directory makes a short list; a binary
    search in it brings keys and blocks together by an ordinary join, each block
    is handed the keys between its first and last one, searches its lines for
    them and reads those records alone.  Null and unknown URLs find nothing.
    """
    wanted = urls.where(F.col(url).isNotNull()).select(_key(F.col(url)).alias("wanted")).distinct()
    numbered = directory.withColumn("row", F.row_number().over(Window.orderBy("first_key", "archive", "start")))
    steps = sorted({r.first_key for r in numbered.where(f"row % {STEP} = 1").select("first_key").collect()})

    @F.pandas_udf("int")
    def step(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect.bisect_right(steps, k)).astype("int32")
    spread = directory.withColumn("step", F.explode(F.sequence(step("first_key"), step("last_key"))))
    met = spread.join(wanted.withColumn("step", step("wanted")), "step")
    met = met.where(F.col("wanted").between(F.col("first_key"), F.col("last_key")))
    blocks = met.groupBy(*directory.columns).agg(F.array_sort(F.collect_set("wanted")).alias("wanted"))
    return blocks.mapInArrow(_fetch(folder), RECORD)
