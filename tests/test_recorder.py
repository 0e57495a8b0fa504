"""Recorder files read from any byte on: borders against the serial walk, ranges against whole files, pushed filters, damage."""

from __future__ import annotations

import math
import random
import struct
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoband.plans import landing
from chronoband.sources import binary as B
from chronoband.sources import recorder as R
from tests.conftest import SMALL


def spectrum_bytes(rng, n, width=None, zeros=False):
    out, borders, rows = bytearray(struct.pack("<8s3I", b"SPECDATA", 1, 10, 64)), [], []
    for k in range(n):
        borders.append(len(out))
        if rng.random() < 0.2:
            out += struct.pack("<dH", 0.0, 0xFFFF)
            continue
        w = width or rng.randrange(0, 40)
        p = [0] * w if zeros else [rng.randrange(-5000, 5000) for _ in range(w)]
        out += struct.pack(f"<dH{w}i", 1.7e9 + k / 8, w, *p)
        rows.append((1.7e9 + k / 8, p))
    return bytes(out), borders, rows


def aux_bytes(rng, n, constant=False):
    out, borders = bytearray(struct.pack("<8sII", b"AUXDATA", 1, 0)), []
    for k in range(n):
        borders.append(len(out))
        t = 5.0 if constant else 100 + k / 8
        v = [float(0 if constant else rng.randrange(300)) for _ in range(6)]
        tag = 0x13 if constant else rng.choice([0x10, 0x11, 0x12, 0x13])
        body = {0x10: lambda: struct.pack("<dfff", t, *v[:3]), 0x11: lambda: struct.pack("<diihBB", t, int(v[0]), 0x13131313, -1, 7, 0x12),
                0x12: lambda: struct.pack("<df", t, v[0]), 0x13: lambda: struct.pack("<d6f", t, *v)}[tag]()
        out += bytes([tag]) + body
    return bytes(out), borders


def files(rng):
    yield "spectrum", *spectrum_bytes(rng, 400)[:2]
    yield "spectrum", *spectrum_bytes(rng, 150, 64)[:2]
    yield "spectrum", *spectrum_bytes(rng, 200, 12, zeros=True)[:2]
    yield "aux", *aux_bytes(rng, 900)
    yield "aux", *aux_bytes(rng, 300, constant=True)


def test_border_at_any_byte(tmp_path):
    """Every start agrees with the walk from the header; a small longest record lets chains end inside the files."""
    rng = random.Random(4)
    for longest in (R.SPECTRUM.longest, 270):
        for k, (kind, data, borders) in enumerate(files(rng)):
            layout = R.LAYOUTS[kind]
            if kind == "spectrum":
                layout = replace(layout, longest=longest)
            path = tmp_path / f"{longest}-{k}.bin"
            path.write_bytes(data)
            with R.open_file(str(path)) as f:
                for at in [*rng.sample(range(layout.header, len(data)), 60), *rng.sample(borders[1:], 10)]:
                    want = next((b for b in borders if b >= at), len(data))
                    assert R.first_border(f, len(data), layout, at) == want


def test_certain_border_is_used():
    """Away from the end of a file the chain alone decides; it is never wrong where it decides."""
    rng, decided = random.Random(8), 0
    data, borders = aux_bytes(rng, 2000)
    for at in rng.sample(range(R.AUX.header, len(data) - 4000), 300):
        found = R.certain_border(data[at:at + R.AUX.longest * (R.AUX.chain + 1)], R.AUX)
        if found is not None:
            decided += 1
            assert at + found == next(b for b in borders if b >= at)
    assert decided > 100  # the payloads hold tag bytes on purpose


def cells(df):
    return sorted((r.ts, tuple(r.power)) for r in df.collect())


@pytest.mark.parametrize("block", [64, 777, 1 << 20])
def test_ranges_and_blocks_give_all_records(spark, tmp_path, block):
    rng, want = random.Random(block), []
    for k in range(3):
        data, _, rows = spectrum_bytes(rng, 120)
        (tmp_path / f"S{k}.BIN").write_bytes(data[:-3] if k == 0 else data)  # the last record of one file may be cut short
        want += rows if k else [r for r in rows if r is not rows[-1]] if data[-3:] and not data.endswith(struct.pack("<dH", 0.0, 0xFFFF)) else rows
    (tmp_path / "S9.bin").write_bytes(b"something else altogether")
    (tmp_path / "other.txt").write_bytes(b"")
    by_range = R.read_recorder(spark, str(tmp_path), "spectrum", "s*.bin", block)
    by_block = B.read_spectrum(B.listed(spark, str(tmp_path), "s*.bin"), block)
    assert cells(by_range) == cells(by_block) == sorted((t, tuple(p)) for t, p in want)
    assert by_range.rdd.getNumPartitions() >= (30 if block < 1000 else 4)


def test_filters_and_columns(spark, tmp_path):
    data, _ = aux_bytes(random.Random(2), 500)
    (tmp_path / "a.bin").write_bytes(data)
    whole = R.read_recorder(spark, str(tmp_path), "aux", block=1000)
    rows = [(r.tag, r.ts, tuple(r.v)) for r in whole.collect()]
    cut = whole.where("ts > 110.0 AND ts <= 130.5 AND tag <> 18")
    assert sorted((r.tag, r.ts, tuple(r.v)) for r in cut.collect()) == sorted(r for r in rows if 110 < r[1] <= 130.5 and r[0] != 18)
    few = R.read_recorder(spark, str(tmp_path), "aux", columns=["ts"])
    assert few.columns == ["ts"] and few.where("ts = 120.0").count() == 1


def test_pushed_bounds():
    schema = R.SPECTRUM_SCHEMA
    reader = R.RecorderReader({"path": "x"}, schema)
    left = list(reader.pushFilters([R.ds.GreaterThan(("ts",), 1.0), R.ds.LessThanOrEqual(("ts",), 3.0), R.ds.EqualTo(("num_points",), 4),
                                    R.ds.GreaterThanOrEqual(("ts",), 1.0)]))
    assert [f.attribute for f in left] == [("num_points",)]
    assert reader.keep(R.np.array([1.0, 1.5, 3.0, 3.1, math.nan])).tolist() == [False, True, True, False, False]
    free = R.RecorderReader({"path": "x"}, schema)
    assert free.keep(R.np.array([-1.0, math.nan, math.inf])).all()


def test_damage(spark, tmp_path):
    """The strict form ends a file at the damage, wherever the ranges are cut; the data source goes on behind it."""
    data, borders = aux_bytes(random.Random(3), 2000)
    harmed = bytearray(data)
    harmed[borders[150]] = 0x77
    (tmp_path / "a.bin").write_bytes(bytes(harmed))
    for block in (100, 3000, 1 << 20):
        assert B.read_aux(B.listed(spark, str(tmp_path), "*.bin"), block).count() == 150
    assert 150 < R.read_recorder(spark, str(tmp_path), "aux", block=3000).count() < 2000


def test_empty_folder_and_wrong_kind(spark, tmp_path):
    assert R.read_recorder(spark, str(tmp_path), "spectrum").count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        R.read_recorder(spark, str(tmp_path), "other").count()


def test_one_long_file_is_many_tasks(spark, tmp_path):
    rng = random.Random(7)
    data, _, rows = spectrum_bytes(rng, 3000, 256)
    (tmp_path / "long.bin").write_bytes(data)
    x = R.read_recorder(spark, str(tmp_path), block=len(data) // 40)
    per = x.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per) >= 40 and sum(r["count"] for r in per) == len(rows)


def test_many_ranges_share_tasks(spark, tmp_path):
    """Beyond a number of ranges tasks grow and a border is found close by, not from the header on."""
    rng = np.random.default_rng(6)
    rows = [(float(i + 1), rng.integers(700, 1300, 64)) for i in range(9000)]
    body = b"".join(struct.pack("<dH64i", t, 64, *p) + struct.pack("<dH", 0.0, R.SKIPPED_COUNT) for t, p in rows)
    (tmp_path / "s0.bin").write_bytes(struct.pack("<8s3I", b"SPECDATA", 1, 10, 64) + body)
    (tmp_path / "s1.bin").write_bytes(struct.pack("<8s3I", b"SPECDATA", 1, 10, 64) + body)
    x = R.read_recorder(spark, str(tmp_path), "spectrum", block=4096)
    assert 4 <= x.rdd.getNumPartitions() <= R.MOST_RANGES + 2       # 1200 ranges
    want = sorted((t, tuple(p.tolist())) for t, p in rows for _ in range(2))
    assert cells(x) == want and cells(B.read_spectrum(B.listed(spark, str(tmp_path)), block=4096)) == want
    at, size = R.SPECTRUM_HEADER + len(body) // 2, R.SPECTRUM_HEADER + len(body)
    window = body[at - R.SPECTRUM_HEADER:][:R.SPECTRUM.longest * (R.SPECTRUM.chain + 1)]
    assert R.certain_border(window, R.SPECTRUM) is None             # many short records: many chains are true
    met = R.meeting_border(body[:1 << 21], R.SPECTRUM)
    assert met is not None and met % 276 in (0, 266)
    with R.open_file(str(tmp_path / "s0.bin")) as f:
        found = R.first_border(f, size, R.SPECTRUM, at)
    assert found >= at and (found - R.SPECTRUM_HEADER) % 276 in (0, 266) and found - at < 276


def with_a_lost_file(monkeypatch):
    """The queries' own files, and one that is gone when it is read."""
    listed = B.listed

    def also(spark, *args):
        return listed(spark, *args).unionByName(spark.createDataFrame([("file:/no/such/folder/a.bin", 5000)], "path string, length bigint"))
    monkeypatch.setattr(B, "listed", also)


def test_a_lost_file_ends_the_pulse_table(spark, monkeypatch):
    assert landing.demultiplexed(spark, SMALL).count() > 0
    with_a_lost_file(monkeypatch)
    with pytest.raises(Exception, match="No such file"):
        landing.demultiplexed(spark, SMALL).count()


def test_a_lost_file_ends_the_scan_in_blocks(spark, monkeypatch):
    with_a_lost_file(monkeypatch)
    with pytest.raises(Exception, match="No such file"):
        landing.spectrum_blocks(spark, SMALL).count()


@pytest.mark.parametrize("block", [700, 1 << 20])
def test_a_file_cut_short_after_listing_ends_the_read(spark, tmp_path, block):
    data, borders = aux_bytes(random.Random(12), 400)
    path = tmp_path / "a.bin"
    path.write_bytes(data)
    files = B.listed(spark, str(tmp_path), "*.bin").collect()
    path.write_bytes(data[:borders[250]])
    files = spark.createDataFrame(files, "path string, length bigint")
    with pytest.raises(Exception, match="when it was listed"):
        B.read_aux(files, block).count()
    assert [(r.path, r.error) for r in B.rejects(files, "aux").collect()] == [(f"file:{path}", "unreadable: OSError")]
    assert B.read_aux(B.listed(spark, str(tmp_path), "*.bin"), block).count() == 250


def test_records_lost_between_the_passes_end_the_read(tmp_path):
    data, borders = aux_bytes(random.Random(13), 60)
    (tmp_path / "a.bin").write_bytes(data[:borders[40]])
    block = pa.RecordBatch.from_pylist([{"path": str(tmp_path / "a.bin"), "start": borders[0], "stop": borders[50], "error": None}])
    with pytest.raises(OSError, match="has changed"):
        list(B._decode("aux")([block]))
