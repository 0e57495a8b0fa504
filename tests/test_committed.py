"""Sinks under failing, repeated and empty tasks."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoband.sources import committed as C


def frame(spark, n, parts=5):
    return spark.range(n).repartition(parts).select(F.col("id").alias("k"), F.array(F.col("id") * 1.5, F.col("id") - 7.0).alias("f"), F.lit("x").alias("key_"))


def files(path):
    return sorted(os.listdir(path))


def test_matrix_round_trip(spark, tmp_path):
    path = str(tmp_path / "m")
    C.write_matrix(frame(spark, 1000), path, "k", "f")
    listed = C.manifest(path)["files"]
    assert sum(f["rows"] for f in listed) == 1000 and [f["width"] for f in listed] == [2] * len(listed)
    loaded = [np.load(f"{path}/{f['files']['npy']}", mmap_mode="r") for f in listed]
    assert np.array_equal(np.concatenate(loaded), np.stack([np.arange(1000) * 1.5, np.arange(1000) - 7.0], 1).astype("f4"))
    assert np.array_equal(np.concatenate([np.load(f"{path}/{f['files']['keys.npy']}") for f in listed]), np.arange(1000))
    back = [tuple(r) for r in C.read_matrix(spark, path).orderBy("position").collect()]
    assert back == [(i, i, [i * 1.5, i - 7.0]) for i in range(1000)]
    assert len(files(path)) == 2 * len(listed) + 1  # nothing of the job is left but its files and the manifest


def test_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "m")
    C.write_matrix(frame(spark, 30), path, "k", "f", mode="append")
    C.write_matrix(frame(spark, 20), path, "k", "f", mode="append")
    assert [r.key for r in C.read_matrix(spark, path).orderBy("position").collect()] == [*range(30), *range(20)]
    C.write_matrix(frame(spark, 10), path, "k", "f")
    assert [r.key for r in C.read_matrix(spark, path).orderBy("position").collect()] == [*range(10)]
    assert len(files(path)) == 2 * len(C.manifest(path)["files"]) + 1
    C.write_matrix(frame(spark, 0), path, "k", "f")
    assert C.read_matrix(spark, path).count() == 0 and files(path) == [C.MANIFEST]


def test_order_by_other_columns(spark, tmp_path):
    path = str(tmp_path / "m")
    x = frame(spark, 100).withColumn("u", F.col("k") % 3)
    C.write_matrix(x, path, "k", "f", ["u", "k"])
    assert [r.key for r in C.read_matrix(spark, path).orderBy("position").collect()] == sorted(range(100), key=lambda k: (k % 3, k))


def test_refused_rows_leave_the_target(spark, tmp_path):
    path = str(tmp_path / "m")
    C.write_matrix(frame(spark, 12), path, "k", "f")
    before = files(path)
    broken = frame(spark, 40).withColumn("f", F.when(F.col("k") == 33, F.array(F.lit(1.0))).otherwise(F.col("f")))
    with pytest.raises(Exception, match="one length"):
        C.write_matrix(broken, path, "k", "f")
    assert files(path) == before and C.read_matrix(spark, path).count() == 12


class Failing(C.MatrixWriter):
    """The first attempt of every second partition writes its files and then fails."""
    def encode(self, fs, stem, iterator, partition):
        done = super().encode(fs, stem, iterator, partition)
        mark = f"{self.options['marks']}/{partition}"
        if partition % 2 and not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("executor lost")
        return done


def attempts(writer, parts):
    """What Spark does with a writer, by hand: a failed attempt is run again, a slow one twice, the messages of one of each are committed."""
    import pyarrow as pa
    messages = []
    for k in range(parts):
        batch = pa.RecordBatch.from_pydict({"key": pa.array([10 * k, 10 * k + 1]), "features": pa.array([[1.0, k], [2.0, k]], pa.list_(pa.float32()))})
        fs, _, folder = writer.staging()
        fs.create_dir(folder)
        for attempt in range(3):
            try:
                messages.append(writer.encode(fs, f"{folder}/{k:05d}-{attempt}", iter([batch]), k))
                break
            except OSError:
                continue
        writer.encode(fs, f"{folder}/{k:05d}-twin", iter([batch]), k)
    return messages


def test_repeated_attempts(spark, tmp_path):
    path, marks = str(tmp_path / "m"), tmp_path / "marks"
    marks.mkdir()
    writer = Failing(path, True, {"marks": str(marks)})
    writer.commit(attempts(writer, 6))
    assert len(files(marks)) == 3
    assert [r.key for r in C.read_matrix(spark, path).orderBy("position").collect()] == [10 * k + j for k in range(6) for j in (0, 1)]
    assert len(files(path)) == 13
    other = Failing(path, False, {"marks": str(marks)})
    other.abort(attempts(other, 2))
    assert len(files(path)) == 13


def test_trials(spark, tmp_path):
    path, schema = str(tmp_path / "r"), "k long, s string"
    rows = spark.createDataFrame([(1, "ä\n"), (2, None)], schema)
    assert C.read_records(spark, path, schema).count() == 0
    for trial in ("a", "b", "a"):
        C.append_trial(rows, path, trial)
    assert sorted((tuple(r) for r in C.read_records(spark, path, schema).collect()), key=str) == sorted([(1, "ä\n"), (2, None)] * 2, key=str)
    lines = [json.loads(x) for f in C.manifest(path)["files"] for x in open(f"{path}/{f['files']['jsonl']}")]
    assert len(lines) == 4


def test_header_is_numpys(tmp_path):
    for rows, width in ((0, None), (3, 2), (10**15, 10**9)):
        head = C.npy_header("<f4", rows, width)
        assert len(head) == C.HEADER
        (tmp_path / "x").write_bytes(head)
        with open(tmp_path / "x", "rb") as f:
            assert np.lib.format.read_magic(f) == (1, 0)
            assert np.lib.format.read_array_header_1_0(f)[0] == ((rows,) if width is None else (rows, width))
