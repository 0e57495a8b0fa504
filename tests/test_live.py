"""Live operators over several triggers."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chronoband.streaming import live

BASE = datetime(2026, 1, 1)


def write(spark, folder, name, rows):
    data = [(BASE + timedelta(seconds=s), u, i, float(v)) for s, u, i, v in rows]
    spark.createDataFrame(data, "ts timestamp, u int, id int, v double").coalesce(1).write.parquet(f"{folder}/{name}")


def in_order(spark, folder, batches):
    """A stream with one trigger per batch, in the order of the list."""
    import os
    import time
    for k, rows in enumerate(batches):
        write(spark, folder, f"b{k:03d}", rows)
        for f in os.listdir(f"{folder}/b{k:03d}"):
            os.utime(f"{folder}/b{k:03d}/{f}", (time.time() - 1000 + k, time.time() - 1000 + k))
    schema = spark.read.parquet(f"{folder}/*").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def smoothed(rows, alpha, key):
    out, s = {}, None
    for _, u, i, v in sorted(r for r in rows if r[1] == key):
        s = v if s is None else alpha * v + (1 - alpha) * s
        out[i] = s
    return out


def test_ema_over_triggers_with_late_rows(spark, tmp_path):
    """Rows out of order across triggers give the batch result as long as they are within the bound; later ones are dropped."""
    rng = random.Random(3)
    rows = [(float(k), k % 3, k, rng.uniform(-5, 5)) for k in range(120)]
    batches = [[] for _ in range(6)]
    for r in rows:
        batches[min(5, int(r[0] // 20) + rng.choice([0, 0, 1]))].append(r)  # up to 20 s + a trigger late
    batches.append([(300.0, 9, 500, 1.0)])                                   # moves the watermark past all rows
    batches.append([(5.0, 1, 501, 100.0), (301.0, 9, 502, 1.0)])             # one row far too late
    out = live.drain(live.live_ema(in_order(spark, str(tmp_path / "in"), batches), "u", "ts", "id", "v", 0.5, "60 seconds"), "ema")
    got = {r["id"]: r["ema"] for r in out.collect()}
    want = {i: s for key in range(3) for i, s in smoothed(rows, 0.5, key).items()}
    assert sorted(got) == sorted(want)
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_ema_equals_the_batch_form(spark, tmp_path):
    from chronoband.operators.recurrence import ema
    rng = random.Random(4)
    rows = [(rng.uniform(0, 50), k % 4, k, rng.uniform(0, 9)) for k in range(200)]
    rng.shuffle(rows)
    batches = [sorted(rows, key=lambda r: r[0] + rng.uniform(0, 15))[k::1] for k in (0,)]
    stream = [batches[0][k:k + 40] for k in range(0, 200, 40)] + [[(900.0, 77, 900, 0.0)], [(901.0, 77, 901, 0.0)]]
    got = {r["id"]: r["ema"] for r in live.drain(live.live_ema(in_order(spark, str(tmp_path / "in"), stream), "u", "ts", "id", "v", 0.3, "100 seconds"), "ema").collect()}
    frame = spark.createDataFrame([(float(s), u, i, float(v)) for s, u, i, v in rows], "ts double, u int, id int, v double")
    want = {r["id"]: r["ema"] for r in ema(frame, ["u"], ["ts", "id"], "v", 0.3).collect()}
    assert sorted(got) == sorted(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_silent_keys_are_forgotten(spark, tmp_path):
    batches = [[(0.0, 1, 1, 10.0), (1.0, 2, 2, 10.0)], [(40.0, 2, 3, 20.0)], [(100.0, 3, 4, 1.0)], [(101.0, 3, 5, 1.0)], [(120.0, 1, 6, 50.0), (120.0, 2, 7, 50.0)],
               [(200.0, 3, 8, 1.0)], [(201.0, 3, 9, 1.0)]]
    out = live.drain(live.live_ema(in_order(spark, str(tmp_path / "in"), batches), "u", "ts", "id", "v", 0.5, "5 seconds", "60 seconds"), "ema")
    got = {r["id"]: r["ema"] for r in out.collect()}
    assert got[1] == 10 and got[3] == 15
    assert got[6] == 50      # key 1 was silent for more than a minute and starts anew
    assert got[7] == 32.5    # key 2 was not


def test_windows_close_by_watermark(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, "a", [(0, 1, 1, 1), (0.5, 1, 2, 3), (30, 1, 3, 9)])
    s = live.event_stream(spark, f"{folder}/a", "*.parquet")
    out = live.drain(live.windowed_features(s, ["u"], "ts", "v", "1 second", "5 seconds"), "win")
    rows = out.select("n", "mean", F.round("std", 6)).collect()
    assert [tuple(r) for r in rows] == [(2, 2.0, 1.414214)]          # the last second is still open
