"""Live forms of the per-second, sliding, smoothing and session operators.

Each takes a streaming (or static) DataFrame with a TIMESTAMP column and keeps
bounded state: windows close by watermark, sessions by gap, smoothing holds one
value per series and the rows the watermark has not passed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from chronoband.session import scratch_path

#: rows handed to a list state at once
STATE_ROWS = 1024


def event_stream(spark: SparkSession, folder: str, glob: str, ts: str = "ts", files_per_batch: int = 64) -> DataFrame:
    """Parquet files as they arrive; NTZ time becomes a zoned timestamp (watermarks need one)."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return s.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_features(df: DataFrame, keys: Sequence[str], ts: str, value: str, size: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(*keys, F.window(ts, size)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def sliding_features(df: DataFrame, keys: Sequence[str], ts: str, value: str, size: str, slide: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(*keys, F.window(ts, size, slide)).agg(
        F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))


class OrderedEma(StatefulProcessor):
    """Smoothing in event time: rows wait in a list state until the watermark has passed them, then are folded in order.

    A timer stands at the earliest waiting row.  With nothing waiting it stands
    ``forget_ms`` behind the last row, and its expiry clears the key.
    """
    def __init__(self, alpha: float, forget_ms: int, out: T.StructType):
        self.alpha, self.forget_ms, self.id_type, self.row = alpha, forget_ms, out[1].dataType, Row(*out.fieldNames())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = T.StructType([T.StructField("us", T.LongType()), T.StructField("id", self.id_type), T.StructField("x", T.DoubleType())])
        self.waiting = handle.getListState("waiting", row)
        self.held = handle.getValueState("held", T.StructType([T.StructField("s", T.DoubleType()), T.StructField("us", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last = self.held.get()[1] if self.held.exists() else None
        few, first = [], None
        for r in rows:
            if r.us is not None and (last is None or r.us >= last):  # what came before the folded rows is too late
                few.append((r.us, r.id, r.x))
                first = r.us if first is None else min(first, r.us)
                if len(few) == STATE_ROWS:
                    self.waiting.appendList(few)
                    few = []
        if few:
            self.waiting.appendList(few)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = [], []
        for us, id, x in self.waiting.get():
            (ready if us < until else later).append((us, id, x))
        held = self.held.get() if self.held.exists() else None
        s, last = (held[0], held[1]) if held else (None, None)
        if not ready and not later:
            if last is not None and last // 1000 + self.forget_ms <= timerValues.getCurrentWatermarkInMs():
                self.waiting.clear()
                self.held.clear()
            return
        for us, id, x in sorted(ready, key=lambda r: r[:2]):
            s, last = x if s is None else self.alpha * x + (1 - self.alpha) * s, us
            yield self.row(*key, id, s)
        if ready:
            self.held.update((s, last))
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        self.handle.registerTimer(min(r[0] for r in later) // 1000 + 1 if later else last // 1000 + self.forget_ms)


def live_ema(df: DataFrame, key: str, ts: str, id: str, value: str, alpha: float, late: str = "1 hour", forget: str = "30 days") -> DataFrame:
    """Causal exponential average in event time: key, id, ema.

    A row comes out once the watermark (``late`` behind the newest row) has
    passed it, in the order of (time, id): rows that arrive late within that
    bound give what the batch form gives.  Later ones and rows without a time
    are dropped.  The state of a key is one value and its waiting rows; a key
    silent for ``forget`` of event time is forgotten and starts anew.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    forget_ms = int(pd.Timedelta(forget).total_seconds() * 1000)
    out = T.StructType([df.schema[key], df.schema[id], T.StructField("ema", T.DoubleType())])
    rows = df.withWatermark(ts, late).select(F.col(key).alias("k"), F.col(ts).alias("ts"), F.col(id).alias("id"), F.col(value).cast("double").alias("x"),
                                             F.unix_micros(ts).alias("us"))
    return rows.groupBy("k").transformWithState(OrderedEma(alpha, forget_ms, out), out, "Append", "EventTime")


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what has arrived, write it to the shared folder, read it back."""
    spark = df.sparkSession
    target, ckpt = scratch_path(spark, name), scratch_path(spark, name + "-state")
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", target)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(target)
