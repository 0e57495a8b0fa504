"""Causal windows over rows that are arrays: all bins of a spectrum at once.

Rows stream through a task in the order of their series.  The last rows of a
series stay in a buffer as a matrix, so a window is a few matrix operations on
buffer and batch, whatever the number of bins; nothing is exploded and nothing
is grouped back.  A large series is cut into chunks of rows; a chunk borrows
the rows its first windows reach back to, as ``ordered.framed`` does.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoband.operators.ordered import attach, indexed
from chronoband.session import rows_per_chunk

#: cells of a median's windows laid out at once
CELLS = 4_000_000


class Rows:
    """A series as it streams by: ``feed`` gets its next rows (rows x bins) and gives theirs smoothed.

    ``reach`` is how many rows back a result may depend on.
    """
    reach = 0

    def start(self, place: int, size: int) -> None:
        """A new series of ``size`` rows, seen from row ``place`` (from 0) on."""
        self.place, self.size, self.held = place, size, None

    def feed(self, x: np.ndarray) -> np.ndarray:
        both = x if self.held is None else np.concatenate([self.held, x])
        out = self.smoothed(both, len(both) - len(x))
        self.held = both[max(0, len(both) - self.reach):].copy()
        self.place += len(x)
        return out

    def smoothed(self, both: np.ndarray, back: int) -> np.ndarray:
        """Results of ``both[back:]``; the rows before them are what they may look back to."""
        raise NotImplementedError

    def weighted(self, both: np.ndarray, back: int, weights: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of weights[k] times the row k before, sum of the weights that met a row)."""
        n = len(both) - back
        total, met = np.zeros((n, both.shape[1])), np.zeros(n)
        for k, w in enumerate(weights):
            skip = max(0, k - back)
            if skip < n:
                total[skip:] += w * both[back - k + skip:back - k + n]
                met[skip:] += w
        return total, met


class Mean(Rows):
    def __init__(self, width: int = 5):
        self.weights, self.reach = [1.0] * width, width - 1

    def smoothed(self, both: np.ndarray, back: int) -> np.ndarray:
        total, met = self.weighted(both, back, self.weights)
        return total / met[:, None]


class Gaussian(Mean):
    def __init__(self, sigma: float = 2.0):
        reach = int(4 * sigma) if sigma > 0 else 1
        if reach < 1:
            raise ValueError("sigma too small for a causal window")
        self.weights = [math.exp(-0.5 * (k / sigma) ** 2) if sigma > 0 else 1.0 for k in range(reach)]
        self.reach = reach - 1


class Median(Rows):
    def __init__(self, width: int = 5):
        self.width, self.reach = width, width - 1

    def smoothed(self, both: np.ndarray, back: int) -> np.ndarray:
        out = np.empty((len(both) - back, both.shape[1]))
        full = max(back, self.width - 1)
        for i in range(back, min(full, len(both))):
            out[i - back] = np.median(both[:i + 1], axis=0)
        step = max(1, CELLS // max(1, self.width * both.shape[1]))
        for i in range(full, len(both), step):
            part = both[i - self.width + 1:min(i + step, len(both))]
            out[i - back:i - back + step] = np.median(np.lib.stride_tricks.sliding_window_view(part, self.width, axis=0), axis=-1)
        return out


class Savgol(Rows):
    """Short starts use the mean of what is there, short series stay."""
    def __init__(self, width: int = 11, poly: int = 3):
        from chronoband.operators.smooth import causal_savgol_weights
        self.width, self.least = (poly + 2 if width <= poly else width), poly + 2
        self.reach = self.width - 1
        self.newest_first = {n: causal_savgol_weights(n, poly)[::-1] for n in range(self.least, self.width + 1)}

    def smoothed(self, both: np.ndarray, back: int) -> np.ndarray:
        if self.size < self.least:
            return both[back:]
        out = self.weighted(both, back, self.newest_first[self.width])[0]
        for i in range(back, min(len(both), back + max(0, self.width - 1 - self.place))):
            rows = self.place + i - back + 1
            if rows < self.least:
                out[i - back] = both[:i + 1].mean(axis=0)
            else:
                g = self.newest_first[rows]
                if i + 1 >= len(g):  # else a lent row, whose result is not used
                    out[i - back] = g @ both[i - len(g) + 1:i + 1][::-1]
        return out


class Exponential(Rows):
    """The buffer is the last value; a chunk borrows rows until the value it starts from has no weight left."""
    def __init__(self, alpha: float = 0.3):
        if not 0 < alpha <= 1:
            raise ValueError("alpha must be in (0, 1]")
        self.alpha, self.reach = alpha, math.ceil(40 / -math.log1p(-alpha)) if alpha < 1 else 0

    def feed(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        for i, row in enumerate(x):
            self.held = row if self.held is None else self.alpha * row + (1 - self.alpha) * self.held
            out[i] = self.held
        return out


METHODS: Mapping[str, Callable[..., Rows]] = {"moving_average": Mean, "ema": Exponential, "gaussian": Gaussian, "savgol": Savgol, "median": Median}


def _pass(make: Callable[[], Rows], keys: int, power: int):
    """Rows sorted by their series: the series' columns first, then ``_own``, ``_place``, ``_size``; only own rows come out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = make(), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.schema.names
            x = batch.column(power).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            marks = list(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True)) if keys else [()] * n
            place, size = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("_place", "_size"))
            out, at = np.empty_like(x), 0
            while at < n:
                until = at + 1
                while until < n and marks[until] == marks[at]:
                    until += 1
                if marks[at] != now:
                    now = marks[at]
                    rows.start(int(place[at]), int(size[at]))
                out[at:until] = rows.feed(x[at:until])
                at = until
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(out.ravel()))
            batch = batch.set_column(power, names[power], values)
            yield batch.filter(batch.column(names.index("_own"))).select([c for c in names if c not in ("_own", "_place", "_size", "_home")])
    return run


def smoothed_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], power: str, method: str, args: Mapping, peak: int) -> DataFrame:
    """``df`` (group, order and power columns) with ``power`` smoothed along time; its arrays have one length and no nulls.

    ``peak`` is the number of rows of the largest group.
    """
    group, make = list(group), METHODS[method]
    reach, size = make(**args).reach, rows_per_chunk(df.sparkSession)
    kept = [*group, *[c for c in order if c not in group]]
    d = df.select(*kept, F.col(power).cast("array<double>").alias(power))
    if peak <= size:
        n = d.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
        series = group
        d = attach(d, n, group).withColumn("_place", F.lit(0).cast("long")).withColumn("_own", F.lit(True))
        by = list(order)
    else:
        size = max(size, reach, 1)
        d = indexed(d, group, order, "_rn", "_size", peak).withColumn("_place", F.col("_rn") - 1)
        chunk = F.floor(F.col("_place") / size).cast("long")
        lent = F.when(F.col("_place") >= (chunk + 1) * size - reach, chunk + 1)
        d = d.withColumn("_mine", chunk).withColumn("_home", F.explode(F.filter(F.array(chunk, lent), lambda h: h.isNotNull())))
        d = d.withColumn("_own", F.col("_home") == F.col("_mine")).drop("_rn", "_mine")
        series, by = [*group, "_home"], ["_place"]
    d = d.select(*series, *[c for c in kept if c not in series], power, "_own", "_place", "_size")
    placed = d.repartition(*series) if series else d.coalesce(1)
    result = d.drop("_own", "_place", "_size", "_home")
    done = placed.sortWithinPartitions(*series, *by).mapInArrow(_pass(lambda: make(**args), len(series), d.columns.index(power)), result.schema)
    return done.select(*kept, power)
