"""Linear recurrences ``s[t] = u[t] + a1*s[t-1] + ... + ak*s[t-k]`` in time order.

Exponential smoothing and self-fed linear prediction both have this shape.  The
map over a run of rows is affine in its start state, so a large group is cut
into chunks: each chunk first reports its end state from a zero start, the
chunk table (one row per chunk) is folded, and every chunk then runs from its
true start.  Inside a task rows stream in Arrow batches: short runs go side by
side, one NumPy step for all of them; of long runs blocks of 64 rows are affine
maps as well, and a batch is a few matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoband.operators.ordered import group_sizes, indexed, matched
from chronoband.session import rows_per_chunk


BLOCK = 64
#: runs up to so many rows are stepped side by side, longer ones in blocks
SIDE_BY_SIDE = 512


def responses(coef: Sequence[float], size: int) -> tuple[np.ndarray, np.ndarray]:
    """A block of ``size`` steps as an affine map: values = driven @ inputs + started @ state (newest value first)."""
    k = len(coef)
    impulse = np.zeros(size)
    for t in range(size):
        impulse[t] = float(t == 0) + sum(a * impulse[t - j] for j, a in enumerate(coef, 1) if t >= j)
    driven = np.zeros((size, size))
    for t in range(size):
        driven[t, :t + 1] = impulse[t::-1]
    started = np.zeros((size, k))
    for i in range(k):
        values = [0.0] * k
        values[k - 1 - i] = 1.0  # oldest first
        for t in range(size):
            values.append(sum(a * values[-j] for j, a in enumerate(coef, 1)))
        started[:, i] = values[k:]
    return driven, started


def stepped(u: np.ndarray, new: np.ndarray, starts: list, coef: Sequence[float], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The recurrence row by row; what the blocks must equal, and the way rows take that are not finite."""
    out, held = np.empty(len(u)), list(state)
    for i in range(len(u)):
        if new[i]:
            held = list(starts[i])
        s = u[i]
        for a, v in zip(coef, held, strict=True):
            s += a * v
        out[i] = s
        held = [s, *held[:-1]]
    return out, np.array(held)


def side_by_side(u: np.ndarray, heads: np.ndarray, states: np.ndarray, coef: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """All runs one row further at each step, with the row loop's own arithmetic; ``states`` is the state before each run."""
    n = np.diff(np.append(heads, len(u)))
    longest_first = np.argsort(-n, kind="stable")
    heads, n, held = heads[longest_first], n[longest_first], [states[longest_first, j] for j in range(len(coef))]
    out = np.empty(len(u))
    last = states[-1]
    final = int(np.flatnonzero(longest_first == len(n) - 1)[0])
    for step in range(int(n[0])):
        live = int(np.searchsorted(-n, -step, side="left"))  # runs longer than ``step``
        s = u[heads[:live] + step]
        for a, v in zip(coef, held, strict=True):
            s = s + a * v[:live]
        out[heads[:live] + step] = s
        held = [s, *[v[:live] for v in held[:-1]]]
        if step == n[final] - 1:
            last = np.array([v[final] for v in held])
    return out, last


def blocked(u: np.ndarray, new: np.ndarray, starts: list, coef: Sequence[float], state: np.ndarray,
            maps: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of many runs at once: (values, state after the last row).

    Runs are cut into blocks, all blocks are driven from zero by one matrix
    product, states are handed from full block to block inside a run, and a
    second product adds what they contribute.  ``starts[i]`` is the state before
    row i, read where ``new[i]`` is set; ``state`` is the one before the batch.
    """
    driven, started = maps
    size, k, n = len(driven), len(coef), len(u)
    rows = np.arange(n)
    first = np.maximum.accumulate(np.where(new, rows, 0))  # first row of a row's run in this batch
    cut = (rows - first) % size == 0
    block, head = np.cumsum(cut) - 1, np.flatnonzero(cut)
    inputs = np.zeros((len(head), size))
    inputs[block, rows - head[block]] = u
    values = inputs @ driven.T
    states = np.empty((len(head), k))
    carry = started[:-k - 1:-1]  # the newest k values of a full block from its state
    for b, at in enumerate(head.tolist()):
        if new[at]:
            states[b] = starts[at]
        elif b == 0:
            states[b] = state
        else:
            states[b] = values[b - 1, :-k - 1:-1] + carry @ states[b - 1]
    values += states @ started.T
    out = values[block, rows - head[block]]
    before = states[-1][::-1]  # oldest first
    last = np.concatenate([before, out[head[-1]:]])[-k:][::-1]
    return out, last


def with_values(b: pd.DataFrame, values: np.ndarray) -> pd.DataFrame:
    return b.drop(columns=[c for c in ("_u", "_new", "_start") if c in b]).assign(_s=values)


def _stream(coef: list[float], seeded: bool):
    """Task body: rows sorted by (key, rn); ``_new`` marks the first row of a run."""
    k, cs = len(coef), [float(c) for c in coef]
    maps = responses(cs, max(BLOCK, k))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = np.zeros(k)
        for b in batches:
            if not len(b):
                continue
            u, new = b["_u"].to_numpy(float), b["_new"].to_numpy(bool)
            zero = np.zeros(k)
            starts = [zero if s is None else s for s in b["_start"]] if seeded else [zero] * len(b)
            heads = np.unique(np.append(0, np.flatnonzero(new)))
            if np.diff(np.append(heads, len(b))).max() <= SIDE_BY_SIDE:
                before = np.array([starts[h] if new[h] else state for h in heads], dtype=float).reshape(len(heads), k)
                out, state = side_by_side(u, heads, before, cs)
                yield with_values(b, out)
                continue
            plain = np.isfinite(u).all() and np.isfinite(state).all() and all(np.isfinite(starts[i]).all() for i in np.flatnonzero(new))
            out, state = blocked(u, new, starts, cs, state, maps) if plain else stepped(u, new, starts, cs, state)
            yield with_values(b, out)
    return run


def recurrence(df: DataFrame, group: Sequence[str], order: Sequence, u: Column, coef: Sequence[float],
               start: Column | None = None, out: str = "s", rn: str | None = None,
               peak: int | None = None) -> DataFrame:
    """Add ``out``.  ``start`` (array, newest value first) is the state before the
    first row of a group; zeros when absent."""
    group, k = list(group), len(coef)
    if peak is None:
        peak = group_sizes(df, group)[0]
    size = rows_per_chunk(df.sparkSession)
    d = df if rn else indexed(df, group, order, "_rn", "_n", peak).drop("_n")
    pos = rn or "_rn"
    zero = F.array_repeat(F.lit(0.0), k)
    d = d.withColumn("_u", u.cast("double")).withColumn("_start", start if start is not None else zero)
    if peak <= size:
        d = d.withColumn("_new", F.col(pos) == 1)
        keys = group
    else:
        d = d.withColumn("_chunk", F.floor((F.col(pos) - 1) / size).cast("long"))
        d = d.withColumn("_new", (F.col(pos) - 1) % size == 0)
        keys = [*group, "_chunk"]
        d = _with_chunk_starts(d, group, keys, pos, coef)
    schema = T.StructType([f for f in d.schema.fields if f.name not in ("_u", "_new", "_start")]
                          + [T.StructField("_s", T.DoubleType())])
    placed = d.repartition(*keys) if keys else d.coalesce(1)
    done = placed.sortWithinPartitions(*keys, pos).mapInPandas(_stream(list(coef), True), schema)
    drop = [c for c in ("_chunk", "_rn") if c in done.columns and c not in df.columns]
    return done.withColumnRenamed("_s", out).drop(*drop)


def _with_chunk_starts(d: DataFrame, group: list[str], keys: list[str], pos: str, coef: Sequence[float]) -> DataFrame:
    k = len(coef)
    slim = d.select(*keys, pos, "_u", "_new")
    schema = T.StructType([f for f in slim.schema.fields if f.name not in ("_u", "_new")]
                          + [T.StructField("_s", T.DoubleType())])
    loose = slim.repartition(*keys).sortWithinPartitions(*keys, pos).mapInPandas(_stream(list(coef), False), schema)
    top = loose.groupBy(*keys).agg(F.max(pos).alias("_hi"), F.min(pos).alias("_lo"))
    # the newest k values of each chunk, newest first
    tails = matched(loose, top, keys).filter(F.col(pos) > F.col("_hi") - k).groupBy(*keys).agg(
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
        F.transform(F.reverse(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("_s").alias("s"))))),
                    lambda x: x["s"]).alias("_end"))
    first = d.filter(F.col(pos) == 1).select(*group, F.col("_start").alias("_s0"))
    tails = matched(tails, first, group, "left") if group else tails.withColumn("_s0", first.select("_s0").scalar())
    fields = [T.StructField(f.name, f.dataType) for f in tails.select(*keys).schema.fields]
    schema = T.StructType(fields + [T.StructField("_start", T.ArrayType(T.DoubleType()))])
    step = np.zeros((k, k))
    step[0] = coef
    step[1:, :-1] = np.eye(k - 1)

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_chunk")
        state = np.asarray(p["_s0"].iloc[0], float)
        starts = []
        for lo, hi, end in zip(p["_lo"], p["_hi"], p["_end"]):
            starts.append(state.tolist())
            e = np.zeros(k)
            e[: len(end)] = end
            state = np.linalg.matrix_power(step, int(hi - lo + 1)) @ state + e
        out = p[keys].copy()
        out["_start"] = starts
        return out

    folded = tails.groupBy(*group).applyInPandas(fold, schema)
    return matched(d.drop("_start"), folded, keys)


def ema(df: DataFrame, group: Sequence[str], order: Sequence, value: str, alpha: float = 0.3, out: str = "ema",
        peak: int | None = None) -> DataFrame:
    """Causal exponential average; the first value starts it."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    if peak is None:
        peak = group_sizes(df, group)[0]
    d = indexed(df, group, order, "_pos", "_n", peak).drop("_n")
    u = F.when(F.col("_pos") == 1, F.col(value)).otherwise(F.lit(alpha) * F.col(value))
    return recurrence(d, group, order, u, [1 - alpha], None, out, "_pos", peak).drop("_pos")
