"""Components and clusters of spectra."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chronoband.functions import spectrum as P
from chronoband.operators.histories import fixed_sample
from chronoband.operators.normalise import scale_for_distance
from chronoband.operators.ordered import matched
from chronoband.session import materialise

# fixed value: most rows a silhouette is computed on unless all are asked for
SILHOUETTE_ROWS = 2000


def two_components(df: DataFrame, features: str = "features", out: str = "pc") -> DataFrame:
    """First two principal components; the largest loading of each is positive."""
    d = df.withColumn("_v", array_to_vector(F.col(features)))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(d)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), range(load.shape[1])])
    mean = d.select(Summarizer.mean(F.col("_v")).alias("m")).first().m
    centre = mean.toArray() @ load if mean is not None else np.zeros(load.shape[1])
    p = vector_to_array(F.col("_p"))
    parts = [(p[j] - F.lit(float(centre[j]))) * F.lit(float(sign[j])) for j in range(2)]
    return model.transform(d).withColumn(out, F.array(*parts)).drop("_v", "_p")


def centroid_distance(df: DataFrame, split: str, pc: str = "pc") -> DataFrame:
    side = lambda s, j: F.avg(F.when(F.col(split) == s, F.col(pc)[j]))
    sq = sum((F.pow(side("train", j) - side("test", j), 2) for j in (1,)), F.pow(side("train", 0) - side("test", 0), 2))
    return df.agg(F.sqrt(sq).alias("pca_centroid_distance"))


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centres) by one matrix product."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], 0.0)


def _lloyd(centres: np.ndarray):
    """One Lloyd step of all restarts: per task the sums (centre, i, s) of every centre that got rows, ``i`` being a bin or what follows: rows and cost.  ``centres`` is restarts x k x bins."""
    restarts, k, width = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, cost, sums = np.zeros(restarts * k, np.int64), np.zeros(restarts * k), np.zeros((restarts * k, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            far = _squares(x, centres.reshape(-1, width)).reshape(len(x), restarts, k)
            near = far.argmin(axis=2)
            at = near + np.arange(restarts) * k                      # rows x restarts, a place of its own for each (restart, cluster)
            rows += np.bincount(at.ravel(), minlength=restarts * k)
            cost += np.bincount(at.ravel(), np.take_along_axis(far, near[:, :, None], axis=2).ravel(), restarts * k)
            member = np.zeros((len(x), restarts * k))
            member[np.arange(len(x))[:, None], at] = 1.0
            sums += member.T @ x
        used = np.flatnonzero(rows)
        cells = np.column_stack((sums, rows, cost))[used]
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.repeat(used, width + 2).astype(np.int32)),
                                          "i": pa.array(np.tile(np.arange(width + 2, dtype=np.int32), len(used))), "s": pa.array(cells.ravel())})
    return run


def lloyd_step(x: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new centres, cost of each restart); a centre without rows stays.  One pass over the rows; the driver gets the sums of each (restart, cluster)."""
    restarts, k, width = centres.shape
    parts = x.mapInArrow(_lloyd(centres), "at int, i int, s double")
    sums = np.zeros((restarts * k, width + 2))
    for r in parts.groupBy("at", "i").agg(F.sum("s").alias("s")).collect():  # at most restarts x k x (width + 2) rows
        sums[r.at, r.i] = r.s
    new, got = centres.copy().reshape(-1, width), sums[:, width] > 0
    new[got] = sums[got, :width] / sums[got, width:width + 1]
    return new.reshape(centres.shape), sums[:, width + 1].reshape(restarts, k).sum(axis=1)


def kmeans_centres(df: DataFrame, k: int, seed: int = 42, restarts: int = 12, iterations: int = 60, features: str = "features",
                   tol: float = 1e-6) -> np.ndarray:
    """Centres of the cheapest of several runs from random rows; all runs take their steps together, in one pass over the rows.

    Runs that stand still keep their centres.  Fewer different rows than centres
    give repeated ones, of which only the first gets rows.
    """
    x = materialise(df.where(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("x")))  # every step reads it
    first = x.select("x").distinct().orderBy(F.xxhash64(F.lit(seed), "x"), "x").limit(restarts * k).collect()
    if not first:
        return np.empty((0, 0))
    start = np.array([r.x for r in first])
    centres = start[np.arange(restarts * k) % len(start)].reshape(restarts, k, -1)
    moving = np.ones(restarts, dtype=bool)
    for _ in range(iterations):
        new, _ = lloyd_step(x, centres[moving])
        still = np.isclose(new, centres[moving], rtol=1e-5, atol=tol).all(axis=(1, 2))
        centres[moving] = np.where(still[:, None, None], centres[moving], new)
        moving[np.flatnonzero(moving)[still]] = False
        if not moving.any():
            break
    cost = lloyd_step(x, centres)[1]
    return centres[int(cost.argmin())]


def kmeans(df: DataFrame, k: int, seed: int = 42, restarts: int = 12, iterations: int = 60,
           features: str = "features", out: str = "cluster") -> DataFrame:
    """``df`` with the cluster (from 0) of each row under the cheapest of several seeded runs; null where features are."""
    centres = kmeans_centres(df, k, seed, restarts, iterations, features)

    @F.pandas_udf(T.IntegerType())
    def nearest(x: pd.Series) -> pd.Series:
        return pd.Series(_squares(np.stack(x.to_numpy()).astype(float), centres).argmin(axis=1)) if len(x) else pd.Series([], dtype="int32")
    if not centres.size:
        return df.withColumn(out, F.lit(None).cast("int"))
    somewhere = F.coalesce(F.col(features).cast("array<double>"), F.array_repeat(F.lit(0.0), centres.shape[1]))
    return df.withColumn(out, F.when(F.col(features).isNotNull(), nearest(somewhere)))


#: rows of a block; a tile is a block against a block
BLOCK_ROWS = 2048
#: most partitions of a side: every left partition meets every right one, and each brings a sum per row and cluster
SIDE_PARTS = 24
#: cells of a tile that exist at a time
TILE_CELLS = 1 << 17
#: a squared distance below this share of the squared norms is computed from the differences
CLOSE = 1e-4


def _distances(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distances of all rows of ``x`` and ``y``, some rows of ``x`` at a time, by one matrix product; those of near rows by their differences."""
    centre = y[0]
    x, y = x - centre, y - centre
    own, other = (x * x).sum(axis=1), (y * y).sum(axis=1)
    left = np.column_stack((-2 * x, own, np.ones(len(x))))
    right = np.ascontiguousarray(np.column_stack((y, np.ones(len(y)), other)).T)
    bound, step = CLOSE * (own + other.max()), max(1, TILE_CELLS // len(y))
    for k in range(0, len(x), step):
        far = left[k:k + step] @ right
        if not (far.min(axis=1) >= bound[k:k + step]).all():
            i, j = np.nonzero(~(far >= CLOSE * (own[k:k + step, None] + other)))
            for at in range(0, len(i), 1 << 16):
                a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
                far[a, b] = ((x[k + a] - y[b]) ** 2).sum(axis=1)
        far += 1e-12
        yield k, np.sqrt(far, out=far)


def _members(own: np.ndarray) -> tuple[list, np.ndarray]:
    """The clusters of a block, and a matrix of its rows and clusters."""
    kinds, place = np.unique(own, return_inverse=True)
    member = np.zeros((len(own), len(kinds)))
    member[np.arange(len(own)), place] = 1.0
    return kinds.tolist(), member


def _tiles(own: T.DataType):
    """Sums of distances of the rows of a block, per cluster, over the blocks they meet in a task; ``less`` are the rows of that cluster that do not count, as they have the row's key."""
    own = to_arrow_type(own)

    def sums(block: int, found: dict, less: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array(list(found), own), pa.array([t.tobytes() for t in found.values()]),
                                           pa.array([less[c].tobytes() if c in less else None for c in found], pa.binary())], names=["block", "cluster", "total", "less"])

    def add(found: dict, kinds: list, totals: np.ndarray) -> None:
        for kind, total in zip(kinds, totals, strict=True):
            found[kind] = found[kind] + total if kind in found else total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found, less, others = None, {}, {}, {}
        for batch in batches:
            for r in range(batch.num_rows):
                at = lambda name: batch.column(name)[r].values.to_numpy(zero_copy_only=False)
                if batch.column("block")[r].as_py() != block:
                    if found:
                        yield sums(block, found, less)
                    block, found, less = batch.column("block")[r].as_py(), {}, {}
                    keys, (mine, in_mine) = at("keys"), _members(at("own"))
                    x = at("x").reshape(len(keys), -1)
                theirs, in_theirs = _members(at("theirs"))
                y, other = at("y").reshape(len(in_theirs), -1), batch.column("other")[r].as_py()
                total = np.empty((len(x), len(theirs)))
                if other == block:                                  # a key has one block, so only there a row can meet itself
                    out = np.empty((len(x), len(theirs)))
                    for k, far in _distances(x, y):
                        same = keys[k:k + len(far), None] == keys
                        same[np.arange(len(far)), np.arange(k, k + len(far))] = True
                        total[k:k + len(far)], out[k:k + len(far)] = np.where(same, 0.0, far) @ in_theirs, same @ in_theirs
                    less = dict(zip(theirs, out.T.astype(np.int64), strict=True))
                else:
                    back = np.zeros((len(mine), len(y)))
                    for k, far in _distances(x, y):
                        total[k:k + len(far)] = far @ in_theirs
                        back += in_mine[k:k + len(far)].T @ far
                    add(others.setdefault(other, {}), mine, back)
                add(found, theirs, total.T)
        if found:
            yield sums(block, found, less)
        for other, back in others.items():
            yield sums(other, back, {})
    return run


def _summed(own: T.DataType):
    """Rows sorted by (block, cluster): their sums as arrays, a place per row of the block."""
    own = to_arrow_type(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = total = less = None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], own), pa.array([total], pa.list_(pa.float64())),
                                               pa.array([less], pa.list_(pa.int64()))], names=["block", "cluster", "total", "less"])
        for batch in batches:
            for block, cluster, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, cluster) != now:
                    if now is not None:
                        yield closed()
                    now, total, less = (block, cluster), np.zeros(len(t) // 8), np.zeros(len(t) // 8, np.int64)
                total += np.frombuffer(t)
                if n is not None:
                    less += np.frombuffer(n, np.int64)
        if now is not None:
            yield closed()
    return run


def pair_sums(df: DataFrame, key: str, features: str = "features", cluster: str = "cluster", seed: int = 42,
              most: int | None = SILHOUETTE_ROWS, block: int = BLOCK_ROWS) -> DataFrame:
    """Per row and cluster: sum and number of the Euclidean distances to the other rows: key, own, cluster, total, n.

    ``most`` rows, the same ones every time, or all.  Rows are dealt to blocks by
    a hash of their key, every two blocks are a tile, computed once for both.
    Blocks lie in partitions on both sides of a cross join, so a row is shuffled
    twice whatever the number of tiles; pairs of rows exist only inside a tile,
    and a task keeps one sum per row and cluster of the blocks it has.  The key
    is unique and has no nulls.
    """
    d = df.select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x"), F.col(cluster).alias("own")).where("x IS NOT NULL AND own IS NOT NULL")
    if most is not None:
        chosen = fixed_sample(d.select("key"), "key", most, seed)       # only keys meet in one place
        d = d.join(chosen, "key", "left_semi")
    d = materialise(d)
    blocks = max(1, -(-d.count() // block))
    dealt = d.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("long"))
    packed = materialise(dealt.groupBy("block").agg(F.collect_list(F.struct("key", "own", "x")).alias("rows")).select(
        "block", F.col("rows.key").alias("keys"), F.col("rows.own").alias("own"), F.flatten("rows.x").alias("x")))
    sides = min(blocks, SIDE_PARTS)
    left = packed.repartition(sides, "block")
    right = packed.select(F.col("block").alias("other"), F.col("own").alias("theirs"), F.col("x").alias("y")).repartition(sides, "other")
    # one of the two ways round, each for half of the tiles of any task
    turn = (F.col("block") == F.col("other")) | ((F.col("block") < F.col("other")) == ((F.col("block") + F.col("other")) % 2 == 0))
    own = d.schema["own"].dataType
    out = lambda total, less: T.StructType([T.StructField("block", T.LongType()), T.StructField("cluster", own), T.StructField("total", total), T.StructField("less", less)])
    # a broadcast side would leave the work to the few partitions of the other
    parts = left.join(right.hint("shuffle_replicate_nl"), turn).mapInArrow(_tiles(own), out(T.BinaryType(), T.BinaryType()))
    sums = parts.repartition("block").sortWithinPartitions("block", "cluster").mapInArrow(_summed(own), out(T.ArrayType(T.DoubleType()), T.ArrayType(T.LongType())))
    cells = sums.join(packed.select("block", "keys", "own"), "block").select("cluster", F.inline(F.arrays_zip("keys", "own", "total", "less")))
    sizes = d.groupBy(F.col("own").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    rows = cells.join(sizes, "cluster").select(F.col("keys").alias("key"), "own", "cluster", "total", (F.col("size") - F.col("less")).alias("n"))
    return rows.groupBy("key", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def silhouette(df: DataFrame, key: str, features: str = "features", cluster: str = "cluster", seed: int = 42,
               most: int | None = SILHOUETTE_ROWS) -> DataFrame:
    """Mean Euclidean silhouette of at most ``most`` rows (all with None), and their number; null with fewer than two clusters."""
    sums = pair_sums(df, key, features, cluster, seed, most)
    same, mean = F.col("cluster") == F.col("own"), F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    per = sums.groupBy("key").agg(F.coalesce(F.max(F.when(same, mean)), F.lit(0.0)).alias("a"), F.min(F.when(~same, mean)).alias("b"))
    top = F.greatest("a", "b")
    score = F.when(F.col("b").isNotNull(), F.when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(0.0))
    return per.agg(F.avg(score).alias("silhouette"), F.count(F.lit(1)).alias("n_rows"))


def cluster_report(df: DataFrame, key: str, phase: str, experiment: str, k: int = 4, seed: int = 42, features: str = "features") -> DataFrame:
    """Clusters held against phases and experiments, and their silhouette: kind, cluster, name, value.

    Shares are of a cluster's rows and cover the names that occur in it.  The
    silhouette is that of all rows; one without a key has none.
    """
    d = materialise(df.select(key, phase, experiment, features))     # the runs of k-means and what follows read it
    d = materialise(kmeans(d, k, seed, features=features))

    def table(kind: str, name: str) -> DataFrame:
        n = d.groupBy("cluster", F.col(name).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
        whole = n.groupBy("cluster").agg(F.sum("n").alias("all"))
        return matched(n, whole, ["cluster"]).select(F.lit(kind).alias("kind"), "cluster", "name", (F.col("n") / F.col("all")).alias("value"))
    scored = silhouette(d.where(F.col(key).isNotNull()), key, features, "cluster", seed, most=None)
    whole = scored.select(F.inline(F.array(F.struct(F.lit("silhouette").alias("name"), F.col("silhouette").alias("value")),
                                           F.struct(F.lit("n_rows").alias("name"), F.col("n_rows").cast("double").alias("value")))))
    whole = whole.select(F.lit("whole").alias("kind"), F.lit(None).cast("int").alias("cluster"), "name", "value")
    return table("phase", phase).unionByName(table("experiment", experiment)).unionByName(whole)


def cluster_features(df: DataFrame, n_points: int, extra: Sequence[str], power: str = "power", n_bands: int = 24) -> DataFrame:
    """Band means and deviations plus scalar columns, scaled for distances."""
    f = F.concat(P.band_stats(F.col(power), n_points, n_bands), F.array(*[F.col(c).cast("double") for c in extra]))
    return scale_for_distance(df.withColumn("features", f), "features")
