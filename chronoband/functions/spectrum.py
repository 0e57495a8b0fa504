"""Features of one spectrum row (array of bins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoband.functions import arrays as A

# fixed values: calibration of the receiver
DB_OFFSET = -64.4
DB_SCALE = 0.0288
GHZ_PER_BIN = 0.002
GHZ_START = 4.0


def to_db(power: Column) -> Column:
    return F.transform(power, lambda x: F.lit(DB_OFFSET) + F.lit(DB_SCALE) * x)


def bin_ghz(i: Column) -> Column:
    return F.lit(GHZ_PER_BIN) * i + F.lit(GHZ_START)


def min_bin(power: Column) -> Column:
    """struct(bin, value, ghz) of the lowest bin, first one on ties."""
    low = F.array_min(power)
    return A.let(F.struct(low.alias("v"), (F.array_position(power, low) - 1).alias("b")), lambda s: F.struct(
        s["b"].alias("bin"), s["v"].alias("value"), bin_ghz(s["b"]).alias("ghz")))


def dip(power: Column, lo_ghz: float = 4.0, hi_ghz: float = 6.0, n_lowest: int = 10) -> Column:
    """struct(freq, mean, std) over the ``n_lowest`` bins of a band."""
    tagged = F.transform(power, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    band = F.filter(tagged, lambda s: (bin_ghz(s["i"]) >= lo_ghz) & (bin_ghz(s["i"]) <= hi_ghz))
    lowest = F.slice(F.array_sort(band), 1, n_lowest)
    return A.let(lowest, lambda low: F.struct(
        A.median(F.transform(low, lambda s: bin_ghz(s["i"]))).alias("freq"),
        A.mean(F.transform(low, lambda s: s["x"])).alias("mean"),
        A.std(F.transform(low, lambda s: s["x"])).alias("std"),
    ))


def band_edges(n_points: int, n_bands: int) -> list[int]:
    return [int(i * n_points / n_bands) for i in range(n_bands + 1)]


def band_stats(power: Column, n_points: int, n_bands: int = 24) -> Column:
    """mean, std of each of ``n_bands`` equal bands, flattened."""
    edges = band_edges(n_points, n_bands)
    cols: list[Column] = []
    for a, b in zip(edges, edges[1:]):
        part = F.slice(power, a + 1, b - a)
        cols += [A.mean(part), A.std(part)]
    return F.array(*cols)


def third_powers(power: Column) -> Column:
    """struct(total, low, mid, high): mean of all bins and of each third."""
    n = F.size(power)
    c1, c2 = F.floor(n / 3).cast("int"), F.floor(n * 2 / 3).cast("int")
    return F.struct(
        A.mean(power).alias("total"),
        A.mean(F.slice(power, F.lit(1), c1)).alias("low"),
        A.mean(F.slice(power, c1 + 1, c2 - c1)).alias("mid"),
        A.mean(F.slice(power, c2 + 1, n - c2)).alias("high"),
    )
