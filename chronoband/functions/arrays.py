"""Row-local array arithmetic (frequency axis of a spectrum, aux vectors).

All of it stays in JVM higher-order functions.  ``let`` evaluates a value once
per row: an outer expression used inside a lambda would otherwise be evaluated
again for every element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def doubles(a: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def std(a: Column) -> Column:
    """Population standard deviation."""
    return let(mean(a), lambda m: F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(a)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def median(a: Column) -> Column:
    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        lo = F.get(s, F.floor((n - 1) / 2).cast("int"))
        hi = F.get(s, F.floor(n / 2).cast("int"))
        return (lo + hi) / 2
    return let(F.array_sort(a), of_sorted)


def positions(n: Column) -> Column:
    """0 .. n-1."""
    return F.sequence(F.lit(0), n - 1)


def at(a: Column, i: Column) -> Column:
    return F.get(a, i.cast("int"))


def pad_front(a: Column, width: int, fill: Column) -> Column:
    """Left-pad ``a`` with ``fill`` up to ``width`` elements."""
    return F.concat(F.array_repeat(fill, (F.lit(width) - F.size(a)).cast("int")), a)


def nearest(samples: Column, times: Column, target: Column, time: str) -> Column:
    """The sample (a struct) nearest to ``target``; the earlier one on a tie.
    ``samples`` are sorted, ``times`` are their times as a plain array."""
    def around(p):
        before, after = F.get(samples, p - 1), F.get(samples, p)
        return F.when(before.isNull() | (target - before[time] > after[time] - target), after).otherwise(before)
    return let(F.size(F.filter(times, lambda t: t < target)), around)
