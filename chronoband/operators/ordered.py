"""Ordered computation over groups of any size.

Everything on a time axis needs rows in order inside a group (a recording, a
user, the whole table).  A plain window does that in one task per group, which
is right while groups are small and hopeless once one group holds a third of
the table.  The functions here measure the largest group first (a count that is
combined before its shuffle) and then take one of two plans with equal results:

* small groups: one window over ``group``;
* a large group: rows are range-partitioned and sorted once, numbered from
  per-partition counts, cut into chunks of bounded size, and every window runs
  per ``(group, chunk)``.  Frames borrow rows from the neighbouring chunk,
  carried values and running totals come from a table with one row per chunk.

``order`` has to be total inside a group (finish it with an id).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronoband.session import materialise, rows_per_chunk

Exprs = Mapping[str, Callable[[WindowSpec], Column]]


def group_sizes(df: DataFrame, group: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest group, rows of the table)."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    row = counts.agg(F.max("_n"), F.sum("_n")).first()
    return int(row[0] or 0), int(row[1] or 0)


def is_small(df: DataFrame, group: Sequence[str], peak: int | None) -> bool:
    """Does every group fit one window task?  ``peak`` is a known upper bound."""
    limit = rows_per_chunk(df.sparkSession)
    if peak is None:
        peak = group_sizes(df, group)[0]
    return peak <= limit


def _as_column(o: Column | str) -> Column:
    return F.col(o) if isinstance(o, str) else o


def attach(df: DataFrame, stats: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Put per-group values on the rows.

    Without keys ``stats`` is one row and becomes scalar subqueries.  With keys
    it is an equi-join whose strategy adaptive execution picks from the measured
    size; a hot key is split by its skew handling.
    """
    if not on:
        packed = stats.select(F.struct("*").alias("_s")).scalar()
        return df.withColumn("_s", packed).select(
            "*", *[F.col(f"_s.`{c}`").alias(c) for c in stats.columns]
        ).drop("_s")
    return matched(df, stats, on, how)


def matched(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of the same names in which NULL meets NULL: a NULL group is a group like any other."""
    named = other.select(*[F.col(k).alias(f"_on_{k}") for k in on], *[c for c in other.columns if c not in on])
    cond = None
    for k in on:
        same = df[k].eqNullSafe(named[f"_on_{k}"])
        cond = same if cond is None else cond & same
    return df.join(named, cond, how).drop(*[f"_on_{k}" for k in on])


def _sorted_numbers(df: DataFrame, group: Sequence[str], order: Sequence, rn: str, n: str) -> DataFrame:
    """Exact row numbers by one range shuffle; no task sees a whole group."""
    limit = rows_per_chunk(df.sparkSession)
    total = group_sizes(df, group)[1]
    parts = max(2, -(-total // limit))
    keys = [F.col(g) for g in group] + [_as_column(o) for o in order]
    placed = materialise(
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_mid", 33))
    )
    runs = placed.groupBy(*group, "_pid").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt")
    )
    per = Window.partitionBy(*group)
    runs = runs.select(
        *group, "_pid", "_first",
        (F.sum("_cnt").over(per.orderBy("_pid")) - F.col("_cnt")).alias("_before"),
        F.sum("_cnt").over(per).alias(n),
    )
    renamed = runs.select(*[F.col(g).alias(f"_k_{g}") for g in group],
                          F.col("_pid").alias("_k_pid"), "_first", "_before", n)
    cond = placed["_pid"] == renamed["_k_pid"]
    for g in group:
        cond = cond & placed[g].eqNullSafe(renamed[f"_k_{g}"])
    joined = placed.join(renamed, cond)
    return joined.withColumn(rn, F.col("_mid") - F.col("_first") + F.col("_before") + 1).drop(
        "_mid", "_pid", "_first", "_before", "_k_pid", *[f"_k_{g}" for g in group]
    )


def indexed(df: DataFrame, group: Sequence[str], order: Sequence, rn: str = "rn", n: str = "n",
            peak: int | None = None) -> DataFrame:
    """Add the position of a row in its group (from 1) and the group's size."""
    group = list(group)
    if is_small(df, group, peak):
        w = Window.partitionBy(*group)
        return df.withColumn(rn, F.row_number().over(w.orderBy(*order)).cast("long")).withColumn(
            n, F.count(F.lit(1)).over(w))
    return _sorted_numbers(df, group, order, rn, n)


def framed(df: DataFrame, group: Sequence[str], order: Sequence, before: int, after: int, exprs: Exprs,
           peak: int | None = None, rn: str | None = None) -> DataFrame:
    """Window expressions that reach at most ``before``/``after`` rows away.

    Each value of ``exprs`` gets an ordered window and sets its own frame (or
    uses ``lag``/``lead``).  ``rn`` names an existing position column.
    """
    group = list(group)
    if is_small(df, group, peak):
        w = Window.partitionBy(*group).orderBy(*order)
        return df.select("*", *[fn(w).alias(k) for k, fn in exprs.items()])
    size = max(rows_per_chunk(df.sparkSession), before, after, 1)
    d = df.withColumn("_rn", F.col(rn)) if rn else _sorted_numbers(df, group, order, "_rn", "_n").drop("_n")
    own = F.floor((F.col("_rn") - 1) / size).cast("long")
    d = d.withColumn("_own", own)
    homes = F.array(
        F.col("_own"),
        F.when(F.col("_rn") > (F.col("_own") + 1) * size - before, F.col("_own") + 1),
        F.when((F.col("_rn") <= F.col("_own") * size + after) & (F.col("_own") > 0), F.col("_own") - 1),
    )
    d = d.withColumn("_home", F.explode(F.filter(homes, lambda h: h.isNotNull())))
    w = Window.partitionBy(*group, "_home").orderBy("_rn")
    return (
        d.select("*", *[fn(w).alias(k) for k, fn in exprs.items()])
        .filter(F.col("_home") == F.col("_own"))
        .drop("_rn", "_own", "_home")
    )


def scanned(df: DataFrame, group: Sequence[str], order: Sequence, last: Mapping[str, Column] | None = None,
            first: Mapping[str, Column] | None = None, total: Mapping[str, Column] | None = None,
            peak: int | None = None, rn: str | None = None) -> DataFrame:
    """Unbounded scans: ``last`` non-null at or before the row, ``first`` non-null
    at or after it, running ``total`` up to and with it."""
    group = list(group)
    last, first, total = dict(last or {}), dict(first or {}), dict(total or {})
    lo, cur = Window.unboundedPreceding, Window.currentRow

    def local(keys, by):
        # "first at or after" is "last at or before" in reverse order: a frame that
        # ends at the partition's end would be evaluated anew for every row
        up = Window.partitionBy(*keys).orderBy(*by).rowsBetween(lo, cur)
        down = Window.partitionBy(*keys).orderBy(*[_as_column(o).desc() for o in by]).rowsBetween(lo, cur)
        return (
            [F.last(c, ignorenulls=True).over(up).alias(k) for k, c in last.items()]
            + [F.last(c, ignorenulls=True).over(down).alias(k) for k, c in first.items()]
            + [F.sum(c).over(up).alias(k) for k, c in total.items()]
        )

    if is_small(df, group, peak):
        return df.select("*", *local(group, order))

    size = rows_per_chunk(df.sparkSession)
    d = df.withColumn("_rn", F.col(rn)) if rn else _sorted_numbers(df, group, order, "_rn", "_n").drop("_n")
    d = d.withColumn("_chunk", F.floor((F.col("_rn") - 1) / size).cast("long"))
    aggs = (
        [F.max_by(c, F.when(c.isNotNull(), F.col("_rn"))).alias(f"_e_{k}") for k, c in last.items()]
        + [F.min_by(c, F.when(c.isNotNull(), F.col("_rn"))).alias(f"_e_{k}") for k, c in first.items()]
        + [F.sum(c).alias(f"_e_{k}") for k, c in total.items()]
    )
    ends = d.groupBy(*group, "_chunk").agg(*aggs)
    cw = Window.partitionBy(*group).orderBy("_chunk")
    back = Window.partitionBy(*group).orderBy(F.col("_chunk").desc())
    carried = ends.select(
        *[F.col(g).alias(f"_k_{g}") for g in group], F.col("_chunk").alias("_k_chunk"),
        *[F.last(f"_e_{k}", ignorenulls=True).over(cw.rowsBetween(lo, -1)).alias(f"_c_{k}") for k in last],
        *[F.last(f"_e_{k}", ignorenulls=True).over(back.rowsBetween(lo, -1)).alias(f"_c_{k}") for k in first],
        *[F.sum(f"_e_{k}").over(cw.rowsBetween(lo, -1)).alias(f"_c_{k}") for k in total],
    )
    d = d.select("*", *local([*group, "_chunk"], ["_rn"]))
    cond = d["_chunk"] == carried["_k_chunk"]
    for g in group:
        cond = cond & d[g].eqNullSafe(carried[f"_k_{g}"])
    d = d.join(carried, cond)
    for k in [*last, *first]:
        d = d.withColumn(k, F.coalesce(F.col(k), F.col(f"_c_{k}")))
    for k in total:
        d = d.withColumn(k, F.when(F.col(k).isNull(), F.col(f"_c_{k}"))
                         .otherwise(F.col(k) + F.coalesce(F.col(f"_c_{k}"), F.lit(0))))
    made = [*last, *first, *total]
    return d.drop("_rn", "_chunk", "_k_chunk", *[f"_k_{g}" for g in group], *[f"_c_{k}" for k in made])


def time_framed(df: DataFrame, group: Sequence[str], us: str, reach_us: int, exprs: Exprs,
                peak: int | None = None) -> DataFrame:
    """Window expressions over the last ``reach_us`` microseconds.

    ``exprs`` get a window ordered by the BIGINT column ``us`` and may look back
    at most ``reach_us`` and never ahead.  A large group is cut into time slices
    at least that long, and each row also visits the next slice when it is
    within reach of it: at most two copies.  Rows without a time stand before
    all others, in a slice of their own.
    """
    group = list(group)
    if is_small(df, group, peak):
        w = Window.partitionBy(*group).orderBy(us)
        return df.select("*", *[fn(w).alias(k) for k, fn in exprs.items()])
    limit = rows_per_chunk(df.sparkSession)
    # a group is cut by its own rows and its own span: a short recording in a long table is cut as finely as it needs
    cuts = df.groupBy(*group).agg(F.min(us).alias("_t0"), F.max(us).alias("_t1"), F.count(F.lit(1)).alias("_m")).select(
        *group, F.coalesce("_t0", F.lit(0)).alias("_t0"), F.coalesce(F.greatest(
            F.lit(reach_us + 1), F.floor((F.col("_t1") - F.col("_t0")) / F.greatest(F.floor(F.col("_m") / limit), F.lit(1))) + 1),
            F.lit(reach_us + 1)).cast("long").alias("_len"))
    d = attach(df, cuts, group).withColumn("_own", F.coalesce(F.floor((F.col(us) - F.col("_t0")) / F.col("_len")).cast("long"), F.lit(-1)))
    nxt = F.when((F.col("_own") + 1) * F.col("_len") + F.col("_t0") - F.col(us) <= reach_us, F.col("_own") + 1)
    d = d.withColumn("_home", F.explode(F.filter(F.array(F.col("_own"), nxt), lambda h: h.isNotNull())))
    w = Window.partitionBy(*group, "_home").orderBy(us)
    return (
        d.select("*", *[fn(w).alias(k) for k, fn in exprs.items()])
        .filter(F.col("_home") == F.col("_own"))
        .drop("_own", "_home", "_t0", "_len")
    )


def quantiles(df: DataFrame, group: Sequence[str], value: Column | str, probs: Sequence[float],
              out: str = "q", peak: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one array per group.

    A large group is first collapsed to distinct values with counts, then the
    wanted ranks are read off the running count.
    """
    group = list(group)
    v = F.col(value) if isinstance(value, str) else value
    d = df.select(*group, v.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    probs = [float(p) for p in probs]
    if is_small(df, group, peak):
        return d.groupBy(*group).agg(F.percentile("_v", F.array(*[F.lit(p) for p in probs])).alias(out))
    counts = d.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_m"))
    # distinct values may still be many, so the running count is chunked as well
    run = scanned(counts, group, ["_v"], total={"_hi": F.col("_m")})
    n = counts.groupBy(*group).agg(F.sum("_m").alias("_n"))
    run = attach(run, n, group, "inner")
    aggs = []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1) * F.lit(p)
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("_hi") > rank) & (F.col("_hi") - F.col("_m") <= rank)
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{tag}{i}"))
    picked = run.groupBy(*group).agg(F.max("_n").alias("_n"), *aggs)
    vals = []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1) * F.lit(p)
        frac = pos - F.floor(pos)
        vals.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac)
    return picked.select(*group, F.array(*vals).alias(out))


def column_quantiles(df: DataFrame, group: Sequence[str], wanted: Mapping[str, tuple[Column | str, float]], peak: int | None = None,
                     also: Mapping[str, Column] | None = None) -> DataFrame:
    """Exact quantiles of many columns: one row per group with a column per name, and the aggregates ``also``.

    Small groups take one aggregation, so one exchange for all columns and
    probabilities.  For a large group the cells are put in one long table
    (group, column, value) that is collapsed to counts and sorted once.
    """
    group, also = list(group), dict(also or {})
    columns: list[Column | str] = []
    places = {}
    for name, (c, p) in wanted.items():
        at = next((k for k, x in enumerate(columns) if x is c or isinstance(c, str) and isinstance(x, str) and x == c), None)
        if at is None:
            at = len(columns)
            columns.append(c)
        places[name] = (at, float(p))
    probs = [[p for k, p in places.values() if k == at] for at in range(len(columns))]
    values = [_as_column(c).cast("double") for c in columns]
    if is_small(df, group, peak):
        arrays = [F.percentile(v, F.array(*[F.lit(p) for p in ps])).alias(f"_q{at}") for at, (v, ps) in enumerate(zip(values, probs, strict=True))]
        d = df.groupBy(*group).agg(*[c.alias(n) for n, c in also.items()], *arrays)
        return d.select(*group, *also, *[F.col(f"_q{at}")[probs[at].index(p)].alias(n) for n, (at, p) in places.items()])
    cells = df.select(*group, F.inline(F.array(*[F.struct(F.lit(at).alias("_col"), v.alias("_x")) for at, v in enumerate(values)])))
    every = sorted({p for ps in probs for p in ps})
    found = quantiles(cells, [*group, "_col"], "_x", every)
    wide = found.groupBy(*group).agg(*[F.max(F.when(F.col("_col") == at, F.col("q")[every.index(p)])).alias(n) for n, (at, p) in places.items()])
    if not also:
        return wide
    return attach(df.groupBy(*group).agg(*[c.alias(n) for n, c in also.items()]), wide, group)


def with_quantiles(df: DataFrame, group: Sequence[str], value: Column | str, names: Mapping[str, float],
                   peak: int | None = None) -> DataFrame:
    """Per-group quantiles as named columns on every row."""
    return attach(df, column_quantiles(df, group, {k: (value, p) for k, p in names.items()}, peak), list(group))
