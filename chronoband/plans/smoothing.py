"""Smoothing and outlier queries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from chronoband.functions import arrays as A
from chronoband.operators import outliers as O
from chronoband.operators import smooth as S
from chronoband.operators.ordered import group_sizes
from chronoband.operators.recurrence import ema
from chronoband.plans import inputs as I
from chronoband.plans.registry import query

EXP, ORDER = ["exp_id"], ["us", "event_id"]
W = "WINDOW w AS (PARTITION BY exp_id ORDER BY us, event_id)"
SER = f"WITH {I.SERIES}"


def _time(name, sql, fn):
    @query(name, SER + " " + sql)
    def run(spark, d):
        return fn(I.series(spark, d)).select("event_id", I.rounded(F.col("smooth")).alias("smooth"))
    return run


FRAME = "(PARTITION BY exp_id ORDER BY us, event_id ROWS BETWEEN {} PRECEDING AND {} FOLLOWING)"
_time("w1_causal_mean", f"SELECT event_id, round(avg(value) OVER {FRAME.format(4, 0)}, 6) + 0.0 AS smooth FROM series",
      lambda s: S.causal_mean(s, EXP, ORDER, "value", 5))
_time("w3_causal_ema", f""", l AS (SELECT event_id, list(value) OVER {FRAME.format('UNBOUNDED', 0)} AS xs FROM series)
SELECT event_id, round(list_reduce(xs, lambda s, x: 0.3 * x + 0.7 * s), 6) + 0.0 AS smooth FROM l""",
      lambda s: ema(s, EXP, ORDER, "value", 0.3, "smooth"))
_GAUSS = [math.exp(-0.5 * (k / 2.0) ** 2) for k in range(8)]
_time("w5_causal_gaussian", f""", g AS (SELECT * FROM (VALUES {', '.join(f'({k}, {w!r}::DOUBLE)' for k, w in enumerate(_GAUSS))}) v(k, g)),
r AS (SELECT event_id, exp_id, value, row_number() OVER w AS rn FROM series {W})
SELECT a.event_id, round(sum(g.g * b.value) / sum(g.g), 6) + 0.0 AS smooth FROM r a CROSS JOIN g
JOIN r b ON a.exp_id = b.exp_id AND b.rn = a.rn - g.k GROUP BY 1""",
      lambda s: S.causal_gaussian(s, EXP, ORDER, "value", 2.0))


def _savgol_values() -> str:
    rows = []
    for m in range(5, 12):
        odd = m if m % 2 else m - 1
        half = odd // 2
        x = np.arange(-half, half + 1.0)
        v = np.vander(x, 4, increasing=True)
        c = np.linalg.solve(v.T @ v, v.T)[0]
        for back in range(half + 1):
            rows.append(f"({m}, {back}, {float(c[half:].sum() if back == 0 else c[half - back])!r}::DOUBLE)")
    return ", ".join(rows)


_time("w7_causal_savgol", f""", c AS (SELECT * FROM (VALUES {_savgol_values()}) v(m, back, c)),
r AS (SELECT event_id, exp_id, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY exp_id) AS n, avg(value) OVER {FRAME.format(10, 0)} AS mean FROM series {W}),
s AS (SELECT a.event_id, sum(c.c * b.value) AS v FROM r a JOIN c ON c.m = least(a.rn, 11) JOIN r b ON b.exp_id = a.exp_id AND b.rn = a.rn - c.back GROUP BY 1)
SELECT event_id, round(CASE WHEN n < 5 THEN value WHEN rn < 5 THEN mean ELSE v END, 6) + 0.0 AS smooth FROM r LEFT JOIN s USING (event_id)""",
      lambda s: S.causal_savgol(s, EXP, ORDER, "value", 11, 3))
_time("w9_causal_median", f"SELECT event_id, round(quantile_cont(value, 0.5) OVER {FRAME.format(4, 0)}, 6) + 0.0 AS smooth FROM series",
      lambda s: S.causal_median(s, EXP, ORDER, "value", 5))
_time("w11_centred_median", f"SELECT event_id, round(quantile_cont(value, 0.5) OVER {FRAME.format(3, 3)}, 6) + 0.0 AS smooth FROM series",
      lambda s: S.centred_median(s, EXP, ORDER, "value", 7))
_INWARD = f""", r AS (SELECT event_id, exp_id, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY exp_id) AS n FROM series {W})
SELECT a.event_id, round(CASE WHEN a.n < 10 THEN any_value(a.value) ELSE {{}} END, 6) + 0.0 AS smooth
FROM r a JOIN r b ON a.exp_id = b.exp_id AND (a.n < 10 OR b.i - least(greatest(a.i - 5, 0), a.n - 10) BETWEEN 0 AND 9) GROUP BY a.event_id, a.n"""
_time("w12_inward_median", _INWARD.format("quantile_cont(b.value, 0.5)"), lambda s: S.inward_window(s, EXP, ORDER, "value", 10, "median"))
_time("w12_inward_mean", _INWARD.format("avg(b.value)"), lambda s: S.inward_window(s, EXP, ORDER, "value", 10, "mean"))


def _freq(name, sql, fn):
    @query(name, f"WITH {I.CELLS} " + sql)
    def run(spark, d):
        s = I.spectra(spark, d).select("vec_id", F.posexplode_outer(fn(F.col("power"))).alias("bin", "x"))
        return s.select("vec_id", F.col("bin").cast("long").alias("bin"), I.rounded(F.col("x")).alias("x"))
    return run


_ROWF = "(PARTITION BY vec_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
_freq("w2_frequency_mean", f"SELECT vec_id, bin, round(sum(x) OVER {_ROWF} / 5.0::DOUBLE, 6) + 0.0 AS x FROM cells",
      lambda a: S.frequency_mean(a, 5))
_freq("w4_frequency_ema", """, l AS (SELECT vec_id, bin, list(x) OVER (PARTITION BY vec_id ORDER BY bin) AS xs FROM cells)
SELECT vec_id, bin, round(list_reduce(xs, lambda s, x: 0.3 * x + 0.7 * s), 6) + 0.0 AS x FROM l""",
      lambda a: S.frequency_ema(a, 0.3))
_G6 = [math.exp(-0.5 * (k / 1.5) ** 2) for k in range(-6, 7)]
_freq("w6_frequency_gaussian", f""", g AS (SELECT * FROM (VALUES {', '.join(f'({k - 6}, {w / sum(_G6)!r}::DOUBLE)' for k, w in enumerate(_G6))}) v(k, g))
SELECT a.vec_id, a.bin, round(sum(g.g * b.x), 6) + 0.0 AS x FROM cells a CROSS JOIN g JOIN cells b ON a.vec_id = b.vec_id
 AND b.bin = CASE WHEN a.bin + k < 0 THEN -1 - a.bin - k WHEN a.bin + k > 63 THEN 127 - a.bin - k ELSE a.bin + k END GROUP BY 1, 2""",
      lambda a: S.frequency_gaussian(a, 1.5))


def _frequency_savgol_values() -> str:
    rows, x = [], np.arange(7.0)
    for i in range(I.BINS):
        start = min(max(i - 3, 0), I.BINS - 7)
        v = np.vander(x - (i - start), 4, increasing=True)
        c = np.linalg.solve(v.T @ v, v.T)[0]
        rows += [f"({i}, {start + j}, {float(w)!r}::DOUBLE)" for j, w in enumerate(c)]
    return ", ".join(rows)


_freq("w8_frequency_savgol", f""", c AS (SELECT * FROM (VALUES {_frequency_savgol_values()}) v(bin, src, c))
SELECT a.vec_id, c.bin, round(sum(c.c * a.x), 6) + 0.0 AS x FROM c JOIN cells a ON a.bin = c.src GROUP BY 1, 2""",
      lambda a: S.frequency_savgol(a, 7, 3))
_freq("w10_frequency_median", f""", l AS (SELECT vec_id, bin, list(x) OVER {_ROWF} AS xs FROM cells)
SELECT vec_id, bin, round(list_sort(list_concat(xs, list_resize([]::DOUBLE[], 5 - len(xs), 0.0)))[3], 6) + 0.0 AS x FROM l""",
      lambda a: S.frequency_median(a, 5))

ZFLAG = "abs((value - avg(value) OVER p) / (stddev_pop(value) OVER p + 1e-8)) > 2.0 AS outlier"
P = "WINDOW p AS (PARTITION BY exp_id)"


@query("w14_zscore_mask", SER + f" SELECT event_id, {ZFLAG} FROM series {P}")
def zscore(spark, d):
    return O.flag_zscore(I.series(spark, d), EXP, "value", 2.0).select("event_id", "outlier")


@query("w14_zscore_mask_by_row", f"""WITH {I.CELLS} SELECT vec_id, count(*) FILTER (abs((x - m) / (s + 1e-8)) > 2.0) AS n_outliers
 FROM (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS m, stddev_pop(x) OVER (PARTITION BY vec_id) AS s FROM cells) GROUP BY 1""")
def row_zscore(spark, d):
    mask = O.row_zscore(F.col("power"), 2.0)
    return I.spectra(spark, d).select("vec_id", F.size(F.filter(mask, lambda b: b)).cast("long").alias("n_outliers"))


IQR = f"""iq AS (SELECT *, quantile_cont(value, 0.25) OVER p AS q1, quantile_cont(value, 0.75) OVER p AS q3 FROM series {P}),
fl AS (SELECT *, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS outlier FROM iq)"""


@query("w15_iqr_mask", SER + f", {IQR} SELECT event_id, outlier FROM fl")
def iqr(spark, d):
    return O.flag_iqr(I.series(spark, d), EXP, "value").select("event_id", "outlier")


REPAIR = SER + f", {IQR}, "


def _repair(name, sql, how, places=6):
    @query(name, REPAIR + sql)
    def run(spark, d):
        s = I.series(spark, d)
        peak = group_sizes(s, EXP)[0]
        f = O.flag_iqr(s, EXP, "value", peak=peak)
        out = O.repair(f, EXP, ORDER, "value", "outlier", how, peak)
        return out.select("event_id", I.rounded(F.col("repaired"), places).alias("repaired"))
    return run


_repair("w16_repair_linear", f"""n AS (SELECT *, row_number() OVER w AS rn, count(*) FILTER (NOT outlier) OVER (PARTITION BY exp_id) AS ok FROM fl {W}),
g AS (SELECT * FROM n WHERE NOT outlier), a AS (SELECT n.*, g.rn AS lr, g.value AS lv FROM n ASOF LEFT JOIN g ON n.exp_id = g.exp_id AND n.rn >= g.rn),
b AS (SELECT a.*, g.rn AS rr, g.value AS rv FROM a ASOF LEFT JOIN g ON a.exp_id = g.exp_id AND a.rn <= g.rn)
SELECT event_id, round(CASE WHEN NOT outlier OR ok < 2 THEN value WHEN lr IS NULL THEN rv WHEN rr IS NULL THEN lv
 ELSE lv + (rn - lr) * (rv - lv) / (rr - lr) END, 6) + 0.0 AS repaired FROM b""", "interpolate")
_repair("w17_repair_median", """m AS (SELECT exp_id, quantile_cont(value, 0.5) AS v FROM fl WHERE NOT outlier GROUP BY 1)
SELECT event_id, round(CASE WHEN outlier THEN v ELSE value END, 6) + 0.0 AS repaired FROM fl LEFT JOIN m USING (exp_id)""", "median")
_repair("w17_repair_mean", """m AS (SELECT exp_id, avg(value) AS v FROM fl WHERE NOT outlier GROUP BY 1)
SELECT event_id, round(CASE WHEN outlier THEN v ELSE value END, 8) + 0.0 AS repaired FROM fl LEFT JOIN m USING (exp_id)""", "mean", 8)
_repair("w18_repair_clip", """m AS (SELECT exp_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM fl WHERE NOT outlier GROUP BY 1),
z AS (SELECT exp_id, bool_or(outlier) AS bad FROM fl GROUP BY 1)
SELECT event_id, round(CASE WHEN bad THEN least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)) ELSE value END, 6) + 0.0 AS repaired
FROM fl LEFT JOIN m USING (exp_id) JOIN z USING (exp_id)""", "clip")


@query("w13_smoothing_chain", f"""WITH {I.CELLS}, st AS (SELECT *, avg(x) OVER p AS m, stddev_pop(x) OVER p AS s FROM cells WINDOW p AS (PARTITION BY label, bin)),
f AS (SELECT *, abs((x - m) / (s + 1e-8)) > 2.0 AS bad FROM st),
r AS (SELECT vec_id, label, bin, CASE WHEN bad THEN avg(x) FILTER (NOT bad) OVER (PARTITION BY label, bin) ELSE x END AS x FROM f),
t AS (SELECT vec_id, bin, avg(x) OVER (PARTITION BY label, bin ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS x FROM r)
SELECT vec_id, bin, round(sum(x) OVER (PARTITION BY vec_id ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0::DOUBLE, 6) + 0.0 AS x FROM t""")
def chain(spark, d):
    out = S.smooth_spectra(I.spectra(spark, d), ["label"], ["vec_id"], "moving_average", {"width": 3},
                           "moving_average", {"width": 3}, "zscore", 2.0, "mean")
    cells = out.select("vec_id", F.posexplode_outer("power").alias("bin", "x"))
    return cells.select("vec_id", F.col("bin").cast("long").alias("bin"), I.rounded(F.col("x")).alias("x"))


@query("w13_outlier_report", f"""WITH {I.CELLS}, st AS (SELECT *, avg(x) OVER p AS m, stddev_pop(x) OVER p AS s FROM cells WINDOW p AS (PARTITION BY label, bin))
SELECT count(*) FILTER (abs((x - m) / (s + 1e-8)) > 2.0) AS n_outliers, round(avg(CASE WHEN abs((x - m) / (s + 1e-8)) > 2.0 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS outlier_ratio FROM st""")
def outlier_report(spark, d):
    long = S.explode_bins(I.spectra(spark, d), ["label", "vec_id"])
    f = O.flag_zscore(long, ["label", "bin"], "x", 2.0)
    return f.agg(F.count_if("outlier").alias("n_outliers"), I.rounded(F.avg(F.col("outlier").cast("double"))).alias("outlier_ratio"))


@query("w19_fill", SER + f""", g AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS x FROM series)
SELECT event_id, round(coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY exp_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(x IGNORE NULLS) OVER (PARTITION BY exp_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0), 6) + 0.0 AS x FROM g""")
def fill(spark, d):
    s = I.series(spark, d).withColumn("x", F.when(F.col("event_type") == "purchase", F.col("value")))
    return O.filled(s, EXP, ORDER, ["x"]).select("event_id", I.rounded(F.col("x")).alias("x"))


@query("p15_clean_rate", SER + f""", g AS (SELECT *, CASE WHEN value BETWEEN 50 AND 100 THEN value END AS x FROM series)
SELECT event_id, round(coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY exp_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(x IGNORE NULLS) OVER (PARTITION BY exp_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0.0 AS rate FROM g""")
def clean_rate(spark, d):
    s = I.series(spark, d).withColumn("rate", F.when(F.col("value").between(50, 100), F.col("value")))
    return O.filled(s, EXP, ORDER, ["rate"], zero=False).select("event_id", I.rounded(F.col("rate")).alias("rate"))
