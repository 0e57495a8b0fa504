"""Windows, histories, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoband.operators import histories as H
from chronoband.operators.ordered import time_framed
from chronoband.plans import inputs as I
from chronoband.plans.registry import query

EXP, ORDER = ["exp_id"], ["us", "event_id"]
SER = f"WITH {I.SERIES}"
W = "WINDOW w AS (PARTITION BY exp_id ORDER BY us, event_id)"
DAY = 24 * I.HOUR
R = f"r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY exp_id) AS n FROM series {W})"


def _cells(df, column="history", value="v"):
    x = df.select("event_id", F.posexplode_outer(column).alias("pos", value))
    return x.select("event_id", F.col("pos").cast("long").alias("pos"), I.rounded(F.col(value)).alias(value))


def _count_sql(width, keep, pad):
    return SER + f""", {R}, p AS (SELECT unnest(range({width})) AS pos)
SELECT a.event_id, p.pos, round(CASE WHEN a.rn - {width} + p.pos < 1 THEN {pad} ELSE b.value END, 6) + 0.0 AS v FROM r a CROSS JOIN p
LEFT JOIN r b ON b.exp_id = a.exp_id AND b.rn = a.rn - {width} + p.pos LEFT JOIN r f ON f.exp_id = a.exp_id AND f.rn = 1 WHERE a.rn > {keep}"""


for _pad, _keep, _expr in (("drop", 4, "NULL"), ("zero", 1, "0.0"), ("edge", 1, "f.value"), ("repeat", 1, "f.value")):
    @query(f"l4_count_window_{_pad}", _count_sql(4, _keep, _expr))
    def count_window(spark, d, pad=_pad):
        return _cells(H.count_windows(I.series(spark, d), EXP, ORDER, "value", 4, pad))


@query("l4_count_window_spectra", f"""WITH {I.CELLS}, r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM (SELECT DISTINCT vec_id, label FROM cells))
SELECT a.vec_id, round(sum(c.x * (c.bin + 1) * (4 - a.rn + b.rn)), 5) + 0.0 AS checksum FROM r a JOIN r b ON a.label = b.label AND b.rn BETWEEN a.rn - 3 AND a.rn - 1
JOIN cells c ON c.vec_id = b.vec_id WHERE a.rn > 3 GROUP BY 1""")
def spectra_window(spark, d):
    w = H.count_windows(I.spectra(spark, d), ["label"], ["vec_id"], "power", 3)
    per_row = F.transform("history", lambda a, k: F.aggregate(
        F.transform(a, lambda x, i: x * (i + 1) * (k + 1)), F.lit(0.0), lambda s, x: s + x))
    return w.select("vec_id", I.rounded(F.aggregate(per_row, F.lit(0.0), lambda s, x: s + x), 5).alias("checksum"))


@query("l5_lazy_window_index", SER + f", {R} SELECT event_id, rn AS stop, rn - 10 AS start FROM r WHERE rn > 10")
def lazy(spark, d):
    return H.window_index(I.series(spark, d), EXP, ORDER, 10).select("event_id", "stop", "start")


@query("j5_interval_join", SER + f""" SELECT a.event_id, count(b.event_id) AS n_rows, round(sum(b.value), 6) + 0.0 AS total FROM series a
 LEFT JOIN series b ON a.exp_id = b.exp_id AND b.us >= a.us - {2 * DAY} AND b.us < a.us GROUP BY 1""")
def interval(spark, d):
    frame = lambda w: w.rangeBetween(-2 * DAY, -1)
    x = time_framed(I.series(spark, d), EXP, "us", 2 * DAY, {
        "n_rows": lambda w: F.count("event_id").over(frame(w)), "total": lambda w: F.sum("value").over(frame(w))})
    return x.select("event_id", "n_rows", I.rounded(F.col("total")).alias("total"))


@query("j5_interval_join_closed", SER + f""" SELECT a.event_id, count(b.event_id) AS n_rows, min(b.event_id) AS first_id FROM series a
 LEFT JOIN series b ON a.exp_id = b.exp_id AND b.us BETWEEN a.us - {2 * DAY} AND a.us GROUP BY 1""")
def interval_closed(spark, d):
    frame = lambda w: w.rangeBetween(-2 * DAY, 0)
    x = time_framed(I.series(spark, d), EXP, "us", 2 * DAY, {
        "n_rows": lambda w: F.count("event_id").over(frame(w)), "first_id": lambda w: F.min("event_id").over(frame(w))})
    return x.select("event_id", "n_rows", "first_id")


TW = SER + f""", g AS (SELECT a.event_id, a.exp_id, a.us, {{grid}} FROM series a {{cross}}),
b AS (SELECT g.*, s.us AS bus, s.value AS bv FROM g JOIN series s ON s.exp_id = g.exp_id AND s.us >= g.us - {3 * DAY} AND s.us < g.us)"""


@query("l6_time_window_grid", TW.format(grid=f"i AS pos, a.us - {3 * DAY} + i * {DAY // 2} AS gt", cross="CROSS JOIN generate_series(0, 5) AS q(i)")
       + " SELECT event_id, pos, round(arg_min(bv, abs(bus - gt) * 2 + CASE WHEN bus > gt THEN 1 ELSE 0 END), 6) + 0.0 AS v FROM b GROUP BY 1, 2")
def time_grid(spark, d):
    return _cells(H.time_windows(I.series(spark, d), EXP, "us", "value", "value", 3 * DAY, DAY // 2, tie=["event_id"]))


@query("l6_time_window_padded", SER + f""", b AS (SELECT a.event_id, s.us AS bus, s.value AS bv, row_number() OVER (PARTITION BY a.event_id ORDER BY s.us DESC) AS back,
 count(*) OVER (PARTITION BY a.event_id) AS m FROM series a JOIN series s ON s.exp_id = a.exp_id AND s.us >= a.us - {DAY} AND s.us < a.us),
w AS (SELECT max(m) AS width FROM b), p AS (SELECT unnest(range(width)) AS pos, width FROM w), e AS (SELECT DISTINCT event_id, m FROM b)
SELECT e.event_id, p.pos, round(b.bv, 6) + 0.0 AS v FROM e CROSS JOIN p JOIN b ON b.event_id = e.event_id AND b.back = least(width - pos, e.m)""")
def time_padded(spark, d):
    return _cells(H.time_windows(I.series(spark, d), EXP, "us", "value", "value", DAY, tie=["event_id"]))


@query("l7_rf_image_index", SER + f""", f AS (SELECT exp_id, min(us) AS t0 FROM series GROUP BY 1)
SELECT a.event_id, arg_min(b.event_id, row(b.us, b.event_id)) AS start, round(avg(b.value), 7) + 0.0 AS mean_label FROM series a JOIN f USING (exp_id)
JOIN series b ON a.exp_id = b.exp_id AND b.us BETWEEN a.us - {2 * DAY} AND a.us WHERE t0 <= a.us - {2 * DAY} GROUP BY 1 HAVING count(*) >= 2""")
def rf_index(spark, d):
    x = H.rf_image_index(I.series(spark, d), EXP, "us", "event_id", "value", 2 * DAY)
    return x.select("event_id", "start", I.rounded(F.col("mean_label"), 7).alias("mean_label"))


RF_US = 1_000_000
_RF_REACH = 40 * RF_US


@query("i10_rf_image", f"""WITH {I.CELLS}, g AS (SELECT v.vec_id, v.label, q.i AS row_no, v.us - 40000000.0::DOUBLE + q.i * (40000000.0::DOUBLE / 3) AS gt, v.us FROM
 (SELECT DISTINCT vec_id, label, vec_id * 1000000 AS us FROM cells) v CROSS JOIN generate_series(0, 3) AS q(i)),
w AS (SELECT g.*, b.us AS bus, b.vec_id AS bid FROM g JOIN (SELECT DISTINCT vec_id, label, vec_id * 1000000 AS us FROM cells) b ON b.label = g.label AND b.us BETWEEN g.us - 40000000 AND g.us),
n AS (SELECT vec_id, row_no, gt, count(*) AS n, count(*) FILTER (bus < gt) AS c, list(bid ORDER BY bus) AS ids, list(bus ORDER BY bus) AS ts FROM w GROUP BY 1, 2, 3),
r AS (SELECT *, least(greatest(c, 1), n - 1) AS rt FROM n),
z AS (SELECT vec_id, row_no, ids[CASE WHEN n = 1 THEN 1 ELSE rt END] AS a, ids[CASE WHEN n = 1 THEN 1 ELSE rt + 1 END] AS b,
 CASE WHEN n = 1 THEN 0 ELSE least(greatest((gt - ts[rt]) / (ts[rt + 1] - ts[rt]), 0), 1) END AS share FROM r)
SELECT z.vec_id, z.row_no, p.bin, round(p.x * (1 - share) + q.x * share, 6) + 0.0 AS x FROM z JOIN cells p ON p.vec_id = z.a JOIN cells q ON q.vec_id = z.b AND q.bin = p.bin""")
def rf(spark, d):
    s = I.spectra(spark, d).withColumn("us", F.col("vec_id") * RF_US)
    x = H.rf_image(s, ["label"], "us", "power", _RF_REACH, 4)
    rows = x.select("vec_id", F.posexplode_outer("image").alias("row_no", "r"))
    cells = rows.select("vec_id", "row_no", F.posexplode_outer("r").alias("bin", "x"))
    return cells.select("vec_id", F.col("row_no").cast("long").alias("row_no"), F.col("bin").cast("long").alias("bin"), I.rounded(F.col("x")).alias("x"))


def _hist_sql(shift):
    return SER + f""", {R}, p AS (SELECT unnest(range(3)) AS pos)
SELECT a.event_id, p.pos, round(coalesce(b.value, CASE WHEN a.rn = 1 THEN a.value ELSE f.value END), 6) + 0.0 AS v FROM r a CROSS JOIN p
LEFT JOIN r b ON b.exp_id = a.exp_id AND b.rn = a.rn - {shift} + p.pos LEFT JOIN r f ON f.exp_id = a.exp_id AND f.rn = 1"""


@query("l8_label_history_aligned", _hist_sql(3))
def history_aligned(spark, d):
    return _cells(H.label_history(I.series(spark, d), EXP, ORDER, "value", 3), "label_history")


@query("l8_label_history_current", _hist_sql(2))
def history_current(spark, d):
    return _cells(H.label_history(I.series(spark, d), EXP, ORDER, "value", 3, aligned=False), "label_history")


@query("l9_history_from_window", TW.format(grid=f"i AS pos, a.us - {3 * DAY} + i * {DAY // 2} AS gt", cross="CROSS JOIN generate_series(0, 5) AS q(i)")
       + """ SELECT event_id, pos - 2 AS pos, round(arg_min(bv, abs(bus - gt) * 2 + CASE WHEN bus > gt THEN 1 ELSE 0 END), 6) + 0.0 AS v FROM b WHERE pos BETWEEN 2 AND 4 GROUP BY event_id, pos""")
def history_window(spark, d):
    x = H.time_windows(I.series(spark, d), EXP, "us", "value", "value", 3 * DAY, DAY // 2, tie=["event_id"])
    return _cells(x.withColumn("h", H.history_from_window(F.col("label_history"), 3)), "h")


@query("l10_resampled_history", SER + f""", g AS (SELECT a.event_id, a.exp_id, a.us, i AS pos, a.us - (4 - i) * {DAY // 2} AS gt FROM series a CROSS JOIN generate_series(0, 3) AS q(i))
SELECT g.event_id, g.pos, round(coalesce(arg_min(s.value, abs(s.us - gt) * 2 + CASE WHEN s.us > gt THEN 1 ELSE 0 END), 5.0), 6) + 0.0 AS v
FROM g LEFT JOIN series s ON s.exp_id = g.exp_id AND s.us >= g.us - {3 * DAY} AND s.us < g.us GROUP BY 1, 2""")
def resampled(spark, d):
    return _cells(H.resampled_history(I.series(spark, d), EXP, "us", "value", 4, DAY // 2, 3 * DAY))


@query("l2_uniform_thinning", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS p, count(*) OVER () AS n FROM events),
k AS (SELECT CASE WHEN i = 499 THEN n - 1 ELSE floor(i * ((n - 1) / 499.0::DOUBLE)) END AS p FROM (SELECT DISTINCT n FROM r) CROSS JOIN generate_series(0, 499) AS q(i))
SELECT event_id FROM r WHERE n <= 500 OR p IN (SELECT p FROM k)""")
def thinning(spark, d):
    return H.thinned(I.series(spark, d), ORDER, 500).select("event_id")


@query("l3_fixed_sample", "SELECT event_id, value FROM events ORDER BY md5(event_id || ':42'), event_id LIMIT 400")
def sample(spark, d):
    return H.fixed_sample(I.series(spark, d), "event_id", 400, 42).select("event_id", "value")


@query("l4_train_overlap", SER + f""", s AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM series),
o AS (SELECT event_id, split, coalesce(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) OVER (PARTITION BY exp_id ORDER BY us, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS train_rows FROM s)
SELECT event_id, train_rows FROM o WHERE split = 'test'""")
def overlap(spark, d):
    s = I.series(spark, d).withColumn("split", F.when(F.col("event_id") % 4 == 0, "test").otherwise("train"))
    return H.window_overlap(s, EXP, ORDER, 5, "split").select("event_id", "train_rows")
