"""Split strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoband.operators import splits as X
from chronoband.plans import inputs as I
from chronoband.plans.registry import query

ORDER = ["us", "event_id"]
SER = f"WITH {I.SERIES}"
N = "count(*) OVER ()"


def _days(spark, d):
    return I.series(spark, d).withColumn("day", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd"))


DAYS = SER + ", rows_ AS (SELECT *, strftime(make_timestamp(us), '%Y-%m-%d') AS day FROM series)"


def _out(df):
    return df.select("event_id", "split")


RANK = "row_number() OVER (ORDER BY md5(event_id || ':42'), event_id)"


@query("x1_random", SER + f""", r AS (SELECT event_id, {RANK} AS rn, {N} AS n FROM series), s AS (SELECT *, ceil(round(n * 0.15, 9)) AS nt FROM r)
SELECT event_id, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + ceil(round((n - nt) * (0.15::DOUBLE / 0.85::DOUBLE), 9)) THEN 'val' ELSE 'train' END AS split FROM s""")
def random(spark, d):
    return _out(X.random(I.series(spark, d), "event_id"))


@query("x1_random_without_validation", SER + f""", r AS (SELECT event_id, {RANK} AS rn, {N} AS n FROM series)
SELECT event_id, CASE WHEN rn <= ceil(n * 0.3) THEN 'test' ELSE 'train' END AS split FROM r""")
def random_two(spark, d):
    return _out(X.random(I.series(spark, d), "event_id", 0.7, 0.0, 0.3))


@query("x2_temporal", SER + f""", r AS (SELECT event_id, row_number() OVER (ORDER BY exp_id, us, event_id) AS rn, {N} AS n FROM series)
SELECT event_id, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r""")
def temporal(spark, d):
    return _out(X.temporal(I.series(spark, d), ["exp_id", "us", "event_id"]))


@query("x3_stratified", SER + """, m AS (SELECT min(value) AS lo, max(value) AS hi FROM series),
b AS (SELECT event_id, (value >= lo + 1 * (hi - lo) / 5)::INT + (value >= lo + 2 * (hi - lo) / 5)::INT + (value >= lo + 3 * (hi - lo) / 5)::INT + (value >= lo + 4 * (hi - lo) / 5)::INT AS bin FROM series, m),
c AS (SELECT bin, count(*) AS c FROM b GROUP BY 1), w AS (SELECT *, ceil(round(sum(c) OVER () * 0.15, 9)) AS want, c * ceil(round(sum(c) OVER () * 0.15, 9)) / sum(c) OVER ()::DOUBLE AS ex FROM c),
t AS (SELECT *, floor(ex) + CASE WHEN row_number() OVER (ORDER BY ex - floor(ex) DESC, bin) <= want - sum(floor(ex)) OVER () THEN 1 ELSE 0 END AS nt FROM w),
v AS (SELECT *, c - nt AS rest, ceil(round((sum(c) OVER () - want) * (0.15::DOUBLE / 0.85::DOUBLE), 9)) AS wv FROM t), x AS (SELECT *, rest * wv / sum(rest) OVER ()::DOUBLE AS ev FROM v),
y AS (SELECT *, floor(ev) + CASE WHEN row_number() OVER (ORDER BY ev - floor(ev) DESC, bin) <= wv - sum(floor(ev)) OVER () THEN 1 ELSE 0 END AS nv FROM x),
r AS (SELECT b.*, nt, nv, row_number() OVER (PARTITION BY b.bin ORDER BY md5(event_id || ':42'), event_id) AS rn FROM b JOIN y USING (bin))
SELECT event_id, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + nv THEN 'val' ELSE 'train' END AS split FROM r""")
def stratified(spark, d):
    return _out(X.stratified(I.series(spark, d), "event_id", "value"))


@query("x4_experiment", SER + f""", e AS (SELECT exp_id, row_number() OVER (ORDER BY md5(exp_id || ':42'), exp_id) AS rn, {N} AS n FROM (SELECT DISTINCT exp_id FROM series)),
p AS (SELECT *, greatest(1, floor(n * 0.7::DOUBLE)) AS a, greatest(1, floor(n * 0.15::DOUBLE)) AS b FROM e)
SELECT event_id, CASE WHEN rn <= a THEN 'train' WHEN rn <= a + b THEN 'val' ELSE 'test' END AS split FROM series JOIN p USING (exp_id)""")
def by_experiment(spark, d):
    return _out(X.by_experiment(I.series(spark, d), "exp_id"))


def _alt(part, cnt, body):
    return SER + f""", r AS (SELECT event_id, row_number() OVER ({part} ORDER BY us, event_id) AS rn, count(*) OVER ({part}) AS n FROM series),
s AS (SELECT *, CASE WHEN n >= {cnt} THEN least((rn - 1) // (n // {cnt}), {cnt} - 1) END AS i FROM r) SELECT event_id, {body} AS split FROM s"""


ALT = "CASE WHEN i % 2 = 0 THEN 'train' WHEN ((i + 1) // 2) % 3 = 1 THEN 'val' WHEN i IS NOT NULL THEN 'test' END"
HYB = "CASE WHEN i < 5 OR (i - 5) % 2 = 0 THEN 'train' WHEN ((i - 4) // 2) % 3 = 1 THEN 'val' WHEN i IS NOT NULL THEN 'test' END"


@query("x5_alternating_by_experiment", _alt("PARTITION BY exp_id", 10, ALT))
def alternating(spark, d):
    return _out(X.alternating(I.series(spark, d), ORDER, ["exp_id"]))


@query("x5_alternating_global", _alt("", 10, "CASE WHEN i % 2 = 0 THEN 'train' ELSE 'test' END"))
def alternating_global(spark, d):
    return _out(X.alternating(I.series(spark, d), ORDER, use_val=False))


@query("x6_hybrid_alternating", _alt("PARTITION BY exp_id", 10, HYB))
def hybrid(spark, d):
    return _out(X.hybrid_alternating(I.series(spark, d), ORDER, ["exp_id"]))


@query("x7_date", DAYS + """, c AS (SELECT day, count(*) AS c FROM rows_ GROUP BY 1), w AS (SELECT *, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n, sum(c) OVER (ORDER BY day) AS cum, sum(c) OVER () AS total FROM c),
k AS (SELECT *, count(*) FILTER (cum < total * 0.7::DOUBLE) OVER () + 1 AS c1, count(*) FILTER (cum < total * (0.7::DOUBLE + 0.15::DOUBLE)) OVER () + 1 AS c2 FROM w),
a AS (SELECT *, greatest(1, least(c1, greatest(1, n - 2))) AS a FROM k), b AS (SELECT *, greatest(a + 1, least(c2, greatest(a + 1, n - 1))) AS b FROM a)
SELECT event_id, CASE WHEN i <= a THEN 'train' WHEN i <= b THEN 'val' ELSE 'test' END AS split FROM rows_ JOIN b USING (day)""")
def by_date(spark, d):
    return _out(X.by_date(_days(spark, d), "day"))


DR = """h AS (SELECT *, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY md5(day || ':' || (42 + run)), day) AS i FROM dd),
t AS (SELECT *, i <= greatest(1, least({want}, greatest(1, n - 2))) AS tr FROM h),
p AS (SELECT *, count(*) FILTER (NOT tr) OVER (PARTITION BY run) AS lft, row_number() OVER (PARTITION BY run, tr ORDER BY day) AS pos FROM t),
z AS (SELECT *, CASE WHEN tr THEN 'train' WHEN pos <= greatest(1, least(round_even(lft * 0.5::DOUBLE, 0), lft - 1)) THEN 'val' ELSE 'test' END AS split FROM p)"""


@query("x8_date_random", DAYS + ", dd AS (SELECT DISTINCT day, 0 AS run FROM rows_), " + DR.format(want="round_even(n * 0.7::DOUBLE, 0)")
       + " SELECT event_id, split FROM rows_ JOIN z USING (day)")
def date_random(spark, d):
    return _out(X.by_date_random(_days(spark, d), "day"))


@query("x8_date_random_repeats", DAYS + ", dd AS (SELECT day, count(*) AS c, run FROM rows_ CROSS JOIN (SELECT unnest(range(5))::INT AS run) GROUP BY day, run), " + DR.format(want="9")
       + " SELECT run, split, count(*) AS n_days, sum(c)::BIGINT AS n_rows, min(day) AS first_day, max(day) AS last_day FROM z GROUP BY 1, 2")
def repeats(spark, d):
    return X.repeated_date_random(_days(spark, d), "day", 5, train_days=9)


@query("x9_max_day_train_min_day_test", DAYS + """, c AS (SELECT day, count(*) AS c FROM rows_ GROUP BY 1),
k AS (SELECT (SELECT day FROM c ORDER BY c DESC, day LIMIT 1) AS a, (SELECT day FROM c ORDER BY c, day LIMIT 1) AS b, min(day) AS f, max(day) AS l FROM c)
SELECT event_id, CASE WHEN day = CASE WHEN a = b THEN f ELSE a END THEN 'train' WHEN day = CASE WHEN a = b THEN l ELSE b END THEN 'test' END AS split FROM rows_, k""")
def max_min(spark, d):
    return _out(X.max_day_train_min_day_test(_days(spark, d), "day"))


@query("x10_file_temporal", SER + """, r AS (SELECT event_id, row_number() OVER (PARTITION BY exp_id, event_type ORDER BY us, event_id) AS rn, count(*) OVER (PARTITION BY exp_id, event_type) AS n FROM series)
SELECT event_id, CASE WHEN rn <= greatest(1, least(floor(n * 0.8::DOUBLE), n - 1)) THEN 'train' ELSE 'test' END AS split FROM r""")
def file_temporal(spark, d):
    return _out(X.by_file_temporal(I.series(spark, d), ["exp_id", "event_type"], ORDER))


@query("x11_cross_user", SER + """, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM series WHERE event_type IN ('view', 'click'))
SELECT event_id, CASE WHEN event_type = 'view' THEN 'train' WHEN rn <= greatest(1, floor(n * 0.4::DOUBLE)) THEN 'test' END AS split FROM r""")
def cross_user(spark, d):
    return _out(X.cross_user(I.series(spark, d), "event_type", "view", "click", ORDER, 0.4))


@query("x12_multi_user_independent", SER + """, r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || ':42'), event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM series)
SELECT event_id, CASE WHEN rn <= ceil(round(n * 0.15, 9)) THEN 'test' ELSE 'train' END AS split FROM r""")
def per_user(spark, d):
    return _out(X.per_user_random(I.series(spark, d), "event_type", "event_id"))


DER = f"""r AS (SELECT event_id, value, {RANK} AS rn, {N} AS n FROM series),
m AS (SELECT a.event_id, b.value, a.rn, a.n FROM r a JOIN r b ON b.rn = CASE WHEN a.rn = a.n THEN 1 ELSE a.rn + 1 END)"""


@query("n15_label_derangement", SER + f", {DER} SELECT event_id, value FROM m")
def derangement(spark, d):
    return X.deranged(I.series(spark, d), "event_id", ["value"]).select("event_id", "value")


@query("x13_label_shuffle_debug", SER + f""", {DER}, s AS (SELECT *, ceil(round(n * 0.15, 9)) AS nt FROM m)
SELECT event_id, value, CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + ceil(round((n - nt) * (0.15::DOUBLE / 0.85::DOUBLE), 9)) THEN 'val' ELSE 'train' END AS split FROM s""")
def label_shuffle(spark, d):
    return X.label_shuffle(I.series(spark, d), "event_id", "value").select("event_id", "value", "split")


CUT = "CASE WHEN rn <= greatest(1, least(ceil(round(n * 0.7, 9)), n - 1)) THEN 'train' ELSE 'test' END AS split"


@query("x14_diagnostic_random", SER + f", r AS (SELECT event_id, {RANK} AS rn, {N} AS n FROM series) SELECT event_id, {CUT} FROM r")
def diagnostic_random(spark, d):
    return _out(X.diagnostic_random(I.series(spark, d), "event_id"))


def _diag_unit(src, unit):
    return f""", u AS (SELECT {unit}, min(us) AS t FROM {src} GROUP BY 1), r AS (SELECT {unit}, row_number() OVER (ORDER BY t, {unit}) AS rn, {N} AS n FROM u)
SELECT event_id, {CUT} FROM {src} JOIN r USING ({unit})"""


@query("x14_diagnostic_date", DAYS + _diag_unit("rows_", "day"))
def diagnostic_date(spark, d):
    return _out(X.diagnostic_by_first_time(_days(spark, d), "day", "us"))


@query("x14_diagnostic_experiment", SER + _diag_unit("series", "exp_id"))
def diagnostic_experiment(spark, d):
    return _out(X.diagnostic_by_first_time(I.series(spark, d), "exp_id", "us"))


@query("x14_diagnostic_alternating", SER + """, r AS (SELECT event_id, row_number() OVER (PARTITION BY exp_id ORDER BY us, event_id) AS rn, count(*) OVER (PARTITION BY exp_id) AS n FROM series)
SELECT event_id, CASE WHEN n < 4 OR least(floor((rn - 1) * (10.0::DOUBLE / n)), 9)::INT % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM r""")
def diagnostic_alternating(spark, d):
    return _out(X.diagnostic_alternating(I.series(spark, d), ["exp_id"], ORDER))


THREE = """u AS (SELECT day, min(us) AS t FROM rows_ GROUP BY 1), q AS (SELECT day, row_number() OVER (ORDER BY t, day) AS i, count(*) OVER () AS n FROM u),
e AS (SELECT day, i, CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM q)"""


@query("x15_three_way_dates", DAYS + f", {THREE} SELECT event_id, split FROM rows_ JOIN e USING (day)")
def three_way(spark, d):
    return _out(X.three_way_dates(_days(spark, d), "day", "us"))


@query("x16_dispatch", SER + f""", r AS (SELECT event_id, row_number() OVER (ORDER BY exp_id, us, event_id) AS rn, {N} AS n FROM series)
SELECT event_id, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r""")
def dispatch(spark, d):
    return _out(X.split(I.series(spark, d), "temporal", order=["exp_id", "us", "event_id"], train=0.8, val=0.0, test=0.2))


@query("x17_shuffled_parts", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM events")
def shuffled_parts(spark, d):
    s = I.series(spark, d).withColumn("split", F.when(F.col("event_id") % 4 == 0, "test").otherwise("train"))
    return _out(X.shuffled(s, "event_id", 42))
