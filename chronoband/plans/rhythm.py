"""Gaps, slopes, phases, segments, pulse signals and per-second features."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoband.functions import timekeys as K
from chronoband.operators import auxiliary as X
from chronoband.operators import rhythm as R
from chronoband.operators import seconds as B
from chronoband.operators.ordered import indexed
from chronoband.plans import inputs as I
from chronoband.plans.registry import query

EXP, ORDER = ["exp_id"], ["us", "event_id"]
SER = f"WITH {I.SERIES}"
W = "WINDOW w AS (PARTITION BY exp_id ORDER BY us, event_id)"


@query("w20_sampling_gaps", SER + f""", g AS (SELECT exp_id, t, t - lag(t) OVER w AS gap FROM series {W})
SELECT exp_id, count(*) AS n_rows, round(max(t) - min(t), 6) + 0.0 AS span, count(*) FILTER (gap > 20) AS n_gaps,
 round(quantile_cont(gap, 0.5), 6) + 0.0 AS gap_median, round(1 / quantile_cont(gap, 0.5), 6) + 0.0 AS rate FROM g GROUP BY 1""")
def gaps(spark, d):
    g = R.gap_report(I.series(spark, d), EXP, ORDER, "t", 10.0)
    return g.select("exp_id", "n_rows", I.rounded(F.col("span")).alias("span"), "n_gaps",
                    I.rounded(F.col("gap_median")).alias("gap_median"), I.rounded(F.col("rate")).alias("rate"))


GRAD = f"""n AS (SELECT *, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b, lag({{v}}) OVER w AS vp, lead({{v}}) OVER w AS vn FROM {{src}} {W}),
gr AS (SELECT *, 60.0::DOUBLE * CASE WHEN a IS NULL THEN (vn - {{v}}) / b WHEN b IS NULL THEN ({{v}} - vp) / a
 ELSE (a * a * vn + (b * b - a * a) * {{v}} - b * b * vp) / (a * b * (a + b)) END AS slope FROM n)"""


@query("w21_uneven_gradient", SER + ", " + GRAD.format(v="value", src="series") + " SELECT event_id, round(slope, 4) + 0.0 AS slope FROM gr")
def gradient(spark, d):
    return R.gradient(I.series(spark, d), EXP, ORDER, "t", "value").select("event_id", I.rounded(F.col("slope"), 4).alias("slope"))


PHASE = (SER + """, sm AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY exp_id ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM series), """
         + GRAD.format(v="smooth", src="sm") + """, th AS (SELECT exp_id, greatest(quantile_cont(abs(slope), 0.7), 20.0) AS thr FROM gr GROUP BY 1),
ph AS (SELECT gr.*, thr, CASE WHEN slope > thr THEN 'rise' WHEN slope < -thr THEN 'fall' ELSE 'flat' END AS phase FROM gr JOIN th USING (exp_id))""")


def phased(spark, d):
    return R.phases(I.series(spark, d), EXP, ORDER, "t", "value", 5, 0.7, 20.0)


@query("w22_phases", PHASE + " SELECT event_id, round(smooth, 6) + 0.0 AS smooth, round(thr, 4) + 0.0 AS threshold, phase FROM ph")
def phases(spark, d):
    return phased(spark, d).select("event_id", I.rounded(F.col("smooth")).alias("smooth"),
                                   I.rounded(F.col("threshold"), 4).alias("threshold"), "phase")


SEG = f""", r AS (SELECT *, row_number() OVER w AS idx FROM series {W}),
k AS (SELECT * FROM r WHERE event_type <> 'error'),
g AS (SELECT *, t - lag(t) OVER w AS gap, abs(idx - lag(idx) OVER w) AS step FROM k {W}),
l AS (SELECT exp_id, 5.0 * quantile_cont(gap, 0.5) AS lim FROM g WHERE gap > 0 GROUP BY 1)
SELECT event_id, sum(CASE WHEN gap > coalesce(lim, 5.0) OR gap < 0 OR {{jump}} THEN 1 ELSE 0 END) OVER w::BIGINT AS segment FROM g LEFT JOIN l USING (exp_id) {W}"""


def _kept(spark, d):
    return indexed(I.series(spark, d), EXP, ORDER, "idx").filter("event_type <> 'error'")


@query("w23_segments_by_time_and_index", SER + SEG.format(jump="step > 2"))
def segments(spark, d):
    return R.segments(_kept(spark, d), EXP, ORDER, "t", "idx").select("event_id", "segment")


@query("w23_segments_by_experiment", SER + SEG.format(jump="false"))
def segments_by_time(spark, d):
    return R.segments(_kept(spark, d), EXP, ORDER, "t").select("event_id", "segment")


@query("w24_index_gaps", SER + f""", r AS (SELECT *, row_number() OVER w AS idx FROM series {W}), k AS (SELECT * FROM r WHERE event_type <> 'error'),
g AS (SELECT *, lead(t) OVER w AS nt, lead(idx) OVER w AS ni FROM k {W})
SELECT event_id, round(t, 6) + 0.0 AS gap_start, round(nt, 6) + 0.0 AS gap_end FROM g WHERE ni - idx > 1""")
def index_gaps(spark, d):
    return R.index_gaps(_kept(spark, d), EXP, ORDER, "t", "idx").select(
        "event_id", I.rounded(F.col("gap_start")).alias("gap_start"), I.rounded(F.col("gap_end")).alias("gap_end"))


FR = "OVER (PARTITION BY event_type ORDER BY us, event_id ROWS BETWEEN 50 PRECEDING AND 49 FOLLOWING)"


@query("w25_spo2", f"""{SER}, x AS (SELECT *, value + 100 AS red, (event_id * 37) % 101 + 150.0::DOUBLE AS ir FROM series),
f AS (SELECT *, stddev_pop(red) {FR} AS ra, avg(red) {FR} AS rd, stddev_pop(ir) {FR} AS ia, avg(ir) {FR} AS id, count(*) {FR} AS m FROM x),
v AS (SELECT *, CASE WHEN m > 10 AND rd > 0 AND id > 0 AND ia > 0 THEN least(greatest(110 - 25 * (ra / rd) / (ia / id), 70), 100) ELSE 0 END AS v FROM f)
SELECT event_id, round(sum(v) OVER (PARTITION BY event_type ORDER BY us, event_id ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) / 50.0::DOUBLE, 6) + 0.0 AS spo2 FROM v""")
def spo2(spark, d):
    s = I.series(spark, d).withColumn("red", F.col("value") + 100).withColumn("ir", (F.col("event_id") * 37) % 101 + F.lit(150.0))
    return R.spo2(s, ["event_type"], ORDER, "red", "ir").select("event_id", I.rounded(F.col("spo2")).alias("spo2"))


@query("w26_heart_rate", SER + f""", r AS (SELECT *, row_number() OVER w AS rn FROM series {W}), m AS (SELECT *, CASE WHEN event_type = 'click' AND rn > 1 THEN rn END AS mk FROM r),
f AS (SELECT *, count(mk) OVER z AS c, min(mk) OVER z AS a, max(mk) OVER z AS b FROM m WINDOW z AS (PARTITION BY exp_id ORDER BY us, event_id ROWS BETWEEN 19 PRECEDING AND 19 FOLLOWING)),
h AS (SELECT *, CASE WHEN c > 1 THEN 120.0::DOUBLE * (c - 1) / (b - a) ELSE 0 END AS hr FROM f)
SELECT event_id, round(sum(hr) OVER (PARTITION BY exp_id ORDER BY us, event_id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6.0::DOUBLE, 6) + 0.0 AS heart_rate FROM h""")
def heart_rate(spark, d):
    s = I.series(spark, d).withColumn("mark", F.col("event_type") == "click")
    return R.heart_rate(s, EXP, ORDER, "mark", 2.0).select("event_id", I.rounded(F.col("heart_rate")).alias("heart_rate"))


@query("w27_running_error", SER + """, n AS (SELECT *, row_number() OVER (ORDER BY us, event_id) AS rn, count(*) OVER () AS n,
 avg(abs(value - 40)) OVER (ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING) AS m FROM series)
SELECT event_id, round(m, 7) + 0.0 AS running_mean FROM n WHERE rn <= n - 99""")
def running_error(spark, d):
    s = I.series(spark, d).withColumn("err", F.col("value") - 40)
    return R.running_error(s, ORDER, "err").select("event_id", I.rounded(F.col("running_mean"), 7).alias("running_mean"))


@query("w28_bias_removal", SER + " SELECT event_id, round(value - quantile_cont(value, 0.5) OVER (PARTITION BY exp_id), 6) + 0.0 AS centred FROM series")
def bias(spark, d):
    return R.without_bias(I.series(spark, d), EXP, ["value"]).select("event_id", I.rounded(F.col("value_centred")).alias("centred"))


BUCKET = "us // 21600000000"


def _bucketed(spark, d):
    s = I.series(spark, d)
    return s.withColumn("bucket", F.floor(F.col("us") / F.lit(21_600_000_000)).cast("long"))


@query("a1_ppg_features", SER + f""", x AS (SELECT exp_id, {BUCKET} AS bucket, value * 12 AS raw, value / 3 AS filter, value + event_id % 7 AS hr,
 CASE WHEN event_id % 5 > 0 THEN value * 2 END AS hrv, event_id % 2 AS peak FROM series)
SELECT exp_id, bucket, round(avg(raw), 6) + 0.0 AS m, round(coalesce(stddev_samp(raw), 0), 6) + 0.0 AS s, round(quantile_cont(raw, 0.02), 6) + 0.0 AS p2,
 round(quantile_cont(raw, 0.98), 6) + 0.0 AS p98, round(coalesce(stddev_samp(filter), 0), 6) + 0.0 AS fs, round(coalesce(quantile_cont(hr, 0.5), 0), 6) + 0.0 AS hr,
 round(coalesce(quantile_cont(hrv, 0.5), 0), 6) + 0.0 AS hrv, round(avg(peak), 6) + 0.0 AS pk,
 round(avg(CASE WHEN raw <= 2 OR raw >= 4093 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS cf FROM x GROUP BY 1, 2""")
def ppg(spark, d):
    v = F.col("value")
    x = _bucketed(spark, d).select("exp_id", "bucket", (v * 12).alias("raw"), (v / 3).alias("filter"),
                                   (v + F.col("event_id") % 7).alias("hr"), F.when(F.col("event_id") % 5 > 0, v * 2).alias("hrv"),
                                   (F.col("event_id") % 2).alias("peak"))
    f = B.ppg_features(x, ["exp_id", "bucket"])
    names = {"m": "ppg_raw_mean_1s", "s": "ppg_raw_std_1s", "p2": "ppg_raw_p2_1s", "p98": "ppg_raw_p98_1s",
             "fs": "ppg_filter_std_1s", "hr": "ppg_hr_median_1s", "hrv": "ppg_hrv_median_1s",
             "pk": "ppg_peak_rate_1s", "cf": "ppg_clip_frac_1s"}
    return f.select("exp_id", "bucket", *[I.rounded(F.col(c)).alias(k) for k, c in names.items()])


@query("a2_imu_features", SER + f""", x AS (SELECT exp_id, {BUCKET} AS bucket, sqrt(value * value + 4.0::DOUBLE + (event_id % 9) * (event_id % 9)) AS an,
 sqrt(1.0::DOUBLE + (event_id % 5) * (event_id % 5) + value * value / 4) AS gn FROM series),
y AS (SELECT *, an - quantile_cont(an, 0.5) OVER (PARTITION BY exp_id) AS ad FROM x)
SELECT exp_id, bucket, round(avg(an), 6) + 0.0 AS m, round(sqrt(avg(ad * ad)), 6) + 0.0 AS rms, round(coalesce(stddev_samp(an), 0), 6) + 0.0 AS s,
 round(sqrt(avg(gn * gn)), 6) + 0.0 AS ge, round(coalesce(stddev_samp(gn), 0), 6) + 0.0 AS gs FROM y GROUP BY 1, 2""")
def imu(spark, d):
    v, e = F.col("value"), F.col("event_id")
    x = _bucketed(spark, d).select("exp_id", "bucket", v.alias("acc_x"), F.lit(2.0).alias("acc_y"), (e % 9).alias("acc_z"),
                                   F.lit(1.0).alias("gyr_x"), (e % 5).alias("gyr_y"), (v / 2).alias("gyr_z"))
    f = B.imu_features(x, EXP, "bucket")
    names = {"m": "icm_acc_norm_mean_1s", "rms": "icm_acc_dynamic_rms_1s", "s": "icm_acc_norm_std_1s",
             "ge": "icm_gyro_energy_1s", "gs": "icm_gyro_std_1s"}
    return f.select("exp_id", "bucket", *[I.rounded(F.col(c)).alias(k) for k, c in names.items()])


@query("a3_raw_slots", SER + """, r AS (SELECT exp_id, us // 259200000000 AS bucket, value, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY exp_id, us // 259200000000) AS n
 FROM series WINDOW w AS (PARTITION BY exp_id, us // 259200000000 ORDER BY us, event_id)), s AS (SELECT unnest(range(5)) AS slot),
g AS (SELECT DISTINCT exp_id, bucket, n FROM r),
k AS (SELECT g.*, slot, CASE WHEN n <= 5 THEN slot WHEN slot = 4 THEN n - 1 ELSE floor(slot * ((n - 1) / 4.0::DOUBLE))::BIGINT END AS p FROM g CROSS JOIN s)
SELECT k.exp_id, k.bucket, k.slot, round(coalesce(r.value, 0), 6) + 0.0 AS v FROM k LEFT JOIN r ON r.exp_id = k.exp_id AND r.bucket = k.bucket AND r.p = k.p""")
def slots(spark, d):
    s = I.series(spark, d).withColumn("bucket", F.floor(F.col("us") / F.lit(259_200_000_000)).cast("long"))
    x = B.raw_slots(s, ["exp_id", "bucket"], ORDER, "value", 5).select("exp_id", "bucket", F.posexplode("slots").alias("slot", "v"))
    return x.select("exp_id", "bucket", F.col("slot").cast("long").alias("slot"), I.rounded(F.col("v")).alias("v"))


@query("j4_same_second_join", """WITH r AS (SELECT user_id, epoch_us(ts) // 3600000000 AS slot, count(*) AS n, min(event_id) AS first_id, sum(value) AS total FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT a.event_id, coalesce(n, 0) AS n, first_id, round(coalesce(total, 0), 6) + 0.0 AS total FROM events a LEFT JOIN r ON a.user_id = r.user_id AND epoch_us(a.ts) // 3600000000 = slot WHERE a.event_type = 'view'""")
def same_second(spark, d):
    """The raw side is one row per bucket before the join, so no bucket multiplies."""
    s = I.series(spark, d).withColumn("slot", K.second_of(F.col("t")))
    right = s.filter("event_type = 'click'").groupBy("exp_id", "slot").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.sum("value").alias("total"))
    j = s.filter("event_type = 'view'").select("event_id", "exp_id", "slot").join(right, ["exp_id", "slot"], "left")
    return j.select("event_id", F.coalesce("n", F.lit(0)).alias("n"), "first_id", I.rounded(F.coalesce("total", F.lit(0.0))).alias("total"))


@query("a3_raw_slots_joined", SER + """, r AS (SELECT exp_id, us // 3600000000 AS b, value, row_number() OVER w AS p FROM series WHERE event_type = 'click' WINDOW w AS (PARTITION BY exp_id, us // 3600000000 ORDER BY us, event_id)),
s AS (SELECT unnest(range(2)) AS slot) SELECT a.event_id, slot, round(coalesce(r.value, 0), 6) + 0.0 AS v FROM series a CROSS JOIN s LEFT JOIN r ON r.exp_id = a.exp_id AND r.b = a.us // 3600000000 AND r.p = slot + 1 WHERE event_type = 'view'""")
def slots_joined(spark, d):
    s = I.series(spark, d)
    j = X.join_raw_slots(s.filter("event_type = 'view'"), s.filter("event_type = 'click'"), EXP, "t", ORDER, "value", 2, "slots")
    x = j.select("event_id", F.posexplode_outer("slots").alias("slot", "v"))
    return x.select("event_id", F.col("slot").cast("long").alias("slot"), I.rounded(F.col("v")).alias("v"))
