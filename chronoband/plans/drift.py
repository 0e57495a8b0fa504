"""Distribution shift, day and phase reports, components and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoband.functions import spectrum as P
from chronoband.operators import clusters as L
from chronoband.operators import drift as D
from chronoband.operators import metrics as M
from chronoband.operators import reports as R
from chronoband.operators import smooth as S
from chronoband.operators import splits as X
from chronoband.operators.align import nearest_error
from chronoband.operators.normalise import scale_for_distance
from chronoband.operators.ordered import indexed
from chronoband.plans import inputs as I
from chronoband.plans.alignment import PAIRS
from chronoband.plans.features import THIRDS
from chronoband.plans.registry import query
from chronoband.plans.rhythm import PHASE, phased
from chronoband.plans.splitting import CUT, N, THREE
from chronoband.session import materialise

SER = f"WITH {I.SERIES}"
DAYED = "dayed AS (SELECT *, strftime(make_timestamp(us), '%Y-%m-%d') AS day FROM {src})"
VARS = ["value", "slope", "v2"]


def _day(df):
    return df.withColumn("day", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd"))


def split_days(spark, d):
    """Phased samples with day, three-way split and derived variables."""
    s = _day(phased(spark, d))
    return X.three_way_dates(s, "day", "us").withColumn("v2", F.col("value") + F.col("event_id") % 100)


SPLIT_DAYS = PHASE + ", " + DAYED.format(src="ph") + ", rows_ AS (SELECT * FROM dayed), " + THREE + """,
sd AS (SELECT rows_.*, e.split, value + event_id % 100 AS v2 FROM rows_ JOIN e USING (day))"""


def _distance_sql(source: str, keys: str) -> str:
    """``source`` has keys, target, side (0 base, 1 target), v."""
    return f""", src AS ({source}), nn AS (SELECT {keys}, target, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM src GROUP BY ALL),
cc AS (SELECT {keys}, target, v, count(*) FILTER (side = 0) AS b, count(*) FILTER (side = 1) AS c FROM src GROUP BY ALL),
cu AS (SELECT *, sum(b) OVER w AS cb, sum(c) OVER w AS ct, lead(v) OVER w - v AS wd FROM cc WINDOW w AS (PARTITION BY {keys}, target ORDER BY v)),
fg AS (SELECT *, abs(cb / n0::DOUBLE - ct / n1::DOUBLE) AS g FROM cu JOIN nn USING ({keys}, target) WHERE n0 > 0 AND n1 > 0),
ds AS (SELECT {keys}, target, max(g) AS ks, sum(g * coalesce(wd, 0)) AS w1, sqrt(2 * sum(g * g * coalesce(wd, 0))) AS en FROM fg GROUP BY ALL),
sl AS (SELECT {keys}, target, list(v ORDER BY v) AS l FROM src GROUP BY ALL),
ql AS (SELECT {keys}, target, [l[((len(l) - 1) * i) // 20 + 1] + (l[least(((len(l) - 1) * i) // 20 + 2, len(l))] - l[((len(l) - 1) * i) // 20 + 1]) * ((((len(l) - 1) * i) % 20) / 20.0::DOUBLE) FOR i IN range(21)] AS q FROM sl),
qe AS (SELECT DISTINCT {keys}, target, unnest(q) AS e FROM ql), qb AS (SELECT *, lead(e) OVER w AS e2, lead(e, 2) OVER w IS NULL AS fin, count(*) OVER (PARTITION BY {keys}, target) AS ne FROM qe WINDOW w AS (PARTITION BY {keys}, target ORDER BY e)),
hh AS (SELECT {keys}, target, qb.e, ne, count(*) FILTER (side = 0) AS h0, count(*) FILTER (side = 1) AS h1 FROM qb LEFT JOIN src USING ({keys}, target) WHERE e2 IS NOT NULL AND v >= e AND (v < e2 OR (fin AND v = e2)) GROUP BY ALL),
fl AS (SELECT *, greatest(h0 / n0::DOUBLE, 1e-6) AS p, greatest(h1 / n1::DOUBLE, 1e-6) AS t FROM hh JOIN nn USING ({keys}, target) WHERE n0 > 0 AND n1 > 0),
ps AS (SELECT {keys}, target, CASE WHEN max(ne) < 3 THEN 0 ELSE sum((t - p) * ln(t / p)) END AS psi FROM fl GROUP BY ALL)"""


DIST_OUT = """n0 AS n_base, n1 AS n_target, round(ks, 6) + 0.0 AS ks_stat, round(w1, 5) + 0.0 AS wasserstein, round(en, 5) + 0.0 AS energy_distance,
 round(coalesce(psi, 0), 5) + 0.0 AS psi"""
DIST_FROM = "FROM ds JOIN nn USING ({k}, target) LEFT JOIN ps USING ({k}, target)"


def _distances(df, keys):
    return df.select(*keys, "target", "n_base", "n_target", I.rounded(F.col("ks_stat")).alias("ks_stat"),
                     *[I.rounded(F.col(c), 5).alias(c) for c in ("wasserstein", "energy_distance", "psi")])


THREE_VARIABLES = """SELECT variable, t AS target, CASE WHEN split = 'train' THEN 0 ELSE 1 END AS side, v
 FROM (SELECT split, unnest([{'variable': 'value', 'v': value}, {'variable': 'slope', 'v': slope}, {'variable': 'v2', 'v': v2}], recursive := true) FROM sd) CROSS JOIN (SELECT unnest(['val', 'test']) AS t) WHERE split IN ('train', t)"""


@query("d1_d4_distances", SPLIT_DAYS + _distance_sql(THREE_VARIABLES, "variable")
       + f" SELECT variable, target, {DIST_OUT} " + DIST_FROM.format(k="variable"))
def distances(spark, d):
    s = D.unpivot(split_days(spark, d), ["split"], VARS)
    return _distances(D.distances(s, ["variable"], "value", "split", "train", ["val", "test"]), ["variable"])


KS_TAIL = "least(greatest(list_sum([CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0::DOUBLE * k * k * z * z) FOR k IN range(1, 41)]), 0), 1)"


@query("d2_ks_pvalue", SPLIT_DAYS + _distance_sql(THREE_VARIABLES, "variable") + f""", kz AS (SELECT variable, target, ks, ks * sqrt(n0 * n1 / (n0 + n1)::DOUBLE) AS z FROM ds JOIN nn USING (variable, target))
SELECT variable, target, round(ks, 6) + 0.0 AS ks_stat, round(CASE WHEN z < 0.2 THEN 1 ELSE {KS_TAIL} END, 6) + 0.0 AS ks_pvalue FROM kz""")
def ks_p(spark, d):
    s = D.unpivot(split_days(spark, d), ["split"], VARS)
    return D.distances(s, ["variable"], "value", "split", "train", ["val", "test"]).select(
        "variable", "target", I.rounded(F.col("ks_stat")).alias("ks_stat"), I.rounded(F.col("ks_pvalue")).alias("ks_pvalue"))


POWERS = ["spec_total_power", "spec_low_power", "spec_mid_power", "spec_high_power"]
SHIFT_VARIABLES, DAY_VARIABLES = ["value", "slope", *POWERS], ["value", "slope", "spec_total_power"]


def split_days_with_power(spark, d):
    """Split samples, with the band powers of their spectrum where they have one."""
    power = I.spectra(spark, d).select(F.col("vec_id").alias("_id"), P.third_powers(F.col("power")).alias("_p"))
    power = power.select("_id", *[F.col(f"_p.{c}").alias(f"spec_{c}_power") for c in ("total", "low", "mid", "high")])
    s = split_days(spark, d)
    return s.join(power, s["event_id"] == power["_id"], "left").drop("_id")


def _structs(names: list[str]) -> str:
    return ", ".join(f"{{'variable': '{n}', 'v': {n}::DOUBLE}}" for n in names)


SHIFT_SQL = SPLIT_DAYS + f""", {I.CELLS}, {THIRDS.replace("th AS", "tp AS")}, sp AS (SELECT sd.*, total AS spec_total_power, low AS spec_low_power, mid AS spec_mid_power, high AS spec_high_power FROM sd LEFT JOIN tp ON vec_id = event_id)""" + _distance_sql(f"""
 SELECT 'global' AS scope, variable, tg AS target, CASE WHEN split = 'train' THEN 0 ELSE 1 END AS side, v FROM (SELECT split, unnest([{_structs(SHIFT_VARIABLES)}], recursive := true) FROM sp)
  CROSS JOIN (SELECT unnest(['val', 'test']) AS tg) WHERE split IN ('train', tg) AND v IS NOT NULL
 UNION ALL SELECT 'by_date', variable, z.day, CASE WHEN split = 'train' THEN 0 ELSE 1 END, v FROM (SELECT split, day, unnest([{_structs(DAY_VARIABLES)}], recursive := true) FROM sp) x
  CROSS JOIN (SELECT DISTINCT day FROM sd WHERE split <> 'train') z WHERE (split = 'train' OR x.day = z.day) AND v IS NOT NULL""", "scope, variable")


@query("d6_shift_by_split_and_day", SHIFT_SQL + f", dy AS (SELECT day, min(split) AS day_split FROM sd WHERE split <> 'train' GROUP BY 1) SELECT scope, variable, target, coalesce(day_split, target) AS target_split, {DIST_OUT} "
       + DIST_FROM.format(k="scope, variable") + " LEFT JOIN dy ON dy.day = target")
def shift(spark, d):
    r = D.shift_report(split_days_with_power(spark, d), "split", "day", SHIFT_VARIABLES, DAY_VARIABLES)
    return _distances(r, ["scope", "variable", "target_split"])


STRATS = SER + ", " + DAYED.format(src="series") + f""", r1 AS (SELECT event_id, row_number() OVER (ORDER BY md5(event_id || ':42'), event_id) AS rn, {N} AS n FROM series), s1 AS (SELECT event_id, {CUT} FROM r1),
u2 AS (SELECT day, min(us) AS t FROM dayed GROUP BY 1), r2 AS (SELECT day, row_number() OVER (ORDER BY t, day) AS rn, {N} AS n FROM u2), s2 AS (SELECT event_id, {CUT} FROM dayed JOIN r2 USING (day)),
u3 AS (SELECT exp_id, min(us) AS t FROM series GROUP BY 1), r3 AS (SELECT exp_id, row_number() OVER (ORDER BY t, exp_id) AS rn, {N} AS n FROM u3), s3 AS (SELECT event_id, {CUT} FROM series JOIN r3 USING (exp_id)),
r4 AS (SELECT event_id, row_number() OVER (PARTITION BY exp_id ORDER BY us, event_id) AS rn, count(*) OVER (PARTITION BY exp_id) AS n FROM series),
s4 AS (SELECT event_id, CASE WHEN n < 4 OR least(floor((rn - 1) * (10.0::DOUBLE / n)), 9)::INT % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM r4),
al AS (SELECT 'random' AS strategy, * FROM s1 UNION ALL SELECT 'date', * FROM s2 UNION ALL SELECT 'experiment', * FROM s3 UNION ALL SELECT 'alternating', * FROM s4)"""


def strategies(spark, d):
    """Samples once per diagnostic strategy, each with its own split."""
    s = materialise(_day(phased(spark, d)).select("event_id", "exp_id", "us", "day", "value", "phase"))     # every split reads it
    wide = X.diagnostic_random(s, "event_id").withColumnRenamed("split", "random")
    wide = X.diagnostic_by_first_time(wide, "day", "us").withColumnRenamed("split", "date")
    wide = X.diagnostic_by_first_time(wide, "exp_id", "us").withColumnRenamed("split", "experiment")
    wide = X.diagnostic_alternating(wide, ["exp_id"], ["us", "event_id"]).withColumnRenamed("split", "alternating")
    pairs = F.array(*[F.struct(F.lit(k).alias("strategy"), F.col(k).alias("split")) for k in ("random", "date", "experiment", "alternating")])
    return wide.select("event_id", "value", "phase", F.inline(pairs))


PHASE_JS = """, sh AS (SELECT strategy, p.phase, greatest(count(*) FILTER (split = 'train' AND ph.phase = p.phase) / count(*) FILTER (split = 'train')::DOUBLE, 1e-6) AS p,
 greatest(count(*) FILTER (split = 'test' AND ph.phase = p.phase) / count(*) FILTER (split = 'test')::DOUBLE, 1e-6) AS q FROM al JOIN ph USING (event_id) CROSS JOIN (SELECT unnest(['rise', 'flat', 'fall']) AS phase) p GROUP BY 1, 2),
sn AS (SELECT strategy, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM sh WINDOW w AS (PARTITION BY strategy)),
js AS (SELECT strategy, round(sqrt(greatest(sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2, 0)), 6) + 0.0 AS phase_js_distance FROM sn GROUP BY 1)"""
PHASED_STRATS = PHASE + STRATS.replace("WITH " + I.SERIES, "")


@query("d7_split_shift", PHASED_STRATS + PHASE_JS + _distance_sql("SELECT strategy, 'test' AS target, CASE WHEN split = 'train' THEN 0 ELSE 1 END AS side, value AS v FROM al JOIN series USING (event_id)", "strategy")
       + f" SELECT strategy, target, {DIST_OUT}, phase_js_distance " + DIST_FROM.format(k="strategy") + " JOIN js USING (strategy)")
def split_shift(spark, d):
    r = D.split_shift(strategies(spark, d), "strategy", "split", "value", "phase")
    return _distances(r.withColumn("phase_js_distance", I.rounded(F.col("phase_js_distance"))), ["strategy", "phase_js_distance"])


@query("d7_split_shift_report")
def split_shift_report(spark, d):
    """All columns of the report, the distance of the centroids in component space among them."""
    pc = L.two_components(_scaled(spark, d)).select(F.col("vec_id").alias("_id"), "pc")
    s = strategies(spark, d)
    s = s.join(pc, s["event_id"] == pc["_id"], "left").drop("_id")
    r = D.split_shift(s, "strategy", "split", "value", "phase", "pc").orderBy(F.desc_nulls_last("wasserstein"), "strategy")
    return _distances(r, ["strategy", "ks_pvalue", "phase_js_distance", "pca_centroid_distance"])


@query("d5_phase_js_distance", PHASED_STRATS + PHASE_JS + " SELECT * FROM js")
def phase_js(spark, d):
    return D.phase_js(strategies(spark, d), ["strategy"], "split", "phase").select("strategy", I.rounded(F.col("phase_js_distance")).alias("phase_js_distance"))


# ---- reports ---------------------------------------------------------------------

@query("a4_recording_metadata", SER + """ SELECT exp_id, count(*) AS n_samples, round(avg(value), 6) + 0.0 AS label_mean, round(stddev_pop(value), 6) + 0.0 AS label_std, min(value) AS label_min, max(value) AS label_max FROM series GROUP BY 1""")
def metadata(spark, d):
    m = R.recording_metadata(I.series(spark, d), ["exp_id"], "value")
    return m.withColumn("label_mean", I.rounded(F.col("label_mean"))).withColumn("label_std", I.rounded(F.col("label_std")))


@query("a5_recording_audit", PAIRS + """, er AS (SELECT exp_id, least(t - pt, nt - t) AS e FROM p), eq AS (SELECT exp_id, quantile_cont(e, 0.5) AS em, quantile_cont(e, 0.95) AS ep FROM er GROUP BY 1),
tg AS (SELECT exp_id, t, t - lag(t) OVER (PARTITION BY exp_id ORDER BY t, event_id) AS gap FROM targets), ts AS (SELECT exp_id, count(*) AS n, min(t) AS a, max(t) AS b, quantile_cont(gap, 0.5) AS dt FROM tg GROUP BY 1),
kg AS (SELECT *, kt - lag(kt) OVER (PARTITION BY exp_id ORDER BY kt, kid) AS gap FROM knots), ks AS (SELECT exp_id, count(*) AS n, min(y) AS lo, max(y) AS hi, avg(y) AS m, quantile_cont(gap, 0.5) AS dt FROM kg GROUP BY 1),
sm AS (SELECT *, quantile_cont(y, 0.5) OVER (PARTITION BY exp_id ORDER BY kt, kid ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM knots),
nb AS (SELECT *, kt - lag(kt) OVER w AS a, lead(kt) OVER w - kt AS b, lag(s) OVER w AS vp, lead(s) OVER w AS vn FROM sm WINDOW w AS (PARTITION BY exp_id ORDER BY kt, kid)),
gr AS (SELECT exp_id, 60.0::DOUBLE * CASE WHEN a IS NULL THEN (vn - s) / b WHEN b IS NULL THEN (s - vp) / a ELSE (a * a * vn + (b * b - a * a) * s - b * b * vp) / (a * b * (a + b)) END AS slope FROM nb),
th AS (SELECT exp_id, greatest(quantile_cont(abs(slope), 0.7), 0) AS thr FROM gr GROUP BY 1)
SELECT exp_id, ts.n AS n_spectrum, ks.n AS n_labels, round(a, 6) + 0.0 AS start_time, round(b, 6) + 0.0 AS end_time, lo AS label_min, hi AS label_max, round(m, 6) + 0.0 AS label_mean,
 round(ts.dt, 6) + 0.0 AS spectrum_dt_median, round(ks.dt, 6) + 0.0 AS label_dt_median, round(em, 6) + 0.0 AS align_error_median, round(ep, 6) + 0.0 AS align_error_p95, round(thr, 4) + 0.0 AS phase_threshold
FROM ts JOIN ks USING (exp_id) LEFT JOIN eq USING (exp_id) LEFT JOIN th USING (exp_id)""")
def audit(spark, d):
    a = R.audit(I.targets(spark, d), I.knots(spark, d), ["exp_id"], "t", "kt", "y", ["event_id"], ["kid"])
    six = ("start_time", "end_time", "label_mean", "spectrum_dt_median", "label_dt_median", "align_error_median", "align_error_p95")
    return a.select("exp_id", "n_spectrum", "n_labels", "label_min", "label_max", *[I.rounded(F.col(c)).alias(c) for c in six],
                    I.rounded(F.col("phase_threshold"), 4).alias("phase_threshold"))


@query("a6_day_split_summary", SPLIT_DAYS + """ SELECT day, split, count(*) AS n_samples, min(value) AS label_min, max(value) AS label_max, round(avg(value), 6) + 0.0 AS label_mean, round(stddev_samp(value), 6) + 0.0 AS label_std,
 round(avg(slope), 4) + 0.0 AS slope_mean, round(stddev_samp(slope), 4) + 0.0 AS slope_std, round(avg(v2), 6) + 0.0 AS power_mean, round(stddev_samp(v2), 6) + 0.0 AS power_std FROM sd GROUP BY 1, 2""")
def day_summary(spark, d):
    s = R.day_summary(split_days(spark, d), ["day", "split"], "value", "slope", "v2")
    return s.select("day", "split", "n_samples", "label_min", "label_max", *[I.rounded(F.col(c), 4 if "slope" in c else 6).alias(c) for c in
                    ("label_mean", "label_std", "slope_mean", "slope_std", "power_mean", "power_std")])


PHASE_SHARES = SPLIT_DAYS + " SELECT day, split, phase, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY day, split)::DOUBLE, 6) AS ratio FROM sd GROUP BY 1, 2, 3"


@query("a7_phase_shares", PHASE_SHARES)
def phase_shares(spark, d):
    return D.shares(split_days(spark, d), ["day", "split"], "phase").withColumn("ratio", F.round("ratio", 6))


@query("j7_count_total_merge", SER + " SELECT exp_id, event_type, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY exp_id)::DOUBLE, 6) AS ratio FROM series GROUP BY 1, 2")
def merge(spark, d):
    return D.shares(I.series(spark, d), ["exp_id"], "event_type").withColumn("ratio", F.round("ratio", 6))


@query("a8_crosstab", PHASE + " SELECT event_type, round(count(*) FILTER (phase = 'rise') / count(*)::DOUBLE, 6) AS rise, round(count(*) FILTER (phase = 'flat') / count(*)::DOUBLE, 6) AS flat, round(count(*) FILTER (phase = 'fall') / count(*)::DOUBLE, 6) AS fall FROM ph GROUP BY 1")
def crosstab(spark, d):
    c = D.crosstab(phased(spark, d), "event_type", "phase", D.PHASES)
    return c.select("event_type", *[F.round(p, 6).alias(p) for p in D.PHASES])


CELLS = f"WITH {I.CELLS}"


def _phase_cells(spark, d):
    s = I.spectra(spark, d).withColumn("phase", F.when(F.col("label") < 4, "rise").when(F.col("label") < 7, "flat").otherwise("fall"))
    return S.explode_bins(s, ["vec_id", "phase"])


PHASED_CELLS = CELLS + ", pc AS (SELECT *, CASE WHEN label < 4 THEN 'rise' WHEN label < 7 THEN 'flat' ELSE 'fall' END AS phase FROM cells)"


@query("a9_mean_spectrum_by_phase", PHASED_CELLS + " SELECT phase, bin, round(avg(x), 6) + 0.0 AS mean_power FROM pc GROUP BY 1, 2")
def mean_spectrum(spark, d):
    m = R.mean_spectrum(_phase_cells(spark, d), "phase")
    return m.select("phase", F.col("bin").cast("long").alias("bin"), I.rounded(F.col("mean_power")).alias("mean_power"))


EFFECT = PHASED_CELLS + """, s AS (SELECT phase, bin, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM pc WHERE phase <> 'flat' GROUP BY 1, 2),
ef AS (SELECT a.bin, (a.m - b.m) / (sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2 + 1e-12)) + 1e-12) AS d FROM s a JOIN s b ON a.bin = b.bin AND a.phase = 'rise' AND b.phase = 'fall')"""


def effects(spark, d):
    return D.cohens_d(_phase_cells(spark, d), "phase", "rise", "fall")


@query("a10_effect_size_per_bin", EFFECT + " SELECT bin, round(d, 6) + 0.0 AS effect, round(abs(d), 6) AS abs_effect FROM ef")
def effect_size(spark, d):
    return effects(spark, d).select(F.col("bin").cast("long").alias("bin"), I.rounded(F.col("effect")).alias("effect"), F.round("abs_effect", 6).alias("abs_effect"))


@query("t2_top_effects", EFFECT + " SELECT bin, round(d, 6) + 0.0 AS effect FROM ef ORDER BY abs(d) DESC, bin LIMIT 20")
def top_effects(spark, d):
    t = M.top_k(effects(spark, d), F.col("abs_effect"), 20, "bin")
    return t.select(F.col("bin").cast("long").alias("bin"), I.rounded(F.col("effect")).alias("effect"))


@query("t2_top_shift_per_variable", SPLIT_DAYS + _distance_sql("""SELECT variable, t AS target, CASE WHEN split = 'train' THEN 0 ELSE 1 END AS side, v
 FROM (SELECT split, unnest([{'variable': 'value', 'v': value}, {'variable': 'slope', 'v': slope}], recursive := true) FROM sd) CROSS JOIN (SELECT unnest(['val', 'test']) AS t) WHERE split IN ('train', t)""", "variable")
       + ", rk AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY psi DESC, target) AS k FROM ps) SELECT variable, target, round(psi, 5) + 0.0 AS psi FROM rk WHERE k = 1")
def top_shift(spark, d):
    s = D.unpivot(split_days(spark, d), ["split"], ["value", "slope"])
    r = D.distances(s, ["variable"], "value", "split", "train", ["val", "test"])
    return M.best_per_group(r, ["variable"], "psi", "target").select("variable", "target", I.rounded(F.col("psi"), 5).alias("psi"))


@query("a11_power_statistics", CELLS + """, lo AS (SELECT vec_id, arg_min(bin, x * 1e6 + bin * 1e-9) AS b FROM cells GROUP BY 1), fr AS (SELECT b, count(*) AS n FROM lo GROUP BY 1)
SELECT round(min(x), 6) + 0.0 AS power_min, round(max(x), 6) + 0.0 AS power_max, round(avg(x), 6) + 0.0 AS power_mean, round(quantile_cont(x, 0.05), 6) + 0.0 AS p5, round(quantile_cont(x, 0.95), 6) + 0.0 AS p95,
 (SELECT b FROM fr ORDER BY n DESC, b LIMIT 1)::BIGINT AS most_frequent_min_bin FROM cells""")
def power_statistics(spark, d):
    p = R.power_statistics(I.spectra(spark, d))
    return p.select(*[I.rounded(F.col(c)).alias(c) for c in ("power_min", "power_max", "power_mean", "p5", "p95")], "most_frequent_min_bin")


@query("a12_histogram", SER + """, m AS (SELECT event_type, min(value) AS lo, max(value) AS hi, count(*) AS n FROM series GROUP BY 1)
SELECT event_type, least(floor((value - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS n, round(count(*) / (max(m.n) * max((hi - lo) / 20)), 6) + 0.0 AS density FROM series JOIN m USING (event_type) GROUP BY 1, 2""")
def histogram(spark, d):
    return D.histogram(I.series(spark, d), ["event_type"], "value", 20).withColumn("density", I.rounded(F.col("density")))


@query("a13_ecdf", SER + " SELECT event_id, round(row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) / count(*) OVER (PARTITION BY event_type)::DOUBLE, 9) AS ecdf FROM series")
def ecdf(spark, d):
    return D.ecdf(I.series(spark, d), ["event_type"], "value", ["event_id"]).select("event_id", F.round("ecdf", 9).alias("ecdf"))


@query("a14_box_statistics", SPLIT_DAYS + """, bq AS (SELECT day, split, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.75) AS q3 FROM sd GROUP BY 1, 2)
SELECT day, split, round(q1, 6) + 0.0 AS q1, round(md, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3, min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
 max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high, count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_beyond FROM sd JOIN bq USING (day, split) GROUP BY day, split, q1, md, q3""")
def box(spark, d):
    b = R.box_stats(X.three_way_dates(_day(I.series(spark, d)), "day", "us"), ["day", "split"], "value")
    return b.select("day", "split", *[I.rounded(F.col(c)).alias(c) for c in ("q1", "median", "q3")], "whisker_low", "whisker_high", "n_beyond")


@query("a15_share_of_total", "SELECT o_orderpriority AS stage, round(sum(o_totalprice), 2) AS amount, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders) * 100, 6) AS percent FROM orders GROUP BY 1")
def share(spark, d):
    s = R.share_of_total(I.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "stage"), "stage", "o_totalprice")
    return s.select("stage", F.round("amount", 2).alias("amount"), F.round("percent", 6).alias("percent"))


@query("a16_part_ranges", SPLIT_DAYS + """ SELECT split, count(*) AS n, min(value) AS label_min, max(value) AS label_max, round(avg(value), 6) + 0.0 AS label_mean, round(stddev_pop(value), 6) + 0.0 AS label_std, min(us) AS t_start, max(us) AS t_end,
 arg_min(value, us) AS first_label, arg_max(value, us) AS last_label, round(arg_max(value, us) - arg_min(value, us), 6) + 0.0 AS change FROM sd GROUP BY 1""")
def part_ranges(spark, d):
    r = R.part_ranges(X.three_way_dates(_day(I.series(spark, d)), "day", "us"), "split", "value", "us", "event_id")
    for c in ("label_mean", "label_std", "change"):
        r = r.withColumn(c, I.rounded(F.col(c)))
    return r


@query("a18_distinct_values", "SELECT count(DISTINCT user_id) AS n_experiments, count(DISTINCT ts::DATE) AS n_days, count(DISTINCT event_type) AS n_types FROM events")
def distinct(spark, d):
    return _day(I.series(spark, d)).agg(F.countDistinct("exp_id").alias("n_experiments"), F.countDistinct("day").alias("n_days"), F.countDistinct("event_type").alias("n_types"))


def master(spark, d):
    s = materialise(_day(phased(spark, d)).join(I.spectra(spark, d).select(F.col("vec_id").alias("event_id"), "power", "label"), "event_id"))
    return R.master_table(s, "exp_id", "day", "us", ["event_id"])


@query("x18_master_table", PHASE + ", " + DAYED.format(src="ph") + f""", {I.CELLS}, {THIRDS.replace('th AS', 'tp AS')},
rows_ AS (SELECT dayed.*, total, low, mid, high FROM dayed JOIN tp ON tp.vec_id = dayed.event_id), {THREE}
SELECT event_id, row_number() OVER (ORDER BY exp_id, us, event_id) - 1 AS sample_id, dense_rank() OVER (ORDER BY day) AS date_order, split AS split_label, phase,
 round(total, 6) + 0.0 AS spec_total_power, round(low, 6) + 0.0 AS spec_low_power, round(mid, 6) + 0.0 AS spec_mid_power, round(high, 6) + 0.0 AS spec_high_power FROM rows_ JOIN e USING (day)""")
def master_table(spark, d):
    m = master(spark, d)
    return m.select("event_id", "sample_id", "date_order", "split_label", "phase", *[I.rounded(F.col(f"spec_{c}_power")).alias(f"spec_{c}_power") for c in ("total", "low", "mid", "high")])


@query("a17_diagnostic_summary")
def summary(spark, d):
    s = materialise(split_days_with_power(spark, d))    # read by every part of the summary
    err = nearest_error(s.select("exp_id", "t", "event_id", "value", "phase"), I.knots(spark, d), ["exp_id"], "t", "kt", "align_error", ["event_id"])
    err = materialise(err.select("exp_id", "value", "phase", "align_error"))
    dist = D.shift_report(s, "split", "day", SHIFT_VARIABLES, DAY_VARIABLES)
    shift_ = D.split_shift(strategies(spark, d), "strategy", "split", "value", "phase")
    audit_ = R.audit(I.targets(spark, d), I.knots(spark, d), ["exp_id"], "t", "kt", "y", ["event_id"], ["kid"])
    days = R.day_summary(s, ["day", "split"], "value", "slope", "spec_total_power")
    clusters = cluster_report(spark, d).where("kind = 'whole'")
    return R.summary_json(err, dist, effects(spark, d), shift_, "exp_id", "value", "phase", "align_error", days=days, clusters=clusters, audit_rows=audit_)


# ---- components and clusters --------------------------------------------------------

def _scaled(spark, d):
    return scale_for_distance(I.spectra(spark, d).withColumn("features", F.col("power")), "features")


@query("d8_two_components")
def components(spark, d):
    p = L.two_components(_scaled(spark, d))
    return p.select("vec_id", I.rounded(F.col("pc")[0], 4).alias("pc1"), I.rounded(F.col("pc")[1], 4).alias("pc2"))


@query("d9_centroid_distance")
def centroid(spark, d):
    s = X.diagnostic_random(_scaled(spark, d), "vec_id")
    return L.centroid_distance(L.two_components(s), "split")


@query("d10_kmeans")
def kmeans(spark, d):
    k = L.kmeans(_scaled(spark, d), 4)
    return k.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("d11_silhouette", f"""WITH s AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings ORDER BY md5(vec_id || ':42'), vec_id LIMIT 2000),
p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, a.vec_id = b.vec_id AS self, sqrt(list_distance(a.v, b.v) ** 2 + 1e-12) AS d FROM s a CROSS JOIN s b),
g AS (SELECT vec_id, la, lb, avg(d) FILTER (NOT self) AS m, count(*) FILTER (NOT self) AS n FROM p GROUP BY 1, 2, 3),
r AS (SELECT vec_id, coalesce(max(m) FILTER (la = lb AND n > 0), 0) AS a, min(m) FILTER (la <> lb) AS b FROM g GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 6) + 0.0 AS silhouette, count(*) AS n_rows FROM r""")
def silhouette(spark, d):
    s = L.silhouette(I.spectra(spark, d), "vec_id", "power", "label")
    return s.select(I.rounded(F.col("silhouette")).alias("silhouette"), "n_rows")


@query("j10_pairwise_distance_sample", """WITH s AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings ORDER BY md5(vec_id || ':7'), vec_id LIMIT 2000)
SELECT a.label AS own, b.label AS cluster, count(*)::BIGINT AS n, round(sum(sqrt(list_distance(a.v, b.v) ** 2 + 1e-12)) / count(*), 6) + 0.0 AS mean_distance
FROM s a JOIN s b ON a.vec_id <> b.vec_id GROUP BY 1, 2""")
def pairwise(spark, d):
    """Distances of the sample's pairs, summed per pair of labels."""
    s = L.pair_sums(I.spectra(spark, d), "vec_id", "power", "label", seed=7)
    t = s.groupBy("own", "cluster").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
    return t.select("own", "cluster", "n", I.rounded(F.col("total") / F.col("n")).alias("mean_distance"))


@query("j10_pairwise_distances", """WITH s AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.label AS own, b.label AS cluster, count(*)::BIGINT AS n, round(sum(sqrt(list_distance(a.v, b.v) ** 2 + 1e-12)) / count(*), 6) + 0.0 AS mean_distance
FROM s a JOIN s b ON a.vec_id <> b.vec_id GROUP BY 1, 2""")
def all_pairs(spark, d):
    """The same over every row of the table."""
    t = L.pair_sums(I.spectra(spark, d), "vec_id", "power", "label", most=None).groupBy("own", "cluster").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return t.where("n > 0").select("own", "cluster", "n", I.rounded(F.col("total") / F.col("n")).alias("mean_distance"))


def _clustered(spark, d):
    """Phased samples with spectrum, label, slope and alignment error as features."""
    err = nearest_error(master(spark, d), I.knots(spark, d), ["exp_id"], "t", "kt", "align_error", ["event_id"])
    return L.cluster_features(err.withColumn("align_error", F.coalesce("align_error", F.lit(0.0))), I.BINS, ["smooth", "slope", "align_error"])


@query("d12_cluster_report")
def cluster_report(spark, d):
    return L.cluster_report(_clustered(spark, d), "event_id", "phase", "exp_id")


# ---- unions and set operations --------------------------------------------------------

@query("u1_union_of_users", SER + """, p AS (SELECT 'a' AS usr, exp_id, event_id FROM series WHERE event_type = 'view' UNION ALL SELECT 'b', exp_id, event_id FROM series WHERE event_type = 'click')
SELECT event_id, usr, dense_rank() OVER (ORDER BY usr, exp_id) - 1 AS exp_index FROM p""")
def union_users(spark, d):
    s = I.series(spark, d)
    parts = [s.filter(F.col("event_type") == t).select(F.lit(u).alias("usr"), "exp_id", "event_id") for u, t in (("a", "view"), ("b", "click"))]
    return R.union_recordings(parts, ["usr", "exp_id"]).select("event_id", "usr", "exp_index")


@query("u2_days_not_in_train", SPLIT_DAYS + " SELECT DISTINCT day FROM sd EXCEPT SELECT day FROM sd WHERE split = 'train'")
def except_days(spark, d):
    s = X.three_way_dates(_day(I.series(spark, d)), "day", "us")
    return s.select("day").distinct().subtract(s.filter("split = 'train'").select("day"))


@query("u2_common_experiments", "SELECT user_id AS exp_id FROM events WHERE event_type = 'view' AND value > 100 INTERSECT SELECT user_id FROM events WHERE event_type = 'click' AND value > 100")
def intersect(spark, d):
    s = I.series(spark, d).filter("value > 100")
    return s.filter("event_type = 'view'").select("exp_id").intersect(s.filter("event_type = 'click'").select("exp_id"))


@query("j8_semi_membership", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def semi(spark, d):
    c = I.table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return I.table(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("j8_anti_membership", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti(spark, d):
    o = I.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return I.table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("j6_experiment_dimension", "SELECT e.event_id, c.c_mktsegment AS usr, n.n_name AS site FROM events e JOIN customer c ON c.c_custkey = e.user_id JOIN nation n ON n.n_nationkey = c.c_nationkey")
def dimension(spark, d):
    c = I.table(spark, d, "customer").select(F.col("c_custkey").alias("exp_id"), F.col("c_mktsegment").alias("usr"), "c_nationkey")
    n = I.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("site"))
    return I.series(spark, d).select("event_id", "exp_id").join(c, "exp_id").join(n, "c_nationkey").select("event_id", "usr", "site")


@query("j11_permutation_join", SER + """, a AS (SELECT event_id, row_number() OVER (PARTITION BY exp_id ORDER BY event_id) AS k, exp_id FROM series),
b AS (SELECT event_id AS donor, row_number() OVER (PARTITION BY exp_id ORDER BY md5(event_id || ':7'), event_id) AS k, exp_id FROM series) SELECT event_id, donor FROM a JOIN b USING (exp_id, k)""")
def permutation(spark, d):
    s = I.series(spark, d).select("exp_id", "event_id")
    a = indexed(s, ["exp_id"], ["event_id"], "k", "n").drop("n")
    b = indexed(s.withColumnRenamed("event_id", "donor"), ["exp_id"], [X.hashed("donor", 7), "donor"], "k", "n").drop("n")
    return a.join(b, ["exp_id", "k"]).select("event_id", "donor")
