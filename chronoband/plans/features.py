"""Row features, fusion, normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoband.functions import arrays as A
from chronoband.functions import clinical as C
from chronoband.functions import fusion as U
from chronoband.functions import spectrum as P
from chronoband.functions import timekeys as K
from chronoband.operators import normalise as N
from chronoband.operators import seconds as B
from chronoband.operators.ordered import attach, quantiles, with_quantiles
from chronoband.plans import inputs as I
from chronoband.plans.registry import query

SER = f"WITH {I.SERIES}"
CELLS = f"WITH {I.CELLS}"
AUX_NAMES = ["bme_temperature_c", "bme_pressure_hpa", "bme_humidity_pct", "ppg_red", "ppg_ir", "t117_temperature_c",
             "icm_acc_x", "icm_acc_y", "icm_acc_z", "icm_gyr_x", "icm_gyr_y", "icm_gyr_z"]


def paired(spark, d):
    """First 12 bins as aux vector, the other 52 as spectrum."""
    return I.spectra(spark, d).select("vec_id", "label", F.slice("power", 13, 52).alias("power"), F.slice("power", 1, 12).alias("aux"))


def _cells(df, column):
    x = df.select("vec_id", F.posexplode_outer(column).alias("bin", "x"))
    return x.select("vec_id", F.col("bin").cast("long").alias("bin"), I.rounded(F.col("x")).alias("x"))


# ---- names and times ---------------------------------------------------------

@query("p1_start_from_dirname", """WITH n AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'bad_' || event_id ELSE strftime(ts, '%m%d%H%M') || '_u' || user_id END AS name FROM events)
SELECT event_id, CASE WHEN regexp_matches(name, '^\\d{8}_') THEN name[1:2] || '.' || name[3:4] || ' ' || name[5:6] || ':' || name[7:8] END AS start FROM n""")
def p1(spark, d):
    e = I.table(spark, d, "events")
    name = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("bad_"), F.col("event_id"))).otherwise(
        F.concat(F.date_format(F.col("ts").cast("timestamp"), "MMddHHmm"), F.lit("_u"), F.col("user_id")))
    return e.select("event_id", K.start_from_dirname(name).alias("start"))


@query("p2_date_label_and_key", """WITH n AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%m.%d %H:%M') ELSE '' END AS s FROM events)
SELECT event_id, CASE WHEN event_id % 4 IN (0, 2) THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%m.%d') END AS label,
 CASE WHEN event_id % 4 IN (0, 2) THEN year(ts) ELSE 2000 END::INT * 10000 + month(ts)::INT * 100 + day(ts)::INT AS key FROM n""")
def p2(spark, d):
    e, ts, m = I.table(spark, d, "events"), F.col("ts").cast("timestamp"), F.col("event_id") % 4
    start = F.when(m == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(m == 1, F.date_format(ts, "MM.dd HH:mm")).otherwise("")
    name = F.when(m == 2, F.date_format(ts, "yyMMdd_HHmm")).otherwise(F.concat(F.date_format(ts, "MMddHHmm"), F.lit("_u1")))
    return e.select("event_id", K.date_label(start, name).alias("x")).select("event_id", "x.label", "x.key")


@query("p3_civil_to_epoch_and_back", """SELECT event_id, epoch(date_trunc('second', ts)) - 28800.0 AS epoch, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS civil FROM events""")
def p3(spark, d):
    e = I.table(spark, d, "events")
    t = K.civil_to_epoch(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", t.alias("epoch"), K.epoch_to_civil(t).alias("civil"))


@query("p4_epoch_unit", """WITH x AS (SELECT event_type, epoch_us(ts)::DOUBLE * CASE event_type WHEN 'view' THEN 1e-6 WHEN 'click' THEN 1e-3 ELSE 1e3 END AS e FROM events)
SELECT event_type, CASE WHEN median(e) >= 1e14 THEN 'ns' WHEN median(e) >= 1e11 THEN 'ms' ELSE 's' END AS unit,
 round(min(e / CASE WHEN (SELECT median(y.e) FROM x y WHERE y.event_type = x.event_type) >= 1e14 THEN 1e9 WHEN (SELECT median(y.e) FROM x y WHERE y.event_type = x.event_type) >= 1e11 THEN 1e3 ELSE 1 END), 3) + 0.0 AS first_second FROM x GROUP BY 1""")
def p4(spark, d):
    k = F.when(F.col("event_type") == "view", 1e-6).when(F.col("event_type") == "click", 1e-3).otherwise(1e3)
    x = I.series(spark, d).select("event_type", (F.col("us").cast("double") * k).alias("e"))
    x = with_quantiles(x, ["event_type"], "e", {"mid": 0.5}).withColumn("unit", K.epoch_unit(F.col("mid")))
    return x.groupBy("event_type", "unit").agg(I.rounded(F.min(K.to_seconds(F.col("e"), F.col("unit"))), 3).alias("first_second"))


@query("p5_relative_seconds", SER + " SELECT event_id, round((us - epoch_us(TIMESTAMP '2024-01-10 12:30:00')) / 1e6, 6) + 0.0 AS rel FROM series")
def p5(spark, d):
    start = F.unix_timestamp(F.to_timestamp(F.lit("2024-01-10 12:30:00")))
    return I.series(spark, d).select("event_id", I.rounded((F.col("us") - start * 1_000_000) / 1e6).alias("rel"))


@query("p6_shift_to_zero", SER + ", z AS (SELECT exp_id, event_type, min(us) AS t0 FROM series GROUP BY 1, 2) SELECT event_id, us - t0 AS us0, t0 AS offset_us FROM series JOIN z USING (exp_id, event_type)")
def p6(spark, d):
    s, keys = I.series(spark, d), ["exp_id", "event_type"]
    z = s.groupBy(*keys).agg(F.min("us").alias("offset_us"))
    return attach(s, z, keys).select("event_id", (F.col("us") - F.col("offset_us")).alias("us0"), "offset_us")


@query("p7_second_bucket", SER + " SELECT event_id, floor(us / 1e6)::BIGINT AS second FROM series")
def p7(spark, d):
    return I.series(spark, d).select("event_id", K.second_of(F.col("us") / 1e6).alias("second"))


# ---- one spectrum row ----------------------------------------------------------

@query("p8_decibels_and_frequency", CELLS + " SELECT vec_id, bin, round(-64.4::DOUBLE + 0.0288::DOUBLE * x, 6) + 0.0 AS db, round(0.002::DOUBLE * bin + 4, 6) AS ghz FROM cells")
def p8(spark, d):
    x = I.spectra(spark, d).select("vec_id", F.posexplode_outer(P.to_db(F.col("power"))).alias("bin", "db"))
    return x.select("vec_id", F.col("bin").cast("long").alias("bin"), I.rounded(F.col("db")).alias("db"), F.round(P.bin_ghz(F.col("bin")), 6).alias("ghz"))


@query("p9_min_power_bin", CELLS + " SELECT vec_id, arg_min(bin, x * 1e6 + bin * 1e-9)::BIGINT AS bin, round(min(x), 6) + 0.0 AS value, round(0.002::DOUBLE * arg_min(bin, x * 1e6 + bin * 1e-9) + 4, 6) AS ghz FROM cells GROUP BY 1")
def p9(spark, d):
    m = I.spectra(spark, d).select("vec_id", P.min_bin(F.col("power")).alias("m"))
    return m.select("vec_id", "m.bin", I.rounded(F.col("m.value")).alias("value"), F.round("m.ghz", 6).alias("ghz"))


@query("p10_dip_frequency", CELLS + """, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x, bin) AS rn FROM cells WHERE 0.002::DOUBLE * bin + 4 BETWEEN 4.02 AND 4.1)
SELECT vec_id, round(median(0.002::DOUBLE * bin + 4), 6) AS freq, round(avg(x), 6) + 0.0 AS mean, round(stddev_pop(x), 6) + 0.0 AS std FROM r WHERE rn <= 10 GROUP BY 1""")
def p10(spark, d):
    m = I.spectra(spark, d).select("vec_id", P.dip(F.col("power"), 4.02, 4.1, 10).alias("m"))
    return m.select("vec_id", F.round("m.freq", 6).alias("freq"), I.rounded(F.col("m.mean")).alias("mean"), I.rounded(F.col("m.std")).alias("std"))


@query("p11_band_features", CELLS + """, b AS (SELECT *, (SELECT max(i) FROM range(24) q(i) WHERE floor(i * 64 / 24.0) <= bin) AS band FROM cells)
SELECT vec_id, band * 2 AS pos, round(avg(x), 6) + 0.0 AS v FROM b GROUP BY 1, band UNION ALL SELECT vec_id, band * 2 + 1, round(stddev_pop(x), 6) + 0.0 FROM b GROUP BY 1, band""")
def p11(spark, d):
    x = I.spectra(spark, d).select("vec_id", F.posexplode_outer(P.band_stats(F.col("power"), I.BINS)).alias("pos", "v"))
    return x.select("vec_id", F.col("pos").cast("long").alias("pos"), I.rounded(F.col("v")).alias("v"))


THIRDS = """th AS (SELECT vec_id, label, avg(x) AS total, avg(x) FILTER (bin < 21) AS low, avg(x) FILTER (bin BETWEEN 21 AND 41) AS mid, avg(x) FILTER (bin > 41) AS high FROM cells GROUP BY 1, 2)"""


@query("p12_third_powers", CELLS + f", {THIRDS} SELECT vec_id, round(total, 6) + 0.0 AS total, round(low, 6) + 0.0 AS low, round(mid, 6) + 0.0 AS mid, round(high, 6) + 0.0 AS high FROM th")
def p12(spark, d):
    m = I.spectra(spark, d).select("vec_id", P.third_powers(F.col("power")).alias("m"))
    return m.select("vec_id", *[I.rounded(F.col(f"m.{c}")).alias(c) for c in ("total", "low", "mid", "high")])


@query("p13_vector_norms", SER + """, n AS (SELECT event_id, exp_id, sqrt(value * value + (event_id % 9) * (event_id % 9) + 4.0::DOUBLE) AS v FROM series)
SELECT event_id, round(v, 6) AS norm, round(v - quantile_cont(v, 0.5) OVER (PARTITION BY exp_id), 6) + 0.0 AS dynamic FROM n""")
def p13(spark, d):
    n = I.series(spark, d).withColumn("norm", B.norm3(F.col("value"), F.col("event_id") % 9, F.lit(2.0)))
    n = with_quantiles(n, ["exp_id"], "norm", {"mid": 0.5})
    return n.select("event_id", F.round("norm", 6).alias("norm"), I.rounded(F.col("norm") - F.col("mid")).alias("dynamic"))


@query("p14_clip_flag", "SELECT event_id, CASE WHEN value * 12 <= 2 OR value * 12 >= 4093 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS clip FROM events")
def p14(spark, d):
    return I.series(spark, d).select("event_id", B.clip_flag(F.col("value") * 12).alias("clip"))


@query("p16_aux_override", "SELECT vec_id, 12.0 * 0.5::DOUBLE AS total, 12::INT AS width FROM embeddings")
def p16(spark, d):
    a = U.override(F.col("aux"), 0.5)
    return paired(spark, d).select("vec_id", A.total(a).alias("total"), F.size(a).alias("width"))


@query("p17_augmentation", CELLS + """, u AS (SELECT vec_id, bin - 12 AS i, x, md5(vec_id || ':42') AS r, md5(vec_id || ':42:' || (bin - 12)) AS m FROM cells WHERE bin >= 12),
n AS (SELECT vec_id, x, (('0x' || r[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296 AS k, (('0x' || r[9:16])::BIGINT + 0.5::DOUBLE) / 4294967296 AS b,
 (('0x' || m[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296 AS p, (('0x' || m[9:16])::BIGINT + 0.5::DOUBLE) / 4294967296 AS q FROM u)
SELECT vec_id, round(avg(x * (1 + 0.1::DOUBLE * (2 * k - 1)) + 0.1::DOUBLE * (2 * b - 1) + 0.01::DOUBLE * sqrt(-2 * ln(p)) * cos(6.283185307179586::DOUBLE * q)), 6) + 0.0 AS mean,
 round(avg(x), 6) + 0.0 AS plain FROM n GROUP BY 1""")
def p17(spark, d):
    moved = U.augment(F.col("power"), F.col("vec_id"), 42)
    return paired(spark, d).select("vec_id", I.rounded(A.mean(moved)).alias("mean"), I.rounded(A.mean(F.col("power"))).alias("plain"))


@query("p18_sensor_groups", """WITH n AS (SELECT event_id, (CASE event_id % 6 WHEN 0 THEN 'PPG_raw' WHEN 1 THEN 'hr_mean' WHEN 2 THEN 'icm_acc_x' WHEN 3 THEN 't117_temperature_c' WHEN 4 THEN 'humidity_pct' ELSE event_type END) AS name FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ppg' WHEN 1 THEN 'ppg' WHEN 2 THEN 'icm' WHEN 3 THEN 't117' WHEN 4 THEN 'bme' ELSE 'other' END AS sensor FROM n""")
def p18(spark, d):
    m = F.col("event_id") % 6
    name = F.when(m == 0, "PPG_raw").when(m == 1, "hr_mean").when(m == 2, "icm_acc_x").when(m == 3, "t117_temperature_c").when(
        m == 4, "humidity_pct").otherwise(F.col("event_type"))
    return I.series(spark, d).select("event_id", U.sensor_group(name).alias("sensor"))


@query("p18_pulse_motion_branch", CELLS + " SELECT vec_id, round(sum(x) FILTER (bin BETWEEN 3 AND 11 AND bin <> 5), 6) + 0.0 AS branch, round(sum(x) FILTER (bin IN (0, 1, 2, 5)), 6) + 0.0 AS environment FROM cells WHERE bin < 12 GROUP BY 1")
def p18_branch(spark, d):
    ix = U.pulse_motion_indices(AUX_NAMES)
    rest = [i for i in range(12) if i not in ix]
    return paired(spark, d).select("vec_id", I.rounded(A.total(U.pick(F.col("aux"), ix))).alias("branch"),
                                   I.rounded(A.total(U.pick(F.col("aux"), rest))).alias("environment"))


@query("p19_split_row", CELLS + " SELECT vec_id, round(sum(x) FILTER (bin < 52), 6) + 0.0 AS spectrum, round(sum(x) FILTER (bin >= 52), 6) + 0.0 AS aux, count(*) FILTER (bin >= 52)::INT AS n_aux FROM cells GROUP BY 1")
def p19(spark, d):
    s, a = U.split_features(F.col("power"), 52)
    return I.spectra(spark, d).select("vec_id", I.rounded(A.total(s)).alias("spectrum"), I.rounded(A.total(a)).alias("aux"), F.size(a).alias("n_aux"))


ZONE = """CASE WHEN ({t} < 70 AND {p} < 70) OR abs({t} - {p}) < 0.2::DOUBLE * {t} THEN 'A' WHEN {t} <= 70 AND {p} >= 180 THEN 'E' WHEN {t} >= 180 AND {p} <= 70 THEN 'E'
 WHEN {t} >= 240 AND {p} BETWEEN 70 AND 180 THEN 'D' WHEN {t} <= 70 AND {p} BETWEEN 70 AND 180 THEN 'D' WHEN {t} BETWEEN 70 AND 290 AND {p} >= {t} + 110 THEN 'C'
 WHEN {t} BETWEEN 130 AND 180 AND {p} <= 1.4::DOUBLE * {t} - 182 THEN 'C' ELSE 'B' END"""
ZONED = f"zoned AS (SELECT *, {ZONE.format(t='(y_true * 18.0182::DOUBLE)', p='(y_pred * 18.0182::DOUBLE)')} AS zone FROM predictions)"


@query("p20_clarke_zone", f"WITH {I.PREDICTIONS}, {ZONED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, zone FROM zoned")
def p20(spark, d):
    return I.predictions(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                          C.zone(C.mgdl(F.col("y_true")), C.mgdl(F.col("y_pred"))).alias("zone"))


@query("p21_units", f"WITH {I.PREDICTIONS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(y_true * 18.0182::DOUBLE, 6) AS mg, round(y_true * 18.0182::DOUBLE / 18.0182::DOUBLE, 6) AS mmol FROM predictions")
def p21(spark, d):
    mg = C.mgdl(F.col("y_true"))
    return I.predictions(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(mg, 6).alias("mg"), F.round(mg / C.MGDL_PER_MMOL, 6).alias("mmol"))


# ---- fusion --------------------------------------------------------------------

FUSE = CELLS + """, sx AS (SELECT vec_id, bin - 12 AS bin, x FROM cells WHERE bin >= 12), au AS (SELECT vec_id, bin AS i, x AS a FROM cells WHERE bin < 12),
st AS (SELECT vec_id, avg(a) AS m, stddev_pop(a) AS s FROM au GROUP BY 1), tail AS (SELECT vec_id, 52 + i AS bin, a AS x FROM au)
"""
PLUS_AUX = " UNION ALL SELECT vec_id, bin, round(x, 6) + 0.0 AS x FROM tail"


def _fusion(name, method, sql, **args):
    @query(name, FUSE + sql)
    def run(spark, d):
        p = paired(spark, d)
        return _cells(p.withColumn("f", U.fuse(method, F.col("power"), F.col("aux"), **args)), "f")
    return run


_fusion("n6_fusion_concat", "concat", "SELECT vec_id, bin, round(x, 6) + 0.0 AS x FROM sx" + PLUS_AUX)
_fusion("n7_fusion_film", "film", "SELECT vec_id, bin, round((1 + 0.1::DOUBLE * m) * x + 0.1::DOUBLE * (s + 1e-8), 6) + 0.0 AS x FROM sx JOIN st USING (vec_id)" + PLUS_AUX)
_fusion("n8_fusion_residual_film", "residual_film", "SELECT vec_id, bin, round(0.7::DOUBLE * x + 0.3::DOUBLE * ((1 + 0.05::DOUBLE * m) * x + 0.05::DOUBLE * (s + 1e-8)), 6) + 0.0 AS x FROM sx JOIN st USING (vec_id)" + PLUS_AUX)
_fusion("n9_fusion_sensor_aware", "film_sensor_aware", """, w AS (SELECT vec_id, tanh((max(a) FILTER (i = 0) + max(a) FILTER (i = 5)) / 2) AS tp, tanh(max(a) FILTER (i = 2)) AS hu, tanh(max(a) FILTER (i = 1)) AS pr,
 tanh(max(a) FILTER (i = 3)) AS rd, tanh(max(a) FILTER (i = 4)) AS ir, tanh(sqrt(sum(a * a) FILTER (i >= 6))) AS mo FROM au GROUP BY 1)
SELECT vec_id, bin, round(x * CASE WHEN bin >= 26 THEN 1 + 0.08::DOUBLE * tp ELSE 1 END * (1 + 0.02::DOUBLE * pr) * CASE WHEN bin < 17 THEN 1 + 0.06::DOUBLE * rd ELSE 1 END
 * CASE WHEN bin >= 35 THEN 1 + 0.06::DOUBLE * ir ELSE 1 END * (1 - 0.04::DOUBLE * mo) + 0.05::DOUBLE * hu, 6) + 0.0 AS x FROM sx JOIN w USING (vec_id)""" + PLUS_AUX, n_aux=12, ranges=(26, 17, 35))
_fusion("n10_fusion_attention_pool", "attention_pool", """, e AS (SELECT vec_id, i, x, exp(x * a - max(x * a) OVER (PARTITION BY vec_id, i)) AS e FROM sx JOIN au USING (vec_id))
SELECT vec_id, bin, round(x, 6) + 0.0 AS x FROM sx UNION ALL SELECT vec_id, 52 + i, round(sum(x * e) / sum(e), 6) + 0.0 FROM e GROUP BY 1, i UNION ALL SELECT vec_id, 64 + i, round(a, 6) + 0.0 FROM au""")
_fusion("n11_fusion_conditioned_rf", "conditioned_rf", "SELECT vec_id, bin, round((1 + 0.2::DOUBLE * tanh(m) + 0.05::DOUBLE * tanh(m * (s + 1e-8))) * x + 0.15::DOUBLE * tanh(s + 1e-8), 6) + 0.0 AS x FROM sx JOIN st USING (vec_id)")
ATT = """, q AS (SELECT vec_id, avg(x) + stddev_pop(x) + 1e-8 + max(x) + min(x) AS q FROM sx GROUP BY 1), sc AS (SELECT vec_id, i, a, q * a AS s FROM au JOIN q USING (vec_id)),
ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM sc), wt AS (SELECT *, e / (sum(e) OVER (PARTITION BY vec_id) + 1e-8) AS w FROM ex)"""
_fusion("n12_fusion_attention", "attention_fusion", ATT + """, md AS (SELECT vec_id, 1 + 0.3::DOUBLE * tanh(avg(w * a)) AS k FROM wt GROUP BY 1)
SELECT vec_id, bin, round(k * x, 6) + 0.0 AS x FROM sx JOIN md USING (vec_id) UNION ALL SELECT vec_id, 52 + i, round(w * a, 6) + 0.0 FROM wt""")


@query("n12_attention_report", FUSE + ATT + """, r AS (SELECT vec_id, least(greatest(sum(w) / 12, 0.3), 0.7) AS gate, -sum(w * ln(w + 1e-8)) AS ent FROM wt GROUP BY 1)
SELECT round(avg(gate), 6) + 0.0 AS avg_gate, round(avg(ent), 6) + 0.0 AS avg_entropy FROM r""")
def n12_report(spark, d):
    r = paired(spark, d).select(U.attention_report(F.col("power"), F.col("aux")).alias("r"))
    return r.agg(I.rounded(F.avg("r.gate")).alias("avg_gate"), I.rounded(F.avg("r.entropy")).alias("avg_entropy"))


@query("n13_late_fusion_layout", "SELECT vec_id, 52::INT AS split_point, 12::INT AS n_aux, 64::INT AS width FROM embeddings")
def n13(spark, d):
    p = paired(spark, d).withColumn("features", F.concat("power", "aux"))
    return p.select("vec_id", F.size("power").alias("split_point"), F.size("aux").alias("n_aux"), F.size("features").alias("width"))


# ---- normalisers ---------------------------------------------------------------

TRAIN = "vec_id % 3 <> 0"


def parted(spark, d):
    return I.spectra(spark, d).withColumn("split", F.when(F.col("vec_id") % 3 == 0, "test").otherwise("train"))


@query("n1_global_normaliser", CELLS + f", z AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM cells WHERE {TRAIN}) SELECT vec_id, bin, round((x - mu) / sd, 6) + 0.0 AS x FROM cells, z")
def n1(spark, d):
    return _cells(N.normalise(parted(spark, d)), "power")


@query("n2_normalise_spectrum_part", CELLS + f", z AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM cells WHERE {TRAIN} AND bin < 52) SELECT vec_id, bin, round(CASE WHEN bin < 52 THEN (x - mu) / sd ELSE x END, 6) + 0.0 AS x FROM cells, z")
def n2(spark, d):
    return _cells(N.normalise(parted(spark, d), first=52), "power")


@query("n3_aux_zscore", CELLS + ", z AS (SELECT *, avg(x) OVER p AS m, stddev_pop(x) OVER p AS s FROM cells WHERE bin < 12 WINDOW p AS (PARTITION BY label, bin)) SELECT vec_id, bin, round((x - m) / CASE WHEN s > 1e-8 THEN s ELSE 1 END, 6) + 0.0 AS x FROM z")
def n3(spark, d):
    return _cells(N.aux_zscore(paired(spark, d), ["label"]), "aux")


def _scaler(how, center, width):
    @query(f"n4_scaler_{how}", f"SELECT c_custkey, round((c_acctbal - (SELECT {center} FROM customer)) / (SELECT {width} FROM customer), 6) + 0.0 AS x FROM customer")
    def run(spark, d):
        c = I.table(spark, d, "customer").select("c_custkey", "c_acctbal")
        return N.scale_columns(c, ["c_acctbal"], how).select("c_custkey", I.rounded(F.col("c_acctbal")).alias("x"))
    return run


_scaler("standard", "avg(c_acctbal)", "stddev_pop(c_acctbal)")
_scaler("minmax", "min(c_acctbal)", "max(c_acctbal) - min(c_acctbal)")
_scaler("robust", "quantile_cont(c_acctbal, 0.5)", "quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)")


@query("n5_scale_for_distance", CELLS + ", z AS (SELECT *, avg(x) OVER p AS m, stddev_pop(x) OVER p AS s FROM cells WINDOW p AS (PARTITION BY bin)) SELECT vec_id, bin, round((x - m) / (s + 1e-12), 6) + 0.0 AS x FROM z")
def n5(spark, d):
    return _cells(N.scale_for_distance(I.spectra(spark, d), "power"), "power")


def _shuffle(mode, group_sql):
    @query(f"n14_aux_shuffle_{mode}", CELLS + f""", a AS (SELECT vec_id, label, bin, x, {group_sql} AS g, 42 + list_sum(list_transform(string_split(label::VARCHAR, ''), lambda c: ascii(c)))::INT AS seed FROM cells WHERE bin < 12),
k AS (SELECT *, row_number() OVER (PARTITION BY label, bin ORDER BY vec_id) AS kr, row_number() OVER (PARTITION BY label, bin ORDER BY md5(vec_id || ':' || seed || ':' || g), vec_id) AS hr FROM a)
SELECT r.vec_id, r.bin, round(s.x, 6) + 0.0 AS x FROM k r JOIN k s ON r.label = s.label AND r.bin = s.bin AND r.kr = s.hr""")
    def run(spark, d):
        seed = N.name_seed(42, F.col("label"))
        return _cells(N.shuffle_aux(paired(spark, d).drop("power"), ["label"], "vec_id", AUX_NAMES, mode, seed), "aux")
    return run


_shuffle("rows", "0")
_shuffle("features", "bin")
_shuffle("sensor_groups", "CASE WHEN bin < 3 THEN 0 WHEN bin < 5 THEN 1 WHEN bin = 5 THEN 2 ELSE 3 END")
