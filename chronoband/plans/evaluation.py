"""Metrics of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoband.functions.tails import correlation_pvalue
from chronoband.operators import histories as H
from chronoband.operators import metrics as M
from chronoband.operators.ordered import indexed
from chronoband.plans import inputs as I
from chronoband.plans.features import ZONED
from chronoband.plans.registry import query

PRED = f"WITH {I.PREDICTIONS}"
METRICS = """round(avg(abs(e)), 6) + 0.0 AS mae, round(avg(e * e), 6) + 0.0 AS mse, round(sqrt(avg(e * e)), 6) + 0.0 AS rmse, round(1 - avg(e * e) / var_pop(y_true), 6) + 0.0 AS r2,
 round(corr(y_true, y_pred), 6) + 0.0 AS pearson_corr, round(avg(abs(e / (y_true + 1e-8))) * 100, 6) + 0.0 AS mape, round(avg(abs(e) / (abs(y_true) + 1e-8)) * 100, 6) + 0.0 AS mape_abs,
 round(avg(e), 6) + 0.0 AS mean_error, round(stddev_pop(e), 6) + 0.0 AS std_error, round(max(abs(e)), 6) + 0.0 AS max_error, round(min(abs(e)), 6) + 0.0 AS min_error, count(*) AS n_samples,
 round(quantile_cont(e, 0.5), 6) + 0.0 AS median_error, round(quantile_cont(abs(e), 0.25), 6) + 0.0 AS q25_error, round(quantile_cont(abs(e), 0.5), 6) + 0.0 AS q50_error,
 round(quantile_cont(abs(e), 0.75), 6) + 0.0 AS q75_error, round(quantile_cont(abs(e), 0.95), 6) + 0.0 AS q95_error"""
ERR = f"{PRED}, e AS (SELECT *, y_pred - y_true AS e FROM predictions)"


def _rounded(df, keys=()):
    return df.select(*keys, *[c if c == "n_samples" else I.rounded(F.col(c)).alias(c) for c in df.columns if c not in keys])


@query("m1_regression_metrics", f"{ERR} SELECT {METRICS} FROM e")
def overall(spark, d):
    return _rounded(M.regression(I.predictions(spark, d)))


@query("m2_pearson_r_and_p")
def pearson(spark, d):
    m = M.regression(I.predictions(spark, d), ["l_suppkey"])
    return m.select("l_suppkey", "pearson_corr", correlation_pvalue(F.col("pearson_corr"), F.col("n_samples")).alias("pearson_p"))


@query("m3_clarke_shares", f"""{PRED}, {ZONED} SELECT z.zone, count(y_true) AS n, round(count(y_true) * 100.0::DOUBLE / (SELECT count(*) FROM zoned), 6) + 0.0 AS percent
 FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS zone) z LEFT JOIN zoned USING (zone) GROUP BY 1""")
def clarke(spark, d):
    return M.zone_shares(I.predictions(spark, d)).withColumn("percent", I.rounded(F.col("percent")))


@query("m4_clarke_points", f"""{PRED}, {ZONED} SELECT zone, round(y_true, 6) AS actual_mmol_per_l, round(y_pred, 6) AS predicted_mmol_per_l,
 round(y_true * 18.0182::DOUBLE, 6) AS actual_mg_per_dl, round(y_pred * 18.0182::DOUBLE, 6) AS predicted_mg_per_dl FROM zoned""")
def points(spark, d):
    p = M.zone_points(I.predictions(spark, d))
    return p.select("zone", *[F.round(c, 6).alias(c) for c in p.columns if c != "zone"])


@query("m5_ab_percent_and_mard", f"""{PRED}, z AS (SELECT *, y_true * 18.0::DOUBLE AS t, y_pred * 18.0::DOUBLE AS p FROM predictions),
c AS (SELECT *, CASE WHEN (t < 70 AND p < 70) OR abs(t - p) < 0.2::DOUBLE * t THEN 1 WHEN (t <= 70 AND p >= 180) OR (t >= 180 AND p <= 70) OR (t >= 240 AND p BETWEEN 70 AND 180)
 OR (t <= 70 AND p BETWEEN 70 AND 180) OR (t BETWEEN 70 AND 290 AND p >= t + 110) OR (t BETWEEN 130 AND 180 AND p <= 1.4::DOUBLE * t - 182) THEN 0 ELSE 1 END AS ab FROM z)
SELECT l_returnflag, round(avg(ab) * 100, 6) + 0.0 AS ab_percent, round(avg(abs(y_pred - y_true) / y_true) * 100, 6) + 0.0 AS mard FROM c GROUP BY 1""")
def ab_mard(spark, d):
    return _rounded(M.ab_and_mard(I.predictions(spark, d), ["l_returnflag"]), ["l_returnflag"])


@query("m6_metrics_by_experiment", f"{ERR} SELECT l_suppkey, {METRICS} FROM e GROUP BY 1")
def by_group(spark, d):
    return _rounded(M.regression(I.predictions(spark, d), ["l_suppkey"]), ["l_suppkey"])


@query("m6_metrics_by_user_and_file", f"{ERR} SELECT l_returnflag, l_linestatus, {METRICS} FROM e GROUP BY 1, 2")
def by_two(spark, d):
    keys = ["l_returnflag", "l_linestatus"]
    return _rounded(M.regression(I.predictions(spark, d), keys), keys)


@query("m7_error_bands", f"""{ERR}, b AS (SELECT CASE WHEN abs(e) <= 0.5 THEN '<=0.5' WHEN abs(e) <= 1 THEN '0.5-1.0' WHEN abs(e) <= 2 THEN '1.0-2.0' WHEN abs(e) <= 3 THEN '2.0-3.0' ELSE '>3.0' END AS band FROM e)
SELECT band, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM b), 6) + 0.0 AS percent FROM b GROUP BY 1""")
def bands(spark, d):
    return M.error_bands(I.predictions(spark, d)).withColumn("percent", I.rounded(F.col("percent")))


@query("m8_mae_by_value_range", f"""{ERR}, b AS (SELECT e, CASE WHEN y_true < 5.6 THEN '<5.6' WHEN y_true < 7.8 THEN '5.6-7.8' WHEN y_true < 10 THEN '7.8-10.0' ELSE '>=10.0' END AS value_range FROM e)
SELECT v.value_range, round(coalesce(avg(abs(e)), 0), 6) + 0.0 AS mae, count(e) AS n FROM (SELECT unnest(['<5.6', '5.6-7.8', '7.8-10.0', '>=10.0']) AS value_range) v LEFT JOIN b USING (value_range) GROUP BY 1""")
def ranges(spark, d):
    return M.by_value_range(I.predictions(spark, d)).withColumn("mae", I.rounded(F.col("mae")))


@query("m9_residual_diagnostics", f"""{ERR}, s AS (SELECT stddev_pop(e) AS sd FROM e) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(e, 6) + 0.0 AS residual,
 round(e / sd, 6) + 0.0 AS standardised, round(sqrt(abs(e / sd)), 6) + 0.0 AS scale_location FROM e, s""")
def residuals(spark, d):
    r = M.residuals(I.predictions(spark, d))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[I.rounded(F.col(c)).alias(c) for c in ("residual", "standardised", "scale_location")])


@query("m10_losses", f"""{ERR} SELECT l_returnflag, round(avg(e * e), 6) + 0.0 AS mse, round(avg(abs(e)), 6) + 0.0 AS mae,
 round(avg(CASE WHEN abs(e) <= 1 THEN 0.5::DOUBLE * e * e ELSE abs(e) - 0.5::DOUBLE END), 6) + 0.0 AS huber FROM e GROUP BY 1""")
def losses(spark, d):
    return _rounded(M.losses(I.predictions(spark, d), ["l_returnflag"]), ["l_returnflag"])


@query("m11_history_loss", f"""WITH {I.SERIES}, w AS (SELECT *, list(value) OVER (PARTITION BY exp_id ORDER BY us, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h, row_number() OVER (PARTITION BY exp_id ORDER BY us, event_id) AS rn FROM series),
p AS (SELECT *, value * 0.9::DOUBLE + 2 AS pred, h[5] AS last, (-2 * (h[1] - list_avg(h)) - (h[2] - list_avg(h)) + (h[4] - list_avg(h)) + 2 * (h[5] - list_avg(h))) / (10 + 1e-8) AS slope FROM w WHERE rn > 5),
a AS (SELECT event_type, avg((pred - value) ** 2) AS m, avg((pred - last) ** 2) AS s, avg((pred - (last + slope)) ** 2) AS t FROM p GROUP BY 1)
SELECT event_type, round(m, 5) + 0.0 AS main_loss, round(s, 5) + 0.0 AS smoothness_loss, round(t, 5) + 0.0 AS trend_loss, round(m + 0.1::DOUBLE * s + 0.05::DOUBLE * t, 5) + 0.0 AS total_loss FROM a""")
def history_loss(spark, d):
    w = H.count_windows(I.series(spark, d), ["exp_id"], ["us", "event_id"], "value", 5)
    r = M.history_loss(w.withColumn("pred", F.col("value") * 0.9 + 2), ["event_type"], "pred", "value", "history")
    return r.select("event_type", *[I.rounded(F.col(c), 5).alias(c) for c in ("main_loss", "smoothness_loss", "trend_loss", "total_loss")])


EPOCHS = """ep AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, round(value / 10)::BIGINT AS mae FROM events)"""


@query("m12_batch_mae", f"""{ERR}, r AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS rn FROM e)
SELECT rn // 3200 AS step, round(avg(abs(e)), 6) + 0.0 AS mae, count(*) AS n FROM r GROUP BY 1""")
def batch_mae(spark, d):
    b = M.batch_mae(I.predictions(spark, d), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 64, 50)
    return b.select("step", I.rounded(F.col("mae")).alias("mae"), "n")


@query("m13_best_epoch", f"WITH {EPOCHS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY mae, epoch) AS k FROM ep) SELECT run_id, epoch, mae FROM r WHERE k = 1")
def best_epoch(spark, d):
    e = indexed(I.series(spark, d), ["exp_id"], ["us", "event_id"], "epoch").select(
        F.col("exp_id").alias("run_id"), "epoch", F.round(F.col("value") / 10).cast("long").alias("mae"))
    return M.best_epoch(e, ["run_id"], "epoch", "mae")


@query("m14_nan_batches", f"""WITH {I.SERIES}, x AS (SELECT *, CASE WHEN value > 200 THEN NULL ELSE value END AS v, row_number() OVER (ORDER BY us, event_id) - 1 AS rn FROM series),
b AS (SELECT rn // 32 AS b, count(*) FILTER (v IS NULL) AS bad, count(*) AS n FROM x GROUP BY 1)
SELECT count(*) AS batches, count(*) FILTER (bad > 0) AS skipped, sum(bad)::BIGINT AS bad_rows, coalesce(sum(n) FILTER (bad > 0), 0)::BIGINT AS rows_lost FROM b""")
def nan_batches(spark, d):
    s = I.series(spark, d).withColumn("v", F.when(F.col("value") > 200, F.lit(float("nan"))).otherwise(F.col("value")))
    return M.nan_batches(s, ["us", "event_id"], 32, ["v"])


@query("t1_sorted_by_error", f"""{ERR} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(abs(e), 6) AS abs_error FROM e ORDER BY abs(e) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey""")
def sorted_error(spark, d):
    p = I.predictions(spark, d).withColumn("_a", F.abs(F.col("y_pred") - F.col("y_true")))
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return p.orderBy(F.col("_a").desc(), *ids).select(*ids, F.round("_a", 6).alias("abs_error"))


@query("j9_predictions_on_truth", """SELECT o.o_orderkey, o.o_orderdate::DATE::VARCHAR AS day, count(l_orderkey) AS n_predictions, round(coalesce(sum(l_quantity), 0), 6) AS total FROM orders o LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def on_truth(spark, d):
    p = I.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    o = I.table(spark, d, "orders").select("o_orderkey", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("day"))
    return o.join(p, "o_orderkey", "left").groupBy("o_orderkey", "day").agg(
        F.max(F.coalesce("n", F.lit(0))).alias("n_predictions"), F.round(F.max(F.coalesce("q", F.lit(0.0))), 6).alias("total"))
