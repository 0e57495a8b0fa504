"""Baseline regressors on the split column and rolling self-fed prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoband.functions import arrays as A
from chronoband.operators.histories import EMPTY_HISTORY_VALUE
from chronoband.operators.ordered import attach, framed, group_sizes, indexed
from chronoband.operators.recurrence import recurrence
from chronoband.session import materialise

MODELS = ("linear", "gbt")


def _estimator(model: str, label: str, seed: int):
    common = dict(featuresCol="_v", labelCol=label, predictionCol="y_pred")
    if model == "linear":
        return LinearRegression(regParam=1e-6, solver="normal", **common)
    if model == "gbt":
        return GBTRegressor(maxIter=10, maxDepth=4, seed=seed, **common)
    raise ValueError(f"unknown model: {model}")


def fitted(df: DataFrame, features: str, label: str, split: str = "split", model: str = "linear", seed: int = 42, path: str | None = None) -> PipelineModel:
    """A pipeline fitted on the train rows that have features and a label; stored at ``path`` if one is given."""
    train = df.filter((F.col(split) == "train") & F.col(features).isNotNull() & F.col(label).isNotNull())
    made = Pipeline(stages=[_estimator(model, label, seed)]).fit(train.withColumn("_v", array_to_vector(F.col(features))))
    if path is not None:
        made.write().overwrite().save(path)
    return made


def scored(df: DataFrame, features: str, model: PipelineModel) -> DataFrame:
    """``df`` with ``y_pred``; null where features are."""
    width = next(s.numFeatures for s in model.stages if hasattr(s, "numFeatures"))
    whole = F.coalesce(F.col(features).cast("array<double>"), F.array_repeat(F.lit(0.0), width))
    out = model.transform(df.withColumn("_v", array_to_vector(whole))).drop("_v")
    return out.withColumn("y_pred", F.when(F.col(features).isNotNull(), F.col("y_pred")))


def train_and_score(df: DataFrame, features: str, label: str, split: str = "split", model: str = "linear", seed: int = 42) -> DataFrame:
    """Fit on train, predict every row (``y_pred``)."""
    return scored(df, features, fitted(df, features, label, split, model, seed))


def compared(df: DataFrame, features: str, label: str, split: str = "split", models: Sequence[str] = MODELS, seed: int = 42, folder: str | None = None) -> DataFrame:
    """Every model's prediction of every row: the rows of ``df`` once per model, with ``model`` and ``y_pred``.

    Models are stored under ``folder`` and read back where one is given.
    """
    d, out = materialise(df), None      # read by every fit and every prediction
    for m in models:
        path = None if folder is None else f"{folder}/{m}"
        made = fitted(d, features, label, split, m, seed, path)
        rows = scored(d, features, made if path is None else PipelineModel.load(path)).withColumn("model", F.lit(m))
        out = rows if out is None else out.unionByName(rows)
    return out


def _with_past(df: DataFrame, keys: list[str], order: Sequence, label: str, n_history: int, peak: int) -> DataFrame:
    """Place in the segment (``_p`` of ``_m``) and the labels before the row, oldest first (``_h``)."""
    d = indexed(df, keys, order, "_p", "_m", peak)
    past = lambda w: F.collect_list(label).over(w.rowsBetween(-n_history, -1))
    return materialise(framed(d, keys, order, n_history, 0, {"_h": past}, peak, "_p"))   # read by fit, seeds and roll-out


def rolling_prediction(df: DataFrame, group: Sequence[str], segment: str, order: Sequence, inputs: str, label: str,
                       n_history: int, split: str = "split", peak: int | None = None) -> DataFrame:
    """Linear model of inputs and the last labels, then predictions fed back.

    The model is fitted on train rows with true histories.  In every segment the
    first ``n_history`` rows are given; a shorter segment starts from a constant.
    """
    keys = [*group, segment]
    if peak is None:
        peak = group_sizes(df, keys)[0]
    d = _with_past(df, keys, order, label, n_history, peak)
    width = d.select(F.max(F.size(inputs))).first()[0]
    seen = d.filter((F.col("_p") > n_history) & (F.col(split) == "train"))
    fit = LinearRegression(regParam=1e-6, solver="normal", featuresCol="_v", labelCol=label).fit(
        seen.withColumn("_v", array_to_vector(F.concat(inputs, F.reverse("_h")))))
    coef = [float(x) for x in fit.coefficients]
    return _rolled(d, df.columns, keys, order, inputs, label, coef[:width], coef[width:], float(fit.intercept), peak)


def rolled(df: DataFrame, group: Sequence[str], segment: str, order: Sequence, inputs: str, label: str, weights: Sequence[float],
           feedback: Sequence[float], intercept: float, peak: int | None = None) -> DataFrame:
    """``rolling_prediction`` with a model that is there: weights of the inputs, feedback of the last labels (newest first)."""
    keys = [*group, segment]
    if peak is None:
        peak = group_sizes(df, keys)[0]
    d = _with_past(df, keys, order, label, len(feedback), peak)
    return _rolled(d, df.columns, keys, order, inputs, label, weights, feedback, intercept, peak)


def _rolled(d: DataFrame, columns: list[str], keys: list[str], order: Sequence, inputs: str, label: str, weights: Sequence[float],
            feedback: Sequence[float], intercept: float, peak: int) -> DataFrame:
    """Feeding back a linear model is a linear recurrence, so long segments run in chunks (see ``recurrence``)."""
    n_history = len(feedback)
    drive = A.dot(F.col(inputs), A.literal(list(weights))) + F.lit(intercept)
    given = (F.col("_m") >= n_history) & (F.col("_p") <= n_history)
    first = d.filter(given).groupBy(*keys).agg(F.transform(
        F.reverse(F.array_sort(F.collect_list(F.struct("_p", F.col(label).alias("y"))))), lambda s: s["y"]).alias("_seed"))
    run = attach(d.filter(~given), first, keys).withColumn(
        "_seed", F.coalesce("_seed", F.array_repeat(F.lit(EMPTY_HISTORY_VALUE), n_history)))
    run = run.withColumn("_q", F.col("_p") - F.when(F.col("_m") >= n_history, n_history).otherwise(0))
    run = run.withColumn("_seed", F.col("_seed").cast("array<double>"))
    rolled = recurrence(run, keys, order, drive, feedback, F.col("_seed"), "y_pred", "_q", peak)
    keep = [*columns, "y_pred", "given"]
    return rolled.withColumn("given", F.lit(False)).select(*keep).unionByName(
        d.filter(given).withColumn("y_pred", F.col(label).cast("double")).withColumn("given", F.lit(True)).select(*keep))
