"""Error-grid zones, error bands and value ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: mg/dL per mmol/L
MGDL_PER_MMOL = 18.0182
ZONES = ("A", "B", "C", "D", "E")
ERROR_BANDS = ("<=0.5", "0.5-1.0", "1.0-2.0", "2.0-3.0", ">3.0")
VALUE_RANGES = ("<5.6", "5.6-7.8", "7.8-10.0", ">=10.0")


def mgdl(mmol: Column) -> Column:
    return mmol * F.lit(MGDL_PER_MMOL)


def zone(true_mg: Column, pred_mg: Column) -> Column:
    """Clarke zone of a pair in mg/dL.  The order of the tests is part of the rule."""
    t, p = true_mg, pred_mg
    return (
        F.when(((t < 70) & (p < 70)) | (F.abs(t - p) < F.lit(0.2) * t), "A")
        .when((t <= 70) & (p >= 180), "E")
        .when((t >= 180) & (p <= 70), "E")
        .when((t >= 240) & p.between(70, 180), "D")
        .when((t <= 70) & p.between(70, 180), "D")
        .when(t.between(70, 290) & (p >= t + 110), "C")
        .when(t.between(130, 180) & (p <= F.lit(7 / 5) * t - 182), "C")
        .otherwise("B")
    )


def error_band(abs_error: Column) -> Column:
    return (
        F.when(abs_error <= 0.5, ERROR_BANDS[0]).when(abs_error <= 1.0, ERROR_BANDS[1])
        .when(abs_error <= 2.0, ERROR_BANDS[2]).when(abs_error <= 3.0, ERROR_BANDS[3])
        .otherwise(ERROR_BANDS[4])
    )


def value_range(y: Column) -> Column:
    return (
        F.when(y < 5.6, VALUE_RANGES[0]).when(y < 7.8, VALUE_RANGES[1])
        .when(y < 10.0, VALUE_RANGES[2]).otherwise(VALUE_RANGES[3])
    )
