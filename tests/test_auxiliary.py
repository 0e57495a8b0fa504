"""Auxiliary features by mode, and raw segments against a plain version."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoband.operators import auxiliary as X


def sensors(spark, rng, slots):
    rows = [(g, float(np.round(rng.uniform(0, 6), 3)), k, float(rng.normal()) if k % 11 else None) for g in (1, None) for k in range(60)]
    base = spark.createDataFrame(rows, "g int, ts double, id int, v double")
    v = F.col("v")
    return rows, {"pulse": base.select("g", "ts", "id", v.alias("red"), (v * 2).alias("ir")), "motion": base.select("g", "ts", "id", v.alias("acc_x"), (v + 1).alias("gyr_z"))}


def plain_slots(rows, g, second, slots, f):
    own = [f(r[3]) if r[3] is not None else 0.0 for r in sorted((r for r in rows if r[0] == g and int(np.floor(r[1])) == second), key=lambda r: (r[1], r[2]))]
    if len(own) > slots:
        own = [own[i] for i in np.linspace(0, len(own) - 1, slots).astype(int)]
    return own + [0.0] * (slots - len(own))


@pytest.mark.parametrize("slots", [5, 32])
def test_segments(spark, slots):
    rng = np.random.default_rng(slots)
    rows, tables = sensors(spark, rng, slots)
    targets = spark.createDataFrame([(g, float(t), k) for g in (1, None) for k, t in enumerate((0.2, 1.5, 1.9, 4.0, 8.7))], "g int, ts double, sample int")
    raw = X.segment_features(targets, tables, ["g"], "ts", ["ts", "id"], slots, slots, normalise=False)
    assert raw.columns == ["g", "ts", "sample", "ppg_red_seg", "ppg_ir_seg", "icm_acc_x_seg", "icm_gyr_z_seg"]
    wanted = {}
    for name, f in (("ppg_red_seg", lambda v: v), ("ppg_ir_seg", lambda v: 2 * v), ("icm_acc_x_seg", lambda v: v), ("icm_gyr_z_seg", lambda v: v + 1)):
        for r in raw.collect():
            want = plain_slots(rows, r.g, int(np.floor(r.ts)), slots, f)
            assert np.allclose(r[name], want)
            wanted.setdefault((name, r.g), {})[r.sample] = want
    for r in X.segment_features(targets, tables, ["g"], "ts", ["ts", "id"], slots, slots).collect():
        for name in raw.columns[3:]:
            all_rows = np.array(list(wanted[name, r.g].values()))
            sd = all_rows.std(axis=0)
            z = (np.array(wanted[name, r.g][r.sample]) - all_rows.mean(axis=0)) / np.where(sd > 1e-8, sd, 1)
            assert np.allclose(r[name], z, atol=1e-9)


def test_modes(spark):
    base = spark.createDataFrame([(1, float(k) / 4, float(k % 7)) for k in range(40)], "g int, ts double, v double")
    v = F.col("v")
    tables = {"environment": base.select("g", "ts", v.alias("temperature_c"), v.alias("pressure_hpa"), v.alias("humidity_pct")),
              "pulse": base.select("g", "ts", *[v.alias(c) for c in ("raw", "filter", "hr", "hrv", "peak")]), "skin": base.select("g", "ts", v.alias("temperature_c")),
              "motion": base.select("g", "ts", *[(v + k).alias(c) for k, c in enumerate(X.MOTION_AXES)])}
    targets = spark.createDataFrame([(1, k + 0.1, k) for k in range(8)], "g int, ts double, sample int")
    names = lambda mode, motion="raw": X.aligned_auxiliary(targets, tables, ["g"], "ts", ["sample"], mode, motion).columns[3:]
    bme, skin = ["bme_temperature_c", "bme_pressure_hpa", "bme_humidity_pct"], ["t117_temperature_c"]
    axes, proc = [f"icm_{a}" for a in X.MOTION_AXES], [f"icm_{a}_proc" for a in X.MOTION_AXES]
    assert names("raw") == [*bme, "ppg_raw", *skin, *axes]
    assert names("raw", "both") == [*bme, "ppg_raw", *skin, *axes, *proc]
    engineered = names("engineered")
    assert engineered[:3] == bme and skin[0] in engineered and len([n for n in engineered if n.startswith("ppg_")]) == 9 and len([n for n in engineered if n.startswith("icm_")]) == 5
    assert names("segment_raw") == ["ppg_raw_seg", *[f"{a}_seg" for a in axes]]
    for bad in ("segment_raw", "other"):
        with pytest.raises(ValueError):
            X.standard_sensors(tables, ["g"], mode=bad)
    got = X.aligned_auxiliary(targets, tables, ["g"], "ts", ["sample"], "both", "both")
    assert got.count() == 8 and all(x is not None for r in got.collect() for x in r)


def test_segments_travel_short(spark):
    """No exchange carries filled-up segments: what a row takes on its way does not depend on the number of slots."""
    rng = np.random.default_rng(3)
    rows, tables = sensors(spark, rng, 5)
    targets = spark.createDataFrame([(g, float(t), k) for g in (1, None) for k, t in enumerate((0.2, 1.5, 1.9, 4.0, 8.7))], "g int, ts double, sample int")
    plan = X.segment_features(targets, tables, ["g"], "ts", ["ts", "id"], 5, 5)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Join ")
    assert "array_repeat" in above and "array_repeat" not in below
