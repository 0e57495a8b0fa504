"""Hand-computed values."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from chronoband.functions import arrays as A
from chronoband.functions import clinical, fusion, tails
from chronoband.functions import timekeys as K
from chronoband.operators import align, drift, histories, metrics, outliers, recurrence, rhythm, runs, seconds, smooth, splits
from chronoband.sources import binary, labels, sinks, tables


def series(spark, values, ts=None):
    ts = ts or list(range(len(values)))
    return spark.createDataFrame([(1, float(t), v) for t, v in zip(ts, values)], "g int, t double, x double")


def column(df, name, order="t"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def report(spark, text):
    return runs.log_report(spark.createDataFrame([(text,)], "text string"), "text").first()


def test_names(spark):
    names = ["11201828_u1", "11141404_u1", "11211057_u1", "bad"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(K.start_from_dirname(F.col("n"))).collect()] == ["11.20 18:28", "11.14 14:04", "11.21 10:57", None]


def test_date_labels(spark):
    rows = [("2026-01-21 17:03:00", ""), ("11.20 18:28", ""), ("", "260121_1703_u1"), ("", "11201828_u1")]
    df = spark.createDataFrame(rows, "s string, n string")
    got = [r[0] for r in df.select(K.date_label(F.col("s"), F.col("n"))["label"]).collect()]
    assert got == ["2026-01-21", "11.20", "2026-01-21", "11.20"]
    with pytest.raises(Exception, match="no date"):
        spark.createDataFrame([("", "x")], "s string, n string").select(K.date_label(F.col("s"), F.col("n"))).collect()


def test_zone(spark):
    assert one(spark, K.civil_to_epoch(F.lit("2026-01-21 08:00:00"))) == 1768953600.0
    assert one(spark, K.epoch_to_civil(F.lit(1768953600.0))) == "2026-01-21 08:00:00"


KNOTS = {"line": [(0.0, 0.0), (10.0, 10.0)], "flat": [(0.0, 0.0), (1.0, 1.0), (2.0, 1.0)]}


def interp(spark, knots, at, method, outside="extrapolate"):
    k = spark.createDataFrame([(1, t, y) for t, y in knots], "g int, kt double, y double")
    t = spark.createDataFrame([(1, float(x)) for x in at], "g int, t double")
    return column(align.interpolate(t, k, ["g"], "t", "kt", "y", method, outside), "interp")


def test_linear_and_nearest(spark):
    assert interp(spark, KNOTS["line"], [5, 12], "linear") == [5, 12]
    assert interp(spark, KNOTS["line"], [5, 12], "linear", "null") == [5, None]
    assert interp(spark, KNOTS["line"], [5], "nearest") == [0]


def test_pchip(spark):
    assert interp(spark, KNOTS["flat"], [1.5], "pchip") == [1.0]
    knots = [(0.0, 0.0), (1.0, 2.0), (3.0, 2.5), (4.0, 7.0)]
    at = list(np.linspace(0, 4, 41))
    y = interp(spark, knots, at, "pchip")
    assert all(b - a >= -1e-12 for a, b in zip(y, y[1:]))           # monotone data stays monotone
    assert interp(spark, knots, [0, 1, 3, 4], "pchip") == pytest.approx([0, 2, 2.5, 7])


def test_single_knot_is_constant(spark):
    assert interp(spark, [(3.0, 4.0)], [0, 9], "pchip", "null") == [4.0, 4.0]


@pytest.mark.parametrize("chunk", [None, 130])
def test_spline_against_dense_solution(spark, chunked, chunk):
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.uniform(0.5, 1.5, 400))
    y = rng.normal(size=400)
    if chunk:
        chunked(chunk)
    mid = (t[:-1] + t[1:]) / 2
    got = interp(spark, list(zip(t.tolist(), y.tolist())), mid.tolist(), "cubic")
    n, h, m = len(t), np.diff(t), np.diff(y) / np.diff(t)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1], a[i, i], a[i, i + 1] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        b[i] = 3 * (h[i] * m[i - 1] + h[i - 1] * m[i])
    # not-a-knot: third derivatives agree across the second and the last but one knot
    for row, i in ((0, 0), (n - 1, n - 3)):
        for j, s in ((i, 1), (i + 1, -1)):
            a[row, j] += s / h[j] ** 2
            a[row, j + 1] += s / h[j] ** 2
            b[row] += s * 2 * m[j] / h[j] ** 2
    d = np.linalg.solve(a, b)
    x = mid - t[:-1]
    want = y[:-1] + x * (d[:-1] + x * ((3 * m - 2 * d[:-1] - d[1:]) / h + x * (d[:-1] + d[1:] - 2 * m) / h ** 2))
    assert got == pytest.approx(want.tolist(), abs=1e-9)


def test_smoothers(spark):
    assert column(smooth.causal_mean(series(spark, [1., 2., 3., 4.]), ["g"], ["t"], "x", 3), "smooth") == [1, 1.5, 2, 3]
    assert column(recurrence.ema(series(spark, [2., 4., 8.]), ["g"], ["t"], "x", 0.5), "ema") == [2, 3, 5.5]
    assert column(smooth.causal_median(series(spark, [5., 1., 9., 2.]), ["g"], ["t"], "x", 3), "smooth") == [5, 3, 5, 2]
    assert one(spark, smooth.frequency_mean(A.literal([3, 3, 3]), 3)) == pytest.approx([2, 3, 2])
    assert one(spark, smooth.frequency_savgol(A.literal([i ** 3 for i in range(12)]), 7, 3)) == pytest.approx([i ** 3 for i in range(12)])


def test_filters_are_causal(spark):
    a, b = [1., 5., 2., 8., 3., 4., 7.], [1., 5., 2., 8., 3., -40., 90.]
    for fn in smooth.TIME_METHODS.values():
        x, y = (column(fn(series(spark, v), ["g"], ["t"], "x", out="o"), "o")[:5] for v in (a, b))
        assert x == pytest.approx(y)


def test_repair_and_fill(spark):
    df = series(spark, [1., 100., 3.]).withColumn("bad", F.col("x") > 50)
    assert column(outliers.repair_linear(df, ["g"], ["t"], "x", "bad"), "repaired") == [1, 2, 3]
    assert column(outliers.filled(series(spark, [None, 2., None, 5.]), ["g"], ["t"], ["x"]), "x") == [2, 2, 2, 5]
    assert column(outliers.filled(series(spark, [None, None]), ["g"], ["t"], ["x"]), "x") == [0, 0]
    assert not any(column(outliers.flag_zscore(series(spark, [4., 4., 4.]), ["g"], "x"), "outlier"))


def test_gradient_and_segments(spark):
    assert column(rhythm.gradient(series(spark, [0., 1., 5.], [0, 1, 3]), ["g"], ["t"], "t", "x"), "slope") == pytest.approx([60, 80, 120])
    s = rhythm.segments(series(spark, [0.] * 5, [0, 1, 2, 20, 21]), ["g"], ["t"], "t")
    assert column(s, "segment") == [0, 0, 0, 1, 1]


def test_windows(spark):
    df = series(spark, [1., 2., 3., 4.])
    w = histories.count_windows(df, ["g"], ["t"], "x", 2)
    assert column(w, "history") == [[1, 2], [2, 3]]
    w = histories.count_windows(series(spark, [1., 2., 3.]), ["g"], ["t"], "x", 2, "edge")
    assert column(w, "history") == [[1, 1], [1, 2]]
    two = spark.createDataFrame([(1, 0., 1.), (1, 1., 2.), (2, 2., 9.), (2, 3., 8.)], "g int, t double, x double")
    assert column(histories.count_windows(two, ["g"], ["t"], "x", 1), "history") == [[1], [9]]    # never across groups
    h = histories.label_history(series(spark, [5., 6., 7.]), ["g"], ["t"], "x", 2)
    assert column(h, "label_history") == [[5, 5], [5, 5], [5, 6]]
    h = histories.label_history(series(spark, [5., 6., 7.]), ["g"], ["t"], "x", 2, aligned=False)
    assert column(h, "label_history") == [[5, 5], [5, 6], [6, 7]]
    assert one(spark, histories.history_from_window(A.literal([1, 2, 3, 4]), 2)) == [2, 3]
    assert one(spark, histories.history_from_window(A.literal([1, 2, 3]), 3)) == [1, 2]


def test_alternating(spark):
    df = series(spark, [0.] * 20)
    got = column(splits.alternating(df, ["t"], ["g"]), "split")[::2]
    assert got == ["train", "val", "train", "test", "train", "test", "train", "val", "train", "test"]
    got = column(splits.hybrid_alternating(df, ["t"], ["g"], use_val=False), "split")[::2]
    assert [i + 1 for i, s in enumerate(got) if s == "test"] == [7, 9]
    assert column(splits.alternating(series(spark, [0.] * 3), ["t"], ["g"]), "split") == [None] * 3


def test_split_sizes_and_errors(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    n = {r[0]: r[1] for r in splits.random(df, "k").groupBy("split").count().collect()}
    assert n == {"test": 16, "val": 15, "train": 70}
    with pytest.raises(ValueError):
        splits.split(df, "random", key="k", train=0.5, val=0.1, test=0.1)
    with pytest.raises(ValueError):
        splits.split(df, "unheard_of")
    d = splits.deranged(df.withColumn("y", F.col("k")), "k", ["y"])
    assert d.filter("y = k").count() == 0 and d.select("y").distinct().count() == 101


def test_clarke(spark):
    pairs = [(100, 110), (60, 200), (200, 60), (250, 100), (60, 100), (100, 220), (150, 20), (100, 150)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, b double")
    assert "".join(r[0] for r in df.select(clinical.zone(F.col("a"), F.col("b"))).collect()) == "AEEDDCCB"


def test_losses_and_tails(spark):
    df = spark.createDataFrame([(0.0, 0.5), (0.0, 2.0)], "y_true double, y_pred double")
    assert metrics.losses(df).first()["huber"] == pytest.approx(0.8125)
    assert tails.incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)
    assert tails.correlation_p(0.5, 27) == pytest.approx(0.0079, abs=2e-4)
    assert one(spark, tails.kolmogorov_tail(F.lit(1.3581))) == pytest.approx(0.05, abs=1e-4)


def test_distances(spark):
    df = spark.createDataFrame([("v", "train", 0.), ("v", "train", 1.), ("v", "test", 1.), ("v", "test", 2.)], "k string, s string, x double")
    r = drift.distances(df, ["k"], "x", "s", "train", ["test"]).first()
    assert (r["wasserstein"], r["ks_stat"]) == (1.0, 0.5)
    same = spark.createDataFrame([("v", s, 3.0) for s in ("train", "train", "test")], "k string, s string, x double")
    assert drift.distances(same, ["k"], "x", "s", "train", ["test"]).first()["psi"] == 0
    ph = spark.createDataFrame([(s, p) for s in ("train", "test") for p in drift.PHASES], "split string, phase string")
    assert drift.phase_js(ph, [], "split", "phase").first()[0] == pytest.approx(0)


def test_film_and_slots(spark):
    assert one(spark, fusion.film(A.literal([10]), A.literal([1, 1])))[0] == pytest.approx(11)
    df = series(spark, [7., 8., 9.], [0.1, 0.2, 0.3]).withColumn("s", F.floor("t"))
    assert seconds.raw_slots(df, ["g", "s"], ["t"], "x", 2).first()["slots"] == [7, 9]
    assert seconds.raw_slots(df, ["g", "s"], ["t"], "x", 4).first()["slots"] == [7, 8, 9, 0]


def test_tie_goes_to_the_earlier_sample(spark):
    kept = align.grid_downsample(series(spark, [0.] * 4, [0, 4, 6, 11]), ["g"], "t", 5.0, [])
    assert column(kept, "t") == [0, 4, 11]          # 5 is half-way between 4 and 6, 10 is nearest to 11


def test_merge_keeps_the_first_file(spark):
    a = spark.createDataFrame([(1.0, "a")], "ts double, v string")
    b = spark.createDataFrame([(1.0, "b"), (2.0, "b")], "ts double, v string")
    assert column(tables.merged({"f1": a, "f2": b}, ["ts"]), "v", "ts") == ["a", "b"]


def spectrum_file(records, tail=b""):
    body = b"".join(struct.pack(f"<dH{len(p)}i", t, len(p), *p) for t, p in records)
    return struct.pack("<8s3I", b"SPECDATA", 1, 10, 4) + body + tail


def test_binary_records():
    data = spectrum_file([(1.0, [1, 2, 3]), (2.0, [4, 5])], struct.pack("<dH", 0.0, 0xFFFF) + b"\1\2")[20:]
    t, n, p = binary.spectrum_records(data)
    assert (t, n, [list(x) for x in p]) == ([1.0, 2.0], [3, 2], [[1, 2, 3], [4, 5]])
    skin = bytes([0x12]) + struct.pack("<df", 5.0, 36.5)
    tags, times, values = binary.aux_records(skin + bytes([0x12]) + b"short")
    assert (tags, times, values) == ([0x12], [5.0], [[36.5]])
    assert binary.aux_records(skin + bytes([0x77]) + skin)[1] == [5.0]


def test_binary_files_and_rejects(spark, tmp_path):
    (tmp_path / "A.BIN").write_bytes(spectrum_file([(float(i), [i, i + 1]) for i in range(50)]))
    (tmp_path / "b.bin").write_bytes(b"NOTADATA" + b"\0" * 30)
    files = binary.listed(spark, str(tmp_path), "*.bin")
    assert binary.read_spectrum(files, block=64).count() == 50
    assert binary.rejects(files, "spectrum").count() == 1


def test_payload_and_modal_length(spark):
    df = spark.createDataFrame([("0x 01 00",), ("AQA=",), ("01000200",)], "s string")
    df = df.withColumn("b", binary.payload(F.col("s"))).withColumn("a", binary.unpacked(F.col("b"), F.lit("i2")))
    assert [r[0] for r in df.select("a").collect()] == [[1], [1], [1, 2]]
    assert binary.modal_length(df, "a").count() == 2


def test_missing_inputs_stop_early(spark):
    have, want = spark.createDataFrame([("a",)], "p string"), spark.createDataFrame([("a",), ("b",)], "p string")
    with pytest.raises(FileNotFoundError):
        tables.require_inputs(want, have, "p")


def test_history_slope(spark):
    assert one(spark, metrics.history_slope(A.literal([1, 2, 3]))) == pytest.approx(1)
    assert one(spark, metrics.history_slope(A.literal([4]))) == 0


def test_run_mining(spark):
    text = "Test RMSE: 1.5\nTest MAE: 0.9\nval MAE = 3\n"
    m = report(spark, text)["metrics"]
    assert (m["RMSE"], m["MAE"], m["Mean_MAE"]) == (1.5, 0.9, None)
    assert one(spark, runs.metric_values(F.lit(text), "mae", "test")) == [0.9]
    assert one(spark, runs.metric_values(F.lit(text), "mae")) == [0.9, 3.0]
    odd = "Test RMSE: 0.93.\nTest MAE: nan\nTest MAE is 2,\nval/mae=1e-1 (test mae 4)\nTest R²: x\nMean of all RMSE: 9"
    m = report(spark, odd)["metrics"]
    assert (m["RMSE"], m["MAE"], m["R2"], m["Mean_RMSE"]) == (0.93, 2.0, None, None)
    assert one(spark, runs.metric_values(F.lit(odd), "mae")) == [2.0, 0.1, 4.0]
    assert one(spark, runs.metric_values(F.lit(odd), "mae", "val")) == [0.1]
    assert report(spark, "Mean RMSE: 3 MAE: 2. R²: .5")["metrics"]["Mean_R2"] == 0.5
    marker = "best_test_mae: 1.\nBEST_TEST_EPOCH: 7\nnote 3\nBEST_TEST_RMSE: 2e0\nBEST_TEST_LOSS: 4\nBEST_TEST_MAE: 9\n"
    assert tuple(report(spark, marker)["best"]) == (1.0, 7, 2.0, 4.0)
    assert report(spark, "BEST_TEST_MAE: x")["best"] is None
    assert one(spark, runs.objective(A.literal([3, 1, 2]), "huber")) == 1 and one(spark, runs.objective(A.literal([3, 1, 2]), "r_2")) == 3
    cmd = spark.createDataFrame([("python main.py --model tcn --mode window --window_duration 30 --data_fusion --fusion_stage late "
                                  "--fusion_method_late gated_residual --aux_override --aux_override_value 0.5 --no_attention --epochs 9",)], "c string")
    assert runs.run_name(runs.command_columns(cmd, "c")).first()["run_name"] == "[BIN]_tcn_win_wd30_fuslgres_auxov0.5_noattn_ep9"


def test_unit_of_epoch(spark):
    got = [one(spark, K.epoch_unit(F.lit(x))) for x in (1.7e9, 1.7e12, 1.7e18)]
    assert got == ["s", "ms", "ns"]


def test_sinks(spark, tmp_path):
    df = series(spark, [1., 2.])
    sinks.write_table(df, str(tmp_path / "t"), "csv", ["g"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "t")).count() == 2
    f = df.select("t", F.array("x").alias("f")).coalesce(1).withColumn("k", F.col("t").cast("long"))
    blob = sinks.matrix_files(f, ["k"], "f").first()["content"]
    import io
    assert np.load(io.BytesIO(blob)).tolist() == [[1.0], [2.0]]


def test_label_documents(spark):
    doc = spark.createDataFrame([('{"times": ["2026-01-21 08:00:00"], "values": [5.5]}',)], "j string")
    assert labels.from_arrays(doc, "j").collect() == [Row(ts=1768953600.0, glucose=5.5)]
    doc = spark.createDataFrame([('[{"time": "11.20 18:28", "value": 6.1}]',)], "j string")
    assert str(labels.from_objects(doc, "j").first()["datetime"]) == "2025-11-20 18:28:00"


def test_wrong_names_are_refused(spark):
    df = series(spark, [1., 2.])
    with pytest.raises(ValueError):
        smooth.smooth_spectra(df.withColumn("power", F.array("x")), ["g"], ["t"], "fourier")
    with pytest.raises(ValueError):
        histories.count_windows(df, ["g"], ["t"], "x", 2, "mirror")
    with pytest.raises(ValueError):
        align.interpolate(df, df, ["g"], "t", "t", "x", "quintic")
    with pytest.raises(ValueError):
        fusion.fuse("sum", F.col("x"), F.col("x"))
    names = ["bme_pressure_hpa", "PPG_red", "t117_temperature_c", "icm_acc_x", "hr_mean", "note"]
    assert fusion.pulse_motion_indices(names) == [1, 3, 4]
    assert fusion.sensor_indices(names, ["t117"]) == [2]
    assert fusion.pulse_motion_indices(["a", "b"]) == [0, 1]
