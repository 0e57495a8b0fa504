"""Scans, filters, sinks, run mining, models and live operators on the driver's tables."""

from __future__ import annotations

import struct

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import functions as F

from chronoband.functions import arrays as A
from chronoband.functions import timekeys as K
from chronoband.operators import auxiliary as X
from chronoband.operators import models as ML
from chronoband.operators import runs as G
from chronoband.operators.align import interpolate, keep_first
from chronoband.operators.metrics import regression
from chronoband.operators.normalise import scale_columns
from chronoband.operators.ordered import attach, indexed
from chronoband.operators.rhythm import segments
from chronoband.operators.splits import diagnostic_random
from chronoband.plans import inputs as I
from chronoband.plans.alignment import AKIMA_ABCD, AKIMA_D, HERMITE, HORNER, NEIGHBOURS, PCHIP_D
from chronoband.plans.registry import query
from chronoband.session import scratch_path
from chronoband.sources import binary as B
from chronoband.sources import committed as C
from chronoband.sources import labels as L
from chronoband.sources import recorder as R
from chronoband.sources import sinks as W
from chronoband.sources import tables as S
from chronoband.streaming import live as V

SER = f"WITH {I.SERIES}"
NTZ = lambda text: F.lit(text).cast("timestamp_ntz")


# ---- recorder files: written from the tables by tasks, then scanned ---------------

def _land(df, folder, name, encode, header):
    def write(batches):
        fs, inner = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        fs.create_dir(inner)
        task = TaskContext.get()
        path = f"{inner}/{name}{task.partitionId():05d}.BIN"
        own = f"{path}.{task.taskAttemptId()}"
        n = 0
        with fs.open_output_stream(own) as f:
            f.write(header)
            for b in batches:
                for row in b.itertuples(index=False):
                    f.write(encode(row))
                    n += 1
        fs.move(own, path)  # a repeated task puts the same whole file in place
        yield pd.DataFrame({"n": [n]})
    df.mapInPandas(write, "n long").agg(F.sum("n")).first()


def spectrum_files(spark, d):
    """Embedding bins as counts, one file per label bucket, a skipped record after each row."""
    folder = scratch_path(spark, "spectrum-files")
    p = I.spectra(spark, d).select("vec_id", F.transform("power", lambda x: F.round((x + 1) * 1000).cast("int")).alias("p"))
    encode = lambda r: struct.pack(f"<dH{len(r.p)}i", float(r.vec_id), len(r.p), *r.p) + struct.pack("<dH", 0.0, 0xFFFF)
    _land(p.repartition(4, "vec_id"), folder, "s", encode, struct.pack("<8s3I", b"SPECDATA", 1, 10, 64))
    return folder


COUNTS = f"WITH {I.CELLS} SELECT vec_id::DOUBLE AS ts, bin, round((x + 1) * 1000)::INT AS counts FROM cells"


def _count_cells(df, ts="ts"):
    x = df.select(F.col(ts).cast("double").alias("ts"), F.posexplode_outer("power").alias("bin", "counts"))
    return x.select("ts", F.col("bin").cast("long").alias("bin"), F.col("counts").cast("int").alias("counts"))


@query("s1_spectrum_files", COUNTS)
def spectrum_scan(spark, d):
    return _count_cells(R.read_recorder(spark, spectrum_files(spark, d), "spectrum", "S*.bin"))


@query("s1_spectrum_time_range", COUNTS.replace("FROM cells", "FROM cells WHERE vec_id BETWEEN 40 AND 160"))
def spectrum_range(spark, d):
    """The bounds reach the reading tasks; the unread columns are never decoded."""
    x = R.read_recorder(spark, spectrum_files(spark, d), "spectrum", "S*.bin", columns=["ts", "power"])
    return _count_cells(x.where(F.col("ts").between(40.0, 160.0)))


@query("s4_many_files_in_blocks", COUNTS)
def spectrum_blocks(spark, d):
    return _count_cells(B.read_spectrum(B.listed(spark, spectrum_files(spark, d), "*.bin"), block=4096))


@query("s4_many_files_in_ranges", COUNTS)
def spectrum_ranges(spark, d):
    return _count_cells(R.read_recorder(spark, spectrum_files(spark, d), "spectrum", "*.bin", block=4096))


def aux_files(spark, d):
    folder = scratch_path(spark, "aux-files")
    kinds = {"signup": 0x10, "click": 0x11, "view": 0x12, "purchase": 0x13, "error": 0x12}  # five types, four kinds of record

    def encode(r):
        tag, t, v = kinds[r.event_type], r.us / 1e6, r.event_id % 1000
        body = {0x10: lambda: struct.pack("<dfff", t, v, v + 1, v + 2), 0x11: lambda: struct.pack("<diihBB", t, v, -v, v - 500, v % 100, 0),
                0x12: lambda: struct.pack("<df", t, v), 0x13: lambda: struct.pack("<d6f", t, *[v + i for i in range(6)])}[tag]()
        return bytes([tag]) + body
    s = I.series(spark, d).select("event_id", "us", "event_type")
    _land(s.repartition(4, "event_id"), folder, "A", encode, struct.pack("<8sII", b"AUXDATA", 1, 0))
    return folder


@query("s2_aux_files", SER + """ SELECT CASE event_type WHEN 'error' THEN 'view' ELSE event_type END AS kind, round(us / 1e6, 6) AS ts, (event_id % 1000)::DOUBLE AS first_value,
 CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN 1 WHEN 'signup' THEN 3 WHEN 'click' THEN 5 ELSE 6 END::INT AS width FROM series""")
def aux_scan(spark, d):
    kind = F.when(F.col("tag") == 0x10, "signup").when(F.col("tag") == 0x11, "click").when(F.col("tag") == 0x12, "view").otherwise("purchase")
    return R.read_recorder(spark, aux_files(spark, d), "aux", "a*.bin", block=4096).select(kind.alias("kind"), F.round("ts", 6).alias("ts"), F.get("v", 0).alias("first_value"), F.size("v").alias("width"))


@query("s3_demultiplexed_pulse", SER + """ SELECT round(us / 1e6, 6) AS ts, (event_id % 1000)::INT AS red, -(event_id % 1000)::INT AS ir, CASE WHEN event_id % 1000 >= 500 THEN event_id % 1000 - 500 END::SMALLINT AS heart_rate_bpm, (event_id % 1000 % 100)::TINYINT AS spo2_percent FROM series WHERE event_type = 'click'""")
def demultiplexed(spark, d):
    return B.demultiplexed(B.read_aux(B.listed(spark, aux_files(spark, d), "a*.bin"), block=4096))["pulse"].drop("file_source").withColumn("ts", F.round("ts", 6))


@query("s3_demultiplexed_motion", SER + " SELECT round(us / 1e6, 6) AS ts, (event_id % 1000)::DOUBLE AS acc_x, (event_id % 1000 + 5)::DOUBLE AS gyr_z FROM series WHERE event_type = 'purchase'")
def demultiplexed_motion(spark, d):
    return B.demultiplexed(R.read_recorder(spark, aux_files(spark, d), "aux"))["motion"].select(F.round("ts", 6).alias("ts"), "acc_x", "gyr_z")


def _hex(spark, d):
    """Counts as little-endian 32-bit words in hex text, every third row in base64."""
    p = I.spectra(spark, d).select("vec_id", F.transform("power", lambda x: F.round((x + 1) * 1000).cast("int")).alias("p"))
    word = lambda v: F.concat(*[F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(255)), 2, "0") for i in range(4)])
    text = F.array_join(F.transform("p", word), "")
    return p.select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.base64(F.unhex(text))).otherwise(F.concat(F.lit("0x"), text)).alias("data"), F.size("p").alias("count"))


@query("s14_blob_decode", COUNTS.replace("vec_id::DOUBLE AS ts", "vec_id::DOUBLE AS ts"))
def blob_decode(spark, d):
    b = _hex(spark, d).withColumn("blob", B.payload(F.col("data")))
    b = b.withColumn("power", B.unpacked(F.col("blob"), B.blob_type(F.length("blob"), F.col("count"))))
    return _count_cells(B.modal_length(b.filter(F.size("power") == F.col("count")), "power"), "vec_id")


@query("s15_blob_type_guess", """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'i2' WHEN doc_id % 4 = 2 THEN 'i4' WHEN doc_id % 4 = 3 THEN 'f8' WHEN n_chars % 2 = 0 AND n_chars / 2 BETWEEN 8 AND 4096 THEN 'i2'
 WHEN n_chars % 4 = 0 AND n_chars / 4 BETWEEN 8 AND 4096 THEN 'i4' WHEN n_chars % 8 = 0 AND n_chars / 8 BETWEEN 8 AND 4096 THEN 'f8' END AS kind FROM documents""")
def blob_type(spark, d):
    x = I.table(spark, d, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 4).alias("m"))
    width = F.when(F.col("m") == 1, 2).when(F.col("m") == 2, 4).when(F.col("m") == 3, 8)
    length = F.when(F.col("m") == 0, F.col("n_chars")).otherwise(F.col("n_chars") * width)
    count = F.when(F.col("m") == 0, 0).otherwise(F.col("n_chars"))
    return x.select("doc_id", B.blob_type(length, count).alias("kind"))


# ---- tables ------------------------------------------------------------------------

@query("s5_range_scan", "SELECT event_id, user_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def range_scan(spark, d):
    return S.scan(I.table(spark, d, "events"), "ts", NTZ("2024-01-05 00:00:00"), NTZ("2024-01-12 12:00:00"), ["event_id", "user_id", "value"])


HOURLY = "date_trunc('hour', ts)"


def _hourly(spark, d, kinds):
    e = I.table(spark, d, "events").withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return {k: e.filter(F.col("event_type") == k).select("user_id", "hour", "event_id", "value") for k in kinds}


@query("s6_merged_files", f"SELECT event_id, event_type AS file_source FROM events QUALIFY row_number() OVER (PARTITION BY user_id, {HOURLY} ORDER BY event_type, event_id) = 1")
def merged_files(spark, d):
    kinds = ("click", "error", "purchase", "signup", "view")
    return S.merged(_hourly(spark, d, kinds), ["user_id", "hour"], ["event_id"]).select("event_id", "file_source")


@query("s8_merged_aux_files", f"SELECT event_id, event_type AS file_source FROM events WHERE event_type IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY user_id, {HOURLY} ORDER BY event_type, event_id) = 1")
def merged_aux(spark, d):
    return S.merged(_hourly(spark, d, ("click", "view")), ["user_id", "hour"], ["event_id"]).select("event_id", "file_source")


@query("s7_aliased_columns", "SELECT c_custkey AS ts, c_acctbal AS temperature_c, NULL::DOUBLE AS pressure_hpa FROM customer")
def aliased(spark, d):
    c = I.table(spark, d, "customer").select(F.col("c_custkey").alias("ts"), F.col("c_acctbal").alias("Temp"))
    return S.shaped(c, {"ts": "bigint", "temperature_c": "double", "pressure_hpa": "double"}, S.ALIASES["environment"])


@query("s9_label_table", "SELECT user_id, epoch_us(ts) / 1000000::DOUBLE AS ts, value AS glucose, strftime(date_trunc('second', ts) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS civil FROM events WHERE event_type = 'purchase'")
def label_table(spark, d):
    s = I.series(spark, d).filter("event_type = 'purchase'").select(F.col("exp_id").alias("user_id"), (F.col("us") / 1e6).alias("create_time"), "value")
    return L.from_table(s, "create_time", "value", ("user_id",))


@query("s10_label_documents_of_arrays", """WITH x AS (SELECT event_id, epoch(date_trunc('second', ts)) - 28800.0 AS ts, value FROM events WHERE event_type = 'view'),
y AS (SELECT event_id, ts, value AS glucose FROM x UNION ALL SELECT event_id, ts + 60, value / 2 FROM x) SELECT * FROM y WHERE ts <= 1705000000""")
def label_arrays(spark, d):
    e = I.table(spark, d, "events").filter("event_type = 'view'").withColumn("z", F.col("ts").cast("timestamp"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    doc = F.to_json(F.struct(F.array(F.date_format("z", fmt), F.date_format(F.col("z") + F.expr("INTERVAL 60 SECONDS"), fmt)).alias("times"),
                             F.lit("u").alias("username"), F.array(F.col("value"), F.col("value") / 2).alias("values")))
    return L.from_arrays(e.select("event_id", doc.alias("j")), "j", ("event_id",), stop=1705000000)


@query("s11_label_documents_of_objects", "SELECT event_id, strftime(ts, '2025-%m-%d %H:%M') AS datetime, value AS glucose FROM events WHERE event_type = 'view'")
def label_objects(spark, d):
    e = I.table(spark, d, "events").filter("event_type = 'view'")
    doc = F.to_json(F.array(F.struct(F.date_format(F.col("ts").cast("timestamp"), "MM.dd HH:mm").alias("time"), "value")))
    out = L.from_objects(e.select("event_id", doc.alias("j")), "j", ("event_id",))
    return out.withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm"))


@query("s12_recording_config", """SELECT 'e' || c_custkey AS experiment_name, '/data/u/' || c_name AS db_path, 1::INT AS n_files, CASE WHEN c_custkey % 2 = 0 THEN '/data/u/labels.db' END AS glucose_db_path,
 CASE WHEN c_custkey % 2 = 1 THEN '/abs/l.json' ELSE '' END AS json_path FROM customer""")
def recording_config(spark, d):
    c, k = I.table(spark, d, "customer"), F.col("c_custkey")
    doc = F.to_json(F.array(F.struct(F.concat(F.lit("e"), k).alias("experiment_name"), F.col("c_name").alias("db_path"),
                                     F.when(k % 2 == 0, "labels.db").alias("glucose_db_path"), F.when(k % 2 == 1, "/abs/l.json").alias("json_path"))))
    out = L.config(c.select(doc.alias("j")), "j", "/data/u")
    return out.select("experiment_name", "db_path", F.size("db_files").alias("n_files"), "glucose_db_path", "json_path")


@query("s13_discovered_recordings", """WITH f AS (SELECT user_id, epoch_us(min(ts)) AS a FROM events GROUP BY 1)
SELECT 'rec/' || user_id || '/s.db' AS path, CASE WHEN user_id % 3 = 0 THEN 'rec/' || user_id || '/cgm.db' ELSE 'rec/root_labels.db' END AS label_path,
 strftime(make_timestamp(a // 1000000 * 1000000) + INTERVAL 8 HOUR, '%m%d%H%M') || '_u' AS experiment_name FROM f""")
def discovery(spark, d):
    s = I.series(spark, d).groupBy("exp_id").agg((F.floor(F.min("us") / 1e6)).alias("min_ts"), F.floor(F.max("us") / 1e6).alias("max_ts"))
    folder = F.concat(F.lit("rec/"), F.col("exp_id"))
    s = s.withColumn("folder", folder).withColumn("root", F.lit("rec"))
    f = s.select(F.concat("folder", F.lit("/s.db")).alias("path"), "folder", "root", F.lit("spectrum").alias("kind"))
    own = s.filter("exp_id % 3 = 0").select(F.concat("folder", F.lit("/cgm.db")).alias("path"), "folder", "root", F.lit("labels").alias("kind"))
    js = s.filter("exp_id % 5 = 0").select(F.concat("folder", F.lit("/s.json")).alias("path"), "folder", "root", F.lit("json").alias("kind"))
    root = s.agg(F.first("root").alias("root")).select(F.lit("rec/root_labels.db").alias("path"), F.col("root").alias("folder"), "root", F.lit("labels").alias("kind"))
    files = f.unionByName(own).unionByName(js).unionByName(root)
    spans = s.select(F.concat("folder", F.lit("/s.db")).alias("path"), "min_ts", "max_ts")
    return S.discovered(files, spans, "u").select("path", "label_path", "experiment_name")


PROFILED = ("customer", "events", "lineitem", "nation", "orders", "part")


@query("s17_table_profile", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM {t}))::INT AS n_columns" for t in PROFILED))
def profile(spark, d):
    return S.profile({t: I.table(spark, d, t) for t in PROFILED}).select("table", "n_rows", "n_columns")


KEYS = {"customer": ["c_custkey"], "events": ["event_id"], "lineitem": ["l_orderkey", "l_linenumber"], "nation": ["n_nationkey"], "orders": ["o_orderkey"], "part": ["p_partkey"]}
TYPED = {"events": [("event_id", True), ("event_type", False), ("value", True)], "nation": [("n_nationkey", True), ("n_name", False)], "customer": [("c_custkey", True), ("c_acctbal", True), ("c_mktsegment", False)]}


@query("s17_column_profile", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", (SELECT count(*) FROM {t} WHERE {c} IS NULL) AS n_null, (SELECT min({c})::VARCHAR FROM {t}) AS lowest, (SELECT max({c})::VARCHAR FROM {t}) AS highest"
    for t, cs in TYPED.items() for c, number in cs if not number))
def column_profile(spark, d):
    """The exact parts for text columns; distinct counts and medians are sketches and stand in ``s17_column_sketches``."""
    p = S.column_profiles({t: I.table(spark, d, t).select(*[c for c, _ in TYPED[t]]) for t in TYPED}, {t: KEYS[t] for t in TYPED})
    return p.where("median IS NULL").select("table", "column", "n_null", "lowest", "highest")


@query("s17_column_sketches")
def column_sketches(spark, d):
    return S.column_profiles({t: I.table(spark, d, t) for t in PROFILED}, KEYS)


@query("s17_decoded_preview", """WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: round((x::DOUBLE + 1) * 1000)::INT) AS p FROM embeddings ORDER BY vec_id LIMIT 50)
SELECT vec_id, len(p)::BIGINT AS "count", len(p) * 4 AS data_len, 'i4' AS dtype, i - 1 AS place, p[i]::DOUBLE AS value FROM (SELECT *, unnest(range(1, 11)) AS i FROM h)""")
def decoded_preview(spark, d):
    """The first ten values of the blobs in the head of a table."""
    x = S.decoded_preview(_hex(spark, d).withColumn("count", F.col("count").cast("long")), "data", "count", ["vec_id"], 50, 10)
    return x.select("vec_id", "count", F.col("data_len").cast("long").alias("data_len"), "dtype", F.posexplode("preview").alias("place", "value")).withColumn("place", F.col("place").cast("long"))


@query("s16_table_roles", "SELECT 'raw_ppg' AS \"table\", 'pulse' AS role, 'ts' AS time_column, (SELECT count(*) FROM events WHERE event_type = 'click') AS n_rows UNION ALL SELECT 'env_bme', 'environment', 'Time', (SELECT count(*) FROM events WHERE event_type = 'view')")
def roles(spark, d):
    e = I.table(spark, d, "events")
    t = {"raw_ppg": e.filter("event_type = 'click'").select("ts", F.col("value").alias("red"), F.col("value").alias("ir")),
         "env_bme": e.filter("event_type = 'view'").select(F.col("ts").alias("Time"), F.col("value").alias("temp"))}
    return S.profile(t).select("table", "role", "time_column", "n_rows")


@query("s18_missing_inputs", "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def missing_inputs(spark, d):
    return S.missing(I.table(spark, d, "orders").select(F.col("o_custkey").alias("key")), I.table(spark, d, "events").select(F.col("user_id").alias("key")), "key")


@query("s19_table_sink", SER + " SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM series GROUP BY 1")
def table_sink(spark, d):
    path = scratch_path(spark, "sink")
    W.write_table(I.series(spark, d), path, "parquet", ["event_type"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s19_matrix_sink", f"WITH {I.CELLS}, p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings) SELECT position, vec_id AS key, bin, round(x, 6) + 0.0 AS x FROM cells JOIN p USING (vec_id)")
def matrix_sink(spark, d):
    """Written through the commit protocol, read back from the ``.npy`` files."""
    path = scratch_path(spark, "matrix")
    C.write_matrix(I.spectra(spark, d), path, "vec_id", "power")
    x = C.read_matrix(spark, path).select("position", "key", F.posexplode("features").alias("bin", "x"))
    return x.select("position", "key", F.col("bin").cast("long").alias("bin"), I.rounded(F.col("x").cast("double")).alias("x"))


@query("s20_record_sink", "SELECT event_id, event_type, round(value, 6) + 0.0 AS value, 2::BIGINT AS n FROM events")
def record_sink(spark, d):
    """Two trials; the second is sent twice and stands once."""
    path = scratch_path(spark, "records")
    for trial in ("first", "second", "second"):
        C.append_trial(I.series(spark, d).select("event_id", "event_type", "value"), path, trial)
    x = C.read_records(spark, path, "event_id long, event_type string, value double")
    return x.groupBy("event_id", "event_type", I.rounded(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("s21_trainer_batches", f"WITH {I.CELLS} SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, md5(vec_id || ':42') AS shuffle_key, CASE WHEN bin < 52 THEN 'spectrum' ELSE 'aux' END AS part, CASE WHEN bin < 52 THEN bin ELSE bin - 52 END AS i, round(x, 6) + 0.0 AS x FROM cells")
def trainer_batches(spark, d):
    s = I.spectra(spark, d).withColumn("split", F.when(F.col("vec_id") % 3 == 0, "test").otherwise("train")).withColumnRenamed("power", "features")
    path = scratch_path(spark, "batches")
    W.write_table(W.feature_batches(s.withColumn("label", F.lit(0.0)), "late_fusion", "vec_id", 52), path)
    b, parts = spark.read.parquet(path), []
    for part in ("spectrum", "aux"):
        x = b.select("vec_id", "split", "shuffle_key", F.lit(part).alias("part"), F.posexplode(part).alias("i", "x"))
        parts.append(x.select("vec_id", "split", "shuffle_key", "part", F.col("i").cast("long").alias("i"), I.rounded(F.col("x")).alias("x")))
    return parts[0].unionByName(parts[1])


# ---- filters -----------------------------------------------------------------------

CONFIG = "cfg AS (SELECT c_custkey AS exp_id, 1704067200.0::DOUBLE + (c_custkey % 35) * 86400 AS a, 1704067200.0::DOUBLE + (c_custkey % 35 + c_custkey % 7) * 86400 AS b FROM customer)"


@query("f1_effective_range", SER + f", {CONFIG}, sp AS (SELECT exp_id, min(us / 1e6) AS lo, max(us / 1e6) AS hi FROM series GROUP BY 1) SELECT exp_id, round(greatest(a, lo), 6) AS from_ts, round(least(b, hi), 6) AS to_ts FROM cfg JOIN sp USING (exp_id) WHERE greatest(a, lo) < least(b, hi)")
def effective(spark, d):
    c, k = I.table(spark, d, "customer"), F.col("c_custkey")
    cfg = c.select(k.alias("exp_id"), (F.lit(1704067200.0) + (k % 35) * 86400).alias("start_ts"), (F.lit(1704067200.0) + (k % 35 + k % 7) * 86400).alias("end_ts"))
    s = I.series(spark, d).withColumn("sec", F.col("us") / 1e6)
    r = S.effective_ranges(cfg, s, ["exp_id"], "sec")
    return r.select("exp_id", F.round("from_ts", 6).alias("from_ts"), F.round("to_ts", 6).alias("to_ts"))


@query("f2_chosen_recordings", "SELECT c_custkey FROM customer WHERE c_name IN ('Customer#000000003', 'Customer#000000011') OR c_mktsegment IN ('Customer#000000003', 'MACHINERY')")
def chosen(spark, d):
    return S.chosen(I.table(spark, d, "customer"), ["Customer#000000003", "Customer#000000011", "MACHINERY"], "c_name", "c_mktsegment").select("c_custkey")


@query("f3_labels_inside_range", SER + ", sp AS (SELECT exp_id, min(us) AS lo, max(us) AS hi FROM series WHERE event_type = 'view' GROUP BY 1) SELECT event_id FROM series JOIN sp USING (exp_id) WHERE event_type = 'purchase' AND us BETWEEN lo AND hi")
def inside(spark, d):
    s = I.series(spark, d)
    span = s.filter("event_type = 'view'").groupBy("exp_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    return attach(s.filter("event_type = 'purchase'"), span, ["exp_id"], "inner").filter("us BETWEEN lo AND hi").select("event_id")


@query("f4_time_slice", SER + ", sp AS (SELECT exp_id, min(t) AS lo, max(t) AS hi FROM series GROUP BY 1) SELECT event_id FROM series JOIN sp USING (exp_id) WHERE lo + 60 < hi AND (hi - lo <= 200 OR t BETWEEN lo + 60 AND lo + 60 + 200)")
def time_slice(spark, d):
    return S.time_slice(I.series(spark, d), ["exp_id"], "t", 200.0, 60.0).select("event_id")


@query("f5_drop_missing", "SELECT event_id FROM events WHERE event_id % 3 <> 0 AND value <= 100")
def drop_missing(spark, d):
    s = I.series(spark, d).select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("red"), F.when(F.col("value") <= 100, 1).alias("ir"))
    return s.dropna(subset=["red", "ir"]).select("event_id")


@query("f6_first_per_timestamp", f"SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, {HOURLY} ORDER BY event_id) = 1")
def first_per_time(spark, d):
    s = I.series(spark, d).withColumn("hour", F.floor("t"))
    return keep_first(s, ["exp_id", "hour"], ["event_id"]).select("event_id")


@query("f7_day_filter", "SELECT event_id FROM events WHERE ts::DATE = DATE '2024-01-09'")
def day_filter(spark, d):
    e = I.table(spark, d, "events")
    return S.scan(e, "ts", NTZ("2024-01-09 00:00:00"), NTZ("2024-01-09 23:59:59.999999")).select("event_id")


@query("f7_available_days", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events")
def days(spark, d):
    return I.table(spark, d, "events").select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day")).distinct()


@query("f8_minimum_points", SER + " SELECT exp_id, CASE WHEN count(*) >= 5 THEN 'akima' WHEN count(*) >= 3 THEN 'pchip' WHEN count(*) >= 2 THEN 'linear' ELSE 'constant' END AS method FROM series WHERE event_type = 'purchase' AND value > 80 GROUP BY 1")
def minimum(spark, d):
    n = I.series(spark, d).filter("event_type = 'purchase' AND value > 80").groupBy("exp_id").count()
    return n.select("exp_id", F.when(F.col("count") >= 5, "akima").when(F.col("count") >= 3, "pchip").when(F.col("count") >= 2, "linear").otherwise("constant").alias("method"))


@query("t4_head_sample", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 50")
def head(spark, d):
    return S.head(I.series(spark, d), ["us", "event_id"], 50).select("event_id", "value")


FEW = f"WITH {I.SERIES}, {I.TARGETS}, knots AS (SELECT exp_id, t AS kt, value AS y FROM series WHERE event_type = 'purchase' AND value > 80)"


@query("i7_method_by_knot_count", FEW + NEIGHBOURS + f", {AKIMA_ABCD}, dd AS (SELECT *, CASE WHEN n >= 5 THEN {AKIMA_D} ELSE {PCHIP_D} END AS d FROM ac)" + HERMITE
       + f", one AS (SELECT exp_id, any_value(y) AS y1 FROM knots GROUP BY 1 HAVING count(*) = 1) SELECT t.event_id, t.exp_id, round(coalesce(y1, CASE WHEN z.t BETWEEN z.lo AND z.hi THEN {HORNER.replace('(t - kt)', '(z.t - kt)')} END), 6) + 0.0 AS interp FROM targets t LEFT JOIN z USING (event_id) LEFT JOIN one ON one.exp_id = t.exp_id")
def by_count(spark, d):
    k = I.knots(spark, d).filter("y > 80")
    out = interpolate(I.targets(spark, d), k, ["exp_id"], "t", "kt", "y", "akima", "null", "interp", ["event_id"])
    return out.select("event_id", "exp_id", I.rounded(F.col("interp")).alias("interp"))


def _pair(kind, name):
    return f"""{name}b AS (SELECT s.event_id, s.exp_id, s.t, k.t AS pt, k.value AS py FROM targets s ASOF LEFT JOIN (SELECT * FROM series WHERE event_type = '{kind}') k ON s.exp_id = k.exp_id AND s.t >= k.t),
{name} AS (SELECT b.*, CASE WHEN pt = b.t THEN py ELSE py + (b.t - pt) * (k.value - py) / (k.t - pt) END AS v FROM {name}b b ASOF LEFT JOIN (SELECT * FROM series WHERE event_type = '{kind}') k ON b.exp_id = k.exp_id AND b.t < k.t)"""


_FILL = "coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY exp_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (PARTITION BY exp_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {c}"


@query("i9_aux_alignment", f"WITH {I.SERIES}, {I.TARGETS}, {_pair('purchase', 'pu')}, {_pair('click', 'cl')}, w AS (SELECT pu.event_id, pu.exp_id, pu.t, pu.v AS a, pu.v * 2 + 1 AS b, cl.v AS c FROM pu JOIN cl USING (event_id)), "
       f"f AS (SELECT event_id, exp_id, {_FILL.format(c='a')}, {_FILL.format(c='b')}, {_FILL.format(c='c')} FROM w) SELECT event_id, "
       + ", ".join(f"round(({c} - avg({c}) OVER p) / CASE WHEN stddev_pop({c}) OVER p > 1e-8 THEN stddev_pop({c}) OVER p ELSE 1 END, 6) + 0.0 AS f_{c}" for c in "abc") + " FROM f WINDOW p AS (PARTITION BY exp_id)")
def aux_alignment(spark, d):
    s = I.series(spark, d)
    env = s.filter("event_type = 'purchase'").select("exp_id", F.col("t").alias("kt"), F.col("value").alias("x"), (F.col("value") * 2 + 1).alias("y"))
    imu = s.filter("event_type = 'click'").select("exp_id", F.col("t").alias("kt"), F.col("value").alias("z"))
    out = X.align_sensors(I.targets(spark, d), [X.Sensor(env, "kt", {"x": "f_a", "y": "f_b"}), X.Sensor(imu, "kt", {"z": "f_c"}, True)],
                          ["exp_id"], "t", ["event_id"], "linear")
    return out.select("event_id", *[I.rounded(F.col(f"f_{c}")).alias(f"f_{c}") for c in "abc"])


KNOTTED = f"WITH {I.SERIES}, {I.TARGETS}, {I.KNOTS}"


@query("i9_aux_alignment_pchip", KNOTTED + NEIGHBOURS + f", dd AS (SELECT *, {PCHIP_D} AS d FROM s)" + HERMITE
       + f", w AS (SELECT event_id, exp_id, t, CASE WHEN t BETWEEN lo AND hi THEN {HORNER} END AS a FROM z), f AS (SELECT event_id, exp_id, {_FILL.format(c='a')} FROM w) "
       + "SELECT event_id, round((a - avg(a) OVER p) / CASE WHEN stddev_pop(a) OVER p > 1e-8 THEN stddev_pop(a) OVER p ELSE 1 END, 5) + 0.0 AS f_a, "
       + "round((a - avg(a) OVER p) / CASE WHEN stddev_pop(a) OVER p > 1e-8 THEN stddev_pop(a) OVER p ELSE 1 END, 5) + 0.0 AS f_b FROM f WINDOW p AS (PARTITION BY exp_id)")
def aux_pchip(spark, d):
    """The second channel is an affine copy of the first, so its z-scores agree."""
    s = I.series(spark, d)
    env = s.filter("event_type = 'purchase'").select("exp_id", F.col("t").alias("kt"), F.col("value").alias("x"), (F.col("value") * 2 + 1).alias("y"))
    out = X.align_sensors(I.targets(spark, d), [X.Sensor(env, "kt", {"x": "f_a", "y": "f_b"})], ["exp_id"], "t", ["event_id"], "pchip")
    return out.select("event_id", *[I.rounded(F.col(c), 5).alias(c) for c in ("f_a", "f_b")])


def aux_tables(spark, d):
    """The events as four sensors whose second is a day, so that a second has several samples."""
    s = I.series(spark, d).withColumn("ts", F.col("t") / 24)
    of = lambda kind, **columns: s.filter(F.col("event_type") == kind).select("exp_id", "ts", "event_id", *[c.alias(k) for k, c in columns.items()])
    v = F.col("value")
    return s.filter("event_type = 'view'").select("event_id", "exp_id", "us", "ts"), {
        "environment": of("purchase", temperature_c=v, pressure_hpa=v * 2 + 1, humidity_pct=v / 4),
        "pulse": of("click", raw=v, filter=v / 3, hr=v, hrv=v + 5, peak=F.col("event_id") % 2),
        "skin": of("signup", temperature_c=v),
        "motion": of("error", acc_x=v, acc_y=v + 1, acc_z=v * 2, gyr_x=v - 3, gyr_y=v / 2, gyr_z=v * 3)}


MODE_FEATURES = {
    "raw": {"bme_temperature_c": "pu", "bme_pressure_hpa": "pu", "bme_humidity_pct": "pu", "ppg_raw": "cl", "t117_temperature_c": "si",
            **{f"icm_{a}": "er" for a in X.MOTION_AXES}},
}


@query("i9_mode_raw", f"WITH {I.SERIES}, {I.TARGETS}, {_pair('purchase', 'pu')}, {_pair('click', 'cl')}, {_pair('signup', 'si')}, {_pair('error', 'er')}, "
       + "w AS (SELECT pu.event_id, pu.exp_id, pu.t, pu.v AS pu, cl.v AS cl, si.v AS si, er.v AS er FROM pu JOIN cl USING (event_id) JOIN si USING (event_id) JOIN er USING (event_id)), "
       + f"f AS (SELECT event_id, exp_id, {', '.join(_FILL.format(c=c) for c in ('pu', 'cl', 'si', 'er'))} FROM w), "
       + "z AS (SELECT event_id, " + ", ".join(f"round(({c} - avg({c}) OVER p) / CASE WHEN stddev_pop({c}) OVER p > 1e-8 THEN stddev_pop({c}) OVER p ELSE 1 END, 5) + 0.0 AS {c}" for c in ("pu", "cl", "si", "er")) + " FROM f WINDOW p AS (PARTITION BY exp_id)) "
       + "SELECT event_id, " + ", ".join(f"{v} AS {k}" for k, v in MODE_FEATURES["raw"].items()) + " FROM z")
def aux_raw(spark, d):
    """Affine copies of a channel have its z-scores, which is what the SQL says."""
    targets, tables = aux_tables(spark, d)
    out = X.aligned_auxiliary(targets, tables, ["exp_id"], "ts", ["event_id"], "raw", method="linear")
    return out.select("event_id", *[I.rounded(F.col(c), 5).alias(c) for c in MODE_FEATURES["raw"]])


def _mode(mode, motion):
    def run(spark, d):
        targets, tables = aux_tables(spark, d)
        out = X.aligned_auxiliary(targets, tables, ["exp_id"], "ts", ["event_id"], mode, motion, "linear")
        return out.select("event_id", *[I.rounded(F.col(c), 5).alias(c) for c in out.columns if c not in targets.columns])
    return run


query("i9_mode_engineered")(_mode("engineered", "raw"))
query("i9_mode_both")(_mode("both", "both"))
SEGMENTS = ["ppg_raw", *[f"icm_{a}" for a in X.MOTION_AXES]]


@query("i9_mode_segment_raw", f"""WITH {I.SERIES}, {I.TARGETS}, raw AS (SELECT exp_id, event_id, t / 24 AS ts, value AS v, event_type FROM series),
x AS (SELECT exp_id, event_id, ts, unnest(CASE event_type WHEN 'click' THEN [{{'feature': 'ppg_raw', 'v': v}}] WHEN 'error' THEN [{{'feature': 'icm_acc_x', 'v': v}}, {{'feature': 'icm_acc_y', 'v': v + 1}}, {{'feature': 'icm_acc_z', 'v': v * 2}},
  {{'feature': 'icm_gyr_x', 'v': v - 3}}, {{'feature': 'icm_gyr_y', 'v': v / 2}}, {{'feature': 'icm_gyr_z', 'v': v * 3}}] END, recursive := true) FROM raw WHERE event_type IN ('click', 'error')),
l AS (SELECT exp_id, feature, floor(ts)::BIGINT AS sec, list(v ORDER BY ts, event_id) AS l FROM x GROUP BY ALL),
g AS (SELECT t.event_id, t.exp_id, f.feature, s.slot, coalesce(l.l[s.slot + 1], 0) AS v FROM targets t CROSS JOIN (SELECT unnest({SEGMENTS}) AS feature) f CROSS JOIN (SELECT unnest(range(0, 64)) AS slot) s
  LEFT JOIN l ON l.exp_id = t.exp_id AND l.feature = f.feature AND l.sec = floor(t.t / 24)::BIGINT),
z AS (SELECT event_id, feature, slot, (v - avg(v) OVER p) / CASE WHEN stddev_pop(v) OVER p > 1e-8 THEN stddev_pop(v) OVER p ELSE 1 END AS z FROM g WINDOW p AS (PARTITION BY exp_id, feature, slot))
SELECT event_id, feature, round(sum(z * (slot + 1)), 4) + 0.0 AS weighted, round(max(z), 4) + 0.0 AS highest FROM z GROUP BY 1, 2""")
def aux_segments(spark, d):
    """256 pulse and 128 motion slots per column; all are summed, those no second fills are nought."""
    targets, tables = aux_tables(spark, d)
    out = X.aligned_auxiliary(targets, tables, ["exp_id"], "ts", ["event_id"], "segment_raw", order=["ts", "event_id"])
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{n}_seg").alias("x")) for n in SEGMENTS])
    x = out.select("event_id", F.inline(parts))
    total = A.total(F.transform("x", lambda v, i: v * (i + 1)))
    return x.select("event_id", "feature", I.rounded(total, 4).alias("weighted"), I.rounded(F.array_max("x"), 4).alias("highest"))


# ---- logs and commands -----------------------------------------------------------------

def logs(spark, d):
    """Log texts made of the orders' numbers."""
    o, k = I.table(spark, d, "orders"), F.col("o_orderkey")
    mae, rmse = F.format_string("%d.%02d", k % 7, k % 100), F.format_string("%d.%02d", k % 9 + 1, (k * 3) % 100)
    text = F.concat(F.lit("epoch 1\nval MAE: 9.5\n"), F.when(k % 3 == 0, F.concat(F.lit("Mean over runs RMSE: "), rmse, F.lit(" then MAE: "), mae, F.lit(" and R²: 0.5\n")))
                    .otherwise(F.concat(F.lit("Test RMSE: "), rmse, F.lit("\nTest MAE: "), mae, F.lit("\nTest R²: 0.25\n"))),
                    F.lit("BEST_TEST_MAE: 7.5\nBEST_TEST_EPOCH: 1\nBEST_TEST_RMSE: 8.5\nBEST_TEST_LOSS: 1e-1\nBEST_TEST_MAE: "), mae,
                    F.lit("\nBEST_TEST_EPOCH: 4\nBEST_TEST_RMSE: "), rmse, F.lit("\nBEST_TEST_LOSS: 2.5\n"))
    return o.select("o_orderkey", text.alias("text"))


NUM = "((o_orderkey % 7)::DOUBLE + round((o_orderkey % 100) / 100.0, 2))"
NUM2 = "((o_orderkey % 9 + 1)::DOUBLE + round((o_orderkey * 3 % 100) / 100.0, 2))"


@query("g1_log_metrics", f"""SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 > 0 THEN {NUM} END, 2) AS mae, round(CASE WHEN o_orderkey % 3 > 0 THEN {NUM2} END, 2) AS rmse,
 round(CASE WHEN o_orderkey % 3 = 0 THEN {NUM} END, 2) AS mean_mae, CASE WHEN o_orderkey % 3 = 0 THEN 0.5::DOUBLE END AS mean_r2, round({NUM}, 2) AS best_mae, 4::BIGINT AS best_epoch, round({NUM2}, 2) AS best_rmse FROM orders""")
def log_metrics(spark, d):
    x = G.log_report(logs(spark, d), "text", "m", "b")
    return x.select("o_orderkey", F.col("m.MAE").alias("mae"), F.col("m.RMSE").alias("rmse"), F.col("m.Mean_MAE").alias("mean_mae"),
                    F.col("m.Mean_R2").alias("mean_r2"), F.col("b.mae").alias("best_mae"), F.col("b.epoch").alias("best_epoch"), F.col("b.rmse").alias("best_rmse"))


@query("g1_scoped_values", f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 3 ELSE 2 END::INT AS n_values, round({NUM}, 2) AS last_value FROM orders")
def scoped(spark, d):
    v = G.metric_values(F.regexp_replace("text", "BEST_TEST_", "best test "), "mae", "test")
    return logs(spark, d).select("o_orderkey", F.size(v).alias("n_values"), F.element_at(v, -1).alias("last_value"))


def commands(spark, d):
    o, k = I.table(spark, d, "orders"), F.col("o_orderkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    parts = [F.lit("python main.py --model"), pick("mlp", "cnn", "tcn"), F.when(k % 2 == 0, "--data_source db"),
             F.when(k % 3 == 0, "--mode window --window_size 30").when(k % 3 == 1, "--mode instant"),
             F.when(k % 4 == 0, "--experiments all").when(k % 4 == 1, "--experiments e1 e2 e3").when(k % 4 == 2, "--experiments e7"),
             F.when(k % 5 < 3, F.concat(F.lit("--data_fusion --fusion_method "), pick("film", "concat", "custom"))),
             F.when(k % 7 == 0, "--normalize"), F.lit("--lr 0.001"), F.when(k % 2 == 1, "--split_strategy alternating --n_splits 8").otherwise("--split_strategy date")]
    return o.select("o_orderkey", F.concat_ws(" ", *parts).alias("command"))


@query("g2_command_columns_and_name", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'db' ELSE 'bin' END AS data_source, ['mlp', 'cnn', 'tcn'][o_orderkey % 3 + 1] AS model,
 concat_ws('_', CASE WHEN o_orderkey % 2 = 0 THEN '[DB]' ELSE '[BIN]' END, ['mlp', 'cnn', 'tcn'][o_orderkey % 3 + 1], CASE o_orderkey % 4 WHEN 0 THEN 'expall' WHEN 1 THEN 'exp3exps' WHEN 2 THEN 'expe7' END,
 CASE o_orderkey % 3 WHEN 0 THEN 'win_ws30' WHEN 1 THEN 'inst' END, CASE WHEN o_orderkey % 5 < 3 THEN 'fuse' || ['film', 'con', 'cust'][o_orderkey % 3 + 1] END, CASE WHEN o_orderkey % 7 = 0 THEN 'norm' END,
 'lr0.001', CASE WHEN o_orderkey % 2 = 1 THEN 'alt8' ELSE 'dat' END) AS run_name FROM orders""")
def command_name(spark, d):
    return G.run_name(G.command_columns(commands(spark, d), "command")).select("o_orderkey", "data_source", "model", "run_name")


@query("g3_batch_summary", "SELECT o_orderstatus AS status, count(*) AS n_runs, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 6) AS percent, round(sum(o_totalprice) / 3600, 4) AS hours FROM orders GROUP BY 1")
def batch_summary(spark, d):
    s = G.batch_summary(I.table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), "status", "o_totalprice")
    return s.select("status", "n_runs", F.round("percent", 6).alias("percent"), F.round("hours", 4).alias("hours"))


@query("g4_leaderboard", "SELECT user_id, min(value) AS objective FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 25")
def leaderboard(spark, d):
    s = I.series(spark, d).withColumnRenamed("exp_id", "user_id")
    return G.leaderboard(s, ["user_id"], "value", "mae", ["us", "event_id"], 25)


@query("g4_objective", """WITH l AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)::DOUBLE) AS v FROM conversations)
SELECT conv_id, turn, list_max(v) AS best_r2, list_min(v) AS best_mae, v[-1] AS last FROM l""")
def objective(spark, d):
    c = I.table(spark, d, "conversations").withColumn("v", F.transform(F.split("text", " "), lambda w: F.length(w).cast("double")))
    return c.select("conv_id", "turn", G.objective(F.col("v"), "r2").alias("best_r2"), G.objective(F.col("v"), "mae").alias("best_mae"), G.objective(F.col("v"), "other").alias("last"))


# ---- models --------------------------------------------------------------------------

def _baselines(spark, d):
    s = I.spectra(spark, d).withColumn("y", F.col("label").cast("double"))
    return ML.compared(diagnostic_random(s, "vec_id"), "power", "y", folder=scratch_path(spark, "models")).filter("split = 'test'")


@query("r1_baseline_regression")
def baseline(spark, d):
    return regression(_baselines(spark, d), ["model"], "y", "y_pred").select("model", "n_samples", "mae", "rmse", "r2")


@query("r1_baseline_predictions")
def baseline_predictions(spark, d):
    return _baselines(spark, d).select("model", "vec_id", "split", "y", I.rounded(F.col("y_pred")).alias("y_pred"))


@query("r2_rolling_prediction")
def rolling(spark, d):
    s = segments(I.series(spark, d), ["exp_id"], ["us", "event_id"], "t")
    s = s.withColumn("split", F.when(F.col("exp_id") % 4 == 0, "test").otherwise("train")).withColumn("x", F.array((F.col("event_id") % 24).cast("double")))
    return ML.rolling_prediction(s, ["exp_id"], "segment", ["us", "event_id"], "x", "value", 3).select("event_id", "segment", "y_pred", "given")


WEIGHT, FEEDBACK, INTERCEPT = 0.0493827160493827, [0.4938271604938271, 0.1975308641975309, 0.0987654320987654], 1.0


@query("r2_rolling_given_model", SER + f""", p AS (SELECT event_id, exp_id, us // 604800000000 AS week, value, {INTERCEPT} + {WEIGHT} * (event_id % 24) AS drive,
  row_number() OVER w AS p, count(*) OVER (PARTITION BY exp_id, us // 604800000000) AS m FROM series WINDOW w AS (PARTITION BY exp_id, us // 604800000000 ORDER BY us, event_id)),
 r AS (WITH RECURSIVE q AS (
  SELECT event_id, exp_id, week, p, m >= 3 AS given, CASE WHEN m >= 3 THEN value ELSE drive + 5 * {sum(FEEDBACK)} END AS y, CASE WHEN m >= 3 THEN value ELSE drive + 5 * {sum(FEEDBACK)} END AS h1, 5.0::DOUBLE AS h2, 5.0::DOUBLE AS h3 FROM p WHERE p = 1
  UNION ALL SELECT n.event_id, n.exp_id, n.week, n.p, n.p <= 3 AND n.m >= 3, n.y, n.y, q_h1, q_h2
  FROM (SELECT p.*, q.h1 AS q_h1, q.h2 AS q_h2, CASE WHEN p.p <= 3 AND p.m >= 3 THEN p.value ELSE drive + {FEEDBACK[0]} * q.h1 + {FEEDBACK[1]} * q.h2 + {FEEDBACK[2]} * q.h3 END AS y
        FROM q JOIN p ON p.exp_id = q.exp_id AND p.week = q.week AND p.p = q.p + 1) n) SELECT * FROM q)
 SELECT event_id, given, round(y, 6) + 0.0 AS y_pred FROM r""")
def rolling_given(spark, d):
    """A model that is there, fed back through every week of every series."""
    s = I.series(spark, d).withColumn("week", F.floor(F.col("us") / F.lit(604_800_000_000))).withColumn("x", F.array((F.col("event_id") % 24).cast("double")))
    out = ML.rolled(s, ["exp_id"], "week", ["us", "event_id"], "x", "value", [WEIGHT], FEEDBACK, INTERCEPT)
    return out.select("event_id", "given", I.rounded(F.col("y_pred")).alias("y_pred"))


# ---- live ------------------------------------------------------------------------------

CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


def _stream(spark, d):
    return V.event_stream(spark, d, "events.parquet")


@query("q1_live_window_features", f"""SELECT user_id, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start_us, count(*) AS n, round(avg(value), 8) + 0.0 AS mean, round(coalesce(stddev_samp(value), 0), 6) + 0.0 AS std FROM events
 GROUP BY 1, 2 HAVING make_timestamp(epoch_us(time_bucket(INTERVAL 6 HOUR, any_value(ts)))) + INTERVAL 6 HOUR <= {CLOSED}""")
def live_windows(spark, d):
    x = V.drain(V.windowed_features(_stream(spark, d), ["user_id"], "ts", "value", "6 hours", "1 hour"), "live-windows")
    return x.select("user_id", F.unix_micros("window.start").alias("start_us"), "n", I.rounded(F.col("mean"), 8).alias("mean"), I.rounded(F.col("std")).alias("std"))


@query("q2_live_sliding_features", f"""WITH e AS (SELECT *, epoch_us(time_bucket(INTERVAL 3 HOUR, ts)) - 10800000000 * k AS start_us FROM events CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k))
SELECT user_id, start_us, round(avg(value), 8) + 0.0 AS mean, min(value) AS low, max(value) AS high FROM e GROUP BY 1, 2 HAVING make_timestamp(start_us) + INTERVAL 12 HOUR <= {CLOSED}""")
def live_sliding(spark, d):
    x = V.drain(V.sliding_features(_stream(spark, d), ["user_id"], "ts", "value", "12 hours", "3 hours", "1 hour"), "live-sliding")
    return x.select("user_id", F.unix_micros("window.start").alias("start_us"), I.rounded(F.col("mean"), 8).alias("mean"), "low", "high")


@query("q3_live_ema", f"""WITH l AS (SELECT event_id, ts, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS xs FROM events)
SELECT event_id, round(list_reduce(xs, lambda s, x: 0.3 * x + 0.7 * s), 6) + 0.0 AS ema FROM l WHERE ts < date_trunc('millisecond', {CLOSED})""")
def live_ema(spark, d):
    """All rows the final watermark has passed, smoothed in event time."""
    x = V.drain(V.live_ema(_stream(spark, d), "user_id", "ts", "event_id", "value", 0.3, "1 hour"), "live-ema")
    return x.select("event_id", I.rounded(F.col("ema")).alias("ema"))


@query("q4_live_sessions", f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 43200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, no HAVING max(ts) + INTERVAL 12 HOUR <= {CLOSED}""")
def live_sessions(spark, d):
    x = V.drain(V.sessions(_stream(spark, d), ["user_id"], "ts", "12 hours", "1 hour"), "live-sessions")
    return x.select("user_id", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")
