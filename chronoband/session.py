"""Session settings and the two knobs every operator shares.

The settings are the ones a cluster run wants: adaptive execution with skew
splitting, UTC as the session zone, Arrow in batches of bounded size for the few
Python stages, and checkpoint files removed with their references.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_CHUNK = 250_000
ROWS_PER_CHUNK_CONF = "spark.chronoband.rowsPerChunk"


RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "2m",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(master: str | None = None, app: str = "chronoband", **extra: str) -> SparkSession:
    conf = {
        **RUNTIME,
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    conf.update(extra)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepared(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on, for a session made elsewhere.

    On a cluster the shared folder is asked for here, at every table size, and
    not first by the operator that meets a large group.
    """
    if not spark.sparkContext.master.startswith("local"):
        shared_dir(spark)
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def rows_per_chunk(spark: SparkSession) -> int:
    """Most rows one window task should own; operators split larger groups."""
    return int(spark.conf.get(ROWS_PER_CHUNK_CONF, str(ROWS_PER_CHUNK)))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="chronoband-")
    sc.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{os.urandom(6).hex()}")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage on the shared folder; survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
