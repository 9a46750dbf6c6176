"""Spark session settings and the shared staging location.

Every timestamp in the store is a UTC wall-clock value without zone
(TIMESTAMP_NTZ), so the session zone is pinned to UTC and ANSI mode stays
on: the parsers use the ``try_*`` forms wherever bad input must become NULL.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # raw pages are wide: Arrow batches are bounded by rows and by bytes, so
    # one batch of HTML never dominates a Python worker's memory
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
}


# Settings for a large cluster (~100 TB inputs): start shuffles wide and let
# AQE coalesce them to ~256 MB partitions, split skewed join partitions,
# and keep input splits and Arrow batches of raw HTML bounded.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "128",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}


def get_spark(master: str | None = None, app: str = "equitylake",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(SESSION_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled",
              "spark.sql.timestampType",
              "spark.sql.execution.arrow.maxRecordsPerBatch",
              "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set(k, conf[k])
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder for lineage cuts and staging tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir).
    Jobs never fall back to a machine-local folder: on a cluster that
    would lose staged data together with the executor that wrote it.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/...) before running jobs that stage data")
    return d


def ensure_checkpoint_dir(spark: SparkSession, fallback=None) -> str:
    """Set the checkpoint dir only when a local session has none (tests, bench).
    ``fallback``: a path, or None for a fresh scratch folder. On a cluster a
    missing setting is an error: a scratch folder there would be each
    machine's own."""
    d = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            return checkpoint_root(spark)  # raises
        if fallback is None:
            import tempfile
            fallback = tempfile.mkdtemp(prefix="equitylake-ckpt-")
        os.makedirs(fallback, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", fallback)
        spark.sparkContext.setCheckpointDir(fallback)
        d = fallback
    return d


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/equitylake-staging/{name}-{uuid.uuid4().hex}"


def utc_now():
    """Current UTC wall-clock time without zone (the store's stamp type)."""
    import datetime as dt
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


def ship_package(spark: SparkSession) -> None:
    """Make ``equitylake`` importable in Python workers (what ``--py-files``
    does on spark-submit): zip the package once per SparkContext and add it
    with ``addPyFile``. Workers need it for the page scanner."""
    import tempfile
    import zipfile
    sc = spark.sparkContext
    if getattr(sc, "_equitylake_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="equitylake-pyfiles-"), "equitylake.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    sc._equitylake_shipped = True
