"""Session settings and the shared folder for tables that outlive a stage."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime settings every job relies on; all can be set on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # few but costly rows (daily series) still spread over the cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # newest-N reads (N up to a few thousand) prune per map task before the shuffle
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
}


def get_spark(app: str = "tickloom", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings above."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def with_conf(spark: SparkSession, conf: dict[str, str]):
    """Settings that hold inside a ``with`` block and are then as before."""
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield spark
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_local_fallback: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in ``spark.checkpoint.dir``.

    Only a local master (tests) may fall back to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _local_fallback:
        _local_fallback[sc.applicationId] = tempfile.mkdtemp(prefix="tickloom-")
    return _local_fallback[sc.applicationId]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/tickloom/{name}-{uuid.uuid4().hex[:12]}"


def folder(spark: SparkSession, path: str):
    """Hadoop file system of a path, and the path as one of its own."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a staged folder."""
    files, where = folder(spark, path)
    files.delete(where, True)


def day_folders(spark: SparkSession, path: str, day: str) -> list[str]:
    """Days of a table by its directory names; no file is opened."""
    files, where = folder(spark, path)
    if not files.exists(where):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(where) if entry.isDirectory()]
    return sorted(name.split("=", 1)[1] for name in names if name.startswith(f"{day}="))


def cut_lineage(df):
    """Reliable checkpoint, so a lost executor never replays the whole history of ``df``."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(spark))
    return df.checkpoint()
