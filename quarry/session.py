"""Session construction and the few session-level settings the library relies on."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # iterative operators checkpoint every round: drop files no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster, use the cluster's session and only call
    :func:`ensure_checkpoint_dir` on it."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is read from
    the session and used as is.  Only when it is unset (local tests) a fresh
    scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back: computed
    once for all readers, each of which reads only the columns it needs."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def freed(spark: SparkSession) -> None:
    """Let Spark see which shuffles and checkpoints nobody can read any more: else their files stay until the
    driver's heap is full."""
    gc.collect()
    spark._jvm.System.gc()


def dropped(*frames: DataFrame) -> None:
    """Take the files of tables that :func:`stored` wrote, and that nothing reads any more, off the disk."""
    for df in frames:
        jvm, at = df.sparkSession._jvm, getattr(df, "_stored_at", None)
        if at is not None:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    freed(frames[0].sparkSession)
