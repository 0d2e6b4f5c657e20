"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

UTC = "UTC"


def build_session(app: str = "tapeloom", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, Arrow)."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", UTC)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """UTC timestamps (New York time is derived where a rule needs it), and small
    shuffle partitions kept apart: per-session scans are bound by CPU, not bytes,
    so AQE must not merge them into one task because they are small on disk.
    """
    spark.conf.set("spark.sql.session.timeZone", UTC)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
    return spark


@contextmanager
def without_huge_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside it generate no method of over 8,000 bytes (wide windows do): the JVM would not compile it."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own: on a
    cluster a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is not None:
        return
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives executor loss and is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
