"""Spark session defaults and lineage cutting."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC for reproducible dates, AQE for runtime
# re-planning (partition coalescing, broadcast conversion from real sizes,
# skew-join splitting of hot keys), Arrow for the few pandas steps.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def scale_conf(input_bytes: int, partition_bytes: int = 256 << 20) -> dict:
    """Settings sized so shuffle and scan partitions fit executor memory for ``input_bytes`` of input.

    Shuffle partitions start at about input / ``partition_bytes`` (200 at least); AQE then coalesces small ones to the advisory
    size and splits a partition over four times that size when it is skewed.
    """
    parts = max(200, math.ceil(input_bytes / partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes // 2),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes * 2),
    }


def get_spark(master: str | None = None, app: str = "evalspark",
              shuffle_partitions: int | None = None, extra: dict | None = None,
              input_bytes: int | None = None) -> SparkSession:
    """Session with :data:`DEFAULT_CONF`; ``input_bytes`` adds :func:`scale_conf` sizing."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if input_bytes:
        for k, v in scale_conf(input_bytes).items():
            b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # Spark Connect
        pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, setting one only where none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only where it is unset and the master is local (tests) a fresh scratch
    folder is made; on a cluster an unset folder is an error, since executors
    don't share the driver's disk.
    Without a local SparkContext (Spark Connect) the server's setting is used.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the checkpoint folder is the server's setting
        return spark.conf.get("spark.checkpoint.dir", "") or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="evalspark-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint directory.

    Used where later steps must see one fixed version of a result (dense id
    assignment) and so that a lost executor does not replay a long lineage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_rest(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Cuts lineage like :func:`cut_lineage`; later steps read only the columns
    (and nested fields) that they use, and Catalyst knows the table's real size.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
