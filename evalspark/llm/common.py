"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import sys
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from evalspark.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(key, make):
    """``make()`` once per Python worker process; kept between the tasks that a reused worker runs.

    A worker holds one value at a time: another key drops it, so that the jobs
    of a pipeline don't add up in its memory.
    """
    held = sys.modules.setdefault("_llm_worker_cache", type(sys)("_llm_worker_cache")).__dict__.setdefault("held", {})
    if key not in held:
        if held:
            held.clear()
            let_go()
        held[key] = make()
    return held[key]


def let_go() -> None:
    """Give back what a worker no longer needs: Python's, Arrow's and the C library's free memory."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def file_uri(uri: str) -> str:
    """``file:/a`` and ``/a`` as ``file:///a``; other schemes as they are."""
    if uri.startswith("/"):
        return "file://" + uri
    return re.sub(r"^file:/(?!/)", "file:///", uri)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads each uint64 over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
