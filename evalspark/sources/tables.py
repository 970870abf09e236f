"""Table scans, key lookups and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES
from ..session import at_rest


def conform(df: DataFrame, table: str, keep_extra: bool = False) -> DataFrame:
    """Give ``df`` the declared schema of ``table``.

    Declared columns are cast to their type; declared columns absent from
    ``df`` are added as typed NULLs (absent = not supplied).  Other columns
    are dropped unless ``keep_extra``.  A pure projection: Catalyst prunes
    whatever a later step does not use.
    """
    t = TABLES[table]
    have = set(df.columns)
    cols: list[Column] = []
    for c in t.cols:
        src = F.col(c.name) if c.name in have else F.lit(None)
        cols.append(src.cast(c.dtype).alias(c.name))
    if keep_extra:
        declared = {c.name for c in t.cols}
        cols += [F.col(c) for c in df.columns if c not in declared]
    return df.select(*cols)


def load_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Read one table from Parquet with its declared schema (never inferred)."""
    return spark.read.schema(TABLES[name].struct).parquet(path)


def by_keys(df: DataFrame, keys: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows of ``df`` whose key appears in ``keys`` (left semi join).

    Duplicate keys do not duplicate rows; a filter on the key columns of a
    Parquet scan is pushed down by Catalyst when ``keys`` is broadcast.
    """
    on = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*on), on, "left_semi")


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a new table version.  Never write over the path being read."""
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


#: Partition column of :func:`save_by_key`: a hash of the key, so that keys of any type and skew make even partitions.
KEY_PART = "key_part"


def key_part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")


def save_by_key(df: DataFrame, path: str, key: str, parts: int) -> None:
    """Write a table in ``parts`` partitions by a hash of ``key``, for :func:`save_touched`."""
    placed = df.withColumn(KEY_PART, key_part(key, parts))
    placed.repartition(KEY_PART).write.mode("errorifexists").partitionBy(KEY_PART).parquet(path)


def load_by_key(spark: SparkSession, path: str) -> DataFrame:
    """A table of :func:`save_by_key`, without its partition column."""
    return spark.read.parquet(path).drop(KEY_PART)


def save_touched(df: DataFrame, touched: DataFrame, path: str, key: str, parts: int) -> int:
    """Bring the table at ``path`` to the new version ``df``, writing only the partitions of the ``touched`` keys.

    Rows of other keys are taken to be as they were, so files of other partitions
    stay.  The new rows are put at rest before anything is overwritten, so ``df`` may be computed
    from the table itself.  Returns the number of partitions written or emptied; their
    numbers (at most ``parts``) go through the driver.
    """
    spark = df.sparkSession
    at = touched.select(key_part(key, parts).alias(KEY_PART)).distinct()
    named = sorted(r[0] for r in at.collect() if r[0] is not None)
    rows = at_rest(df.withColumn(KEY_PART, key_part(key, parts)).where(F.col(KEY_PART).isin(named)), "touched")
    (rows.repartition(KEY_PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(KEY_PART).parquet(path))
    # a partition without rows is not in the write: what it held goes
    left = {r[0] for r in rows.select(KEY_PART).distinct().collect()}
    for part in set(named) - left:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{KEY_PART}={part}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(named)
