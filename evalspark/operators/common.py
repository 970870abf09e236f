"""Join helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import at_rest

# A side is broadcast only within ``evalspark.broadcast.maxRows`` rows (default
# 1,000,000) and an estimated ``evalspark.broadcast.maxBytes`` (default 64 MB).
# Otherwise the join is left to AQE, which converts it from real sizes and
# splits skewed keys.
DEFAULT_BROADCAST_MAX_ROWS = 1_000_000
DEFAULT_BROADCAST_MAX_BYTES = 64 << 20


def _conf_int(df: DataFrame, key: str, default: int) -> int:
    v = df.sparkSession.conf.get(key, None)
    return int(v) if v else default


def broadcast_limit(df: DataFrame) -> int:
    return _conf_int(df, "evalspark.broadcast.maxRows", DEFAULT_BROADCAST_MAX_ROWS)


def row_width(dt: T.DataType) -> int:
    """Rough bytes per value, for the broadcast size check (arrays counted as 8 elements)."""
    if isinstance(dt, T.StructType):
        return sum(row_width(f.dataType) for f in dt.fields) + 8
    if isinstance(dt, T.ArrayType):
        return 8 * row_width(dt.elementType) + 16
    if isinstance(dt, T.MapType):
        return 8 * (row_width(dt.keyType) + row_width(dt.valueType)) + 16
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return 32
    if isinstance(dt, T.DecimalType):
        return 16
    return 8


def _estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df`` (no job), or None where unavailable."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # e.g. Spark Connect
        return None


#: Up to this size a log is dealt over all tasks before its bodies are parsed; parsing costs far more than moving it.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all shuffle partitions if Catalyst's estimate says that it is small (few files, so few tasks); else as it is."""
    est = _estimated_bytes(df)
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if est is not None and est <= SPREAD_BYTES else df


def sized_broadcast(df: DataFrame) -> DataFrame:
    """``broadcast(df)`` if Catalyst's estimate is within the byte bound, else ``df`` unchanged; runs no job.

    A scan's estimate is its files' size; in memory compressed columns are
    several times that, which the bound leaves room for.  Filters and projections
    only shrink it.  An explode is not in the estimate, so a plan with one is left to AQE.
    """
    est = _estimated_bytes(df)
    if est is None or est > _conf_int(df, "evalspark.broadcast.maxBytes", DEFAULT_BROADCAST_MAX_BYTES):
        return df
    return df if "Generate" in str(df._jdf.queryExecution().optimizedPlan()) else F.broadcast(df)


def counted_broadcast(df: DataFrame) -> DataFrame:
    """``broadcast(df)`` if its counted rows are within the bounds; for checkpointed sets.

    After a checkpoint Catalyst keeps the estimate of the plan before it, which multiplies through joins; counting the rows at rest costs one small job.
    """
    width = max(row_width(df.schema), 1)
    limit = min(broadcast_limit(df), _conf_int(df, "evalspark.broadcast.maxBytes", DEFAULT_BROADCAST_MAX_BYTES) // width)
    return F.broadcast(df) if df.count() <= limit else df


#: Bytes that a row of a broadcast table takes in the driver's memory besides its values.
ROW_OVERHEAD = 128


def broadcast_or_merge(df: DataFrame) -> DataFrame:
    """``broadcast(df)`` if its counted rows are within the bounds, a side to merge with (:func:`merged`) if they are not.

    For sides that are cheap to count (a scan, or little more than one).  Nothing is counted where Catalyst's estimate is beyond the byte bound
    already: the join is then left to AQE.
    """
    most = _conf_int(df, "evalspark.broadcast.maxBytes", DEFAULT_BROADCAST_MAX_BYTES)
    est = _estimated_bytes(df)
    if est is None or est > most:
        return df
    limit = min(broadcast_limit(df), most // (row_width(df.schema) + ROW_OVERHEAD))
    return F.broadcast(df) if df.count() <= limit else merged(df)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is not to be broadcast.

    For sides with a row per pair, assignment or request.  Catalyst sizes a scan by its compressed files and deals the size out by the declared
    types, so keys beside wide documents, or repeated values, seem a hundredth of what they are in memory; a few such sides fill the driver.
    """
    return df.hint("merge")


def latest_per_key(df: DataFrame, keys: list[str], order_col: str = "seq") -> DataFrame:
    """Keep the row with the largest ``order_col`` per key (last change wins).

    A ``max(struct(order, row))`` aggregate: partial aggregation on the map
    side, so a hot key never gathers its rows in one task.
    """
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(F.col(order_col).alias("__o"), *[F.col(c) for c in others if c != order_col])
    agg = df.groupBy(*keys).agg(F.max(packed).alias("__last"))
    return agg.select(*keys, F.col("__last.__o").alias(order_col),
                      *[F.col(f"__last.{c}").alias(c) for c in others if c != order_col]).select(df.columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); the component is its least node.

    Each round every node follows the least of its neighbours, by doubling to the
    end of that chain, and the chains' ends are the nodes of the next round, with
    the edges between them.  A node with a neighbour is at most half as many
    next time, so rounds and their steps grow with the logarithm of the nodes.
    """
    left = at_rest(edges.select("a", "b").where("a <> b").distinct(), "edges")
    known = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = at_rest(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "step")
        while True:
            ahead = step.select(F.col("a").alias("to"), F.col("to").alias("next"))
            further = at_rest(step.join(ahead, "to").select("a", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("went")), "step")
            step = further.drop("went")
            if further.where("went").isEmpty():
                break
        ends = step.select(F.col("a").alias("node"), F.col("to").alias("component"))
        if known is not None:
            met = known.select("node", F.col("component").alias("a")).join(step, "a", "left").select(
                "node", F.coalesce("to", "a").alias("component"))
            ends = met.unionByName(ends.join(known.select("node"), "node", "left_anti"))
        known = at_rest(ends, "components")
        left = at_rest(left.join(step, "a").select(F.col("to").alias("a"), "b").join(
            step.select(F.col("a").alias("b"), F.col("to").alias("to_b")), "b").select("a", F.col("to_b").alias("b"))
            .where("a <> b").distinct(), "edges")
    if known is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return known
