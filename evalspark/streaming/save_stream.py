"""The save log as Structured Streaming jobs with keyed state.

Requests arrive as files.  Two streams take them on, each with its own checkpoint:

1. :func:`check_arrivals`, stateless: a micro-batch binds and checks its own saves
   and writes them as one folder of checked saves.
2. :func:`keep_state`, stateful: per pair (form, user) Spark's state store holds what
   the pair's saves come to so far - the request that makes its assignment, the last due date, the first
   valid submit (the lock) and the last valid save, with their documents.  A micro-batch touches the state of its own pairs
   and writes those out.

What the state holds are aggregates that do not depend on the order of
arrival or on repeats (earliest, latest, a set), so a batch that is repeated
after a failure, and saves that arrive late, change nothing else.  A save whose due date does not parse can't make an assignment; where
there is none yet it is kept aside in the pair's state until the assignment's request is known.

:func:`state_after` applies the pairs' state to the tables with the batch W6's own functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_blank, normalize_status, try_date
from ..operators import changes, workflow
from ..operators.common import merged
from ..sources.documents import SAVE_DOC

STATE_TABLES = ("eval_assignment", "eval_kpi_user", "eval_competency_score", "eval_ta_score", "eval_dev_plan",
                "eval_additional", "eval_step")

SAVE_LOG_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("form_id", T.LongType()),
    T.StructField("status", T.IntegerType()), T.StructField("due_date", T.StringType()),
    T.StructField("doc", T.StringType())])

CHECKED_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("form_id", T.LongType()),
    T.StructField("user_id", T.LongType()), T.StructField("due", T.DateType()), T.StructField("creates", T.BooleanType()),
    T.StructField("sure", T.BooleanType()), T.StructField("good", T.BooleanType()), T.StructField("status", T.IntegerType()),
    T.StructField("d", SAVE_DOC)])

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def receive_save_log(spark: SparkSession, log_dir: str, received_dir: str, checkpoint: str,
                     max_files_per_trigger: int = 1, schema: T.StructType = SAVE_LOG_SCHEMA) -> DataFrame:
    """Stream all files of ``log_dir`` into ``received_dir``; a later call resumes where this one stopped."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(log_dir)
    query = (stream.writeStream.format("parquet").option("path", received_dir)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(schema).parquet(received_dir)


def checked(batch: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One batch of requests as checked saves: refused bodies are gone, the rest say what they may do.

    ``creates``: the request could make its pair's assignment; ``sure``: it has one, stored or made by itself at
    the latest; ``good``: the tables take the whole document.
    """
    bound = workflow.bind_saves(batch)
    flags = workflow.flagged_saves(bound, tables["eval_competency"]).where("reject IS NULL")
    stored = tables["eval_assignment"].select("form_id", "user_id", F.lit(True).alias("stored"))
    pairs = flags.select("form_id", "user_id").distinct()
    made = changes.with_parents(pairs, tables.get("eval_form"), tables.get("users")).withColumn("parents", F.lit(True))
    rows = flags.join(merged(stored), ["form_id", "user_id"], "left").join(merged(made), ["form_id", "user_id"], "left").where("stored OR parents")
    due = try_date("due_date")
    creates = is_blank("due_date") | due.isNotNull()
    return rows.join(merged(bound.select("seq", "d")), "seq").select(
        "seq", "ts", "form_id", "user_id", due.alias("due"), creates.alias("creates"), (F.coalesce("stored", F.lit(False)) | creates).alias("sure"),
        F.col("sound").alias("good"), normalize_status("req_status").cast("int").alias("status"), "d")


def check_arrivals(spark: SparkSession, log_dir: str, base: str, tables: dict[str, DataFrame], max_files_per_trigger: int = 1):
    """Take on all new files of ``log_dir``; returns the finished query.  A repeated batch writes its folder anew."""
    stream = spark.readStream.schema(SAVE_LOG_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(log_dir)

    def arrive(batch: DataFrame, batch_id: int) -> None:
        checked(batch, tables).write.mode("overwrite").parquet(f"{base}/checked/{batch_id}")

    query = stream.writeStream.foreachBatch(arrive).option("checkpointLocation", f"{base}/arrivals").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def keep_state(spark: SparkSession, base: str, max_files_per_trigger: int = 100):
    """Fold all new checked saves into the pairs' state; returns the finished query."""
    stream = spark.readStream.schema(CHECKED_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(f"{base}/checked/*")
    save = F.struct("seq", "status", "d")
    valid = F.col("good") & F.col("sure")
    state = stream.groupBy("form_id", "user_id").agg(
        F.max_by("due", F.when(F.col("due").isNotNull(), F.col("seq"))).alias("last_due"),
        F.min_by(F.struct("seq", "ts", "due"), F.when(F.col("creates"), F.col("seq"))).alias("creator"),
        F.min_by(save, F.when(valid & (F.col("status") == workflow.LOCKED), F.col("seq"))).alias("lock"),
        F.max_by(save, F.when(valid, F.col("seq"))).alias("last"),
        F.collect_set(F.when(F.col("good") & ~F.col("sure"), save)).alias("aside"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{base}/pairs/{batch_id}")

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        query = (state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
    return query


def state_after(spark: SparkSession, base: str, tables: dict[str, DataFrame], as_of_ts: str) -> dict[str, DataFrame]:
    """``tables`` after all saves that the pairs' state holds."""
    pairs = spark.read.parquet(f"{base}/pairs/*")
    newest = pairs.groupBy("form_id", "user_id").agg(F.max("batch").alias("batch"))
    pairs = pairs.join(merged(newest), ["form_id", "user_id", "batch"])
    stored = tables["eval_assignment"].select("form_id", "user_id", F.col("status").alias("stored_status"))
    pairs = pairs.join(merged(stored), ["form_id", "user_id"], "left")
    # saves kept aside count from the request on that made the assignment
    late = F.filter("aside", lambda s: s["seq"] > F.col("creator.seq"))
    earliest = F.array_min(F.transform(F.filter(late, lambda s: s["status"] == workflow.LOCKED), lambda s: s["seq"]))
    lock_seq = F.least(F.col("lock.seq"), earliest)
    saves = F.filter(F.concat(F.array("lock", "last"), F.coalesce(late, F.array())), lambda s: s.isNotNull())
    last_seq = F.coalesce(lock_seq, F.array_max(F.transform(saves, lambda s: s["seq"])))
    per_key = pairs.select("form_id", "user_id", "last_due", "creator")
    open_ = pairs.where(~F.coalesce(F.col("stored_status") == workflow.LOCKED, F.lit(False)))
    last = open_.select("form_id", "user_id", F.get(F.filter(saves, lambda s: s["seq"] == last_seq), 0).alias("s")).where("s IS NOT NULL")
    last = workflow.at_rest(last.select("form_id", "user_id", "s.*"), "last-saves")
    a1 = changes.ensured(tables["eval_assignment"], per_key, tables.get("eval_form"), tables.get("users"))
    return workflow.apply_last_saves(tables, a1, last.select("user_id", "form_id", "seq", "status"), last.select("seq", "d"), as_of_ts)


def stream_save_log(spark: SparkSession, log_dir: str, base: str, as_of_ts: str,
                    tables: dict[str, DataFrame], max_files_per_trigger: int = 1) -> dict[str, DataFrame]:
    """Take on what is new in ``log_dir`` (state and checkpoints lie below ``base``) and return ``tables`` after all saves so far."""
    check_arrivals(spark, log_dir, base, tables, max_files_per_trigger)
    keep_state(spark, base)
    return state_after(spark, base, tables, as_of_ts)
