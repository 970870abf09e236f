"""Registered query: the save log through Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import AS_OF_TS, fixture_tables
from ..operators.workflow import state_by_key
from ..session import ensure_checkpoint_dir
from ..streaming.save_stream import SAVE_LOG_SCHEMA, STATE_TABLES, stream_save_log
from .q_workflow import STATE_ORACLE
from .registry import query

STREAM_FILES = 3


def stage_log_files(log, log_dir: str, files: int = STREAM_FILES) -> None:
    """Write the log as about ``files`` files by ranges of ``seq``: one job, whatever gaps ``seq`` has."""
    (log.select(*[F.col(f.name).cast(f.dataType) for f in SAVE_LOG_SCHEMA])
     .repartitionByRange(files, "seq").write.mode("append").parquet(log_dir))


# the stream must end in exactly the state W6 computes over the whole log
@query("stream_save_state", STATE_ORACLE)
def q_stream_save_state(spark, sf_dir):
    """State after the save log received in micro-batches (must equal save_log_state)."""
    t = fixture_tables(spark, sf_dir, ["save_log", "eval_form", "users", "eval_competency"] + list(STATE_TABLES))
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stage_log_files(t["save_log"], f"{base}/log")
    tables = {n: t[n] for n in (*STATE_TABLES, "eval_competency", "eval_form", "users")}
    final = stream_save_log(spark, f"{base}/log", base, AS_OF_TS, tables)
    return state_by_key(final, t["save_log"])
