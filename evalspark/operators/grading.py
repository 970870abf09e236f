"""Grade-band lookup and first active step.

G1 is a range join (``total BETWEEN min_pct AND max_pct``).  Instead of a
nested-loop join, each band is listed under every whole-number bucket
``floor(min_pct) .. floor(max_pct)`` it covers (at most ~2,000 for a
DECIMAL(5,2) band).  The candidate lists are grouped per (form_id, bucket)
for own-form bands and per bucket for default bands, already ordered best
first, so each scored row does at most one equi-join lookup per set - no
fan-out, no aggregation and no second pass over the scored rows - and takes
the first candidate whose [min, max] holds its total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_broadcast

NO_GRADE = "N/A"  # fixed value: grade when no band matches


def _band_buckets(bands: DataFrame) -> DataFrame:
    b = bands.select(F.col("id").cast("long").alias("band_id"), F.col("form_id").cast("long").alias("b_form"),
                     F.col("grade").alias("b_grade"),
                     F.col("min_pct").cast("double").alias("b_min"),
                     F.col("max_pct").cast("double").alias("b_max"))
    return b.withColumn("bucket", F.explode(F.sequence(F.floor("b_min"), F.floor("b_max"))))


def _candidate_lists(bb: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Bands per key, best first: highest min_pct, then lowest band id."""
    cand = F.struct((-F.col("b_min")).alias("neg_min"), "band_id", "b_min", "b_max", "b_grade")
    return bb.groupBy(*keys).agg(F.sort_array(F.collect_list(cand)).alias(name))


def assign_grade(scored: DataFrame, bands: DataFrame, total_col: str = "total_pct",
                 form_col: str = "form_id", key: str = "assignment_id") -> DataFrame:
    """Add ``grade``, ``grade_min``, ``grade_max`` to ``scored``.

    Candidates are bands of the row's own form or default bands whose
    [min_pct, max_pct] holds the (rounded) total.  Best = own-form first, then
    highest min_pct, then lowest band id (our tie-break).  An own-form band set
    with no hit falls back to the default set; no candidate -> 'N/A', 0, 0.
    Both candidate tables are broadcast after a size check; otherwise they
    are shuffle-joined (unique keys, so still one row per scored row).
    """
    bb = _band_buckets(bands)
    own = _candidate_lists(bb.where(F.col("b_form").isNotNull()), ["b_form", "bucket"], "__own")
    dflt = _candidate_lists(bb.where(F.col("b_form").isNull()), ["bucket"], "__def") \
        .withColumnRenamed("bucket", "__dbucket")
    own = sized_broadcast(own.withColumnRenamed("bucket", "__obucket"))
    dflt = sized_broadcast(dflt)
    total = F.col(total_col)
    bucket = F.floor(total)
    j = (scored.join(own, (F.col(form_col).cast("long") == F.col("b_form")) & (bucket == F.col("__obucket")), "left")
         .join(dflt, bucket == F.col("__dbucket"), "left"))
    hit = lambda arr: F.get(F.filter(arr, lambda b: total.between(b["b_min"], b["b_max"])), 0)
    best = F.coalesce(hit(F.col("__own")), hit(F.col("__def")))
    return j.select(
        *[F.col(c) for c in scored.columns],
        F.coalesce(best["b_grade"], F.lit(NO_GRADE)).alias("grade"),
        F.coalesce(best["b_min"], F.lit(0.0)).alias("grade_min"),
        F.coalesce(best["b_max"], F.lit(0.0)).alias("grade_max"),
    )


def first_active_step(steps: DataFrame) -> DataFrame:
    """Per assignment, the active (status 1) step with the lowest idx (then id).

    ``min(struct(idx, id))`` aggregate: partial aggregation, no per-key sort.
    """
    first = (steps.where(F.col("status") == 1)
             .groupBy("assignment_id")
             .agg(F.min(F.struct("idx", "id")).alias("m")))
    return first.select("assignment_id", F.col("m.id").alias("step_id"), F.col("m.idx").alias("idx"))
