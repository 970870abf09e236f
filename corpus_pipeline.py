"""A training corpus from ``documents``: toxic documents out, one of each group of near copies, personal data
out of the texts, and the rest packed into sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all
its predecessor kept.  ``run`` writes each stage's result as Parquet in the
folder that the cluster shares and gives it, read again, to the next stage.

Null and empty texts are kept, with the score of an empty text, as sets of their own, without spans and as a
document of only the end id; repeated rows count as copies; of equal texts the smallest id stays; extra columns
stay, whatever their names; an empty table gives no rows.  No stage reads a part of a text only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import jaccard, packing, pii, toxicity
from evalspark.llm.common import staged, table
from evalspark.llm.queries import tokenizer_path

#: A document goes when its score says toxic rather than not; op1's lower cut would also take clean ones.
REJECT = 0.5

#: Workers still hold memory of the stages before, so packing remembers fewer words than by itself.
REMEMBERED = 75_000


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    return "_".join([name, *docs.columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``REJECT``, learned from ``labels``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "toxicity")
    return toxicity.score(docs, model, score).where(F.col(f"`{score}`") < REJECT).drop(score)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents, the one with the smallest id."""
    return jaccard.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; n_chars is the new text's length."""
    spans = unused(docs, "spans")
    redacted = pii.redact(pii.find_spans(docs, out=spans), spans=spans)
    return redacted.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [("toxicity", without_toxic), ("near_copies", one_of_near_copies), ("personal_data", without_personal_data),
          ("packing", packed)]

#: Learning, components and token ids can't be said in SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
