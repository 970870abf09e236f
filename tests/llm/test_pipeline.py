"""The corpus pipeline against plain Python over each stage's own input."""

import importlib.util
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    from test_jaccard import brute
    from test_packing import check
    from test_pii import brute as spans

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf_dir).cache())
    raw, clean, single, redacted, packed = kept
    assert all(k.columns == columns for k in kept[:-1])

    assert clean.exceptAll(raw).count() == 0
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").join(raw, "doc_id", "left_semi")
    gone = toxic.join(clean, "doc_id", "left_anti")
    assert gone.where("toxic = 0").count() <= 0.05 * toxic.where("toxic = 0").count()

    rows = clean.select("doc_id", "text").collect()
    want = {c for _, n, c in brute([tuple(r) for r in rows]) if n} | {d for d, n, _ in brute([tuple(r) for r in rows]) if not n}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(want)

    before, after = ({r["doc_id"]: r for r in k.collect()} for k in (single, redacted))
    assert before.keys() == after.keys()
    for d, r in after.items():
        found = spans(before[d]["text"])
        assert not spans(r["text"]) and r["n_chars"] == len(r["text"] or "")
        if not found and "[" not in r["text"]:
            assert r["text"] == before[d]["text"]

    pieces = packed.collect()
    check(pieces, 4096)
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(after.keys())


def test_run_and_registration(spark, sf_dir):
    import __spark_entry__ as entry
    assert "pipeline" in entry.queries() and [n for n in entry.queries() if n.startswith("op")] and len(corpus_pipeline.STAGES) in (4, 5)
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 11))
    assert importlib.util.find_spec("corpus_pipeline") is not None


def test_stages_keep_extra_columns_and_empty_tables(spark, odd_docs, no_docs, sf_dir):
    docs = odd_docs.withColumn("_x", F.lit(1)).withColumn("node", F.lit("n"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, no_docs, sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, sf_dir).count() == 0


def test_labelled_toxic_documents_go(spark, sf_dir):
    """At sf0.01, where there are enough labels to learn from: a stage that rejects nothing fails."""
    larger = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    clean = corpus_pipeline.without_toxic(spark, docs, larger).select("doc_id")
    labelled = spark.read.parquet(f"{larger}/labels.parquet").join(docs, "doc_id", "left_semi")
    gone = {r["toxic"]: r["n"] for r in labelled.join(clean, "doc_id", "left_anti").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    of = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    assert gone.get(1, 0) >= 0.6 * of[1] and gone.get(0, 0) <= 0.02 * of[0]


def test_columns_with_the_stages_own_names_stay(spark, sf_dir):
    import corpus_pipeline
    from evalspark.llm import toxicity
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).selectExpr("*", "doc_id AS _toxicity", "text AS _spans", "1 AS toxicity", "2 AS spans")
    kept = corpus_pipeline.without_toxic(spark, docs, sf_dir)
    assert kept.columns == docs.columns and kept.where("_toxicity <> doc_id").isEmpty() and kept.count() > 20
    clean = corpus_pipeline.without_personal_data(spark, docs, sf_dir)
    assert clean.columns == docs.columns and clean.where("_spans IS NULL AND text IS NOT NULL").isEmpty()
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert dict(toxicity.score(docs, model, "toxicity").dtypes)["toxicity"] == "double"


def test_every_operator_is_registered():
    import re

    import __spark_entry__ as e
    numbers = sorted(int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in e.queries()) if m)
    assert numbers == list(range(1, 14)) and "pipeline" in e.queries()
