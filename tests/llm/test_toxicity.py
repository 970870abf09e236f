import random
import zlib

import numpy as np
from odd_texts import ODD_TEXTS

from evalspark.llm import toxicity
from evalspark.llm.queries import op1_toxicity


def corpus(n=1200, seed=0):
    """(doc_id, text, toxic): random words, in a quarter of the texts with words of their own."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    bad = ["vilest", "wretch", "scumbag", "dreck"]
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(bad)
        out.append((i, " ".join(text), int(toxic)))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    got = {r["doc_id"]: r["s"] for r in toxicity.score(docs, toxicity.fit(docs, labels), "s").collect()}
    held = [(got[d] >= toxicity.CUT, y) for d, _, y in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(p == bool(y) for p, y in held) >= 0.97 * len(held) and len(held) > 200
    assert all(0 <= s <= 1 for s in got.values())


def test_held_out_rows_are_not_learned_from(spark):
    rows = corpus(400)
    docs, labels = frames(spark, rows)
    model = toxicity.fit(docs, labels)
    flipped = [(d, t, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y) for d, t, y in rows]
    other = toxicity.fit(docs, frames(spark, flipped)[1])
    assert model.toxic == other.toxic and np.array_equal(model.weights, other.weights)
    shuffled = toxicity.fit(docs.orderBy("text").repartition(7), labels.repartition(5))
    assert model.toxic == shuffled.toxic and np.allclose(model.weights, shuffled.weights)


def test_dictionaries_shorten_their_own_words():
    rows = corpus()
    toxic, ordinary = toxicity.learn_dictionaries([t for _, t, y in rows if y], [t for _, t, y in rows if not y])
    assert len(toxic) == len(ordinary)
    d = toxicity.Distance(toxic, ordinary, remembered=100)
    assert all(d.memory.get(w) > 3 for w in (b"vilest", b"wretch", b"scumbag", b"dreck"))
    common = sorted({w for _, t, y in rows if not y for w in toxicity.windows(t)})[:300]
    assert np.mean([abs(d.memory.get(w)) <= 3 for w in common]) > 0.95


def test_windows_cover_whole_texts():
    for t in ODD_TEXTS:
        t = t or ""
        assert b"".join(toxicity.windows(t)) == b"".join(t.lower().encode().split())
        assert all(0 < len(w) <= toxicity.WINDOW for w in toxicity.windows(t))


def test_edges(spark, odd_docs, no_docs):
    docs, labels = frames(spark, corpus(400))
    model = toxicity.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (6, 7), (8, 1)], labels.schema)))
    clash = odd_docs.withColumnRenamed("lang", "toxicity").withColumnRenamed("source", "window")
    got = toxicity.score(clash, model, "s")
    assert got.columns == [*clash.columns, "s"] and got.count() == odd_docs.count()
    assert len({r["s"] for r in got.collect() if not (r["text"] or "").strip()}) == 1
    assert toxicity.score(no_docs, model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["toxicity"] for r in toxicity.score(docs, none).collect()} == {0.0}
    only = toxicity.fit(docs, labels.where("toxic = 1"))
    assert {r["toxicity"] for r in toxicity.score(docs, only).collect()} == {1.0}


def test_query(spark, sf_dir):
    rows = op1_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
