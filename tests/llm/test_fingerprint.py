import hashlib
from collections import Counter

import numpy as np
from odd_texts import ODD_TEXTS

from evalspark.llm import fingerprint as fp
from evalspark.llm.queries import op7_fingerprint


def some(n, seed=0, size=3000):
    rng = np.random.default_rng(seed)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(400)]
    return [" ".join(rng.choice(words, size // 6)).encode() for _ in range(n)]


def test_classes_equal_counting_each_window():
    data = np.random.default_rng(1).integers(97, 110, 500).astype(np.uint8)
    got = fp.windows_class(data)
    for i in range(len(got)):
        total = sum(int(fp.CLOG[c]) for c in Counter(data[i:i + 64].tolist()).values())
        assert got[i] == total * (fp.CLASSES - 1) // int(fp.CLOG[64])


def test_features_equal_a_plain_search():
    """Selected places by definition: votes of all runs of 64 neighbouring windows, runs at the ends included."""
    t = some(1, 3, 1500)[0]
    rank = fp.rarity(fp.class_counts(some(5)))
    cls = fp.windows_class(np.frombuffer(t, np.uint8))
    r = rank[cls].tolist()
    votes = Counter()
    for lo in range(-63, len(r)):
        run = range(max(lo, 0), min(lo + 64, len(r)))
        votes[min(run, key=lambda i: (r[i], i))] += 1
    assert sum(v >= fp.VOTES for v in votes.values()) == fp.digests([t], rank)[0][1]


def test_texts_do_not_influence_each_other(monkeypatch):
    texts = [(t or "").encode() for t in ODD_TEXTS] + some(30)
    rank = fp.rarity(fp.class_counts(texts))
    alone = [fp.encoded(fp.digests([t], rank)[0]) for t in texts]
    assert alone == [fp.encoded(d) for d in fp.digests(texts, rank)]
    monkeypatch.setattr(fp, "BATCH_BYTES", 100)
    assert alone == [fp.encoded(d) for d in fp.digests(texts, rank)]
    assert (fp.class_counts(texts) == sum(fp.class_counts([t]) for t in texts)).all()
    assert [fp.encoded(fp.decoded(x)) for x in alone] == alone


def test_likeness():
    texts = some(20, 5, 30000)
    rank = fp.rarity(fp.class_counts(texts))
    own = fp.digests(texts, rank)
    changed = fp.digests([t[:20000] + texts[i - 1][:len(t) - 20000] for i, t in enumerate(texts)], rank)
    for i in range(20):
        assert fp.likeness(own[i], own[i]) == 1.0
        assert fp.likeness(own[i], changed[i]) > 0.4 > 0.15 > fp.likeness(own[i], own[i - 1])
        assert fp.likeness(own[i], changed[i]) == fp.likeness(changed[i], own[i]) or len(own[i][0]) == len(changed[i][0])
    empty, short = fp.digests([b"", b"abc"], rank)
    assert fp.likeness(empty, empty) == 1.0 and fp.likeness(empty, short) == 0.0 == fp.likeness(own[0], empty)
    assert fp.likeness(short, fp.digests([b"abc"], rank)[0]) == 1.0


def edited(docs):
    """(doc_id, n_chars, hash of the edited text), rows by descending id, nulls last, ties by text."""
    rows = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 3
        out.append((d, len(t), hashlib.sha256((t[:len(t) - k] + after[:k]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_texts(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for buckets in (1, 2, 5, 40):
        got = fp.edited_pairs(odd_docs, buckets).collect()
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == edited(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows).get(r["doc_id"]), set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fp.edited_pairs(no_docs).count() == 0
    one = spark.createDataFrame([(None, "abc def")], "doc_id long, text string")
    assert fp.edited_pairs(one).first()["near_next"] == 1.0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = op7_fingerprint(spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == edited([tuple(r) for r in docs])
    text = {r["doc_id"]: r["text"] for r in docs}
    seen = {}
    for r in got:
        assert seen.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    near = sorted(r["near_edited"] for r in got)
    other = sorted(r["near_next"] for r in got)
    assert near[len(near) // 20] > other[len(other) * 95 // 100]


def test_likeness_across_the_border_of_short_texts():
    """Texts below and from SHORT bytes on are compared by features of one kind."""
    texts = some(40, 11, 6000)
    rank = fp.rarity(fp.class_counts(texts))
    near = lambda a, b: fp.likeness(*(fp.decoded(fp.encoded(d)) for d in fp.digests([a, b], rank)))
    kept, other = [], []
    for t, u in zip(texts, texts[1:]):
        assert near(t[:250], t[:260]) > 0.9 and near(t[:255], t[:256]) > 0.9 and near(t[10:260], t[:260]) > 0.8
        assert near(t[:384], t[:240]) > 0.9  # cut by the edit's third and more
        assert near(t[:255], t[:1023]) > 0.5
        assert near(t[:250], t[:260]) == near(t[:260], t[:250])
        kept.append(near(t[:300], t[:200] + u[:55]))  # an edit below the border
        other.append(near(t[:250], u[:260]))
    assert min(kept) > 0.5 > 0.3 > max(other)
    # texts without short features: the short one's selected windows are compared
    mean = [np.mean([near(t[:250], x[:n]) for t, x in zip(texts, like)]) for n in (1024, 5000) for like in (texts, texts[1:])]
    assert min(mean[0], mean[2]) > 0.4 > 0.1 > max(mean[1], mean[3])
    assert near(b"", texts[0][:300]) == 0.0 == near(b"", texts[0]) and near(texts[0][:60], texts[0]) == 0.0
