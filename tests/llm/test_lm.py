import math
import mmap
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.llm import elias_fano, lm, queries


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def brute(rows, growth):
    """The model in plain floats: {row: (held_out, n_tokens, n_known, N, base, score)}."""
    out, train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows], []
    c, pairs = Counter(), Counter()
    for (_, text), held in zip(rows, out):
        if not held:
            t = tokens_of(text)
            train.append(t)
            c.update(t)
            pairs.update(zip(["<", *t], t))
    n, v = sum(c.values()), len(c)
    starts = {**c, "<": c[None]}
    unigram = lambda w: (c[w] + 1) / (n + v + 1)

    def bigram(a, w):
        k = starts.get(a, 0)
        m = max(k, 1) ** growth
        return (pairs[a, w] + m * unigram(w)) / (k + m) if k else unigram(w)

    rest = []
    for (i, text), held in zip(rows, out):
        t = tokens_of(text)
        rest.append((i, held, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(unigram(w)) for w in t),
                     sum(math.log10(bigram(a, w)) for a, w in zip(["<", *t], t))))
    return rest


def same(got, want):
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=repr)
    want = sorted(want, key=repr)
    key = lambda r: repr(r[:4]) + f"{r[5]:.6f}"
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert abs(a[6] - b[6]) <= a[2] * 1.6 / lm.UNIT  # codes are rounded once or twice a token


def made(n=300, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(150)] + ["The", "the", "É", "x" * 90]
    p = 1 / np.arange(1, len(words) + 1)
    return [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=p / p.sum()))) for i in range(n)]


def test_equal_to_plain_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 700)
    monkeypatch.setattr(lm, "SHARD", 150)
    rows = made() + [(1000, None), (1001, ""), (1002, "\t the\nthe  "), (None, "the null id"), (5, "again w1"), (5, "again w1"), (1003, "hot pair " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for c in ("block", "shard", "data", "train", "score"):
        df = df.selectExpr("*", f"1 AS {c}")
    same(lm.score_documents(df, growth=0.8).collect(), brute(rows, 0.8))


def test_empty_and_no_training_documents(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows = [(i, "a b c") for i in held]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["held_out"] and r["train_tokens"] == r["n_known"] == 0 and r["score"] == 0 for r in got) and len(got) == 4


def test_hot_contexts_are_dealt_over_shards():
    model = lm.Model(1000, 10, 0.8, 50)
    words = np.arange(1, 400, dtype=np.uint64)
    hot = model.shard(np.full(399, 7, np.uint64), np.full(399, 500), words)
    cold = model.shard(np.full(399, 9, np.uint64), np.full(399, 10), words)
    assert len(set(hot)) > 15 and len(set(cold)) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1), min_size=0, max_size=300), st.lists(st.integers(0, 2 ** 64 - 1), max_size=40), st.integers(0, 60))
def test_elias_fano(values, asked, shift):
    values = sorted(v >> shift for v in values)
    ef = elias_fano.EliasFano.of_arrays(*elias_fano.EliasFano.arrays(np.array(values, np.uint64)))
    if values:
        assert ef.get(np.arange(len(values))).tolist() == values
    asked = [v >> shift for v in asked] + values
    want = [next((i for i, v in enumerate(values) if v >= x), len(values)) for x in asked]
    assert ef.successor(np.array(asked, np.uint64)).tolist() == want
    assert [values[i] if i >= 0 else None for i in ef.find(np.array(asked, np.uint64))] == [x if x in set(values) else None for x in asked]


def test_trie_is_queried_from_a_mapped_file(tmp_path):
    rng = np.random.default_rng(4)
    contexts, words = np.unique(rng.integers(0, 2 ** 63, 200)).astype(np.uint64), np.unique(rng.integers(0, 2 ** 63, 500)).astype(np.uint64)
    pairs = np.unique(rng.integers(0, len(contexts) * len(words), 3000))
    pairs = np.stack([pairs // len(words), pairs % len(words)], 1)
    pairs = pairs[pairs[:, 0] % 5 != 0]  # contexts without successors
    p, backoff = rng.integers(0, 60000, len(pairs)), rng.integers(0, 3000, len(contexts))
    path = tmp_path / "trie"
    path.write_bytes(elias_fano.Trie.build(contexts, backoff, words, pairs, p))
    with path.open("rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        trie = elias_fano.Trie.from_buffer(data)
        held = {(c, w): x for (c, w), x in zip(pairs.tolist(), p.tolist())}
        c, w = np.divmod(np.arange(len(contexts) * len(words)), len(words))
        assert (trie.contexts.find(contexts) == np.arange(len(contexts))).all() and (trie.words.find(words) == np.arange(len(words))).all()
        got = trie.codes(c, w, np.full(len(c), 7))
        assert got.tolist() == [held.get((a, b), int(backoff[a]) + 7) for a, b in zip(c.tolist(), w.tolist())]
        assert trie.codes(np.array([-1, 3]), np.array([2, -1]), np.array([9, 9])).tolist() == [9, int(backoff[3]) + 9]
        assert (path.stat().st_size - trie.probabilities.nbytes - trie.backoffs.nbytes) / len(pairs) < 16
        del trie


def test_query(spark, sf_dir, monkeypatch):
    found = []
    model = lm.Model
    monkeypatch.setattr(lm, "Model", lambda *a: found.append(model(*a)) or found[-1])
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_lm"](spark, sf_dir).collect()
    same(got, brute(rows, found[0].growth))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
