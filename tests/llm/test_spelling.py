import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.llm import queries, spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying all places."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, count=5):
    """The contract, each word against each other (only lengths that can be near)."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= count}
    gone = {}  # words by what is left when one place is taken out: near words share one
    for w in n:
        for i in range(len(w)):
            gone.setdefault(w[:i] + w[i + 1:], set()).add(w)
    close = {w: {x for i in range(len(w)) for x in gone[w[:i] + w[i + 1:]] | gone.get(w, set())} | ({w[:i] + w[i + 1:] for i in range(len(w))} & set(n)) for w in n}
    close = {w: {x for x in v if x != w and near(w, x)} for w, v in close.items()}
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in close.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, n[w], len(close[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def made(seed=0):
    rng = np.random.default_rng(seed)
    letters = list("etaoinéß")
    words = ["".join(rng.choice(letters, rng.integers(5, 9))) for _ in range(60)]
    for w in list(words):
        i = int(rng.integers(0, len(w)))
        words += [w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + "É" + w[i + 1:]]
    p = rng.zipf(1.3, len(words)).clip(1, 400).astype(float)
    texts = [" ".join(rng.choice(words, 60, p=p / p.sum())) for _ in range(400)]
    return list(enumerate(texts))


def test_equal_to_brute_force(spark):
    rows = made() + [(7, None), (8, ""), (None, "letters " * 300), (9, "123 !!"), (9, "Straße-straße; STRASSE " * 9)]
    rows += [(i, "settle settles settled Settle nettle kettle " * (1 + 30 * (i % 5 == 0))) for i in range(1000, 1040)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for c in ("word", "n", "form", "root", "sig", "other"):
        df = df.selectExpr("*", f"1 AS {c}")
    want = brute(rows)
    assert any(r[3] for r in want) and any(r[5] not in (r[0], r[3]) for r in want)
    assert found(spelling.variants(df)) == want


def test_empty_tables_and_long_texts(spark, monkeypatch):
    assert found(spelling.variants(spark.createDataFrame([], "doc_id long, text string"))) == []
    text = "letters, " * 150_000 + "a" * 300_000 + " " + "Lettres " * 150_000  # a slice ends inside a run and inside the long one
    assert found(spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string"))) == brute([(1, text)])


def test_no_join_is_broadcast(spark, monkeypatch):
    """Catalyst takes these tables for far smaller than they are in memory; the driver would hold them whole."""
    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df
    staged = spelling.staged
    monkeypatch.setattr(spelling, "staged", lambda df, name: staged(planned(df), name))
    planned(spelling.variants(spark.createDataFrame(made(), "doc_id long, text string")))
    assert sum(p.count("SortMergeJoin") for p in plans) >= 5 and not any("Broadcast" in p for p in plans)


def test_slices_end_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 7)
    text = "ab cdefghijklmnop qr, stuvw xyz éàü 12 É"
    assert spelling.runs(text) == Counter(re.findall("[a-zÀ-ÿ]+", text))


@settings(max_examples=300, deadline=None)
@given(st.text("abcdeé", min_size=5, max_size=9), st.integers(0, 8), st.sampled_from("abzéÿ"), st.integers(0, 2))
def test_near_words_share_a_signature(word, at, letter, kind):
    at = at % len(word)
    other = [word[:at] + letter + word[at + 1:], word[:at] + letter + word[at:], word[:at] + word[at + 1:]][kind]
    if other == word:
        return
    sections = np.arange(256 * (spelling.DEEP + 1)) % spelling.SECTIONS
    sigs = [[set(k[i].tolist()) for k in spelling.signatures([word, other], sections)] for i in range(2)]
    (two_a, short_a, long_a), (two_b, short_b, long_b) = sigs
    assert two_a & two_b if len(word) == len(other) else (short_a & long_b if len(word) < len(other) else long_a & short_b)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.QUERIES["op13_spelling"](spark, sf_dir)) == brute(rows)
