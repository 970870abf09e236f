import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
from odd_texts import ODD_TEXTS
from pyspark.sql import functions as F

from evalspark.llm import jaccard
from evalspark.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    """doc_id -> (n_shingles, component_id), by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in docs]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def make(rng, n):
    """Texts of all sizes with copies, near copies at every distance, chains of near copies and shared passages."""
    words = ["w%d" % i for i in range(60)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    passage, out = text(60), []
    while len(out) < n:
        base = text(rng.choice([1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 30, 60, 150]))
        if rng.random() < 0.3:
            base = base[:20] + passage
        out.append(base)
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice([base, out[-1]]))
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                i = rng.randrange(len(w) + 1)
                w[i:i + rng.randint(0, 1)] = text(rng.randint(0, 1))
            out.append(w if rng.random() < 0.8 else w[:rng.randint(0, len(w))])
    return [(i, " ".join(x.upper() if rng.random() < 0.1 else x for x in w) + rng.choice(["", " ", "\n"])) for i, w in enumerate(out[:n])]


def result(spark, docs, parts=5):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted(map(tuple, jaccard.similar_components(df).select("doc_id", "n_shingles", "component_id").collect()))


def test_equals_all_pairs(spark):
    for seed in (1,):
        docs = make(random.Random(seed), 400)
        assert result(spark, docs) == brute(docs)


def test_light_boundary_whatever_the_cost(spark, monkeypatch):
    rng = random.Random(7)
    docs = [(i, t) for i, (_, t) in enumerate(make(rng, 900)) if len(t.split()) < 17]
    want = brute(docs)
    for boundary in (6, 12):
        monkeypatch.setattr(jaccard, "choose_boundary", lambda sizes, b=boundary: b)
        assert result(spark, docs) == want, boundary


def test_hot_order_and_small_flushes_change_nothing(spark, monkeypatch):
    docs = make(random.Random(9), 300)
    want = brute(docs)
    monkeypatch.setattr(jaccard, "HOT", 50)
    monkeypatch.setattr(jaccard, "FLUSH", 500)
    monkeypatch.setattr(jaccard, "PER_BUCKET", 100)
    assert result(spark, docs, parts=2) == want


def test_shingle_hashes_follow_the_words():
    texts = [t or "" for t in ODD_TEXTS] + [t for _, t in make(random.Random(3), 200)]
    sets = jaccard.shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    alone = [jaccard.shingle_sets([t.encode()])[0] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(sets, alone))
    by_set = defaultdict(set)
    for t, s in zip(texts, sets):
        by_set[shingles(t)].add(jaccard.node_of(s))
    assert all(len(v) == 1 for v in by_set.values()) and len({x for v in by_set.values() for x in v}) == len(by_set)


def test_least_overlap_and_prefix_are_exact():
    for a in range(1, 60):
        for b in range(a, 80):
            need = jaccard.enough(a, b)
            for o in range(0, a + 1):
                assert (100 * o >= 75 * (a + b - o)) == (o >= need)
            if need <= a:  # sets that can be similar share a listed shingle
                assert jaccard.listed(a) + jaccard.listed(b) > 0 and a - jaccard.listed(a) < need and b - jaccard.listed(b) < need


def test_edges(spark, odd_docs, no_docs):
    rows = jaccard.similar_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sorted((r["doc_id"], r["n_shingles"]) for r in rows) == sorted((r["doc_id"], len(shingles(r["text"]))) for r in odd_docs.collect())
    assert all(r["component_id"] == r["doc_id"] for r in rows if not r["n_shingles"])
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 3) and r["n_shingles"]} == {3}
    assert jaccard.similar_components(no_docs).count() == 0
    ids = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, (r["component_id"] for r in jaccard.similar_components(ids).collect()))) == ["4", "4", "None"]


def test_one_of_each_keeps_one(spark, odd_docs):
    docs = make(random.Random(4), 200)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, node int")
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    want = {c for _, n, c in brute(docs) if n} | {d for d, n, _ in brute(docs) if not n}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    again = jaccard.one_of_each(odd_docs).select("doc_id", "text").collect()
    assert [r["text"] for r in again if r["doc_id"] == 3 and (r["text"] or "").strip()] == ["a b c d"]


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 70)]
    star = [(100, 100 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(path + star + [(500, 500), (7, 3)], "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert {got[i] for i in range(71)} == {0} and {got[100 + i] for i in range(300)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(edges.where(F.col("a") == 500)).count() == 0


def test_one_of_each_of_repeated_ids(spark):
    """Of rows with equal ids each goes or stays by its own text."""
    text = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    a, b, near_b, c = text(0, 150), text(200, 350), text(202, 351), text(400, 550)
    rows = [(5, a), (5, b), (3, near_b), (7, a), (7, c), (7, c), (7, ""), (8, b), (9, c), (None, c), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).repartition(3)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(5, a), (3, near_b), (7, c), (7, ""), (None, c), (None, "")], key=str)


def test_rows_without_id_link_long_texts(spark):
    text = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(1, text(0, 200)), (None, text(20, 220)), (2, text(40, 240)), (3, text(500, 700))]
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3, None: 1}


def test_long_words_do_not_collide():
    morse = [0]
    while len(morse) < 2048:
        morse += [1 - x for x in morse]
    word, other = ("".join("ab"[x ^ k] for x in morse) for k in range(2))  # one hash by any polynomial modulo 2**64
    text = f"{word} b c d e {other} b c d e {word}"
    assert [len(s) for s in jaccard.shingle_sets([text.encode()])] == [len(shingles(text))]
    assert jaccard.node_of(jaccard.shingle_sets([word.encode()])[0]) != jaccard.node_of(jaccard.shingle_sets([other.encode()])[0])


def test_long_texts_are_hashed_in_slices(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice(["a", "bb", "Ccc", "x" * 90, "y" * 700]) + rng.choice(["", "\n", "\t"]) for _ in range(3000))
    whole = jaccard.shingle_sets([text.encode()])[0]
    monkeypatch.setattr(jaccard, "BATCH_BYTES", 150)
    assert (jaccard.shingle_sets(["a b".encode(), text.encode(), b"c"])[1] == whole).all() and len(whole) == len(shingles(text))


def test_a_very_long_text_takes_bounded_memory():
    import subprocess
    import sys
    code = ("import resource, numpy as np; from evalspark.llm import jaccard; t = b'lorem ipsum dolor ' * 1_800_000 + b'z' * 4_000_000;"
            "a = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; jaccard.shingle_sets([t]);"
            "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a)")
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert grown < 700_000  # kilobytes, for 36 MB


def test_unlike_sets_with_a_common_passage_do_not_meet(spark):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(50)]
    docs = [(i, " ".join([f"r{rng.randrange(10 ** 9)}" for _ in range(14)] + passage)) for i in range(300)]
    assert result(spark, docs) == brute(docs)


def test_sketches_bound_the_overlap():
    rng = np.random.default_rng(8)
    for size in (3, 40, 2000, 100_000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:size // 2], rng.integers(0, 1 << 63, size, dtype=np.uint64)]))
        x, y = (np.frombuffer(jaccard.sketch_of(s), np.uint8)[None] for s in (a, b))
        assert jaccard.most_shared(x, y)[0] >= len(np.intersect1d(a, b))
        assert size != 40 or jaccard.most_shared(x, y)[0] < 0.8 * size
