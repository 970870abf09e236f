import hashlib
import math

import numpy as np
import pytest

from evalspark.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    """The contract, row by row, in Python integers."""
    kept = [(i, [math.floor(4096 * x) if abs(x) < 2 ** 52 else 4096 * int(x) for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    w = len(kept[0][1]) // 8
    cut = lambda v, p: v[p * w:(p + 1) * w]
    books = [[cut(v, p) for _, v, _ in first] for p in range(8)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda a, book: min(range(len(book)), key=lambda k: (dist(a, book[k]), k))
    for _ in range(6):
        for p in range(8):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(cut(v, p), books[p]), []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e
                        for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, lab in kept:
        codes = [nearest(cut(v, p), books[p]) for p in range(8)]
        out.append((i, lab, bytes(codes).hex(), sum(dist(cut(v, p), books[p][codes[p]]) for p in range(8))))
    by = {}
    for _, lab, _, e in out:
        by[lab] = by.get(lab, 0) + e
    return sorted((str(i), c, e, by[lab], sha) for i, lab, c, e in out)


def found(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_equal_to_plain_rounds(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)) * rng.uniform(0.01, 3, (600, 1))
    x[100:180] = x[5]  # a large group of one vector
    x = np.round(x, 2)  # many ties
    rows = [(i, x[i].tolist(), None if i % 7 == 0 else i % 3) for i in range(600)]
    rows += [(600, None, 1), (601, [None] * 16, 1), (602, [float("nan")] * 16, 1), (603, [1.0, float("inf")] * 8, 2), (604, [], 0),
             (605, [0.0] * 16, 0), (7, x[8].tolist(), 5), (7, x[8].tolist(), 5), (None, x[9].tolist(), None)]
    got = found(vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got == brute(rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(0, 40)).tolist(), i % 2) for i in range(60)] + [(70, [1.7e308, -1.7e308] * 4, 1)]
    fits = lambda e: e if e < 1 << 63 else None
    want = sorted((i, c, fits(e), s) for i, c, e, _, s in brute(rows))
    got = found(vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert [(i, c, e, s) for i, c, e, _, s in got] == want


def test_few_rows_other_dimensions_and_clashing_columns(spark):
    rows = [(i, [float(i), 1.0] * 4, 0) for i in range(5)]
    df = spark.createDataFrame([*rows, (9, [1.0] * 3, 0), (10, [1.0] * 16, 0)], SCHEMA)
    for c in ("code", "error", "q", "bounds", "sums", "v", "own"):
        df = df.selectExpr("*", f"1 AS {c}")
    assert found(vector_codes.compress(df)) == brute(rows)
    assert vector_codes.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, None), (2, [1.0] * 9, 1)], SCHEMA)).collect() == []


def test_bounds_spare_rescans_and_lose_nothing():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = centres[rng.integers(0, 16, 5000)] + rng.integers(-150, 150, (5000, 8))
    history = [[x[:16].tolist()] * vector_codes.PARTS]
    b, stats = np.zeros(len(x), vector_codes.BOUNDS), {}
    for t in range(8):
        vector_codes.Codebooks(history).assign(x, 0, b, stats)
        book = np.array(history[-1][0])
        assert (b["entry"] == vector_codes.squared(x, book).argmin(1)).all()
        new = [(x[b["entry"] == k].sum(0) // max((b["entry"] == k).sum(), 1)).tolist() if (b["entry"] == k).any() else book[k].tolist()
               for k in range(16)]
        history.append([new] * vector_codes.PARTS)
    assert stats["rescanned"] < 0.5 * stats["parts"]


def test_net_displacement_is_at_most_accumulated_drift():
    rng = np.random.default_rng(3)
    history = [[rng.integers(-99, 99, (16, 8)).tolist()] * vector_codes.PARTS for _ in range(5)]
    books = vector_codes.Codebooks(history)
    steps = [np.linalg.norm(np.array(b[0], float) - np.array(a[0], float), axis=1) for a, b in zip(history, history[1:])]
    assert (books.moved[0][0] <= sum(steps) * (1 + 1e-8)).all() and (books.moved[0][0] < 0.9 * sum(steps)).any()


@pytest.mark.parametrize("name", ["op12_vector_codes"])
def test_query(spark, sf_dir, name):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(queries.QUERIES[name](spark, sf_dir)) == brute(rows)
