import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from evalspark.llm import packing
from evalspark.llm.queries import op9_pack, tokenizer_path

WORD = tokenizer_path("word_bpe_49k.json")


def check(rows, capacity):
    """Every sequence is gapless from 0 and within capacity; returns their number."""
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_patterns_use_up_the_counts():
    rng = random.Random(2)
    for _ in range(60):
        cap = rng.choice([10, 64, 300])
        counts = Counter(rng.randint(1, cap) for _ in range(rng.randint(0, 400)))
        plan = packing.plan_patterns(counts, cap)
        used = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= cap and times > 0
            for x in pattern:
                used[x] += times
        assert used == counts
        low = -(-sum(k * v for k, v in counts.items()) // cap)
        bins = sum(t for _, t in plan)
        assert low <= bins <= 1.3 * low + 2


def test_exact_complements_come_first():
    plan = dict(packing.plan_patterns({7: 3, 3: 2, 2: 1, 1: 1}, 10))
    assert plan == {(7, 3): 2, (7, 2, 1): 1}
    assert dict(packing.plan_patterns({6: 1, 2: 1, 1: 2}, 10)) == {(6, 2, 1, 1): 1}
    assert dict(packing.plan_patterns({5: 5}, 10)) == {(5, 5): 2, (5,): 1}
    assert packing.plan_patterns({}, 10) == []


def test_allocation_gives_each_rank_one_place():
    place = packing.allocation([((4, 4, 2), 3), ((4,), 2)])
    assert place["length"].tolist() == [2, 4, 4, 4] and place["first"].tolist() == [0, 0, 3, 6]


def test_whole_table_against_the_library(spark, sf_dir):
    tok = Tokenizer.from_file(WORD)
    rows = op9_pack(spark, sf_dir).collect()
    bins = check(rows, 4096)
    assert bins <= -(-sum(r["length"] for r in rows) // 4096) + 1
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = tok.encode(d["text"] or "", add_special_tokens=False).ids + [1]
        for r in got[d["doc_id"]]:
            part = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part) and r["start"] == 4096 * r["piece"]
        assert sum(r["length"] for r in got[d["doc_id"]]) == len(ids)


def test_edges(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs.withColumnRenamed("lang", "length"), WORD, capacity=50, with_ids=True).collect()
    check(rows, 50)
    assert sum(r["piece"] == 0 for r in rows) == odd_docs.count()
    assert all(len(r["ids"]) == 4 * r["length"] and r["length"] == 50 for r in rows
               if any(x["doc_id"] == r["doc_id"] and x["piece"] > r["piece"] for x in rows) and r["doc_id"] != 3)
    assert packing.pack_documents(no_docs, WORD).count() == 0


def test_a_length_that_most_rows_share_is_spread(spark):
    pieces = spark.range(5000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "CASE WHEN id % 3 = 0 THEN 7L ELSE 5L END AS length",
                                          "0L AS ids_crc32")
    rows = packing.pack(pieces, capacity=12, per_group=100).collect()
    assert len(rows) == 5000 and check(rows, 12) == 1667 + -(-(3333 - 1667) // 2)
