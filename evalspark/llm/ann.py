"""Approximate nearest neighbours by largest inner product: a permutation index.

Each vector is represented by its ``PREFIX`` nearest pivots, nearest first, and
posted in the inverted file of each of them with the pivot's place.  A query
reads the files of its own pivots and adds up, for each vector met, how well
the places agree (the footrule distance with absent pivots at place
``PREFIX``).  The best vectors by footrule are ranked again by their inner
product on the original vectors.

So that pivots order vectors as inner products do, vectors get one more
component that brings all to the length of the longest (queries get 0 there).
Pivots are the at most ``PIVOTS`` vectors with the smallest hash of their id;
every vector is indexed.  From each block of the index a query ranks again the
share ``RERANK`` of its vectors, and at least ``LEAST`` vectors in all.

The index is cut into blocks and the queries into blocks; each pair of blocks
is a task of bounded size, and only each query's best per block are shuffled
further.  Equal vectors beyond the smallest ``k + 1`` ids are left out of the
index, as they cannot be among the k nearest; they are cut before the shuffle.

Defined results: vectors that are null, zero, of another than the commonest
dimension, or hold null or non-finite components take no part, nor do rows
without an id; an id with several vectors counts with the least of them; ties
go to the smaller id; fewer candidates give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import staged

PIVOTS, PREFIX = 128, 48
RERANK, LEAST = 0.3, 1000
INDEX_BLOCK, QUERY_BLOCK = 1 << 14, 1 << 12


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v: array<double>): one usable vector per id, of the commonest dimension."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
        & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False))))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (common["d"] if common else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors whose angles to a query fall in the order of inner products."""
    rest = np.sqrt(np.maximum(longest ** 2 - (x ** 2).sum(1), 0))
    return np.c_[x, rest] / longest


def prefixes(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each row's nearest pivots, nearest first (ties: the earlier pivot)."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :PREFIX]


class Block:
    """The inverted files of some vectors: per pivot, which vectors hold it and at which place."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, longest: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order])
        near = prefixes(lengthened(self.x, longest), pivots)
        self.width = near.shape[1]
        flat = near.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.vector = (by_pivot // self.width).astype(np.int64)
        self.place = (by_pivot % self.width).astype(np.int64)
        self.cut = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))

    def candidates(self, near: np.ndarray, n: int) -> np.ndarray:
        """The n vectors with the least footrule distance to a query's prefix."""
        if n >= len(self.ids):
            return np.arange(len(self.ids))
        agree = np.zeros(len(self.ids), np.int32)
        gain = (self.width - np.abs(np.arange(self.width)[:, None] - np.arange(self.width)[None])).astype(np.int32)
        for place, p in enumerate(near):
            part = slice(self.cut[p], self.cut[p + 1])
            agree[self.vector[part]] += gain[place][self.place[part]]
        return np.argpartition(-agree, n - 1)[:n]

    def nearest(self, query_id: int, q: np.ndarray, near: np.ndarray, n: int, k: int):
        """(ids, scores) of the k best of the n candidates, the query's own id left out."""
        c = np.sort(self.candidates(near, n))
        c = c[self.ids[c] != query_id]
        x = self.x[c]
        s = x @ q
        if len(c) > k:  # all that might be among the best, whatever the order of summation
            kth = np.partition(s, len(s) - k)[len(s) - k]
            close = s >= kth - 1e-9 * (1 + abs(kth))
            c, x = c[close], x[close]
        s = (x * q).sum(1)
        best = np.lexsort((self.ids[c], -s))[:k]
        return self.ids[c][best], s[best]


def matrix(column) -> np.ndarray:
    """An Arrow column of lists of equal length as rows."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, rerank: float = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query's vector, nearest first.

    ``vectors`` and ``queries`` have vec_id and embedding; without ``queries``
    they are the rows whose vec_id is divisible by 20.
    """
    rows = staged(usable(vectors), "vectors")
    asked = rows.where(F.col("vec_id") % 20 == 0) if queries is None else staged(usable(queries), "queries")
    same = Window.partitionBy("v").orderBy("vec_id")
    index = staged(rows.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= k + 1).drop("_copy"), "indexed")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = index.agg(F.count("*").alias("n"), F.max(length).alias("longest")).first()
    pivots = [r["v"] for r in index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()]  # at most PIVOTS rows
    total, longest = facts["n"], facts["longest"]
    if not total:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    pivots = lengthened(np.array(pivots), longest)
    blocks, asked_blocks = -(-total // INDEX_BLOCK), -(-max(asked.count(), 1) // QUERY_BLOCK)
    share = max(rerank, LEAST / total)
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.select(part(blocks).alias("i"), "vec_id", "v").select("i", each(asked_blocks).alias("j"), "vec_id", "v")
    right = asked.select(part(asked_blocks).alias("j"), "vec_id", "v").select(each(blocks).alias("i"), "j", "vec_id", "v")

    def rank(_, index_part, query_part):
        out = ([], [], [])
        if len(index_part) and len(query_part):
            block = Block(index_part.column("vec_id").to_numpy(), matrix(index_part.column("v")), pivots, longest)
            q = matrix(query_part.column("v"))
            if q.shape[1] == block.x.shape[1]:
                near = prefixes(np.c_[q, np.zeros(len(q))], pivots)
                n = max(1, int(np.ceil(share * len(block.ids))) + 1)
                for query_id, row, own in zip(query_part.column("vec_id").to_numpy(), q, near):
                    ids, s = block.nearest(query_id, row, own, n, k)
                    for column, values in zip(out, (np.full(len(ids), query_id), ids, s)):
                        column.append(values)
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)),
                         "score": pa.array(cols[2].astype(np.float64))})

    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(rank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
