"""Best-fit packing by exact-complement hashing.

Documents are tokenized, cut only where longer than a sequence, and counted by
length.  The plan works on that histogram alone (at most ``capacity`` rows,
whatever the corpus): for each length, longest first, it looks up single
lengths, then pairs, then triples whose sum fills the gap exactly, takes as
many as the availability counts allow, and best-fits what is left.  The plan is
a list of patterns with multiplicities; each piece finds its place by its rank
among the pieces of its length.  Nothing but the histogram reaches the driver.

Defined results: a null text is empty (a document of only the end id); equal
doc_ids and equal rows are packed each on its own; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import staged, worker_cache
from evalspark.llm.wordtok import ChunkTokenizer

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1,
                 with_ids: bool = False, remembered: int = 300_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary of little-endian uint32]) of each document's pieces."""
    end = np.uint32(end_id).tobytes()

    def cut(batches):
        tok = worker_cache(("chunk-tokenizer", tokenizer, remembered), lambda: ChunkTokenizer(tokenizer, remembered))
        for b in batches:
            rows = ([], [], [], [], [], [])
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = tok.encode(text.as_py() or "") + end
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo:lo + 4 * capacity]
                    for col, v in zip(rows, (doc_id, k, lo // 4, len(part) // 4, zlib.crc32(part), part)):
                        col.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            cols = [pa.array(c, t) for c, t in zip(rows, types)][:6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays(cols, names=names[:len(cols)])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence) with how often each is used; together they use up ``counts``."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        while have[length]:
            found = _complement(have, length, capacity)
            if found is None:
                break
            pattern = (length, *found)
            times = min(int(have[x]) // pattern.count(x) for x in set(pattern))
            for x in pattern:
                have[x] -= times
            plan.append((pattern, times))
    return plan + _best_fit(have, capacity)


def _complement(have: np.ndarray, length: int, capacity: int):
    """Lengths that with ``length`` fill a sequence exactly: none, one, two or three, the longest first; or None."""
    gap = capacity - length
    if gap == 0:
        return ()
    have[length] -= 1  # the piece itself is taken
    try:
        if have[gap]:
            return (gap,)
        pair = _pair(have, gap)
        if pair:
            return pair
        for a in np.flatnonzero(have[:gap - 1])[::-1]:
            if 3 * a < gap:  # a is the longest of the three
                break
            have[a] -= 1
            pair = _pair(have, gap - int(a))
            have[a] += 1
            if pair and pair[0] <= a:
                return (int(a), *pair)
        return None
    finally:
        have[length] += 1


def _pair(have: np.ndarray, total: int):
    """The two available lengths with this sum whose longer one is longest, or None."""
    if total < 2:
        return None
    low = np.arange(1, total // 2 + 1)
    ok = (have[low] > 0) & (have[total - low] > 0)
    if total % 2 == 0 and have[total // 2] < 2:
        ok[-1] = False
    i = int(ok.argmax()) if len(ok) else 0
    return (total - int(low[i]), int(low[i])) if len(ok) and ok[i] else None


def _best_fit(have: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on groups of like sequences: each length goes where it leaves the smallest gap."""
    groups: dict[int, list] = {}  # gap -> [(pattern, times)]
    gaps: list[int] = []
    closed = []

    def put(pattern, times):
        gap = capacity - sum(pattern)
        if gap == 0:
            closed.append((pattern, times))
            return
        if gap not in groups:
            insort(gaps, gap)
        groups.setdefault(gap, []).append((pattern, times))

    for length in np.flatnonzero(have)[::-1].tolist():
        left = int(have[length])
        while left:
            i = bisect_left(gaps, length)
            if i == len(gaps):
                fit = capacity // length
                full, rest = divmod(left, fit)
                if full:
                    put((length,) * fit, full)
                if rest:
                    put((length,) * rest, 1)
                break
            gap = gaps[i]
            pattern, times = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(i)
            used = min(times, left)
            if used < times:
                put(pattern, times - used)
            put((*pattern, length), used)
            left -= used
    return closed + [g for v in groups.values() for g in v]


def allocation(plan) -> dict[str, np.ndarray]:
    """For each length, which ranks go to which sequences: arrays sorted by (length, first rank)."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            rows.append((length, first, base, offset))
            used[length] = first + times
            offset += length
        base += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "first": a[:, 1], "base": a[:, 2], "offset": a[:, 3]}


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_group: int = 100_000) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...; a table at rest, it is read twice) with sequence_id and offset.

    Ranks within a length are taken in groups of about ``per_group`` rows, so a
    length that a third of all pieces share is spread over many tasks.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = -(-max(counts.values(), default=1) // per_group)
    place = allocation(plan_patterns(counts, capacity))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    group = Window.partitionBy("length", "_salt")
    before = (salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
              .select("length", "_salt", F.coalesce(F.sum("_n").over(
                  Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)),
                  F.lit(0)).alias("_before")))
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    ranked = (salted.withColumn("_rank", F.row_number().over(group.orderBy(*order)) - 1)
              .join(before, ["length", "_salt"])
              .select(*pieces.columns, (F.col("_rank") + F.col("_before")).alias("_rank")))
    fields = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)

    def locate(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            length = t.column("length").to_numpy()
            rank = t.column("_rank").to_numpy()
            shift = np.int64(1) << 44
            i = np.searchsorted(place["length"] * shift + place["first"], length * shift + rank, "right") - 1
            seq = place["base"][i] + rank - place["first"][i]
            t = t.drop(["_rank"]).append_column("sequence_id", pa.array(seq, pa.int64()))
            yield from t.append_column("offset", pa.array(place["offset"][i], pa.int64())).to_batches()

    return ranked.mapInArrow(locate, fields + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1,
                   with_ids: bool = False, remembered: int = 300_000) -> DataFrame:
    """Tokenize, cut and pack: one row per piece with its sequence and place.  A worker remembers up to
    ``remembered`` words and chunks twice over (about 200 bytes each); fewer cost time, not results."""
    return pack(staged(token_pieces(docs, tokenizer, capacity, end_id, with_ids, remembered), "pieces"), capacity)
