"""Compressed vectors: codebooks by k-means, with norm-of-sum bounds before exact rescans.

A component x becomes the integer floor(4096 * x).  Vectors are cut into
``PARTS`` equal consecutive parts, each with a codebook of up to ``ENTRIES``
entries.  All distances and sums are exact integers.

Each round assigns every part to its nearest entry.  A part keeps two bounds
between rounds: an upper one for the distance to its entry and a lower one for
the distance to every other entry, each exact in the round whose number it is
stamped with.  The driver keeps the history of all codebooks, so that a bound of
round s is moved to round t by how far the entries really are from where they
were, |c_t - c_s|: the norm of the sum of the steps, which is at most the sum of
their norms.  Only where the moved bounds cross is a distance computed: first
that to the part's own entry (the upper bound gets a new stamp), and if that does not
settle it, those to all entries.  Bounds are 32-bit, rounded outwards, and a part
stays without a rescan only if its bounds are strictly apart, so ties always
go to the lower index.

A round is one narrow pass over the vectors: state rows go on to the next round
(persisted; a lost executor's are computed again from the table and the
codebook history), and each partition adds its sums per (part, entry), which
Spark adds up.  The driver sees these sums only: one number per entry and
position.  Nothing is dealt out by key until the errors are added by label.

Defined results: vectors that are null, empty or hold null or non-finite
components are dropped, and so are those of another dimension than the commonest
one that ``PARTS`` divides (ties: the larger).  Repeated rows and rows with
null ids count and are returned; the first codebook takes ids ascending, equal
ids by their vectors, nulls last; fewer rows than ``ENTRIES`` give shorter codebooks.
Components of any size are computed exactly; an error over 2^63 - 1 is null.
An empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from evalspark.llm.common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows in one go; a row's distances to all entries take ENTRIES times its own size.
ROWS = 2048
#: Integers below this give sums of squares that doubles hold exactly for parts of up to 1024 positions.
EXACT = 1 << 20
#: Sums travel as digits of this base, so that no number of rows or size of component overflows.
BASE = 10 ** 15

BOUNDS = np.dtype([("entry", "u1"), ("upper_round", "u1"), ("lower_round", "u1"), ("upper", "<f4"), ("lower", "<f4")])


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): int64, or Python integers where one does not fit its exact range."""
    y = np.floor(x * SCALE)
    if not y.size or np.abs(y).max() < 2 ** 52:
        return y.astype(np.int64)
    whole = [int(v) * SCALE if abs(v) >= 2.0 ** 52 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(x.shape)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries) of integer rows to integer entries."""
    if x.dtype != object and entries.dtype != object and x.shape[1] <= 1024 and max(
            np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) < EXACT:
        x, entries = x.astype(np.float64), entries.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)).astype(np.int64)
    d = x.astype(object)[:, None, :] - entries.astype(object)[None, :, :]
    return (d * d).sum(2)


def as_entries(numbers: list) -> np.ndarray:
    """Lists of integers as an array, of Python integers if one is large."""
    small = all(abs(v) < 2 ** 52 for row in numbers for v in row)
    return np.array(numbers, dtype=np.int64 if small else object).reshape(len(numbers), -1)


class Codebooks:
    """The codebooks of all rounds so far, and how far entries are from where they were."""

    def __init__(self, history: list):
        self.history = [[as_entries(part) for part in book] for book in history]
        self.now = len(history) - 1
        self.moved = [[self._apart(s, p) for p in range(PARTS)] for s in range(len(history))]
        self.others_moved = [[np.array([np.delete(m, k).max(initial=0) for k in range(len(m))]) for m in row]
                             for row in self.moved]

    def _apart(self, s: int, p: int) -> np.ndarray:
        d = self.history[self.now][p] - self.history[s][p]
        if d.dtype == object:  # a bound moved by more than 10^150 is no bound in any case
            d = np.minimum(np.abs(d), 10 ** 150)
        d = d.astype(float)
        return np.sqrt((d * d).sum(1)) * (1 + 1e-9)  # outwards

    def assign(self, x: np.ndarray, p: int, b: np.ndarray, stats: dict | None = None) -> None:
        """Bring part ``p``'s bounds ``b`` of the rows ``x`` to the current round, its entries exact."""
        entries, now = self.history[-1][p], self.now
        moved = np.stack([m[p] for m in self.moved])
        others = np.stack([m[p] for m in self.others_moved])

        def apart(rows):
            own = b["entry"][rows]
            upper = b["upper"][rows].astype(float) + moved[b["upper_round"][rows], own]
            lower = b["lower"][rows].astype(float) - others[b["lower_round"][rows], own]
            return upper * (1 + 1e-9) < lower

        rows = np.arange(len(b))
        if now:
            rows = rows[~apart(rows)]
            if x.dtype != object and entries.dtype != object:
                own = entries[b["entry"][rows]].astype(float)
                near = np.sqrt(((x[rows] - own) ** 2).sum(1))
                b["upper"][rows] = np.nextafter((near * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))
                b["upper_round"][rows] = now
                rows = rows[~apart(rows)]
        if stats is not None:
            stats["rescanned"] = stats.get("rescanned", 0) + len(rows)
            stats["parts"] = stats.get("parts", 0) + len(b)
        if not len(rows):
            return
        d = squared(x[rows], entries)
        best = d.argmin(1)
        b["entry"][rows] = best
        b["upper_round"][rows] = b["lower_round"][rows] = now
        if d.dtype == object:  # too large for bounds: always scanned
            b["upper"][rows], b["lower"][rows] = np.inf, -np.inf
            return
        near = np.sqrt(d[np.arange(len(rows)), best].astype(float))
        d[np.arange(len(rows)), best] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(1).astype(float)) if d.shape[1] > 1 else np.full(len(rows), np.inf)
        b["upper"][rows] = np.nextafter((near * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))
        b["lower"][rows] = np.nextafter((second * (1 - 1e-9)).astype(np.float32), np.float32(-np.inf))


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes: int64, or decimal text of odd length where one does not fit."""
    if x.dtype != object:
        return [r.tobytes() for r in x.astype("<i8")]
    texts = [",".join(map(str, r)).encode() for r in x]
    return [t if len(t) % 2 else t + b" " for t in texts]


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    if not any(len(r) % 2 for r in rows):
        return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), dim)
    out = [[int(v) for v in r.split(b",")] if len(r) % 2 else np.frombuffer(r, "<i8").tolist() for r in rows]
    return as_entries(out)


def digits(value: int) -> list[int]:
    """``value`` in base ``BASE``, least first, each digit with its sign."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value or not out:
        out.append(sign * (value % BASE))
        value //= BASE
    return out


def _usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the vectors that take part, and their dimension."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), v.alias("v")).where(
        (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where(F.col("d") % PARTS == 0)
    common = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return (rows.where(F.size("v") == common["d"]), common["d"]) if common else (rows.where(F.lit(False)), 0)


def _quantise(batches):
    for b in batches:
        for lo in range(0, len(b), ROWS):
            part = b.slice(lo, ROWS)
            v = part.column(2)
            x = quantised(v.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1))
            none = pa.nulls(len(part), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pack(x), pa.binary()), none],
                                             names=["vec_id", "label", "q", "bounds"])


def _round(history: list, dim: int):
    """One pass: the rows with their bounds in this round, and a row of the partition's sums (q is null there)."""
    width = dim // PARTS

    def run(batches):
        books = Codebooks(history)
        sizes = [len(part) for part in history[-1]]
        sums = [np.zeros((n, width), dtype=object) for n in sizes]
        counts = [np.zeros(n, dtype=np.int64) for n in sizes]
        ids, labels = None, None
        for b in batches:
            ids, labels = b.schema.field("vec_id").type, b.schema.field("label").type
            for lo in range(0, len(b), ROWS):
                part = b.slice(lo, ROWS)
                x = unpack(part.column(2).to_pylist(), dim)
                state = np.zeros((len(part), PARTS), BOUNDS)
                if books.now:
                    state = np.frombuffer(b"".join(part.column(3).to_pylist()), BOUNDS).reshape(len(part), PARTS).copy()
                for p in range(PARTS):
                    own = x[:, p * width:(p + 1) * width]
                    books.assign(own, p, state[:, p])
                    entry = state[:, p]["entry"]
                    order = np.argsort(entry, kind="stable")
                    used, first = np.unique(entry[order], return_index=True)
                    sums[p][used] += np.add.reduceat(own[order], first, axis=0).astype(object)
                    counts[p] += np.bincount(entry, minlength=len(counts[p]))
                bounds = [r.tobytes() for r in state]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(bounds, pa.binary()), pa.nulls(len(part), SUMS)],
                    names=["vec_id", "label", "q", "bounds", "sums"])
        if ids is not None:
            out = [(p, k, -1, 0, int(counts[p][k])) for p in range(PARTS) for k in np.flatnonzero(counts[p]).tolist()]
            for p, k, *_ in list(out):
                for at in range(width):
                    out += [(p, k, at, i, d) for i, d in enumerate(digits(int(sums[p][k][at])))]
            rows = pa.array([[dict(zip(("part", "entry", "at", "digit", "value"), o)) for o in out]], SUMS)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, ids), pa.nulls(1, labels), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), rows],
                                             names=["vec_id", "label", "q", "bounds", "sums"])
    return run


SUMS = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("digit", pa.int32()), ("value", pa.int64())]))
SUMS_SQL = "array<struct<part:int,entry:int,at:int,digit:int,value:bigint>>"


def _next(book: list, rows) -> list:
    """The codebook after the sums ``rows`` (part, entry, at, digit, value); unused entries stay."""
    totals: dict = {}
    for r in rows:
        key = (r["part"], r["entry"], r["at"])
        totals[key] = totals.get(key, 0) + int(r["value"]) * BASE ** r["digit"]
    return [[[totals[p, k, at] // totals[p, k, -1] for at in range(len(entry))] if (p, k, -1) in totals else entry
             for k, entry in enumerate(part)] for p, part in enumerate(book)]


def _final(history: list, dim: int):
    """(vec_id, label, code, error) by the last codebook."""
    width = dim // PARTS

    def run(batches):
        books = Codebooks(history)
        for b in batches:
            for lo in range(0, len(b), ROWS):
                part = b.slice(lo, ROWS)
                x = unpack(part.column(2).to_pylist(), dim)
                state = np.frombuffer(b"".join(part.column(3).to_pylist()), BOUNDS).reshape(len(part), PARTS).copy()
                error = np.zeros(len(part), dtype=object)
                for p in range(PARTS):
                    own = x[:, p * width:(p + 1) * width]
                    books.assign(own, p, state[:, p])
                    d = own.astype(object) - books.history[-1][p].astype(object)[state[:, p]["entry"]]
                    error += (d * d).sum(1)
                codes = [r.tobytes().hex() for r in np.ascontiguousarray(state["entry"])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(codes),
                     pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])
    return run


def first_codebook(rows: DataFrame, dim: int) -> list:
    """The parts of the ``ENTRIES`` vectors with the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    x = [quantised(np.array([r["v"]], dtype=float))[0].tolist() for r in first]
    width = dim // PARTS
    return [[v[p * width:(p + 1) * width] for v in x] for p in range(PARTS)]


def train(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
          rounds: int = ROUNDS) -> tuple[list, DataFrame | None, int]:
    """The codebooks of all rounds (part, entry, position), the persisted rows of the last one, and the dimension."""
    rows, dim = _usable(vectors, vec_id, embedding, label)
    if not dim:
        return [[[] for _ in range(PARTS)]], None, 0
    history = [first_codebook(rows, dim)]
    names = T.StructType([*rows.schema.fields[:2], T.StructField("q", T.BinaryType()), T.StructField("bounds", T.BinaryType())])
    sums = T.StructType([*names.fields, T.StructField("sums", T._parse_datatype_string(SUMS_SQL))])
    state, kept = rows.mapInArrow(_quantise, names), None
    for _ in range(rounds):
        passed = state.mapInArrow(_round(history, dim), sums).persist(StorageLevel.MEMORY_AND_DISK)
        added = passed.where("q is null").select(F.explode("sums").alias("s")).select("s.*").groupBy(
            "part", "entry", "at", "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        history.append(_next(history[-1], added.collect()))  # ENTRIES numbers per position
        if kept is not None:
            kept.unpersist()
        kept, state = passed, passed.where("q is not null").select(*names.fieldNames())
    return history, kept, dim


def codebooks_sha256(book: list) -> str:
    return hashlib.sha256(",".join(str(v) for part in book for entry in part for v in entry).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Per kept row: vec_id, code, error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    history, kept, dim = train(vectors, vec_id, embedding, label)
    source = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label")).schema.fields
    schema = T.StructType([*source, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if kept is None:
        coded = spark.createDataFrame([], schema)
    else:
        state = kept.where("q is not null").select("vec_id", "label", "q", "bounds")
        coded = staged(state.mapInArrow(_final(history, dim), schema), "vector-codes")
        kept.unpersist()
    by_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    by_label = by_label.select(F.col("label").alias("own"), F.col("label_error").try_cast("long").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("own")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(history[-1])).alias("codebooks_sha256"))
