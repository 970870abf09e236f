"""Improbable-feature digests of texts, and their likeness.

Every window of ``WINDOW`` bytes is a feature.  Its Shannon entropy is put into
one of ``CLASSES`` classes, and a class is the rarer the fewer windows of the
whole corpus fall into it.  In each run of ``WINDOW`` neighbouring features the
rarest (the leftmost of equals) gets a vote, and features with ``VOTES`` votes
are selected.  Each sets ``HASHES`` bits of a Bloom filter of ``BITS`` bits; after
``PER_FILTER`` features the next filter of the chain begins.  Two chains are alike as far as
each filter of the shorter one overlaps with its best match in the other,
beyond what chance explains (0 to 1).

Entropies roll: how often the entering and the leaving byte occur in the window
comes from comparing the text with itself at 1 to 63 bytes' distance, so the
cost per byte is constant and nothing loops over bytes in Python.

Texts of fewer than ``SHORT`` bytes have too few windows to choose from; all
their windows of ``SHORT_WINDOW`` bytes are features, in order of first place.
The two kinds of features can't overlap, so texts on both sides of that border
carry a second chain of the other kind: texts of ``SHORT`` to ``BAND`` bytes all
short windows, texts of ``WINDOW`` to ``SHORT`` bytes the selected windows.  A
text on one side and one on the other are compared by short windows if the
longer has them, else by selected windows.  ``BAND`` is more than the contract's
edit can move a text: below 768 bytes if the edited text is below 256.

Defined results: a text of fewer than ``WINDOW`` bytes and one of ``BAND`` or more have likeness 0 (no kind of feature in common);
texts of fewer than ``SHORT_WINDOW`` bytes are one feature; a null text is empty; an empty text has an empty chain, like another empty one (1.0)
and unlike anything else (0.0); equal texts have equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import mix64

WINDOW, VOTES, HASHES, BITS, PER_FILTER = 64, 16, 5, 2048, 128
SHORT, SHORT_WINDOW = 256, 8  # texts of fewer bytes: every window of 8 bytes is a feature
BAND = 1024  # texts of fewer bytes carry the short features, too
CLASSES = 1 << 10
BATCH_BYTES = 1 << 19  # texts are worked on together up to this size
#: c * log2(c), in whole units so that sums are exact.
_UNIT = 1 << 10
CLOG = np.round(np.array([0.0] + [c * np.log2(c) for c in range(1, WINDOW + 1)]) * _UNIT).astype(np.int64)
BYTE_CODE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


class Digest(NamedTuple):
    """A text's chain as rows of BITS bits, its number of features, whether they are short windows, and the chain of the other kind."""

    bits: np.ndarray
    count: int
    short: bool
    also: np.ndarray
    also_count: int


def windows_class(data: np.ndarray) -> np.ndarray:
    """The entropy class of each window of ``data`` (uint8), 0 for the highest entropy."""
    n, w = len(data), WINDOW
    if n < w:
        return np.zeros(0, np.int32)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, w):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    gain = np.diff(CLOG)
    total = np.empty(n - w + 1, np.int64)
    total[0] = CLOG[np.bincount(data[:w], minlength=256)].sum()
    np.cumsum(gain[before[w:]] - gain[after[:n - w]], out=total[1:])
    total[1:] += total[0]
    return (total * (CLASSES - 1) // int(CLOG[w])).astype(np.int32)


def _together(texts: list[bytes]):
    """The texts in one array with gaps that no run of features crosses, and where each begins."""
    size = [len(t) for t in texts]
    starts = np.cumsum([0] + [s + WINDOW + 1 for s in size[:-1]]) if texts else np.zeros(0, np.int64)
    gap = b"\x00" * (WINDOW + 1)
    return np.frombuffer(gap.join(texts) + gap, np.uint8), np.asarray(starts, np.int64), np.asarray(size, np.int64)


def _batches(texts: list[bytes]):
    """Runs of texts of about BATCH_BYTES together."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _inside(starts, size, n_windows) -> np.ndarray:
    """Which windows lie within one text."""
    ok = np.zeros(n_windows + 1, np.int8)
    whole = size >= WINDOW
    np.add.at(ok, starts[whole], 1)
    np.add.at(ok, starts[whole] + size[whole] - WINDOW + 1, -1)
    return np.cumsum(ok[:-1]).astype(bool)


def class_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows of the texts fall into each entropy class."""
    out = np.zeros(CLASSES, np.int64)
    for part in _batches(texts):
        data, starts, size = _together(part)
        cls = windows_class(data)
        out += np.bincount(cls[_inside(starts, size, len(cls))], minlength=CLASSES)
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """Each class's rank, 0 for the rarest."""
    rank = np.empty(CLASSES, np.int64)
    rank[np.lexsort((np.arange(CLASSES), counts))] = np.arange(CLASSES)
    return rank


def _short_features(text: bytes) -> np.ndarray:
    data = np.frombuffer(text.ljust(SHORT_WINDOW, b"\x00"), np.uint8)
    views = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, SHORT_WINDOW)).view("<u8").ravel()
    first = np.sort(np.unique(views, return_index=True)[1])
    return mix64(views[first] + np.uint64(1 + min(len(text), SHORT_WINDOW)))


def _selected(data, starts, size, rank) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of the selected features, in order of place."""
    cls = windows_class(data)
    n = len(cls)
    inside = _inside(starts, size, n)
    none = np.int64(CLASSES) << 40
    key = np.where(inside, (rank[cls] << 40) | np.arange(n), none)
    run = np.concatenate([np.full(WINDOW - 1, none), key, np.full(WINDOW - 1, none)])
    for shift in (1, 2, 4, 8, 16, 32):
        run = np.minimum(run[:-shift], run[shift:])
    votes = np.bincount(run[run < none] & ((1 << 40) - 1), minlength=n)
    at = np.flatnonzero(votes >= VOTES)
    owner = np.searchsorted(starts, at, "right") - 1
    # polynomial hash of each selected window, from prefix sums modulo 2**64 within the text
    power = np.ones(len(data), np.uint64)
    power[1:] = BASE
    np.multiply.accumulate(power, out=power)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODE[data] * power, dtype=np.uint64)])
    inverse = np.full(len(at), 1, np.uint64)
    step, e = INVERSE, at.astype(np.uint64)
    while e.any():
        inverse[(e & np.uint64(1)).astype(bool)] *= np.uint64(step)
        step, e = step * step % (1 << 64), e >> np.uint64(1)
    return owner, mix64((prefix[at + WINDOW] - prefix[at]) * inverse)


def _chains(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The filters of each of ``n`` texts, from the features' (sorted) text numbers and hashes, and how many features each has."""
    count = np.bincount(owner, minlength=n)
    filters = -(-count // PER_FILTER)
    first = np.cumsum(filters) - filters
    rows = first[owner] + (np.arange(len(owner)) - (np.cumsum(count) - count)[owner]) // PER_FILTER
    bits = np.zeros((int(filters.sum()), BITS), np.uint8)
    for k in range(HASHES):
        bits[rows, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return [bits[first[i]:first[i] + filters[i]] for i in range(n)], count


def digests(texts: list[bytes], rank: np.ndarray) -> list[Digest]:
    """Each text's chain, and the chain of the other kind near the border of the two."""
    out = []
    for part in _batches(texts):
        data, starts, size = _together(part)
        selected, n_selected = _chains(*_selected(data, starts, size, rank), len(part))
        band = np.flatnonzero((size > 0) & (size < BAND))
        own = [_short_features(part[i]) for i in band]
        short, n_short = _chains(np.repeat(band, [len(x) for x in own]),
                                 np.concatenate([np.zeros(0, np.uint64), *own]), len(part))
        for i in range(len(part)):
            kinds = (selected[i], int(n_selected[i])), (short[i], int(n_short[i]))
            is_short = bool(size[i] < SHORT)
            out.append(Digest(*kinds[is_short], is_short, *kinds[not is_short]))
    return out


def _packed(bits: np.ndarray, count: int) -> str:
    return f"{len(bits)}:{count}:{base64.b64encode(np.packbits(bits, axis=1).tobytes()).decode()}"


def encoded(digest: Digest) -> str:
    """``filters:features:base64 of the filters``; then, if the text has one, the chain of the other kind, behind ``:s:`` if its
    own features are short windows and ``:l:`` if not.  A text without the second chain and of fewer than SHORT bytes ends in ``:s``."""
    also = ":" + _packed(digest.also, digest.also_count) if len(digest.also) else ""
    kind = ":s" if digest.short else ":l" if also else ""
    return _packed(digest.bits, digest.count) + kind + also


def decoded(fingerprint: str) -> Digest:
    def chain(n="0", count="0", text=""):
        raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(int(n), BITS // 8)
        return np.unpackbits(raw, axis=1), int(count)

    parts = fingerprint.split(":")
    return Digest(*chain(*parts[:3]), parts[3:4] == ["s"], *chain(*parts[4:]))


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1; each filter of the shorter chain against its best match, weighed by its bits.

    Chains of one kind are compared: the texts' own, or those of the kind that both have.
    """
    one, two = a.bits, b.bits
    if a.short != b.short:
        low, high = (a, b) if a.short else (b, a)
        one, two = (low.bits, high.also) if len(high.also) else (low.also, high.bits)
    a, b = sorted((one, two), key=len)
    if not len(a):
        return float(not len(b))
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    set_a, set_b = a.sum(1, dtype=np.int64), b.sum(1, dtype=np.int64)
    other = b.astype(np.float32)
    best = np.zeros(len(a))
    for lo in range(0, len(a), 256):
        part = slice(lo, lo + 256)
        common = a[part].astype(np.float32) @ other.T
        chance = set_a[part, None] * set_b[None] / BITS
        most = np.minimum(set_a[part, None], set_b[None])
        best[part] = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(1)
    return float((best * set_a).sum() / set_a.sum())


def corpus_rarity(docs: DataFrame) -> np.ndarray:
    """Rarity of the entropy classes over all texts; one small row per task reaches the shuffle."""

    def count(batches):
        total = np.zeros(CLASSES, np.int64)
        for b in batches:
            total += class_counts([t.as_py().encode() for t in b.column(0) if t.is_valid])
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k], pa.int64())], names=["class", "n"])

    rows = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "class int, n long")
            .groupBy("class").agg(F.sum("n").alias("n")).collect())  # at most CLASSES rows
    counts = np.zeros(CLASSES, np.int64)
    for r in rows:
        counts[r["class"]] = r["n"]
    return rarity(counts)


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None, out: str = "fingerprint") -> DataFrame:
    """(doc_id, fingerprint) of each row's whole text."""
    rank = corpus_rarity(docs) if rank is None else rank

    def run(batches):
        for b in batches:
            texts = [(t.as_py() or "").encode() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(encoded, digests(texts, rank)), pa.string())],
                                             names=["doc_id", out])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id long, {out} string")


def in_rings(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, text, look): rows by descending doc_id, nulls last, equal ids by text, cut into partitions.

    Each partition ends with a copy of the row that comes next (``look`` is
    true); after the last row comes the first.  Only the ranges' borders (one
    id a partition) pass through the driver; the texts move once.
    """
    least = -(1 << 63)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(least))
    cuts = d.select(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*(F.lit(c).cast("long") for c in cuts))
    d = d.withColumn("key", key).withColumn("bucket", F.size(F.filter(bounds, lambda b: b <= F.col("key"))))
    tops = {r["bucket"]: r["top"] for r in d.groupBy("bucket").agg(F.max("key").alias("top")).collect()}
    if not tops:
        return d.select("doc_id", "text", F.lit(False).alias("look"))
    order = sorted(tops)
    # the top row of a bucket follows the last row of the bucket above it; the very top follows the lowest bucket
    goes_to = {tops[low]: high for low, high in pairwise(order)} | {tops[order[-1]]: order[0]}
    looks = (d.where(F.col("key").isin(list(goes_to))).groupBy("key").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
             .withColumn("bucket", F.create_map(*(F.lit(x) for kv in goes_to.items() for x in kv))[F.col("key")]))
    every = d.withColumn("look", F.lit(False)).unionByName(looks.withColumn("look", F.lit(True)))
    return (every.repartitionById(len(cuts) + 1, F.col("bucket"))
            .sortWithinPartitions("look", F.col("key").desc(), "text").select("doc_id", "text", "look"))


def edited_pairs(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited form (the last third replaced by the start of the next text), and likeness."""
    spark = docs.sparkSession
    rank = corpus_rarity(docs)
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def rows_of(pending):
        edited = []
        for (_, t, _), (_, after, _) in pairwise(pending):
            k = len(t) // 3
            edited.append((t[:len(t) - k] + after[:k]).encode())
        own = digests([t.encode() for _, t, _ in pending], rank)
        changed = digests(edited, rank)
        rows = [(pending[i][0], len(pending[i][1]), hashlib.sha256(e).hexdigest(), encoded(own[i]), encoded(c),
                 likeness(own[i], c), likeness(own[i], own[i + 1]))
                for i, (e, c) in enumerate(zip(edited, changed)) if not pending[i][2]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names=names)

    def run(batches):
        pending, size = [], 0
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                pending.append((row[0], row[1].as_py(), row[2]))
                size += len(pending[-1][1])
                if size >= BATCH_BYTES and len(pending) > 1:
                    yield rows_of(pending)
                    pending, size = pending[-1:], len(pending[-1][1])
        if len(pending) > 1:
            yield rows_of(pending)

    return in_rings(docs, buckets).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                              "edited_fingerprint string, near_edited double, near_next double")
