"""Toxicity by compression distance: two zstandard dictionaries, one learned from toxic and one from ordinary text.

A text is read in windows (its words, long ones in pieces).  Each window is
compressed once with either dictionary; how many bytes shorter the toxic one
makes it is the window's distance.  A document's distances are counted at
several thresholds, and a logistic calibration turns the counts into a score.

Learning.  Both dictionaries share one base, the commonest words of ordinary
text, so that ordinary windows cost the same in both; behind it, nearest to
the window, come the words that documents of the class hold significantly
oftener than the other class.  Before compression each byte is spelled with
four, so that a match of one letter already counts and lengths, which come in
whole bytes, resolve small differences.  Dictionaries are learned from the
labelled rows whose crc32 leaves 0 or 1 by 4, the calibration from those that
leave 3; rows that leave 2 are never used.  At most ``SAMPLE`` rows of each
class are used (those with the smallest hash of their id, so the choice does
not depend on the table's order or partitions), weighted back to the classes'
whole numbers.

Defined results: a null or empty text has no windows and gets the score of a
text without toxic windows; rows with null or unknown labels are not learned
from; an id labelled more than once counts as its largest label; equal texts
get equal scores; without labels of both classes every score is the share of
toxic labels (0 without any); other columns pass through.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import worker_cache
from evalspark.llm.wordtok import Memory

SAMPLE = 4000          # labelled rows of each class that are learned from, at most
CUT = 0.3              # scores from here on are predicted toxic
WINDOW = 64            # bytes of a window, at most
BASE_BYTES, CLASS_BYTES = 48 << 10, 8 << 10
SIGNIFICANT = 10.8     # likelihood ratio of a word between the classes (chi-square, p = 0.001)
LEVEL = 12
THRESHOLDS = (2, 3, 4, 6, 8, 10, 12, 16)
WIDE = np.random.default_rng(1).integers(0, 256, (256, 4), dtype=np.uint8)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def windows(text: str) -> list[bytes]:
    out = []
    for w in text.lower().encode().split():
        if len(w) <= WINDOW:
            out.append(w)
        else:
            out += [w[i:i + WINDOW] for i in range(0, len(w), WINDOW)]
    return out


def wide(data: bytes) -> bytes:
    return WIDE[np.frombuffer(data, np.uint8)].tobytes()


def likelihood_ratio(a: int, n: int, b: int, m: int) -> float:
    """G-squared of a in n against b in m."""
    def part(k, total, p):
        return (k * math.log(p) if k else 0.0) + ((total - k) * math.log(1 - p) if total > k else 0.0)
    p = (a + b) / (n + m)
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, p) - part(b, m, p)) if 0 < p < 1 else 0.0


def joined(words, size: int) -> bytes:
    """The first words that fit into ``size`` bytes, each after a blank, the first one last (nearest to a window)."""
    out, left = [], size
    for w in words:
        if len(w) + 1 > left:
            break
        out.append(b" " + w)
        left -= len(w) + 1
    return b"".join(reversed(out))


def learn_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionary content of equal size, from texts of each class."""
    held = [Counter(w for t in texts for w in set(windows(t))) for texts in (toxic, ordinary)]
    n, m = len(toxic), len(ordinary)

    def typical(cls):
        mine, other, size, rest = (held[0], held[1], n, m) if cls == 0 else (held[1], held[0], m, n)
        found = [(g, w) for w, a in mine.items() if a / size > other[w] / rest
                 and (g := likelihood_ratio(a, size, other[w], rest)) > SIGNIFICANT]
        return [w for _, w in sorted(found, key=lambda x: (-x[0], x[1]))]
    own = [typical(0), typical(1)]
    special = {*own[0], *own[1]}
    common = sorted((w for w in held[1] if w not in special), key=lambda w: (-held[1][w], w))
    base = wide(joined(common, BASE_BYTES))
    parts = [wide(joined(words, CLASS_BYTES)) for words in own]
    room = max(map(len, parts))
    noise = np.random.default_rng(2).integers(0, 256, room, dtype=np.uint8).tobytes()  # matches nothing
    return tuple(base + noise[:room - len(p)] + p for p in parts)


class Distance:
    """How many bytes shorter the toxic dictionary makes a window; remembered for a bounded number of windows."""

    def __init__(self, toxic: bytes, ordinary: bytes, remembered: int = 300_000):
        import zstandard
        self.pair = []
        for content in (ordinary, toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                                      write_checksum=False, write_dict_id=False).compress)
        self.memory = Memory(self._one, remembered)

    def _one(self, window: bytes) -> int:
        w = wide(b" " + window)
        return len(self.pair[0](w)) - len(self.pair[1](w))

    def features(self, text: str) -> list[float]:
        d = np.array(self.memory.all(windows(text)), dtype=np.int32)
        n = len(d)
        over = [int((d >= t).sum()) for t in THRESHOLDS]
        return [*map(math.log1p, over), *(math.log1p(1000 * k / n) if n else 0.0 for k in over),
                float(max(d.max(), 0)) if n else 0.0, math.log1p(n)]


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the first one is the intercept
    prior: float         # the score of everything when there is nothing to learn from

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.toxic:
            return np.full(len(features), self.prior)
        x = (features - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, row_weights: np.ndarray, ridge: float = 1.0):
    """Ridge logistic regression by Newton's method: (mean, scale, weights)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    penalty = np.r_[1e-6, np.full(x.shape[1], ridge)]
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (row_weights * p * (1 - p))[:, None]).T @ z + np.diag(penalty),
                               z.T @ (row_weights * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``labels`` (doc_id, toxic) on the texts of ``docs``; at most ``sample`` rows of each class."""
    known = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    every = sum(totals.values())
    by_hash = lambda cls: known.where(F.col("toxic") == cls).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(by_hash(1).unionByName(by_hash(0)))  # at most 2 * sample rows of two numbers
    rows = (docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .join(chosen, "doc_id").select("text", "toxic", (F.crc32(F.col("doc_id").cast("string")) % 4).alias("part"))
            .collect())
    rows.sort(key=lambda r: (r["toxic"], r["part"], r["text"]))
    texts = lambda cls: [r["text"] for r in rows if r["toxic"] == cls and r["part"] < 2]
    rest = [r for r in rows if r["part"] == 3]
    prior = totals.get(1, 0) / every if every else 0.0
    if not texts(0) or not texts(1) or len({r["toxic"] for r in rest}) < 2:
        return Model(b"", b"", np.zeros(0), np.ones(0), np.zeros(1), prior)
    toxic, ordinary = learn_dictionaries(texts(1), texts(0))
    distance = Distance(toxic, ordinary)
    y = np.array([r["toxic"] for r in rest], dtype=float)
    used = np.array([(y == 0).sum(), (y == 1).sum()])
    shares = np.array([totals[0], totals[1]]) / every * len(y) / used
    x = np.array([distance.features(r["text"]) for r in rest])
    return Model(toxic, ordinary, *calibrate(x, y, shares[y.astype(int)]), prior)


def score(docs: DataFrame, model: Model, out: str = "toxicity", text: str = "text") -> DataFrame:
    """``docs`` with the score of each row's whole text in ``out`` (a column of that name is replaced); no shuffle."""
    docs = docs.drop(out)
    key = ("toxicity", hashlib.sha256(model.toxic + model.ordinary).hexdigest())
    at = docs.columns.index(text)

    def run(batches):
        distance = worker_cache(key, lambda: Distance(model.toxic, model.ordinary)) if model.toxic else None
        for b in batches:
            x = np.array([distance.features(t.as_py() or "") if distance else [0.0] for t in b.column(at)], dtype=float)
            s = model.scores(x) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, out])

    fields = docs.schema.fields
    from pyspark.sql import types as T
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))
