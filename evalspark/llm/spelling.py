"""Spelling variants: words one code point apart, found by PartEnum signatures of their letter multisets.

Words are maximal runs of letters (A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased),
counted over whole texts.  A word's multiset of letters is a binary vector:
one position per letter and occurrence (the second "e" is another position than
the first).  A replaced code point changes two positions, an inserted or
deleted one changes one, so near words are vectors of Hamming distance 2 and
equal length, or of distance 1 and lengths that differ by one.

PartEnum: the positions are dealt into ``SECTIONS`` sections of about equal
frequency (counted over all words).  Vectors at distance two agree on all but
two sections, those at distance one on all but one; so a word has one signature
for each way to leave two sections out, with its length, and one for each
section left out alone, with the length of the shorter word.  Near words share a
signature; words that share one are verified by their edit distance inside
the equi-join, so that only near pairs come out of it.  Equal signatures
of different vectors (hashes of 64 bits) only add candidates.

Texts are counted per task before anything is dealt out, by word; signatures are made
of distinct words only.  No join sends words or signatures to every task: Catalyst sizes a table by its
compressed files and doesn't see that a word becomes 45 signatures, so that what it takes for 10 MB
may be gigabytes on the driver; each join is asked to merge.  A long text is read in slices of ``SLICE`` code
points that end between runs, and a task flushes its counts beyond ``HELD`` words.  Roots are
found by doubling along forms, whose counts grow at least ``FACTOR``-fold each step.

Defined results: null and empty texts hold no words; a null id counts as the
empty text in the deletion rule; repeated rows count as often as they come;
ties of forms go to the word that is first in code-point order; an empty table gives no
rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import mix64, staged

LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: A run of a document loses a code point when this divides its hash.
DROP = 199
SECTIONS = 10
#: Occurrences of a letter from here on share one position's section.
DEEP = 3
SLICE, HELD = 1 << 20, 200_000
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def runs(text: str) -> Counter:
    """The lower-cased runs of a text and how often each occurs."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + SLICE
        rest = RUN.match(text, end)
        end = rest.end() if rest else end
        found.update(RUN.findall(text[at:end].encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")))
        at = end
    return found


def word_of(run: str, h: int) -> str:
    """The run, less one code point where its document's hash says so."""
    return run if h % DROP else run[:h % len(run)] + run[h % len(run) + 1:]


def _count(batches):
    total: dict = {}

    def flushed():
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py()
            if not text:
                continue
            seed = zlib.crc32(f"{doc_id}:".encode())
            for run, n in runs(text).items():
                if len(run) >= LEAST_LENGTH:
                    w = word_of(run, zlib.crc32(run.encode(), seed))
                    if len(w) >= LEAST_LENGTH:
                        total[w] = total.get(w, 0) + n
            if len(total) > HELD:
                yield flushed()
    yield flushed()


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): every word of all texts that is long and frequent enough."""
    source = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def positions(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of every letter; a position is the letter and which of its occurrences it is."""
    data = [w.encode("latin-1") for w in words]
    row = np.repeat(np.arange(len(data)), [len(d) for d in data])
    key = row * 256 + np.frombuffer(b"".join(data), np.uint8)
    key.sort()
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    nth = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    return key // 256, (key % 256) + 256 * nth


def _frequencies(batches):
    for b in batches:
        _, at = positions(b.column(0).to_pylist())
        at, n = np.unique(at % 256 + 256 * np.minimum(at // 256, DEEP), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["at", "n"])


def sections_of(frequencies: dict[int, int]) -> np.ndarray:
    """Section per position (below 256 * (DEEP + 1)): each, the most frequent first, goes to the section lightest so far."""
    out, weight = np.zeros(256 * (DEEP + 1), np.int64), [0] * SECTIONS
    for at in sorted(frequencies, key=lambda a: (-frequencies[a], a)):
        out[at] = min(range(SECTIONS), key=lambda s: (weight[s], s))
        weight[out[at]] += frequencies[at]
    return out


def section_sums(words: list[str], sections: np.ndarray) -> np.ndarray:
    """(words, SECTIONS): a hash of each word's vector within each section."""
    row, at = positions(words)
    sums = np.zeros((len(words), SECTIONS), np.uint64)
    np.add.at(sums, (row, sections[at % 256 + 256 * np.minimum(at // 256, DEEP)]), mix64(at.astype(np.uint64) + np.uint64(1)))
    return sums


def signatures(words: list[str], sections: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures per word: leaving out two sections; one, as the shorter word; one, as the longer word."""
    sums = section_sums(words, sections)
    whole, length = sums.sum(1), np.array([len(w) for w in words], np.uint64)

    def tagged(kept, which, long):
        return mix64(kept ^ mix64(long * np.uint64(1000) + np.uint64(which + 1)))

    two = [tagged(whole - sums[:, i] - sums[:, j], SECTIONS + i * SECTIONS + j, length) for i, j in combinations(range(SECTIONS), 2)]
    short = [tagged(whole - sums[:, i], i, length) for i in range(SECTIONS)]
    longer = [tagged(whole - sums[:, i], i, length - np.uint64(1)) for i in range(SECTIONS)]
    return tuple(np.array(x, np.uint64).reshape(-1, len(words)).T for x in (two, short, longer))


def _signed(sections: np.ndarray, kind: int):
    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 2000):
                part = b.slice(lo, 2000)
                sig = signatures(part.column(0).to_pylist(), sections)[kind]
                take = pa.array(np.repeat(np.arange(len(part)), sig.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(sig.ravel().view(np.int64)), part.column(0).take(take), part.column(1).take(take)],
                                                 names=["sig", "word", "n"])
    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words that differ by exactly one code point, once."""
    frequencies = {r["at"]: r["n"] for r in words.mapInArrow(_frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    sections = sections_of(frequencies)  # one number per letter and occurrence up to DEEP
    two, short, longer = (words.mapInArrow(_signed(sections, k), "sig long, word string, n long") for k in range(3))

    def side(df, name):
        return df.select("sig", F.col("word").alias(name), F.col("n").alias(f"n_{name}"))

    near = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    replaced = side(two, "a").join(side(two, "b").hint("merge"), "sig").where((F.col("a") < F.col("b")) & near)
    inserted = side(short, "a").join(side(longer, "b").hint("merge"), "sig").where(near)
    return replaced.unionByName(inserted).drop("sig").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: the end of its chain, by doubling the step each round."""
    step = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = staged(step.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        if step.where("went").isEmpty():
            return step.drop("went")
        step = step.drop("went")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root."""
    words = staged(count_words(docs, doc_id, text), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))).alias("p")).select("p.*")
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("m"))
    large = -F.col("m.n") >= FACTOR * F.col("n")
    forms = staged(best.select("word", "n_near", F.when(large, F.col("m.other")).alias("form"), F.when(large, -F.col("m.n")).alias("form_n")), "forms")
    last = roots(forms.where("form is not null"))
    return words.join(forms.hint("merge"), "word", "left").join(last.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
