"""Elias-Fano sequences and a two-level n-gram trie made of them, laid out for memory mapping.

All structures are arrays in one run of bytes.  ``from_buffer`` only makes views of
it (numpy over any buffer: a memory-mapped file or the bytes of a Spark row), so
nothing is decoded before it is queried; queries take whole arrays.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
WORDS = 8  # 64-bit words for each entry of the directory


def packed(bits: np.ndarray) -> np.ndarray:
    """0/1 values as 64-bit words, lowest first, with a spare word at the end."""
    out = np.packbits(bits, bitorder="little")
    return np.concatenate([out, np.zeros(-len(out) % 8 + 8, np.uint8)]).view("<u8")


def select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit of each word."""
    at, k = np.zeros(len(word), np.int64), k.copy()
    for width in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(word & U64((1 << width) - 1)).astype(np.int64)
        go = k >= n
        k -= n * go
        at += width * go
        word = word >> (U64(width) * go.astype(U64))
    return at


class EliasFano:
    """A sequence of non-decreasing uint64: low bits in a packed array, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, top: int):
        self.n, self.low_bits, self.low, self.high, self.ones, self.top = n, low_bits, low, high, ones, top
        self.zeros = np.arange(len(ones), dtype=np.int64) * (64 * WORDS) - ones

    @classmethod
    def arrays(cls, values: np.ndarray) -> list[np.ndarray]:
        """The arrays of a sequence, for :meth:`of_arrays`."""
        v = np.ascontiguousarray(values, dtype=U64)
        n = len(v)
        last = int(v[-1]) if n else 0
        bits = max(0, ((last + 1) // max(n, 1)).bit_length() - 1)
        low = v & U64((1 << bits) - 1)
        chunks = [((low[i:i + 65536, None] >> np.arange(bits, dtype=U64)) & U64(1)).astype(np.uint8).ravel() for i in range(0, n, 65536)]
        buckets = (v >> U64(bits)).astype(np.int64)
        top = last >> bits
        unary = np.zeros(n + top + 1, np.uint8)
        unary[buckets + np.arange(n)] = 1
        high = packed(unary)
        high = np.concatenate([high, np.zeros(-len(high) % WORDS, U64)])
        counts = np.bitwise_count(high).reshape(-1, WORDS).sum(1).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        low_words = packed(np.concatenate(chunks) if chunks else np.zeros(0, np.uint8))
        return [np.array([n, bits, top], np.int64), low_words, high, ones]

    @classmethod
    def of_arrays(cls, head, low, high, ones) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, high, ones, int(head[2]))

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Places of the k-th ones (``flip``: zeros) of the high bits."""
        block = np.searchsorted(before, k, side="right") - 1
        rest = k - before[block]
        word_at = block * WORDS
        todo = np.ones(len(k), bool)
        for _ in range(WORDS - 1):
            w = self.high[word_at]
            n = np.bitwise_count(~w if flip else w).astype(np.int64)
            todo &= rest >= n
            if not todo.any():
                break
            rest -= n * todo
            word_at += todo
        w = self.high[word_at]
        return word_at * 64 + select_in_word(~w if flip else w, rest)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U64)
        at = i.astype(np.int64) * self.low_bits
        word, off = at >> 6, (at & 63).astype(U64)
        value = self.low[word] >> off
        over = off + U64(self.low_bits) > U64(64)
        value = np.where(over, value | (self.low[word + 1] << (U64(64) - np.where(over, off, U64(1)))), value)
        return value & U64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        high = self._select(i, self.ones, False) - i
        return (high.astype(U64) << U64(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value that is not below x (``n`` where there is none)."""
        x = np.asarray(x, U64)
        out = np.full(len(x), self.n, np.int64)
        in_range = (x >> U64(self.low_bits)) <= U64(self.top)
        if not self.n or not in_range.any():
            return out
        x = x[in_range]
        h = (x >> U64(self.low_bits)).astype(np.int64)
        start = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, True) - (h - 1), 0)
        end = self._select(h, self.zeros, True) - h
        low = x & U64((1 << self.low_bits) - 1)
        while True:
            open_ = np.flatnonzero(start < end)
            if not len(open_):
                break
            mid = (start[open_] + end[open_]) // 2
            below = self._low(mid) < low[open_]
            start[open_] = np.where(below, mid + 1, start[open_])
            end[open_] = np.where(below, end[open_], mid)
        out[in_range] = start
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each value x, -1 where it is not held."""
        at = self.successor(x)
        held = at < self.n
        held[held] = self.get(at[held]) == np.asarray(x, U64)[held]
        return np.where(held, at, -1)


class Trie:
    """Contexts and their successors with quantised probabilities.

    Level one holds the contexts' keys, their monotone pointers into level two and their back-off weights;
    level two holds, for each context, its successors' word numbers and probabilities.  A context's numbers
    are kept relative to the last number of the context before it, so that level two is one monotone
    sequence; a query looks for its own number on top of that as the successor in its context's range.
    """

    LEVELS = ("contexts", "pointers", "words", "successors")

    def __init__(self, parts: list[np.ndarray]):
        for i, name in enumerate(self.LEVELS):
            setattr(self, name, EliasFano.of_arrays(*parts[4 * i:4 * i + 4]))
        self.backoffs, self.probabilities = parts[-2:]

    @classmethod
    def build(cls, contexts: np.ndarray, backoffs: np.ndarray, words: np.ndarray, pairs: np.ndarray, probabilities: np.ndarray) -> bytes:
        """From sorted context keys, their codes, sorted word keys, and pairs (context, word: numbers) in order with codes."""
        counts = np.bincount(pairs[:, 0], minlength=len(contexts))
        pointers = np.concatenate([[0], np.cumsum(counts)])
        ends = pointers[1:][counts > 0] - 1
        steps = np.zeros(len(contexts), np.int64)
        steps[counts > 0] = pairs[ends, 1] + 1
        base = np.concatenate([[0], np.cumsum(steps)[:-1]]) if len(contexts) else steps
        levels = (contexts, pointers, words, base[pairs[:, 0]] + pairs[:, 1])
        parts = [a for level in levels for a in EliasFano.arrays(level)] + [backoffs.astype("<u2"), probabilities.astype("<u2")]
        heads = np.array([[p.nbytes, {"<i8": 0, "<u8": 1, "<u2": 2}[p.dtype.newbyteorder("<").str]] for p in parts], np.int64)
        return heads.tobytes() + b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)

    @classmethod
    def from_buffer(cls, data) -> Trie:
        n = 4 * len(cls.LEVELS) + 2
        heads = np.frombuffer(data, "<i8", 2 * n).reshape(n, 2)
        parts, at = [], 16 * n
        for size, kind in heads.tolist():
            dtype = ("<i8", "<u8", "<u2")[kind]
            parts.append(np.frombuffer(data, dtype, size // np.dtype(dtype).itemsize, at))
            at += size + -size % 8
        return cls(parts)

    def codes(self, context: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Codes of P(word | context); numbers from ``contexts.find`` and ``words.find``, ``lower``: the words' own codes."""
        held = context >= 0
        out = lower.astype(np.int64)
        out[held] += self.backoffs[context[held]].astype(np.int64)
        ask = np.flatnonzero(held & (word >= 0))
        if len(ask):
            own, which = np.unique(context[ask], return_inverse=True)
            begin = self.pointers.get(own).astype(np.int64)
            end = self.pointers.get(own + 1).astype(np.int64)
            base = np.where(begin > 0, self.successors.get(np.maximum(begin - 1, 0)) + U64(1), U64(0))
            target = base[which] + word[ask].astype(U64)
            at = self.successors.successor(target)
            hit = at < end[which]
            hit[hit] = self.successors.get(at[hit]) == target[hit]
            out[ask[hit]] = self.probabilities[at[hit]]
        return np.minimum(out, 65535)
