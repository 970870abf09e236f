"""SentencePiece encoding and decoding by a streaming Viterbi search.

Each prefix of a text has one best last piece, found among the pieces that end
there from the best paths of shorter prefixes; a piece may follow another when
the model's merges leave the two as they are (see :mod:`evalspark.llm.bpe`), so
the path is exactly the model's encoding.  The search keeps only the starts
from which a piece may still be under way, at most the longest piece back, and
commits ids as soon as the paths from all of them share a boundary; the window
before that boundary is dropped.

No piece of the models handled here goes on into a blank after another
character, or holds a line feed, which is checked on loading.  All paths
therefore meet before each run of blanks and around each line feed, and the
ids of such a fragment are remembered (boundedly) by its text.

Defined results: a null or empty text has no ids; equal rows are encoded each;
an empty table gives no rows; characters that no piece holds become byte
pieces; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.bpe import Merges
from evalspark.llm.common import worker_cache
from evalspark.llm.wordtok import Memory

BLANK = "▁"


class Encoder:
    """Encoder and decoder of one SentencePiece model with byte fallback."""

    def __init__(self, path: str, remembered: int = 400_000):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = {i: sp.id_to_piece(i) for i in range(n)}
        self.byte_id, plain = {}, {}
        for i, p in pieces.items():
            if sp.is_byte(i):
                self.byte_id[int(p[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain[i] = p
        if any("\n" in p or re.search(f"[^{BLANK}]{BLANK}", p) for p in plain.values()) or len(self.byte_id) != 256:
            raise ValueError("this model has pieces across blanks or no byte pieces")
        rank = {p: -sp.get_score(i) for i, p in plain.items()}
        self.merges = Merges({i: tuple(p) for i, p in plain.items()}, lambda a, b: rank.get(a + b))
        self.longest = max(map(len, plain.values()))
        self.fragments = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
        self.known = Memory(self._fragment, remembered)
        self.raw = [p.replace(BLANK, " ").encode() if i in plain else bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else b""
                    for i, p in pieces.items()]

    def _fragment(self, text: str) -> bytes:
        s = Stream(self)
        return np.array(s.push(text) + s.finish(), dtype="<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian int32."""
        if not text:
            return b""
        parts = self.fragments.findall(BLANK + text.replace(" ", BLANK))
        return b"".join(self.known.all(parts))

    def decode(self, ids) -> str:
        """The text of ids: byte pieces joined to characters, the blank that encoding put first taken off."""
        return b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


class Stream:
    """Encodes text (blanks already as ``BLANK``) given piece by piece; ``push`` returns the ids that are settled."""

    def __init__(self, encoder: Encoder):
        self.e, self.m = encoder, encoder.merges
        self.text: list[str] = []      # characters after the last settled boundary
        self.path = [(-1, -1)]         # boundary -> (start of the piece that ends there, its id)
        self.first = -1                # the piece before the window
        self.active = [(0, 0)]         # (start, trie node) of the pieces under way

    def push(self, chars: str) -> list[int]:
        out: list[int] = []
        trie, token_at, allowed, wide = self.m.trie, self.m.token_at, self.m.allowed, 2 * self.e.longest
        for c in chars:
            moved, best, path = [], None, self.path
            for start, node in self.active:
                nxt = trie[node].get(c)
                if nxt is None:
                    continue
                if best is None:
                    piece = token_at[nxt]
                    if piece >= 0 and allowed(path[start][1] if start else self.first, piece):
                        best = (start, piece)
                if trie[nxt]:
                    moved.append((start, nxt))
            n = len(path)
            self.text.append(c)
            path.append(best or (n - 1, -2))  # a character of no piece stands alone
            moved.append((n, 0))
            self.active = moved
            if n >= wide or len(moved) == 1:
                out += self._settle()
        return out

    def _settle(self) -> list[int]:
        """Commit up to the last boundary that the paths from all active starts share."""
        ends = {start for start, _ in self.active}
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(self.path[last][0])
        return self._commit(ends.pop())

    def _commit(self, cut: int) -> list[int]:
        if cut <= 0:
            return []
        ids: list[int] = []
        at = cut
        while at > 0:
            start, piece = self.path[at]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.e.byte_id[b] for b in reversed(self.text[start].encode())]
            at = start
        self.first = self.path[cut][1]
        self.text = self.text[cut:]
        self.path = [(-1, -1)] + [(s - cut, p) for s, p in self.path[cut + 1:]]
        self.active = [(s - cut, node) for s, node in self.active]
        return ids[::-1]

    def finish(self) -> list[int]:
        return self._commit(len(self.text))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids): the piece ids of each row's whole text."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        enc = worker_cache(("sentencepiece", model), lambda: Encoder(model))
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo in range(0, len(ids), 256):
                packed = [enc.encode(t.as_py() or "") for t in texts[lo:lo + 256]]
                ends = np.cumsum([0] + [len(p) // 4 for p in packed], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
                yield pa.RecordBatch.from_arrays([ids[lo:lo + 256], pa.ListArray.from_arrays(pa.array(ends), values)],
                                                 names=["doc_id", "ids"])

    return src.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the text that the ids stand for."""

    def run(batches):
        enc = worker_cache(("sentencepiece", model), lambda: Encoder(model))
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                texts = [enc.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                                 names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
