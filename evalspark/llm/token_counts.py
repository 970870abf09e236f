"""Token counts by a compiled finite-state transducer.

The byte-pair vocabulary is compiled into a deterministic transducer over the
bytes of a pre-tokenized word.  A state holds, for each token that may still be
under way, its place in the vocabulary's trie and the token before it; a
transition carries the change of the token count, so running a word and adding
up its annotations gives the count.  States are made when first reached and
kept per worker.  A word run from the start state to its end is itself one
transition (start to start), remembered by the word's text.

A text is cut into chunks anywhere.  A chunk's map says what it does to a word
that is still open when it begins: (text before the first break, tokens of the
words within, text after the last break).  Maps compose associatively, so the
counts of a long text come from a prefix scan over the maps of its chunks.

Defined results: a null text is empty and has no tokens; equal rows are counted
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.bpe import Merges
from evalspark.llm.common import worker_cache
from evalspark.llm.wordtok import Memory, Splitter

LIMIT = 2048
CHUNK_CHARS = 1 << 18
WORD_END = "</w>"
FINAL = 256  # symbols 256-511: the same bytes at a word's end


class Transducer:
    """Counts the tokens of words; ``word`` runs one, ``count`` a blank-free fragment of a text, remembered."""

    def __init__(self, path: str, remembered: int = 400_000, states: int = 1_000_000):
        self.split = Splitter(path)
        model, chars, byte_of = self.split.spec["model"], self.split.chars, self.split.byte_of

        def symbols(token):
            body, end = (token[:-len(WORD_END)], WORD_END) if token.endswith(WORD_END) else (token, "")
            return tuple(body[:-1]) + (body[-1] + end,)
        known = {t: i for t, i in model["vocab"].items() if t != WORD_END and all(c in byte_of for c in t.removesuffix(WORD_END))}
        ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.merges = Merges({i: symbols(t) for t, i in known.items()}, lambda a, b: ranks.get((a, b)))
        self.symbol = chars + [c + WORD_END for c in chars]
        self.limit = states
        self._reset()
        self.words = Memory(self.word, remembered)
        self.fragments = Memory(self._fragment, remembered)
        self.count = self.fragments.get

    def _reset(self):
        start = ((0, -1, 0),)
        self.states, self.number, self.next = [start], {start: 0}, {}

    def _step(self, state: int, symbol: int):
        """The transition from ``state`` on ``symbol``: (state, count change); state -1 after a word's last byte."""
        m, moved, found = self.merges, [], None
        for node, last, rel in self.states[state]:
            nxt = m.trie[node].get(self.symbol[symbol])
            if nxt is None:
                continue
            token = m.token_at[nxt]
            if found is None and token >= 0 and m.allowed(last, token):
                found = (token, rel + 1)
            if m.trie[nxt]:
                moved.append((nxt, last, rel))
        token, change = found
        if symbol >= FINAL:
            result = (-1, change)
        else:
            out = (*((node, last, rel - change) for node, last, rel in moved), (0, token, 0))
            if out not in self.number:
                self.number[out] = len(self.states)
                self.states.append(out)
            result = (self.number[out], change)
        self.next[state * 512 + symbol] = result
        return result

    def word(self, data: bytes) -> int:
        """Tokens of one pre-tokenized word."""
        if len(self.states) > self.limit:
            self._reset()
        state = total = 0
        get = self.next.get
        for b in data[:-1]:
            state, change = get(state * 512 + b) or self._step(state, b)
            total += change
        b = FINAL + data[-1]
        return total + (get(state * 512 + b) or self._step(state, b))[1]

    def _fragment(self, text: str) -> int:
        self.words.turn()
        return sum([1 if isinstance(p, int) else self.words.get(p) for p in self.split.pieces(text)])

    def chunk_map(self, text: str):
        """(text before the first break, tokens within, text after the last break), or (text,) if there is no break."""
        parts = text.replace("\n", " ").split(" ")
        if len(parts) == 1:
            return (text,)
        within = sum(self.fragments.all(parts[1:-1]))
        return (parts[0], within, parts[-1])

    def compose(self, a, b):
        """The map of a chunk followed by the next; associative."""
        if len(a) == 1:
            return (a[0] + b[0], *b[1:])
        if len(b) == 1:
            return (a[0], a[1], a[2] + b[0])
        return (a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2])

    def total(self, m) -> int:
        """The count of a whole text with this map: nothing is open before it or after it."""
        return self.count(m[0]) + (m[1] + self.count(m[2]) if len(m) > 1 else 0)

    def prefix_maps(self, maps):
        """The scan: the maps of all prefixes of a sequence of chunks."""
        return accumulate(maps, self.compose)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``; texts reach Python in chunks of bounded size."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("text"))
    last = F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / chunk_chars)
    chunks = F.when(F.length("text") <= chunk_chars, F.array("text")).otherwise(F.transform(
        F.sequence(F.lit(0).cast("long"), last),
        lambda k: F.substr("text", (k * chunk_chars + 1).cast("int"), F.lit(chunk_chars))))
    src = src.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), last.alias("last"),
                     F.posexplode(chunks).alias("k", "chunk"))

    def run(batches):
        fst = worker_cache(("transducer", tokenizer), lambda: Transducer(tokenizer))
        open_map = None
        for b in batches:
            ids, sizes, counts = [], [], []
            for doc_id, n_bytes, final, k, chunk in zip(*(c.to_pylist() for c in b.columns)):
                own = fst.chunk_map(chunk)
                open_map = own if k == 0 else fst.compose(open_map, own)
                if k == final:
                    ids.append(doc_id)
                    sizes.append(n_bytes)
                    counts.append(fst.total(open_map))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, sizes, counts)],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    return (src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
