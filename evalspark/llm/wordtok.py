"""Splitting texts for the byte-level tokenizer with white space dropped, and token ids word by word.

Such a tokenizer (NFC, blanks to one space, lower case, then a pattern that
never matches a blank) gives each blank-free chunk the same ids in any text.
A worker therefore splits and encodes each distinct chunk once and joins what
it remembers.  The memory is bounded: two generations of at most ``limit``
chunks each (and those of one text); chunks still in use move to the new one.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

#: White space as the tokenizer's normalizer sees it.
BLANKS = "\t-\r \x85\xa0  -     　"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + extra)
            extra += 1
    return [chars[b] for b in range(256)]


class Memory:
    """``make(key)`` for a bounded number of keys; ``known`` is the new generation."""

    def __init__(self, make, limit: int, longest: int = 64):
        self.make, self.limit, self.longest = make, limit, longest
        self.known, self.old = {}, {}

    def turn(self) -> None:
        if len(self.known) >= self.limit:
            self.known, self.old = {}, self.known

    def get(self, key):
        got = self.known.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.make(key)
            if len(key) <= self.longest:
                self.known[key] = got
        return got

    def all(self, keys: list) -> list:
        """The values of all keys."""
        try:
            return [self.known[k] for k in keys]
        except KeyError:
            self.turn()
            get = self.get
            return [get(k) for k in keys]


class Splitter:
    """Normalizes and splits a chunk as the tokenizer file says: special tokens, and words as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.spec = json.loads(self.library.to_str())
        steps = self.spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(p["pattern"]["Regex"] for p in steps if p["type"] == "Split")
        if [n["type"] for n in self.spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this tokenizer normalizes otherwise")
        self.find = regex.compile(pattern.replace(r"\s", BLANKS)).findall
        self.special_ids = {a["content"]: a["id"] for a in self.spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, self.special_ids)) or r"(?!)")
        self.chars = byte_chars()
        self.byte_of = {c: i for i, c in enumerate(self.chars)}

    def words(self, text: str) -> list[bytes]:
        """Characters beyond the Latin blocks go by the library, whose Unicode version may differ."""
        if text.isascii():
            return [w.encode() for w in self.find(text.lower())]
        if max(text) <= "ɏ":
            return [w.encode() for w in self.find(unicodedata.normalize("NFC", text).lower())]
        plain = self.library.normalizer.normalize_str(text)
        return [bytes([self.byte_of[c] for c in w]) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def pieces(self, text: str) -> list:
        """Words as bytes and special tokens as ids, in order."""
        if "<|" not in text:
            return self.words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            if m.start() > at:
                out += self.words(text[at:m.start()])
            out.append(self.special_ids[m[0]])
            at = m.end()
        return out + (self.words(text[at:]) if at < len(text) else [])


class ChunkTokenizer:
    """``encode(text)``: ids as packed little-endian uint32, equal to the library's without added special tokens."""

    def __init__(self, path: str, limit: int = 300_000):
        self.split = Splitter(path)
        self.words = Memory(self._word, limit)
        self.chunks = Memory(self._chunk, limit)

    def _word(self, word: bytes) -> bytes:
        chars = self.split.chars
        text = word.decode("ascii") if word.isascii() and word.isalnum() else "".join([chars[b] for b in word])
        return b"".join([t.id.to_bytes(4, "little") for t in self.split.library.model.tokenize(text)])

    def _chunk(self, chunk: str) -> bytes:
        self.words.turn()
        pieces = self.split.pieces(chunk)
        if len(pieces) == 1 and not isinstance(pieces[0], int):  # remembered as a chunk, not as a word besides
            return self.words.known.get(pieces[0]) or self._word(pieces[0])
        return b"".join([p.to_bytes(4, "little") if isinstance(p, int) else self.words.get(p) for p in pieces])

    def encode(self, text: str) -> bytes:
        return b"".join(self.chunks.all(text.replace("\n", " ").split(" ")))
