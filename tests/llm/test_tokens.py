"""Token counts, ids and SentencePiece against the libraries."""

import random

import numpy as np
import pytest
import sentencepiece
from odd_texts import ODD_TEXTS
from tokenizers import Tokenizer

from evalspark.llm import sp_stream, token_counts
from evalspark.llm.queries import tokenizer_path
from evalspark.llm.wordtok import ChunkTokenizer, Memory

WORD, PIECE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("piece_bpe_32k.model")


def texts():
    rng = random.Random(5)
    some = "abcdefgABC'sdvelm.,!? \n\t0123éÉßΣσ日क्षि😀́\x1c\x85\xa0<|>"
    wide = [(0, 0x2FFF), (0, 0xD7FF), (0xE000, 0x1FFFF)]
    return ([t or "" for t in ODD_TEXTS] + ["a<|endoftext|>b <|startoftext|><|endoftext|>", "  two  spaces\n\n x "]
            + ["".join(rng.choice(some) for _ in range(rng.randint(0, 50))) for _ in range(800)]
            + ["".join(chr(rng.randint(*rng.choice(wide))) for _ in range(15)) for _ in range(400)])


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def test_counts_and_ids_equal_the_library(library):
    fst, ids = token_counts.Transducer(WORD), ChunkTokenizer(WORD, limit=50)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert fst.total(fst.chunk_map(t)) == len(want), repr(t)
        assert np.frombuffer(ids.encode(t), "<u4").tolist() == want, repr(t)


def test_chunk_maps_compose_in_any_grouping():
    fst = token_counts.Transducer(WORD)
    rng = random.Random(1)
    for t in texts()[:300]:
        cuts = sorted(rng.randint(0, len(t)) for _ in range(4))
        a, b, c, d, e = (fst.chunk_map(t[i:j]) for i, j in zip([0, *cuts], [*cuts, len(t)]))
        whole = fst.total(fst.chunk_map(t))
        left = fst.compose(fst.compose(fst.compose(fst.compose(a, b), c), d), e)
        right = fst.compose(a, fst.compose(b, fst.compose(c, fst.compose(d, e))))
        assert left == right and fst.total(left) == whole
        assert [fst.total(m) for m in fst.prefix_maps([a, b, c, d, e])][-1] == whole


def test_transitions_count_every_prefix(library):
    """The annotations add up to the tokens of each prefix as a word of its own."""
    fst = token_counts.Transducer(WORD)
    for word in (b"retitioning", b"disgusting", b"aaaaaaaaaaaaaaaaaaaa", "éelleré".encode()):
        for n in range(1, len(word) + 1):
            t = word[:n].decode("utf-8", "ignore")
            if t:
                assert fst.word(t.encode()) == len(library.encode(t, add_special_tokens=False).ids)


def test_query_counts(spark, odd_docs, no_docs, library):
    for size in (token_counts.CHUNK_CHARS, 7):
        got = token_counts.count_tokens(odd_docs, WORD, limit=100, chunk_chars=size).collect()
        want = sorted((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids))
                      for r in odd_docs.collect())
        assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert token_counts.count_tokens(no_docs, WORD).count() == 0
    clash = odd_docs.withColumnRenamed("lang", "chunk").withColumnRenamed("source", "last")
    assert token_counts.count_tokens(clash, WORD).count() == odd_docs.count()


def test_sentencepiece_equals_the_library():
    sp, enc = sentencepiece.SentencePieceProcessor(model_file=PIECE), sp_stream.Encoder(PIECE, remembered=50)
    for t in texts():
        ids = np.frombuffer(enc.encode(t), "<i4").tolist()
        assert ids == sp.encode(t), repr(t)
        assert enc.decode(ids) == sp.decode(ids) == t.replace("▁", " ")


def test_stream_window_is_bounded_and_commits_early():
    sp, enc = sentencepiece.SentencePieceProcessor(model_file=PIECE), sp_stream.Encoder(PIECE)
    for text in ("ab" * 5000, "the quick brown fox " * 200, "a" * 3000, "日本" * 500):
        s, ids, widest = sp_stream.Stream(enc), [], 0
        for c in "▁" + text.replace(" ", "▁"):
            ids += s.push(c)
            widest = max(widest, len(s.text))
        assert len(ids) > 0.9 * len(sp.encode(text)) - 20  # most are out before the end
        assert ids + s.finish() == sp.encode(text) and widest <= 4 * enc.longest


def test_sentencepiece_frames(spark, odd_docs, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    back = sp_stream.decode(sp_stream.encode(odd_docs, PIECE), PIECE).collect()
    want = sorted((r["doc_id"], r["text"] or "") for r in odd_docs.collect())
    assert sorted((r["doc_id"], r["text"]) for r in back) == want
    assert all(list(r["ids"]) == sp.encode(r["text"]) for r in back)
    assert sp_stream.encode(no_docs, PIECE).count() == 0


def test_memory_stays_bounded():
    m = Memory(lambda k: len(k), limit=100, longest=8)
    for i in range(5000):
        assert m.all([f"k{i}", f"k{i + 1}", "x" * 50]) == [len(f"k{i}"), len(f"k{i + 1}"), 50]
        assert len(m.known) <= 103 and len(m.old) <= 103 and "x" * 50 not in m.known
