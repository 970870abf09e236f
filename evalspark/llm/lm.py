"""Language-model scores of documents: a bigram model in Elias-Fano tries, spread over shards by context.

Tokens are the words of a lower-cased (A-Z) text and one end.  With c the counts in the training
documents, N their sum and V the number of distinct tokens,

    P(w)     = (c(w) + 1) / (N + V + 1)
    P(w | v) = (c(v w) + m P(w)) / (c(v) + m),   m = c(v) ^ growth

which sums to one over all words and the unknown one.  m stands for the number of distinct words after v
(Witten and Bell); ``growth`` is the exponent by which the number of successors grows with the count of
a context, measured over all training texts.  A context without count leaves P(w).

The work goes by blocks (documents of about ``BLOCK`` tokens) and shards:

1. Each task makes blocks: a sorted dictionary of word hashes and the texts as places in it.  Blocks are
   dealt out once, by block, and persisted.
2. Each block sends every shard the words that it holds with their training counts, once, and gets
   the counts over all blocks back: base scores are known.
3. Each block sends every shard its distinct word pairs with training counts, the count of the context and the code
   of P(w).  A shard builds a trie of the pairs that training texts hold and answers each pair of each block
   from it with the code of its probability.
4. Each block adds up its documents' codes.

So what is dealt out is one entry per distinct word or pair of a block, whatever texts
repeat, and answers are codes of two bytes.  Shards are as many as the tokens need.  A context that
holds more than a shard's share of the tokens is dealt over as many shards as it fills, by the word that
follows: P(w | v) needs c(v), which step 2 gave, and c(v w), which is whole in one shard.  The driver sees
five numbers (tokens, N, V and two sums for ``growth``).

Words are known by hashes of 64 bits.  Probabilities and back-off weights are rounded to 1 / ``UNIT`` of a power of ten.

Defined results: a null or empty text is the end alone; repeated rows are scored, and learned from, as often as they
come; a null id counts as the empty text in the choice of training documents; an empty table, or one without training
documents, scores by P(w) alone (N and V 0).  A block holds whole documents, so one very long text is a block of its own (about 40
bytes a token).  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import mix64, staged
from evalspark.llm.elias_fano import Trie

#: Training leaves out the documents whose hash has this remainder.
FOLDS, HELD_OUT = 7, 2
BLOCK, SHARD = 2_000_000, 4_000_000
UNIT = 1024
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: White space can't be a word: keys of the end of a text and of the context before its first word.
END, BEGIN = (np.uint64(xxhash.xxh64_intdigest(b)) for b in (b"\n", b" "))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


# ------------------------------------------------------------------ packing
def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers, each in the narrowest type that holds it, compressed."""
    out = []
    for a in arrays:
        wide = np.min_scalar_type(int(a.max())) if len(a) else np.dtype("u1")
        out += [np.array([wide.itemsize, len(a)], "<i8").tobytes(), a.astype(wide.newbyteorder("<")).view("u1").reshape(-1, wide.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    data, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    while at < len(data):
        size, n = np.frombuffer(data, "<i8", 2, at).tolist()
        planes = np.frombuffer(data, "u1", size * n, at + 16).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").ravel())
        at += 16 + size * n
    return out


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Monotone in the key, so that a sorted dictionary falls into runs by shard."""
    return ((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


# ------------------------------------------------------------------- blocks
def _blocks(id_type: pa.DataType):
    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, train, seen, texts, size = [], [], {}, [], 0

        def closed():
            nonlocal made, size
            words = list(seen)
            keys = np.array([xxhash.xxh64_intdigest(w) for w in words] + [int(END)], np.uint64)
            order = np.argsort(keys, kind="stable")
            place = np.empty(len(keys), np.int64)
            place[order] = np.arange(len(keys))
            lengths = np.array([len(t) + 1 for t in texts])
            tokens = np.full(lengths.sum(), len(words), np.int64)
            inner = np.ones(len(tokens), bool)
            inner[np.cumsum(lengths) - 1] = False
            tokens[inner] = np.concatenate(texts)
            row = pa.RecordBatch.from_arrays(
                [pa.array([(part << 33) + made], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([train], pa.list_(pa.bool_())),
                 pa.array([len(tokens)], pa.int64()), pa.array([pack(keys[order], place[tokens], lengths)], pa.binary())],
                names=["block", "doc_ids", "train", "n_tokens", "data"])
            made, size = made + 1, 0
            for held in (ids, train, texts, seen):
                held.clear()
            return row

        for b in batches:
            for doc_id, learn, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
                own = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))
                ids.append(doc_id)
                train.append(learn)
                texts.append(own)
                size += len(own) + 1
                if size >= BLOCK:
                    yield closed()
        if texts:
            yield closed()
    return run


class Block:
    """A block's texts: word keys in order, tokens as places among them, and the pairs of neighbours."""

    def __init__(self, row: dict):
        self.keys, tokens, lengths = unpack(row["data"])
        self.tokens, self.lengths = tokens.astype(np.int64), lengths.astype(np.int64)
        self.train = np.array(row["train"], bool)
        self.learned = np.repeat(self.train, self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def counts(self) -> np.ndarray:
        """Training count per word."""
        return np.bincount(self.tokens[self.learned], minlength=len(self.keys))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs as context * (words + 1) + word, each token's pair, and the pairs' training counts.

        The context before a text's first word has the number after the last word's.
        """
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = len(self.keys)
        pairs, which = np.unique(before * (len(self.keys) + 1) + self.tokens, return_inverse=True)
        return pairs, which, np.bincount(which[self.learned], minlength=len(pairs))

    def contexts(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return pairs // (len(self.keys) + 1), pairs % (len(self.keys) + 1)


def _runs(shard: np.ndarray):
    """(shard, first, end) of each run of a sorted array."""
    cuts = np.flatnonzero(np.diff(shard)) + 1
    bounds = np.concatenate([[0], cuts, [len(shard)]]) if len(shard) else [0]
    return [(int(shard[a]), a, b) for a, b in zip(bounds[:-1], bounds[1:])]


# -------------------------------------------------------------- words' counts
def _ask_words(shards: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block(row)
                pairs, _, n = block.pairs()
                context = block.contexts(pairs)[0][n > 0]
                starts = np.flatnonzero(np.diff(context, prepend=-1))
                types = np.log(np.diff(np.append(starts, len(context))))
                c = np.log(np.add.reduceat(n[n > 0], starts)) if len(starts) else np.zeros(0)
                grown = [float((c * types).sum()), float((c * c).sum())]
                counts = block.counts()
                out = [(shard, row["block"], pack(block.keys[a:z], counts[a:z]), *grown) for shard, a, z in _runs(shard_of(block.keys, shards))]
                for i in range(1, len(out)):  # a block's sums go with its first run only
                    out[i] = (*out[i][:3], 0.0, 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["shard", "block", "data", "grown", "of"])
    return run


def _count_words(table: pa.Table) -> pa.Table:
    asked = [unpack(d) for d in table["data"].to_pylist()]
    keys, which = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, which, np.concatenate([n for _, n in asked]).astype(np.int64))
    ends = np.cumsum([len(k) for k, _ in asked])
    answers = [pack(counts[which[e - len(k):e]]) for e, (k, _) in zip(ends, asked)]
    first = np.arange(len(answers)) == 0
    return pa.table({"block": table["block"], "shard": table["shard"], "data": answers, "types": first * int((counts > 0).sum()),
                     "tokens": first * int(counts.sum()), "grown": table["grown"], "of": table["of"]})


# --------------------------------------------------------------- pairs' codes
class Model:
    """The model's numbers: training tokens and types, growth, and how pairs are dealt to shards."""

    def __init__(self, tokens: int, types: int, growth: float, shards: int):
        self.tokens, self.types, self.growth, self.shards = tokens, types, growth, shards

    def log_unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.tokens + (self.types + 1)))

    def smoothing(self, context_counts: np.ndarray) -> np.ndarray:
        return np.maximum(context_counts, 1).astype(float) ** self.growth

    def shard(self, context: np.ndarray, count: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Shard per pair: by context, and by word too for contexts of more than a shard's share."""
        filled = (1 + count * self.shards // max(self.tokens, 1)).astype(np.uint64)
        return shard_of(mix64(context + mix64(word) % filled), self.shards).astype(np.int64)


def code(log10: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-log10 * UNIT), 65535).astype(np.int64)


def _dealt(block: Block, counts: np.ndarray, model: Model):
    """The block's pairs, each token's pair, and the order of pairs by shard, context and word with the shards."""
    pairs, which, n = block.pairs()
    context, word = block.contexts(pairs)
    keys = np.append(block.keys, BEGIN)
    held = np.append(counts, counts[np.searchsorted(block.keys, END)])  # texts begin as often as they end
    shard = model.shard(keys[context], held[context], keys[word])
    order = np.argsort(shard, kind="stable")
    return which, n, context, word, keys, held, shard[order], order


def _answers(table: pa.Table) -> np.ndarray:
    rows = sorted(zip(table["shard"].to_pylist(), table["data"].to_pylist()))
    return np.concatenate([unpack(d)[0] for _, d in rows]).astype(np.int64)


def _ask_pairs(model: Model):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.to_pylist()[0])
        counts = _answers(right)
        _, n, context, word, keys, held, shard, order = _dealt(block, counts, model)
        unigram = code(model.log_unigram(counts))
        out = []
        for s, a, z in _runs(shard):
            rows = order[a:z]
            own, first = np.unique(context[rows], return_index=True)
            words, place = np.unique(word[rows], return_inverse=True)
            out.append((s, left["block"][0].as_py(), pack(keys[own], held[own], np.diff(np.append(first, len(rows))), keys[words], unigram[words], place, n[rows])))
        return pa.table([pa.array(x) for x in zip(*out)], names=["shard", "block", "data"])
    return run


def build_trie(asked: list, model: Model) -> bytes:
    """The trie of all pairs with training counts among ``asked`` (contexts, counts, sizes, words, codes, places, n)."""
    contexts, first = np.unique(np.concatenate([a[0] for a in asked]), return_index=True)
    context_counts = np.concatenate([a[1] for a in asked])[first].astype(np.int64)
    words, first = np.unique(np.concatenate([a[3] for a in asked]), return_index=True)
    lower = np.concatenate([a[4] for a in asked])[first].astype(np.int64)
    keys, seen = [], []
    for own, _, sizes, vocabulary, _, place, n in asked:
        c = np.repeat(np.searchsorted(contexts, own), sizes.astype(np.int64))
        w = np.searchsorted(words, vocabulary)[place]
        keys.append((c * len(words) + w)[n > 0])
        seen.append(n[n > 0].astype(np.int64))
    pairs, which = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(which, np.concatenate(seen), len(pairs))
    pairs = np.stack([pairs // max(len(words), 1), pairs % max(len(words), 1)], 1)
    m = model.smoothing(context_counts)
    own = pairs[:, 0]
    p = (n + m[own] * 10.0 ** (-lower[pairs[:, 1]] / UNIT)) / (context_counts[own] + m[own])
    backoff = np.where(context_counts > 0, m / (context_counts + m), 1.0)
    return Trie.build(contexts, code(np.log10(backoff)), words, pairs, code(np.log10(p)))


def _answer_pairs(model: Model):
    def run(table: pa.Table) -> pa.Table:
        asked = [unpack(d) for d in table["data"].to_pylist()]
        trie = Trie.from_buffer(build_trie(asked, model))
        answers = []
        for own, _, sizes, vocabulary, lower, place, _ in asked:
            context = np.repeat(trie.contexts.find(own), sizes.astype(np.int64))
            answers.append(pack(trie.codes(context, trie.words.find(vocabulary)[place], lower[place])))
        return pa.table({"block": table["block"], "shard": table["shard"], "data": answers})
    return run


def _scores(model: Model):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.to_pylist()[0])
        level = np.array(right["level"].to_pylist())
        counts = _answers(right.filter(pa.array(level == 1)))
        which, *_, order = _dealt(block, counts, model)
        codes = np.empty(len(order), np.int64)
        codes[order] = _answers(right.filter(pa.array(level == 2)))

        def per_text(values):
            return np.add.reduceat(values, block.starts)

        n = len(block.lengths)
        return pa.table({"doc_id": left["doc_ids"].combine_chunks().flatten(), "held_out": ~block.train, "n_tokens": block.lengths,
                         "n_known": per_text((counts > 0)[block.tokens].astype(np.int64)), "train_tokens": np.full(n, model.tokens),
                         "base_score": per_text(model.log_unigram(counts)[block.tokens]), "score": per_text(codes[which]) / -UNIT})
    return run


# -------------------------------------------------------------------- driver
def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", growth: float | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (~held_out(F.col(f"`{doc_id}`"))).alias("train"), F.col(f"`{text}`").alias("text"))
    id_type = source.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("train", T.ArrayType(T.BooleanType())),
                           T.StructField("n_tokens", T.LongType()), T.StructField("data", T.BinaryType())])
    arrow_id = pa.string() if isinstance(id_type, T.StringType) else {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32()}[id_type.simpleString()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = source.mapInArrow(_blocks(arrow_id), schema).repartition(parts, "block").persist(StorageLevel.MEMORY_AND_DISK)
    out_schema = T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string(
        "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    tokens = blocks.agg(F.sum("n_tokens")).first()[0]
    if not tokens:
        blocks.unpersist()
        return spark.createDataFrame([], out_schema)
    shards = max(parts, -(-tokens // SHARD))
    asked = blocks.mapInArrow(_ask_words(shards), "shard long, block long, data binary, grown double, of double")
    words = staged(asked.groupBy("shard").applyInArrow(
        _count_words, "block long, shard long, data binary, types long, tokens long, grown double, of double"), "lm-words")
    total = words.agg(*[F.sum(c).alias(c) for c in ("tokens", "types", "grown", "of")]).first()
    if growth is None:
        growth = round(total["grown"] / total["of"], 3) if total["of"] else 1.0
    model = Model(total["tokens"], total["types"], growth, shards)
    counts = words.select("block", "shard", "data")
    pairs = blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_ask_pairs(model), "shard long, block long, data binary")
    codes = pairs.groupBy("shard").applyInArrow(_answer_pairs(model), "block long, shard long, data binary")
    answers = counts.withColumn("level", F.lit(1)).unionByName(codes.withColumn("level", F.lit(2)))
    scored = staged(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(model), out_schema), "lm-scores")
    blocks.unpersist()
    return scored
