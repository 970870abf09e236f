"""Size-aware heavy-light join of word shingle sets on their Jaccard similarity.

A document's set holds the hashes of its distinct five-word shingles; documents
with equal sets are one node.  Sets of up to ``boundary`` shingles are light:
for each pair of sizes (a, b) that can be similar, both enumerate their subsets
of the least sufficient overlap c(a, b), and a subset that sets of both sizes
share *is* a link.
Larger sets are heavy: they go through inverted lists.  Only the first shingles
of a set, by a corpus-wide order with frequent shingles last, need listing for
similar sets to meet; lists of one set are dropped, and what is left is tested
on whole sets.  The boundary is the one of least cost for the sizes at hand.

Links are found for components, so sets that are already connected are not
compared again: first each listed set is tested against the most typical set
of its lists that it meets most often (typical: fewest of its listed shingles
are its own alone; of a group of near copies, the one that they were made
from); then all pairs of sets that meet in a list but
lie in different components, unless the place of their shingle is too far on
in either order for what follows to suffice: similar sets meet at the first
shingle that they share, where it does.  That loses no link between components.  Before whole sets are
fetched, sketches (counts of a set's shingles per cell) tell how much two sets can share at most.

Skew: copies collapse into nodes; light subsets and lists of the frequent
shingles are dealt by node, and their least nodes are found by aggregates that
combine before the shuffle.  Only the ``HOT`` most frequent shingles and one row of sizes
reach the driver; they order the lists and set the boundary, the result does
not depend on them.

Words are hashed to 64 bits, those over ``LONG_WORD`` bytes by a hash without known collisions.  A text over
``BATCH_BYTES`` is hashed in slices, so that a long text takes about 10 bytes a byte at once.

Defined results: a null, empty or blank text has an empty set and is alone; with
fewer than five words the whole sequence is the one shingle; equal rows are
copies; a component's id is its smallest non-null doc_id.
"""

from __future__ import annotations

import hashlib
import re
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import mix64, staged, worker_cache
from evalspark.llm.components import components

WORDS = 5
HOT = 200_000           # frequent shingles whose order is kept; the rest are ordered by hash
VERIFY_COST = 8         # of a listed shingle and the tests it leads to, against one light subset
MAX_BOUNDARY = 12
BATCH_BYTES = 1 << 20
LONG_WORD = 64
FLUSH = 1 << 21         # listed shingles that a task holds at a time
PER_BUCKET = 1 << 20    # listed shingles in a reducer's bucket, about
CELLS, FULL = 256, 255  # of a set's sketch
PLACES = 64             # steps in which a shingle's place is kept; sets of up to 2**25 shingles
TOKEN, HOT_TOKEN, SUBSET = range(3)

_CODE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BLANKS = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.random.default_rng(12).integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each UTF-8 text."""
    out: list[np.ndarray] = []
    held, size = [], 0
    for t in texts:
        if len(t) > BATCH_BYTES:
            out += _sets(held) if held else []
            out.append(_shingles(np.concatenate(list(_long_text_words(t)))))
            held, size = [], 0
            continue
        held.append(t)
        size += len(t)
        if size >= BATCH_BYTES:
            out += _sets(held)
            held, size = [], 0
    return out + (_sets(held) if held else [])


def _long_text_words(text: bytes):
    """The word hashes of a long text, in slices of about ``BATCH_BYTES`` that end at blanks; a longer word by itself."""
    at = 0
    while at < len(text):
        blank = _BLANKS.search(text, at + BATCH_BYTES)
        end = blank.start() if blank else len(text)
        first = at
        if end - at > 2 * BATCH_BYTES:
            first = at + 1 + max(text[at:at + BATCH_BYTES].rfind(c) for c in b" \t\n\v\f\r")
            yield _words([text[at:first]])[0]
            yield np.array([_long_word(text[first:end].translate(_LOWER.tobytes()))], np.uint64)
        else:
            yield _words([text[at:end]])[0]
        at = end + 1


def _long_word(word: bytes) -> int:
    """A hash without known collisions; a polynomial modulo 2**64 has them for long words."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words in order, and the number of the first word of each text (and of the end)."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    blank = _BLANK[data]
    edge = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
    word = mix64((prefix[end] - prefix[start]) * _powers(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        word[i] = _long_word(data[start[i]:end[i]].tobytes())
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return word, np.searchsorted(start, begins)


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    word, first = _words(texts)
    return [_shingles(word[lo:hi]) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist())]


def _shingles(word: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's words."""
    n = len(word)
    if not n:
        return np.zeros(0, np.uint64)
    if n < WORDS:
        return mix64(np.array([(word * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    shingle = word[:n - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        shingle += word[k:n - WORDS + 1 + k] * _PLACE[k]
    return np.unique(mix64(shingle))


def node_of(shingles: np.ndarray) -> int:
    """The id of a set: a signed 64-bit hash of its elements and size."""
    if not len(shingles):
        return 0
    total = mix64(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


def sketch_of(shingles: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each of ``CELLS`` cells, up to ``FULL``."""
    return np.minimum(np.bincount((shingles >> np.uint64(40)) % np.uint64(CELLS), minlength=CELLS), FULL).astype(np.uint8).tobytes()


def most_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row of two arrays of sketches the most that the sets can share; without bound where a cell is full in both."""
    both = np.minimum(a, b)
    return np.where((both == FULL).any(1), 1 << 60, both.sum(1, dtype=np.int64))


def enough(a: int, b: int) -> int:
    """The least overlap of sets of sizes a and b that makes them similar: 175 o >= 75 (a + b)."""
    return -(-3 * (a + b) // 7)


def listed(n):
    """How many of a set's n shingles go into the lists."""
    return n - (3 * n + 3) // 4 + 1


def partner_sizes(n: int, boundary: int) -> list[int]:
    return [b for b in range(1, boundary + 1) if 4 * min(n, b) >= 3 * max(n, b)]


def least_listed(boundary: int) -> int:
    """From this size on a set goes into the lists: it may be similar to a heavy one."""
    return -(-3 * (boundary + 1) // 4)


def choose_boundary(sizes: dict[int, int]) -> int:
    """The boundary of least cost: subsets of light sets against listed shingles and the tests they cost."""
    def cost(x):
        light = sum(k * sum(comb(n, enough(n, b)) for b in partner_sizes(n, x)) for n, k in sizes.items() if n <= x)
        heavy = sum(k * listed(n) * VERIFY_COST for n, k in sizes.items() if n >= least_listed(x))
        return light + heavy
    return min(range(1, MAX_BOUNDARY + 1), key=cost)


def _chosen(n: int, c: int, cache: dict) -> np.ndarray:
    if (n, c) not in cache:
        cache[n, c] = np.array(list(combinations(range(n), c)), dtype=np.int64).reshape(-1, c)
    return cache[n, c]


def light_subsets(shingles: np.ndarray, boundary: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """(key, side) of each subset that may link two light sets.

    A key stands for one subset and one pair of sizes; side is the set's own
    size, or 0 where both sizes of the pair are the same.
    """
    n, m = len(shingles), mix64(shingles)
    keys, sides = [], []
    for b in partner_sizes(n, boundary):
        c = enough(n, b)
        if c <= min(n, b):
            salt = np.uint64(min(n, b) * 1000 + max(n, b))
            keys.append(mix64(m[_chosen(n, c, cache)].sum(1, dtype=np.uint64) + salt))
            sides.append(np.full(len(keys[-1]), 0 if b == n else n, np.int32))
    return np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int32), *sides])


def _text_bytes(column) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in column]


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows of two kinds, at rest: (doc_id, node, n, null, sketch) per document; (shingle, null, null, k, null) for
    shingles that occur in k > 2 different sets of one stretch of a task."""

    def run(batches):
        worker_cache("jaccard", dict)  # lets go of what an earlier job kept
        seen, parts, held = set(), [], 0

        def frequent():
            h, k = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64),) * 2
            h, k = h[k > 2], k[k > 2]
            none = pa.nulls(len(h), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), none, none, pa.array(k, pa.int64()), pa.nulls(len(h), pa.binary())],
                                              names=["id", "node", "n", "k", "sketch"])
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.slice(lo, 1000)
                sets = shingle_sets(_text_bytes(part.column(1)))
                nodes = [node_of(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.nulls(len(sets), pa.int64()), pa.array([sketch_of(s) for s in sets], pa.binary())], names=["id", "node", "n", "k", "sketch"])
                for node, s in zip(nodes, sets):
                    if node not in seen:
                        seen.add(node)
                        parts.append(s)
                        held += len(s)
                if held >= FLUSH:
                    yield frequent()
                    seen, parts, held = set(), [], 0
        yield frequent()

    return staged(_source(docs).mapInArrow(run, "id long, node long, n long, k long, sketch binary"), "numbered")


def _entries(docs: DataFrame, hot: np.ndarray, hot_rank: np.ndarray, boundary: int, buckets: int) -> DataFrame:
    """(kind, a, b, n): shingles with the sets that list them (only where at least two do; kind TOKEN, n the set's
    size times PLACES plus the shingle's place among the listed ones in PLACES steps), and light subsets with the sets that have them (kind SUBSET, n the side)."""

    def dealt(batches):
        worker_cache("jaccard", dict)
        cache: dict = {}
        done: set = set()
        tokens, nodes, sizes, subsets, sides, owners = [], [], [], [], [], []
        held = 0

        def flush():
            token = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            node = np.repeat(np.array(nodes, np.int64), [len(t) for t in tokens])
            each = np.array([len(t) for t in tokens], np.int64)
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            n = (np.repeat(np.array(sizes, np.int64), each) * PLACES + at * PLACES // np.repeat(each, each)).astype(np.int32)
            frequent = _is_in(token, hot)
            key = np.concatenate([np.zeros(0, np.uint64), *subsets])
            side = np.concatenate([np.zeros(0, np.int32), *sides])
            owner = np.repeat(np.array(owners, np.int64), [len(x) for x in subsets])
            for kind, a, b, size, deal in (
                    (TOKEN, token[~frequent].view(np.int64), node[~frequent], n[~frequent], token[~frequent]),
                    (HOT_TOKEN, token[frequent].view(np.int64), node[frequent], n[frequent], node[frequent].view(np.uint64)),
                    (SUBSET, key.view(np.int64), owner, side, owner.view(np.uint64))):
                if len(a):
                    to = (mix64(deal) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(to, kind="stable")
                    to, a, b, size = to[order], a[order], b[order], size[order]
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
                    rows = [(int(to[i]), kind, a[i:j].tobytes(), b[i:j].tobytes(), size[i:j].tobytes())
                            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
                    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                     names=["bucket", "kind", "a", "b", "n"])

        for batch in batches:
            for lo in range(0, len(batch), 1000):
                for s in shingle_sets(_text_bytes(batch.column(0).slice(lo, 1000))):
                    if not len(s) or (node := node_of(s)) in done:
                        continue
                    done.add(node)
                    if len(s) <= boundary:
                        for part, value in zip((subsets, sides), light_subsets(s, boundary, cache)):
                            part.append(value)
                        owners.append(node)
                    if len(s) >= least_listed(boundary):
                        tokens.append(_first(s, hot, hot_rank))
                        nodes.append(node)
                        sizes.append(len(s))
                        held += len(tokens[-1])
                if held >= FLUSH:
                    yield from flush()
                    done, tokens, nodes, sizes, subsets, sides, owners, held = set(), [], [], [], [], [], [], 0
        yield from flush()

    def met(_, table):
        out = []
        for kind in range(3):
            rows = table.filter(pa.compute.equal(table.column("kind"), kind))
            if not len(rows):
                continue
            a, b, n = (np.concatenate([np.frombuffer(x.as_py(), t) for x in rows.column(c)])
                       for c, t in (("a", np.int64), ("b", np.int64), ("n", np.int32)))
            order = np.lexsort((b, a))
            a, b, n = a[order], b[order], n[order]
            keep = np.ones(len(a), bool)
            keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b, n = a[keep], b[keep], n[keep]
            same = np.concatenate([[False], a[1:] == a[:-1]])
            if kind == TOKEN:  # lists of one set meet nobody
                shared = same | np.concatenate([same[1:], [False]])
                a, b, n = a[shared], b[shared], n[shared]
            out.append(pa.table({"kind": pa.array(np.full(len(a), SUBSET if kind == SUBSET else TOKEN, np.int32)),
                                 "a": pa.array(a), "b": pa.array(b), "n": pa.array(n)}))
        return pa.concat_tables(out)

    packed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        dealt, "bucket int, kind int, a binary, b binary, n binary")
    return staged(packed.groupBy("bucket").applyInArrow(met, "kind int, a long, b long, n int"), "entries")


def _light_links(subsets: DataFrame) -> DataFrame:
    """Links (a, b) of (key, node, side): each node to the least node of the other side, or of its own where there is one side."""
    ends = subsets.groupBy("key").agg(F.min(F.struct("side", "node")).alias("lo"),
                                      F.min(F.struct((-F.col("side")).alias("side"), "node")).alias("hi"))
    ends = ends.where("lo.side = 0 or lo.side <> -hi.side")
    hub = F.when((F.col("side") == F.col("lo.side")) & (F.col("side") > 0), F.col("hi.node")).otherwise(F.col("lo.node"))
    return subsets.join(ends, "key").select(hub.alias("a"), F.col("node").alias("b")).where("a <> b")


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _first(shingles: np.ndarray, hot: np.ndarray, hot_rank: np.ndarray) -> np.ndarray:
    """The listed shingles of a set: by hash, frequent ones after all others, the most frequent last."""
    p = listed(len(shingles))
    frequent = _is_in(shingles, hot)
    rare = shingles[~frequent]
    if len(rare) >= p:
        return rare[:p]
    rest = shingles[frequent]
    rest = rest[np.argsort(hot_rank[np.searchsorted(hot, rest)])]
    return np.concatenate([rare, rest[:p - len(rare)]])


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes, each pair once) whose whole sets are similar, at rest."""
    def possible(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(len(batch), CELLS) for i in (4, 5))
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            ok = pa.array(7 * most_shared(x, y) >= 3 * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    end = lambda node, n, sketch: classes.select(F.col("node").alias(node), F.col("n").alias(n), F.col("sketch").alias(sketch))
    pairs = pairs.select("a", "b").join(end("a", "n", "x"), "a").join(end("b", "m", "y"), "b")
    pairs = staged(pairs.select("a", "b", "n", "m", "x", "y").mapInArrow(possible, "a long, b long"), "pairs")
    if pairs.isEmpty():
        return pairs
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = staged(classes.join(nodes, "node", "left_semi").select("doc_id", F.when(F.col("doc_id").isNull(), F.col("node")).alias("node")), "wanted")
    few = wanted.count() <= broadcast_rows  # one number a row
    ids, no_id = wanted.where("doc_id is not null").select("doc_id"), wanted.where("doc_id is null").select("node")
    texts = _source(docs).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def sets(batches):
        worker_cache("jaccard", dict)
        for b in batches:
            for lo in range(0, len(b), 500):
                own = shingle_sets(_text_bytes(b.column(1).slice(lo, 500)))
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in own], pa.int64()),
                                                  pa.array([s.tobytes() for s in own], pa.binary())], names=["node", "s"])

    found = texts.mapInArrow(sets, "node long, s binary")
    if not no_id.isEmpty():  # sets that only rows without id hold are known by their node
        found = found.unionByName(_source(docs).where("doc_id is null").mapInArrow(sets, "node long, s binary")
                                  .join(F.broadcast(no_id) if few else no_id, "node", "left_semi"))
    # equal doc_ids may bring copies along: keep one row a node
    whole = staged(found, "sets").dropDuplicates(["node"])

    def similar(batches):
        for b in batches:
            a, c, x, y = (b.column(i) for i in range(4))
            ok = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                o = int((both[1:] == both[:-1]).sum())
                ok.append(100 * o >= 75 * (len(p) + len(q) - o))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(ok), c.filter(ok)], names=["a", "b"])

    joined = (pairs.join(whole.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
              .join(whole.select(F.col("node").alias("a"), F.col("s").alias("x")), "a"))
    return staged(joined.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long"), "links")


def similar_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text)."""
    return _components_by_node(docs).select("doc_id", "n_shingles", "component_id")


def _components_by_node(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, node, part): the last two are the row's set and the node that names its component."""
    numbered = _numbered(docs)
    known = numbered.where("node is not null").select(F.col("id").alias("doc_id"), "node", "n", "sketch")
    rows = known.drop("sketch")
    hot_rows = (numbered.where("node is null").groupBy("id").agg(F.sum("k").alias("k"))
                .orderBy(F.desc("k"), "id").limit(HOT).toPandas())  # at most HOT rows of two numbers
    h = hot_rows["id"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    hot, rank = h[order], -np.arange(len(h), dtype=np.int32)[order]  # the most frequent has rank 0, the others less
    classes = staged(known.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("doc_id"), F.min("sketch").alias("sketch")), "classes")
    small = {r["n"]: r["k"] for r in classes.where(F.col("n") <= 2 * MAX_BOUNDARY).groupBy("n").agg(F.count("*").alias("k")).collect()}
    boundary = choose_boundary(small)
    total = classes.agg(F.sum(F.expr("n - ceil(n * 3 / 4) + 1")).alias("t")).first()["t"] or 0
    entries = _entries(docs, hot, rank, boundary, max(16, int(total) // PER_BUCKET))
    lists = entries.where(F.col("kind") == TOKEN).select(F.col("a").alias("token"), F.col("b").alias("node"),
                                                               F.expr(f"n div {PLACES}").alias("n"), F.expr(f"n % {PLACES}").alias("q"))
    light = _light_links(entries.where(F.col("kind") == SUBSET).select(F.col("a").alias("key"), F.col("b").alias("node"), F.col("n").alias("side")))

    fits = "4 * least(n, m) >= 3 * greatest(n, m)"
    # each set against the most typical set of a list, the one it meets most often
    own = lists.groupBy("node").agg((F.expr("max(n) - ceil(max(n) * 3 / 4) + 1") - F.count("*")).alias("odd"))
    typical = lists.join(own, "node").groupBy("token").agg(F.min(F.struct("odd", F.col("node").alias("hub"), F.col("n").alias("m"))).alias("h"))
    with_hub = (lists.join(typical.select("token", "h.hub", "h.m"), "token").where("node <> hub").where(fits).groupBy("node", "hub", "n", "m").agg(F.count("*").alias("c"))
                .groupBy("node").agg(F.max(F.struct("c", "hub")).alias("best")).select(F.col("best.hub").alias("a"), F.col("node").alias("b")))
    links = light.unionByName(_verified(with_hub, docs, classes))
    part = staged(components(links), "parts")

    # then whatever meets in a list and is not connected yet
    placed = lists.join(part, "node", "left").select("token", "node", "n", "q", F.coalesce("component", "node").alias("part"))
    mixed = placed.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("token")
    mixed = staged(placed.join(mixed, "token", "left_semi"), "mixed")
    other = mixed.select("token", F.col("node").alias("node2"), F.col("n").alias("m"), F.col("q").alias("q2"), F.col("part").alias("part2"))
    # similar sets meet at the first shingle that they share, and share no more than what either has from there on;
    # where that is too little they need not meet here
    low = lambda n, q: f"ceil({q} * ({n} - ceil({n} * 3 / 4) + 1) / {PLACES})"
    reach = f"7 * least(n - {low('n', 'q')}, m - {low('m', 'q2')}) >= 3 * (n + m)"
    pairs = (mixed.join(other, "token").where("node < node2 and part <> part2").where(fits).where(reach)
             .select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct())
    more = _verified(pairs, docs, classes)
    if not more.isEmpty():
        part = staged(components(links.unionByName(more)), "parts")

    placed = rows.join(part, "node", "left").withColumn("part", F.when(F.col("n") > 0, F.coalesce("component", "node")))
    named = placed.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return (placed.join(named, "part", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "node", "part"))


def one_of_each(docs: DataFrame, broadcast_rows: int = 2_000_000) -> DataFrame:
    """``docs`` with one row of each component: the one with its smallest id (of equal ids, the least node).  Rows without words or id all stay.

    Only the ids that go are matched against the documents; where there are few
    enough of them (one number each) the documents aren't shuffled.  Rows of an
    id that occurs more than once are matched by id and set.
    """
    found = staged(_components_by_node(docs).where("doc_id is not null"), "components")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("c"), F.max(F.expr("n_shingles > 0 and doc_id <> component_id")).alias("goes"))
    ids = staged(ids.where("goes or c > 1").select("doc_id", "c"), "gone")
    few = ids.count() <= broadcast_rows
    kept = docs.join(F.broadcast(ids.select("doc_id")) if few else ids.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = ids.where("c > 1").select("doc_id")
    if repeated.isEmpty():
        return kept

    first = (found.where("n_shingles > 0 and doc_id = component_id").join(repeated, "doc_id", "left_semi")
             .groupBy("part").agg(F.min("doc_id").alias("doc_id"), F.min("node").alias("node")).select("doc_id", "node"))
    at, node = docs.columns.index("text"), "_".join(["_node", *docs.columns])  # a name that no column has

    def with_node(batches):
        for b in batches:
            own = [s for lo in range(0, len(b), 500) for s in shingle_sets(_text_bytes(b.column(at).slice(lo, 500)))]
            nodes = pa.array([node_of(s) if len(s) else None for s in own], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, nodes], names=[*b.schema.names, node])

    fields = [*docs.schema.fields, T.StructField(node, T.LongType())]
    again = docs.join(repeated, "doc_id", "left_semi").select(*docs.columns).mapInArrow(with_node, T.StructType(fields))
    stays = again.join(first.withColumnRenamed("node", node), ["doc_id", node], "left_semi").dropDuplicates(["doc_id", node])
    return (kept.unionByName(stays.select(*docs.columns))
            .unionByName(again.where(F.col(f"`{node}`").isNull()).select(*docs.columns)))
