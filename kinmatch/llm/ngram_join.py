"""N-gram Jaccard join by prefix filters under several global token orders.

A document's set has its distinct ``n``-word shingles as 64-bit hashes. Two sets of similarity
``percent`` or more share a token among the first m - ceil(t m) + 1 tokens of each, under any one
order that both follow. The orders here all begin with tokens that few documents have and differ
in how they permute tokens equally frequent; a pair is a candidate only if it passes the filter of
every order, and sizes fit. Steps:

1. Equal sets collapse into one node (128-bit digests; partial minima before the shuffle), so
   exact copies cost nothing further. The same pass counts every token of the whole corpus in one
   of ``CELLS`` cells, some one or two bytes a token to move; the logarithms of these counts weigh the
   orders. Any counts give right results: they only move frequent tokens out of the prefixes.
2. Prefixes under each order. Those of the first are dealt out by token, once; only tokens whose
   cell has ``OFTEN`` or more are counted first, so that a join can split them. A token with at most
   ``BUCKET`` nodes gives pairs of fitting size, which must also share prefix tokens under the
   other orders. A token with more nodes gives no pairs: it links each of them with one of them.
3. These candidate links tell the groups within which all links lie. A group of at most ``BLOCK``
   nodes meets once and is compared in full by matrix products. A larger one meets in blocks, each
   node in one; of what a block links one node stays and meets the others' in the next round, so a
   family of near copies shrinks to one node however large it is, and each text moves about once.
4. What is left of larger groups are nodes of different components that still share a prefix
   token. The largest component of such a rest needs no comparison within itself: its nodes meet
   the others in blocks, and the others meet each other.
5. Components of all links found. A block hands back a spanning forest of its links.

So no group is ever in one task and no group's pairs are listed. Work grows with the square, in
blocks, only for what step 4 has besides its largest component: nodes that share frequent prefix
tokens and yet are no near copies of each other.

Edge cases: null or blank texts have the empty set and link with nothing; a row with a null doc_id
links with nothing and has a null component; rows that share a doc_id are one document with the
links of all its texts; a repeated row is a copy and is compared once; ties in frequency are ordered
by hash, ties in a prefix all belong to it; very long texts are read whole; an empty table gives no
rows; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch.llm import common as C
from kinmatch.llm import graph

#: Words of a shingle and the similarity of a link, where a caller names none.
N, PERCENT = 5, 80
ORDERS = 3
#: Cells that count tokens, and the parts in which they are added up.
CELL_BITS, SHARD_BITS = 25, 6
CELLS, SHARD = 1 << CELL_BITS, 1 << (CELL_BITS - SHARD_BITS)
#: Tokens whose cells a task holds before it hands them on.
SLICE = 8_000_000
#: From this count on the rows of a token need not fit one task.
OFTEN = 1024
BUCKET = 64
BLOCK = 256
#: Rounds in which a large group shrinks.
ROUNDS = 4
#: Bits of the filter that tells which texts are read again.
FILTER_BITS = 1 << 24

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _values(key: np.ndarray) -> np.ndarray:
    return _mix((key.astype(np.uint64) + np.uint64(1)) * _ODD[0])


#: Values of every byte at the first places of a word; those of later ones are computed.
PLACES = 64
_first_values = _values(np.arange(PLACES << 8))


#: Bytes of a text that are hashed at once, and what may end such a piece.
PIECE, _BLANKS = 1 << 20, re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words in order; a long text in pieces of whole words, which bounds the memory."""
    pieces, at = [], 0
    while len(text) - at > PIECE and (blank := _BLANKS.search(text, at + PIECE)):
        pieces.append(_piece_hashes(text[at : blank.start()]))
        at = blank.start()
    return np.concatenate([*pieces, _piece_hashes(text[at:])])


def _piece_hashes(text: bytes) -> np.ndarray:
    """The sum of what each byte of a word is worth at its place."""
    raw = np.frombuffer(text, dtype=np.uint8)
    inside = ~_BLANK[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    length = edges[1::2] - edges[::2]
    if not len(length):
        return np.zeros(0, dtype=np.uint64)
    start = np.cumsum(length) - length
    key = raw[inside] + ((np.arange(int(length.sum())) - np.repeat(start, length)) << 8)
    return _mix(np.add.reduceat(_first_values[key] if length.max() <= PLACES else _values(key), start))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a whole text; A-Z count as a-z.

    ``bytes.lower`` knows ASCII letters only, as the rule wants.
    """
    h = word_hashes((text or "").encode().lower())
    if not len(h):
        return h
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = out * _ODD[4] + h[k : len(h) - width + 1 + k]
    out = _mix(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def cell_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.uint32)


def level_of(counts: np.ndarray) -> np.ndarray:
    """0 for what was never seen, then eight steps to a doubling."""
    return np.where(counts > 0, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(counts, 1)))), 0).astype(np.uint8)


class Orders:
    """The global orders: by how frequent the cell of a token is, then by a hash of its own for
    each order."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        self.level = level_of(np.bincount(cell_of(tokens), weights=counts, minlength=CELLS))

    @classmethod
    def of_levels(cls, level: np.ndarray) -> Orders:
        out = cls.__new__(cls)
        out.level = level
        return out

    def levels(self, tokens: np.ndarray) -> np.ndarray:
        return self.level[cell_of(tokens)]

    def prefixes(self, tokens: np.ndarray, percent: int) -> list[np.ndarray]:
        """For each order the tokens up to the last of its prefix, ties included."""
        p = prefix_size(len(tokens), percent)
        level = self.levels(tokens).astype(np.uint64) << np.uint64(56)
        out = []
        for k in range(ORDERS):
            key = level | (_mix(tokens ^ _ODD[k]) >> np.uint64(8))
            out.append(tokens[key <= np.partition(key, p - 1)[p - 1]])
        return out


def packed(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(shard, bytes) of sorted cells: their steps, low bytes first, which are nearly all that is
    not zero."""
    ends = np.searchsorted(cells, np.arange(0, CELLS + 1, SHARD))
    for k, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        if hi > lo:
            steps = np.diff(cells[lo:hi], prepend=np.uint32(k * SHARD))
            yield k, zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(part: bytes) -> np.ndarray:
    """The places of the cells within their shard."""
    steps = np.frombuffer(zlib.decompress(part), dtype=np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint32)[:, 0], dtype=np.int64)


def _scan(n: int) -> callable:
    """A row a document (doc_id, n, digest), and rows (shard, cells) of its slices' tokens."""

    def rows(*cols: pa.Array) -> pa.RecordBatch:
        return pa.record_batch(list(cols), names=["doc_id", "n", "digest", "shard", "cells"])

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.concatenate(held)
        held.clear()  # sorted in place, so a slice is held once
        cells.sort()
        parts = list(packed(cells))
        k = len(parts)
        return rows(pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([s for s, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.forget()
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            sets = [shingles(t, n) for t in b.column(1).to_pylist()]
            k = len(sets)
            yield rows(b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()))
            for s in sets:
                held.append(cell_of(s))
                size += len(s)
                if size >= SLICE:
                    yield counted(held)
                    size = 0
        if size:
            yield counted(held)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, levels) from the rows (shard, cells) of a task, which come by shard."""

    def row(shard: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([shard], pa.int32()), pa.array([level_of(counts).tobytes()], pa.binary())], names=["shard", "levels"])

    last, counts = None, None
    for b in batches:
        for shard, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if shard != last:
                if last is not None:
                    yield row(last, counts)
                last, counts = shard, np.zeros(SHARD, dtype=np.int64)
            counts += np.bincount(unpacked(part), minlength=SHARD)
    if last is not None:
        yield row(last, counts)


def _orders(parts: DataFrame) -> Orders:
    """The orders from all rows (shard, cells): a byte a cell at the driver, whatever the corpus."""
    dealt = parts.repartition(C.partitions(parts.sparkSession), "shard").sortWithinPartitions("shard")
    level = np.zeros(CELLS, dtype=np.uint8)
    for r in dealt.mapInArrow(_sums, "shard int, levels binary").collect():
        level[r.shard * SHARD : (r.shard + 1) * SHARD] = np.frombuffer(r.levels, dtype=np.uint8)
    return Orders.of_levels(level)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")


class _Once(set):
    """Tells the first of equal (node, digest) rows of a task."""

    def first(self, node: int, digest: bytes) -> bool:
        key = digest + node.to_bytes(8, "little", signed=True)
        if key in self:
            return False
        self.add(key)
        return True


def _cards(docs: DataFrame, orders, copied, n: int, percent: int) -> DataFrame:
    """(node, n, digest, some, p0, h0, p1, ...): whether several rows may have the set, prefixes
    under the first order, tokens that may be frequent apart from the rest, and 32 bits of the
    others' tokens. One pass of Python, so a task has one worker."""
    limit = level_of(np.array([OFTEN]))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(t, n)
                if i is not None and len(s) and once.first(i, d := digest(s)):
                    first, *others = orders.value.prefixes(s, percent)
                    often = orders.value.levels(first) >= limit
                    rows.append((i, len(s), d, first[~often].view(np.int64), first[often].view(np.int64), [o.astype(np.uint32).view(np.int32) for o in others], _in_filter(copied.value, d)))
            yield pa.record_batch(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.binary()),
                    pa.array([r[6] for r in rows], pa.bool_()),
                    pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[4] for r in rows], pa.list_(pa.int64())),
                    *[pa.array([r[5][k] for r in rows], pa.list_(pa.int32())) for k in range(ORDERS - 1)],
                ],
                names=["node", "n", "digest", "some", "p0", "h0", *[f"p{k}" for k in range(1, ORDERS)]],
            )

    kind = "node long, n int, digest binary, some boolean, p0 array<long>, h0 array<long>, " + ", ".join(f"p{k} array<int>" for k in range(1, ORDERS))
    return _texts(docs).mapInArrow(run, kind)


def _in_filter(bits: np.ndarray, digest: bytes) -> bool:
    """Whether a digest may be among those of a filter; its first bits are its place."""
    at = int.from_bytes(digest[:4], "big") % FILTER_BITS
    return bool(bits[at >> 5] >> np.uint32(at & 31) & np.uint32(1))


def _copied(reps: DataFrame) -> np.ndarray:
    """A filter that holds at least the digests that several rows have."""
    first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return _members(reps.where("copies > 1"), F.pmod(first, F.lit(FILTER_BITS)))


def _nodes_only(cards: DataFrame, reps: DataFrame) -> DataFrame:
    """The cards of nodes, each once. Only sets that several rows may have are looked up, so cards
    of single ones do not move; rows that repeat a node are compared after."""
    more = reps.where("copies > 1").select("digest", F.col("node").alias("first"))
    cards = C.cut(cards, "join-cards")
    met = cards.where("some").join(more, "digest", "left").where("first IS NULL OR first = node").drop("some")
    again = C.cut(met.where("first IS NOT NULL").dropDuplicates(["node", "digest"]).unionByName(met.where("first IS NULL")), "join-cards")
    return cards.where("NOT some").drop("some").unionByName(again.drop("first"))


def _fits(u: str, v: str, percent: int) -> F.Column:
    return 100 * F.least(u, v) >= percent * F.greatest(u, v)


def _counted(cards: DataFrame) -> DataFrame:
    """(token, node, n, m): the prefix tokens under the first order that m > 1 nodes have.

    A token whose cell has less than ``OFTEN`` has no more rows than that, so they fit one task and
    move once. Those of the others are counted before they move and meet their count in a join that
    can be split.
    """
    rare = cards.select("node", "n", F.explode("p0").alias("token")).withColumn("m", F.count("*").over(Window.partitionBy("token")))
    often = cards.select("node", "n", F.explode("h0").alias("token"))
    often = often.join(often.groupBy("token").agg(F.count("*").alias("m")), "token")
    return rare.unionByName(often).where("m > 1")


def _candidates(cards: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs (u, v) that pass every order, rows (token, node) of tokens with more nodes)."""
    counted = C.cut(_counted(cards), "join-tokens")
    few = counted.where(F.col("m") <= BUCKET).select("token", "node", "n")
    a = few.select("token", F.col("node").alias("u"), F.col("n").alias("n_u"))
    b = few.select("token", F.col("node").alias("v"), F.col("n").alias("n_v"))
    pairs = C.cut(a.join(b, "token").where((F.col("u") < F.col("v")) & _fits("n_u", "n_v", percent)).select("u", "v").distinct(), "join-pairs")
    cards = _some_of(cards, pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))))
    others = [f"p{k}" for k in range(1, ORDERS)]
    card_u = cards.select(F.col("node").alias("u"), *[F.col(p).alias(f"{p}_u") for p in others])
    card_v = cards.select(F.col("node").alias("v"), *[F.col(p).alias(f"{p}_v") for p in others])
    shared = F.lit(True)
    for p in others:
        shared = shared & F.arrays_overlap(f"{p}_u", f"{p}_v")
    passed = pairs.join(card_u, "u").join(card_v, "v").where(shared).select("u", "v").distinct()
    return passed, counted.where(F.col("m") > BUCKET).select("token", "node")


def _stars(many: DataFrame) -> DataFrame:
    """Links (u, v) of each token's nodes with the first of them."""
    first = many.groupBy("token").agg(F.min("node").alias("u"))
    return many.join(first, "token").where("u <> node").select("u", F.col("node").alias("v")).distinct()


def _place(key: str) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)).cast("long")


def _members(keys: DataFrame, place: F.Column):
    """A filter of fixed size that holds at least the keys at the given places."""
    words = (
        keys.select(place.alias("h"))
        .groupBy(F.shiftright("h", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 32 AS int))")).alias("bits"))
        .toPandas()
    )
    bits = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    bits[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return bits


def _held(key: str, keys: DataFrame) -> F.Column:
    """Whether a row's key may be among the given ones; never false for one that is."""
    bits = keys.sparkSession.sparkContext.broadcast(_members(keys, _place(key)))

    def held(h: pa.Array) -> pa.Array:
        at = h.to_numpy()
        return pa.array((bits.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool))

    return F.arrow_udf(held, "boolean")(_place(key))


def _some_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of at least the given nodes; what is left out need not move."""
    return rows.where(_held("node", nodes))


def _sets_of(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, digest, text) of at least the given nodes; equal rows of a task once. Texts move, as
    they take less room than their sets."""
    bits = docs.sparkSession.sparkContext.broadcast(_members(nodes, _place("node")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for b in batches:
            h = b.column(2).to_numpy()
            some = np.flatnonzero(bits.value[h >> 5] >> (h & 31).astype(np.uint32) & 1)
            b = b.take(pa.array(some))
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(t, n)
                if once.first(i, d := digest(s)):
                    rows.append((i, d, t))
            kinds = (pa.int64(), pa.binary(), pa.string())
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["node", "digest", "text"])

    rows = _texts(docs).where("doc_id IS NOT NULL").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("long"))
    return rows.mapInArrow(run, "node long, digest binary, text string")


def forest(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Stars (root, node) that span the links among some sets, all pairs compared in full."""
    m = len(nodes)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    both = np.zeros((m, m), dtype=np.int32)
    if m == 2:
        both[0, 1] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        # only tokens of several sets matter; those are sorted as numbers of (token, row)
        common = np.concatenate(sets)
        common.sort()
        common = np.unique(common[1:][common[1:] == common[:-1]])
        keys = []
        for i, s in enumerate(sets):
            at = np.searchsorted(common, s)
            at = at[at < len(common)]
            keys.append((at[common[at] == s[: len(at)]] << 32) | i)
        del common
        key = np.concatenate(keys)
        keys.clear()
        key.sort()
        row, col = (key & 0xFFFFFFFF).astype(np.int32), (key >> 32).astype(np.int32)
        del key
        ends = np.searchsorted(col, np.arange(int(col[-1]) + 2 if len(col) else 1))
        often = np.diff(ends)
        if m * m * len(often) / 4e9 > 1e-5 * len(often) + 4e-9 * float((often.astype(float) ** 2).sum()):
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                r = row[a:b]
                both[r[:, None], r] += 1
        else:
            width = max(1, (1 << 20) // m)
            for lo in range(0, len(often), width):
                a, b = ends[lo], ends[min(lo + width, len(often))]
                part = np.zeros((m, width), dtype=np.float32)
                part[row[a:b], col[a:b] - lo] = 1
                both += (part @ part.T).astype(np.int32)
    u, v = np.nonzero(np.triu((100 * both >= percent * (size[:, None] + size[None, :] - both)) & (both > 0), 1))
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(u.tolist(), v.tolist()):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(nodes[find(i)], nodes[i]) for i in range(m) if root[i] != i]


def _forests(n: int, percent: int) -> callable:
    """Links of every block; the rows of a block follow each other, equal ones side by side."""

    def links(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        got = forest(nodes, sets, percent)
        return pa.record_batch([pa.array([u for u, _ in got], pa.int64()), pa.array([v for _, v in got], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, last = None, [], [], None
        for b in batches:
            for k, i, d, t in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if len(nodes) > 1:
                        yield links(nodes, sets)
                    key, nodes, sets, last = k, [], [], None
                if (i, d) != last:
                    nodes.append(i)
                    sets.append(shingles(t, n))
                    last = i, d
        if len(nodes) > 1:
            yield links(nodes, sets)

    return run


def _compared(sets: DataFrame, blocks: DataFrame, rule: tuple[int, int]) -> DataFrame:
    """Links (u, v) of the blocks (node, digest, block); ``rule`` is (n, percent)."""
    dealt = sets.join(blocks, ["node", "digest"]).select("block", "node", "digest", "text")
    return dealt.repartition(C.partitions(sets.sparkSession), "block").sortWithinPartitions("block", "node", "digest").mapInArrow(_forests(*rule), "u long, v long")


def _bucket(salt: int, parts) -> F.Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), parts).cast("int")


def _shrunk(sets: DataFrame, rows: DataFrame, rule: tuple[int, int]) -> list[DataFrame]:
    """Tables of links (u, v) of large groups (node, digest, g): each round deals every node that
    is left to one block, and of what a block links one node stays."""
    out: list[DataFrame] = []
    for k in range(ROUNDS):
        size = rows.groupBy("g").agg(F.count("*").alias("m")).where("m > 1")
        parts = F.ceil(F.col("m") / BLOCK).cast("int")
        dealt = rows.join(size, "g").select("node", "digest", "g", "m", F.concat_ws(":", "g", _bucket(k, parts)).alias("block"))
        dealt = C.cut(dealt, "join-round")
        links = C.cut(_compared(sets, dealt.select("node", "digest", "block"), rule), "join-links")
        out.append(links)
        # groups that met whole are done; so are rounds that no longer shrink what is left
        rows = dealt.where(F.col("m") > BLOCK).select("node", "digest", "g")
        before = rows.count()
        rows = C.cut(rows.join(links.select(F.col("v").alias("node")).distinct(), "node", "left_anti"), "join-left")
        C.drop_cut(sets.sparkSession, dealt)
        if not before or rows.count() > 0.9 * before:
            break
    return out


def _rest(rows: DataFrame, passed: DataFrame, many: DataFrame, found: DataFrame) -> DataFrame:
    """(node, digest, g, c) of large groups' nodes of different components that share a prefix
    token; ``found`` has (node, component) of the links so far."""
    named = rows.join(found, "node", "left").select("node", "digest", F.coalesce("component", "node").alias("c"))
    ids = named.select("node", "c").distinct()
    tokens = many.join(ids, "node")
    mixed = tokens.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("token")
    stars = _stars(tokens.join(mixed, "token").select("token", "node"))
    side = lambda x: ids.select(F.col("node").alias(x), F.col("c").alias(f"c_{x}"))
    pairs = passed.join(side("u"), "u").join(side("v"), "v").where("c_u <> c_v").select("u", "v")
    groups = graph.components(C.cut(stars.unionAll(pairs), "join-rest"))
    return named.join(groups.withColumnRenamed("component", "g"), "node")


def _placed(rest: DataFrame, percent: int) -> DataFrame:
    """(node, digest, block): where the nodes of a rest meet.

    Sizes that differ by more than a factor of 100 / percent cannot link, so nodes meet those of
    their own and the neighbouring size classes. Of a group's components the largest meets only
    the others.
    """
    per = rest.groupBy("g", "c").agg(F.count("*").alias("n"))
    most = per.groupBy("g").agg(F.max(F.struct("n", (-F.col("c")).alias("c"))).alias("x")).select("g", (-F.col("x.c")).alias("most"))
    k = F.floor(F.ln(F.col("n")) / F.lit(float(np.log(100 / percent)))).cast("int")
    rows = C.cut(rest.join(most, "g").select("node", "digest", "g", k.alias("k"), (F.col("c") == F.col("most")).alias("large")), "join-sizes")
    parts = C.cut(rows.groupBy("g", "k", "large").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "join-classes")
    one = rows.join(parts, ["g", "k", "large"]).select("node", "digest", "g", "k", "large", _bucket(9, F.col("parts")).alias("j"))
    near = one.withColumn("k2", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)))
    other = parts.select("g", F.col("k").alias("k2"), F.col("large").alias("large2"), "parts")
    near = near.join(other, ["g", "k2"]).where("NOT (large AND large2)")
    met = near.withColumn("j2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    here, there = F.struct("large", "k", "j"), F.struct(F.col("large2").alias("large"), F.col("k2").alias("k"), F.col("j2").alias("j"))
    name = lambda x: F.concat_ws("-", x["large"].cast("string"), x["k"].cast("string"), x["j"].cast("string"))
    block = F.concat_ws(":", "g", name(F.least(here, there)), name(F.greatest(here, there)))
    return met.select("node", "digest", block.alias("block")).distinct()


def _verified(docs: DataFrame, cards: DataFrame, passed: DataFrame, many: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v) that span every component, from full comparisons."""
    spark, rule = docs.sparkSession, (n, percent)
    groups = graph.components(C.cut(passed.unionAll(_stars(many)), "join-candidates"))
    C.release(spark)
    rows = C.cut(cards.select("node", "digest", "n").join(groups.withColumnRenamed("component", "g"), "node"), "join-groups")
    size = C.cut(rows.groupBy("g").agg(F.count("*").alias("m")), "join-sizes")
    small, large = (rows.join(size.where(c), "g", "left_semi") for c in (F.col("m") <= BLOCK, F.col("m") > BLOCK))
    links = [C.cut(_compared(_sets_of(docs, rows, n), small.select("node", "digest", F.col("g").cast("string").alias("block")), rule), "join-links")]
    C.release(spark)
    if size.where(F.col("m") > BLOCK).limit(1).count():
        large = C.cut(large, "join-large")
        sets = C.cut(_sets_of(docs, large, n).join(large.select("node", "digest").distinct(), ["node", "digest"], "left_semi"), "join-sets")
        links += _shrunk(sets, large.select("node", "digest", "g"), rule)
        found = links[1]
        for x in links[2:]:
            found = found.unionAll(x)
        rest = _rest(large.select("node", "digest"), passed, many, graph.components(C.cut(found, "join-found")))
        rest = C.cut(rest.join(large.select("node", "digest", "n"), ["node", "digest"]), "join-rest")
        links.append(C.cut(_compared(sets, _placed(rest, percent), rule), "join-links"))
    out = links[0]
    for x in links[1:]:
        out = out.unionAll(x)
    return out


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``."""
    spark = docs.sparkSession
    C.prepare(spark)
    start = len(C.made)
    both = C.cut(_texts(docs).mapInArrow(_scan(n), "doc_id long, n long, digest binary, shard int, cells binary"), "join-scan")
    rows = both.where("shard IS NULL").select("doc_id", "n", "digest")
    orders = spark.sparkContext.broadcast(_orders(both.where("shard IS NOT NULL").select("shard", "cells")))
    reps = C.cut(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "join-reps")
    copied = spark.sparkContext.broadcast(_copied(reps))
    cards = _nodes_only(_cards(docs, orders, copied, n, percent), reps)
    orders.unpersist()
    passed, many = _candidates(cards, percent)
    passed = C.cut(passed, "join-passed")
    C.release(spark)
    links = C.cut(_verified(docs, cards, passed, many, n, percent), "join-links")
    found = graph.components(links)
    node = reps.where("copies > 1").select("digest", "node")
    named = rows.join(node, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("node", "doc_id")).otherwise(F.col("doc_id")).alias("node")
    )
    out = named.join(found, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    C.keep_only(spark, start, out)
    return out


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The documents less all but the smallest doc_id of each component; columns as they were.

    Rows without doc_id stay; of rows that repeat a doc_id all stay or go together.
    """
    gone = jaccard_components(docs, n, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four words and 85 %, as the query's contract says."""
    return jaccard_components(C.table(spark, sf_dir, "documents"), 4, 85)
