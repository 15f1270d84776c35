"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is split at the vocabulary's added tokens, then by the byte-level pattern; each piece is
merged on its own. A segment tree holds, for every place, the rank of the pair that starts there;
its root is the leftmost pair of the lowest rank. A merge changes three leaves, each in
logarithmic time, so a piece of n bytes takes n log n however long it is. Merging ends when the
root holds no mergeable pair. The trees of the new pieces of a batch of texts are rows of one
numpy array and merge side by side; long pieces have a tree of their own. Words repeat a lot, so their ids are kept, up to a bound, in each
Python worker.

The vocabulary is a file that the ``tokenizers`` library reads; its path is a parameter and its
content is broadcast (its size is fixed by the file). Nothing is trained here.

Edge cases: a null text counts as empty: 0 tokens, the digests of the empty string; very long
texts and pieces are encoded whole; an empty table gives no rows; a repeated row is encoded again;
only doc_id and text are read, so clashing names of other columns do no harm.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from kinmatch.llm import common as C

#: Fixed value: the splitting pattern of byte-level BPE vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"

#: Words a worker keeps; beyond it the store is emptied and fills again.
KEEP = 400_000
_NONE = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 characters
    stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, n = [], 0
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(256 + n))
            n += 1
    return out


def merge_ids(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge neighbours, always the leftmost pair of the lowest rank, until none is left.

    ``pairs`` maps two ids to (rank, merged id). Keys in the tree are rank * n + place.
    """
    n = len(ids)
    if n < 2:
        return ids
    ids = list(ids)
    get = pairs.get
    width = 1
    while width < n:
        width *= 2
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        p = get((ids[i], ids[i + 1]))
        if p is not None:
            tree[width + i] = p[0] * n + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while tree[1] != _NONE:
        i = tree[1] % n
        j = after[i]
        k = after[j]
        ids[i] = get((ids[i], ids[j]))[1]
        ids[j] = -1
        after[i] = k
        if k < n:
            before[k] = i
        h = before[i]
        for at, left, right in ((j, -1, n), (i, i, k), (h, h, i)):
            if at < 0:
                continue
            p = get((ids[left], ids[right])) if 0 <= left and right < n else None
            key = _NONE if p is None else p[0] * n + at
            at += width
            if tree[at] == key:
                continue
            tree[at] = key
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                low = a if a < b else b
                if tree[at] == low:
                    break
                tree[at] = low
                at >>= 1
    return [x for x in ids if x >= 0]


class PairTable:
    """The pairs as sorted arrays, and segment trees of many pieces worked on side by side."""

    #: Wider pieces are merged one by one; rows of one block of trees.
    WIDEST, BLOCK = 64, 16_384

    def __init__(self, first: list[int], pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pairs = pairs
        self.keys = keys[order]
        self.rank = np.array([r for r, _ in pairs.values()], dtype=np.int64)[order]
        self.merged = np.array([m for _, m in pairs.values()], dtype=np.int64)[order]
        self.first = np.array(first, dtype=np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair in the table, and whether it is there."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, (self.keys[at] == key) & (a >= 0) & (b >= 0)

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of every piece."""
        out: list = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            groups.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(k)
        for width, ks in groups.items():
            if width > self.WIDEST or not len(self.keys):
                for k in ks:
                    out[k] = merge_ids([int(self.first[b]) for b in pieces[k]], self.pairs)
                continue
            for at in range(0, len(ks), self.BLOCK):
                block = ks[at : at + self.BLOCK]
                for k, ids in zip(block, self._merge_block([pieces[k] for k in block], width)):
                    out[k] = ids
        return out

    def _merge_block(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """As ``merge_ids``, a row a piece: each step merges the pair at the root of every row."""
        rows = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(rows, width)
        size = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < size[:, None], self.first[raw], -1)
        after = np.broadcast_to(np.arange(1, width + 1), (rows, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (rows, width)).copy()
        tree = np.full((rows, 2 * width), _NONE, dtype=np.int64)
        at, ok = self.find(ids[:, :-1], ids[:, 1:])
        tree[:, width:-1] = np.where(ok, self.rank[at] * width + np.arange(width - 1), _NONE)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = tree[:, 2 * level : 4 * level].reshape(rows, level, 2).min(axis=2)
            level //= 2
        live = np.flatnonzero(tree[:, 1] != _NONE)
        while len(live):
            i = tree[live, 1] % width
            j = after[live, i]
            k = after[live, j]
            h = before[live, i]
            has_k, has_h = k < width, h >= 0
            at, _ = self.find(ids[live, i], ids[live, j])
            new = self.merged[at]
            ids[live, i] = new
            ids[live, j] = -1
            after[live, i] = k
            before[live[has_k], k[has_k]] = i[has_k]
            tree[live, width + j] = _NONE
            right = np.where(has_k, ids[live, np.minimum(k, width - 1)], -1)
            at, ok = self.find(new, right)
            tree[live, width + i] = np.where(ok, self.rank[at] * width + i, _NONE)
            h0 = np.maximum(h, 0)
            at, ok = self.find(np.where(has_h, ids[live, h0], -1), new)
            tree[live[has_h], width + h[has_h]] = np.where(ok, self.rank[at] * width + h, _NONE)[has_h]
            for leaf in (j, i, h0):
                up = (leaf + width) >> 1
                while up[0]:
                    tree[live, up] = np.minimum(tree[live, 2 * up], tree[live, 2 * up + 1])
                    up = up >> 1
            live = live[tree[live, 1] != _NONE]
        flat = ids[ids >= 0].tolist()
        ends = np.cumsum((ids >= 0).sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encoder and decoder of one vocabulary file (its JSON text)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, pre = data["model"], data["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or data["normalizer"] or pre["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.first = [vocab.get(c, -1) for c in letters]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.table = PairTable(self.first, self.pairs)
        self.bytes = {i: bytes(value[c] for c in t) for t, i in vocab.items()}
        added = {t["content"]: t["id"] for t in data.get("added_tokens", ())}
        self.bytes |= {i: t.encode() for t, i in added.items()}
        self.added = added
        longest = sorted(added, key=len, reverse=True)
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if added else None
        self.pieces = regex.compile(PIECES).findall
        #: entries of words that follow a blank
        self._kept: dict[str, tuple[int, str, bytes]] = {}

    def piece_ids(self, piece: str) -> list[int]:
        return merge_ids([self.first[b] for b in piece.encode()], self.pairs)

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        if self.at_added is None:
            yield text, False
            return
        for k, part in enumerate(self.at_added.split(text)):
            if part:
                yield part, k % 2 == 1

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self._parts(text):
            if special:
                out.append(self.added[part])
            else:
                for piece in self.pieces(part):
                    out += self.piece_ids(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        """Special tokens are written out; bytes that are no UTF-8 become U+FFFD."""
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")

    def _entry(self, chunk: str) -> tuple[int, str, bytes]:
        """Tokens, ids joined by commas, and decoded bytes of a chunk that holds no added token."""
        ids: list[int] = []
        for piece in self.pieces(chunk):
            ids += self.piece_ids(piece)
        return self._of_ids(ids)

    def _of_ids(self, ids: list[int]) -> tuple[int, str, bytes]:
        return len(ids), ",".join(map(str, ids)), b"".join([self.bytes[i] for i in ids])

    def _learn(self, words: set[str]) -> None:
        """Keep the entries of a blank and each word, merging all their pieces side by side."""
        pieces = self.pieces(" " + " ".join(words)) if words else []
        ids = dict(zip(uniq := list(dict.fromkeys(pieces)), self.table.merge_all([p.encode() for p in uniq])))
        todo = iter(words)
        out: list[int] = []
        word = next(todo, None)
        for k, piece in enumerate(pieces):
            if k and piece[0] == " ":
                self._kept[word] = self._of_ids(out)
                word, out = next(todo), []
            out = out + ids[piece] if out else ids[piece]
        if pieces:
            self._kept[word] = self._of_ids(out)

    def _chunks(self, text: str) -> tuple[str, list[str], list[tuple[int, str]]]:
        """(head, words that follow a single blank, (place, chunk) of the chunks in between).

        No piece of the pattern goes over a blank that stands between two characters that are no
        white space, so a text without added tokens may be cut there without changing its pieces.
        """
        words = text.split(" ")
        for w in words:
            if not w or w[0].isspace() or w[-1].isspace():
                break
        else:
            return words[0], words[1:], []
        head, lone, odd, chunk, blank = None, [], [], words[0], False
        for w in [*words[1:], None]:
            if w is not None and not (chunk and not chunk[-1].isspace() and w and not w[0].isspace()):
                chunk, blank = (" " + chunk if blank else chunk) + " " + w, False
                continue
            if head is None:
                head = chunk
            elif blank and not chunk[-1:].isspace():
                lone.append(chunk)
            else:
                odd.append((len(lone), (" " + chunk if blank else chunk)))
            chunk, blank = w, True
        return head, lone, odd

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text (tokens, digest of the ids joined by commas, digest of the text decoded
        from them)."""
        parts = [[(p, None) if special else (p, self._chunks(p)) for p, special in self._parts(t)] for t in texts]
        words = set().union(*[c[1] for ps in parts for _, c in ps if c])
        if len(self._kept) + len(words) > KEEP:
            self._kept = {w: e for w in words if (e := self._kept.get(w))}
        self._learn(words - self._kept.keys())
        kept = self._kept
        out = []
        for ps in parts:
            entries: list[tuple[int, str, bytes]] = []
            for part, chunks in ps:
                if chunks is None:
                    entries.append(self._of_ids([self.added[part]]))
                    continue
                head, lone, odd = chunks
                got = [kept[w] for w in lone]
                for place, chunk in reversed(odd):
                    got.insert(place, self._entry(chunk))
                entries += [self._entry(head), *got]
            decoded = b"".join([e[2] for e in entries]).decode("utf-8", "replace")
            ids = ",".join([e[1] for e in entries if e[0]])
            out.append((sum([e[0] for e in entries]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out


_codecs: dict[str, Codec] = {}
C.kept_in_workers.append(_codecs)


def codec(spec: str) -> Codec:
    """The codec of a vocabulary, one a process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(spec)
    return _codecs[key]


def _mapper(spec, make: Callable, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for b in batches:
            yield pa.record_batch(make(c, b), schema=schema)

    return run


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids array<int>."""
    spark = docs.sparkSession
    C.prepare(spark)
    spec = spark.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def make(c: Codec, b: pa.RecordBatch):
        return [b.column(0), pa.array([c.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))]

    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    rows = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    return rows.mapInArrow(_mapper(spec, make, out), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids decode to the empty text."""
    spark = encoded.sparkSession
    C.prepare(spark)
    spec = spark.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def make(c: Codec, b: pa.RecordBatch):
        return [b.column(0), pa.array([c.decode(t or []) for t in b.column(1).to_pylist()], pa.string())]

    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    rows = encoded.selectExpr("cast(doc_id AS bigint) AS doc_id", "ids")
    return rows.mapInArrow(_mapper(spec, make, out), "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a round trip of every whole text."""
    spark = docs.sparkSession
    C.prepare(spark)
    spec = spark.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def make(c: Codec, b: pa.RecordBatch):
        got = c.digests([t or "" for t in b.column(1).to_pylist()])
        return [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]

    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    rows = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    return rows.mapInArrow(_mapper(spec, make, out), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"), vocabulary_path())
