"""LM scoring by cross-entropy difference.

Two bigram models of the same order, smoothing and vocabulary are compared: one of the target
text (every document labelled good), one of the whole corpus. The vocabulary is every word of the
corpus and one entry for any other; counts of words and bigrams are exact and come from every
document, so what is gathered grows with the corpus. Nothing of that size is collected: a batch of
documents asks the slices of the words' digests for the counts of its bigrams, each slice counts
what it is asked for, by all batches and by the target, and answers with counts in the order asked.

The ``HOT`` most frequent words at most would make slices uneven. Their counts and those of
bigrams of two of them are collected, a square table, and scored where the text is; any other
bigram is asked for with its rare word, the second if both are. That decides where a count is
held, not what it is. There are so many slices that one holds some ``SLICE_WORDS`` rare words of
the corpus, whatever the number of partitions; which document a word is of never leaves its batch.

A document's score is the mean over its words of target loss less background loss, in nats:
lower is more like the target. Words are told apart by 64-bit digests, bigrams by 64 bits of both.

Edge cases: a null or empty text has 0 words, losses and score 0; a repeated row is counted and
scored again; without labels the target model is the prior of a uniform vocabulary; very long
texts are read whole; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import common as C

#: Words whose counts, and those of their bigrams with each other, are broadcast.
HOT = 1_000
SLICE = 1 << 12
#: Weight of the unigram prior behind a history, in words.
PRIOR = 8.0
#: Distinct words that a task counts before it hands them on.
FLUSH = 600_000
#: Words, and documents, that a task deals out at once.
DEAL, DEAL_DOCS = 600_000, 1 << 15
#: Rare words of the corpus in a slice, about.
SLICE_WORDS = 1_500_000
#: Bits that stand for the hashed ids of good documents.
BITS = 1 << 26
#: Bytes of text whose words get their digests at once, and bytes of a word that do so with others.
PIECE, LONG = 1 << 20, 256


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _mix(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """64 bits of one or two arrays of digests."""
    x = a if b is None else a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The first so many bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _digests(words: bytes) -> np.ndarray:
    """64-bit digests of words that each end in a blank; 0 is left for the start of a text."""
    ends = np.flatnonzero(np.frombuffer(words, dtype=np.uint8) == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    length = ends - starts
    at_any = np.ndarray(len(words), dtype="<u8", buffer=words + bytes(8), strides=(1,))
    out = _mix(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (at_any[starts] & _FIRST[np.minimum(length, 8)]))
    some = np.flatnonzero((length > 8) & (length <= LONG))
    done = 8
    while len(some):
        left = length[some] - done
        out[some] = _mix(out[some] * np.uint64(0x9E3779B97F4A7C15) ^ (at_any[starts[some] + done] & _FIRST[np.minimum(left, 8)]))
        some = some[left > 8]
        done += 8
    for k in np.flatnonzero(length > LONG):
        out[k] = int.from_bytes(blake2b(words[starts[k] : ends[k]], digest_size=8).digest(), "little")
    out[out == 0] = 1
    return out


def digests(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of all texts in a row, and how many words each text has."""
    out, held, size, length = [np.zeros(0, np.uint64)], [], 0, np.zeros(len(texts), dtype=np.int64)
    for k, t in enumerate(texts):
        words = tokens(t)
        if words:
            length[k] = len(words)
            held.append(" ".join(words).encode("utf-8", "surrogatepass"))
            size += len(held[-1])
        if size > PIECE:
            out.append(_digests(b" ".join([*held, b""])))
            held, size = [], 0
    if held:
        out.append(_digests(b" ".join([*held, b""])))
    return np.concatenate(out), length


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """First columns, digests and lengths of some documents at a time; the text is the last column."""
    ids, held, lengths, n = [], [], [], 0
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            word, length = digests(part.column(part.num_columns - 1).to_pylist())
            ids += part.column(0).to_pylist() if part.num_columns > 1 else [None] * len(length)
            held.append(word)
            lengths.append(length)
            n += len(word)
            if n >= DEAL or len(ids) > DEAL_DOCS - 64:
                yield ids, np.concatenate(held), np.concatenate(lengths)
                ids, held, lengths, n = [], [], [], 0
    if ids:
        yield ids, np.concatenate(held), np.concatenate(lengths)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(count)], names=["word", "n"])

    for _, word, _ in _groups(batches):
        more, n = np.unique(word, return_counts=True)
        key, place = np.unique(np.concatenate([key, more]), return_inverse=True)
        count = np.bincount(place, np.concatenate([count, n]), len(key)).astype(np.int64)
        if len(key) >= FLUSH:
            yield out()
            key, count = key[:0], count[:0]
    if len(key):
        yield out()


class Numbers:
    """Digests of frequent words to numbers: 0 for the start of a text, 1 for all other words.

    ``distinct`` is the size of the vocabulary, one entry for words not in the corpus included.
    """

    def __init__(self, words: np.ndarray, distinct: int):
        self.size = len(words) + 2
        self.distinct = distinct
        order = np.argsort(words)
        self.digest, self.number = words[order], (order + 2).astype(np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.of_digests(digests([text])[0])

    def of_digests(self, digest: np.ndarray) -> np.ndarray:
        if not len(self.digest):
            return np.ones(len(digest), dtype=np.int32)
        at = np.minimum(np.searchsorted(self.digest, digest), len(self.digest) - 1)
        return np.where(self.digest[at] == digest, self.number[at], np.int32(1))


def _edges(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and the last words of texts that lie in a row."""
    some = length[length > 0]
    ends = np.cumsum(some)
    return ends - some, ends - 1


def _before(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.roll(ids, 1)
    out[starts] = 0
    return out


def _padded(n: int) -> int:
    return -(-n // SLICE) * SLICE


def _tables(numbers) -> callable:
    """Rows (slice, counts) of what a task has counted: bigrams of numbers, then words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = numbers.value.size
        pair = np.zeros(_padded(size * size), dtype=np.int64)
        word = np.zeros(_padded(size), dtype=np.int64)
        for _, digest, length in _groups(batches):
            ids, (starts, _) = numbers.value.of_digests(digest), _edges(length)
            pair += np.bincount(_before(ids, starts) * np.int64(size) + ids, minlength=len(pair))
            word += np.bincount(ids, minlength=len(word))
            word[0] += len(starts)
        rows = np.concatenate([pair, word]).reshape(-1, SLICE)
        some = np.flatnonzero(rows.any(axis=1))
        for at in range(0, len(some), 64):
            part = some[at : at + 64]
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array([rows[k].astype("<i8").tobytes() for k in part], pa.binary())], names=["slice", "counts"])

    return run


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of sorted slices, one at a time."""
    key, total = None, None

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array([key], pa.int32()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["slice", "counts"])

    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            part = np.frombuffer(raw, dtype="<i8")
            if k == key:
                total = total + part
            else:
                if key is not None:
                    yield out()
                key, total = k, part.astype(np.int64)
    if key is not None:
        yield out()


@dataclass
class Bigrams:
    """Exact counts of numbered words (the first is the number of texts) and of their bigrams."""

    pair: np.ndarray
    word: np.ndarray
    distinct: int

    def __post_init__(self) -> None:
        self.words = float(self.word[1:].sum())

    def prior(self, count: np.ndarray) -> np.ndarray:
        """The smoothed share of words that occur ``count`` times."""
        return (count + 0.5) / (self.words + 0.5 * self.distinct)

    def pair_loss(self, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The part of the loss that a bigram and its second word decide."""
        return -np.log(pair + PRIOR * self.prior(word))

    def history_loss(self, count: np.ndarray) -> np.ndarray:
        """The part that the word before decides."""
        return np.log(count + PRIOR)

    def loss(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Minus the log probability of each word after the one before it."""
        return self.pair_loss(self.pair[before * len(self.word) + ids], self.word[ids]) + self.history_loss(self.word[before])


def count_table(texts: DataFrame, numbers, size: int) -> Bigrams:
    """Counts of numbered words in a column of texts; every text counts."""
    spark = texts.sparkSession
    parts = texts.mapInArrow(_tables(numbers), "slice int, counts binary")
    pairs = _padded(size * size)
    n = min(C.partitions(spark), (pairs + _padded(size)) // SLICE)
    rows = parts.repartitionById(n, "slice").sortWithinPartitions("slice").mapInArrow(_sum_slices, "slice int, counts binary").toPandas()
    whole = np.zeros(pairs + _padded(size), dtype=np.int64)
    for k, raw in zip(rows["slice"], rows["counts"]):
        whole[k * SLICE : (k + 1) * SLICE] = np.frombuffer(raw, dtype="<i8")
    return Bigrams(whole[: size * size], whole[pairs : pairs + size], numbers.value.distinct)


def vocabulary(docs: DataFrame, size: int = HOT) -> Numbers:
    """Numbers of the most frequent words, at most ``size``, and the size of the vocabulary."""
    words = docs.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = C.cut(words, "lm-words")
    top = C.most_frequent(counts, "word", "n", size).toPandas().sort_values(["n", "word"], ascending=[False, True])
    distinct = counts.count()
    C.drop_cut(docs.sparkSession, counts)
    return Numbers(top["word"].to_numpy(dtype=np.int64).view(np.uint64), distinct + 1)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64 bits or of counts, in as few bytes as their largest needs; equal bytes of
    neighbours lie together, as their compression wants."""
    head, out = [], []
    for c in columns:
        c = c.view(np.uint64) if c.dtype.itemsize == 8 else c
        c = c.astype(np.min_scalar_type(int(c.max())) if len(c) else np.uint8)
        head += [len(c), c.itemsize]
        out.append(c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes())
    return b"".join([np.array([len(columns), *head], dtype="<i8").tobytes(), *out])


def _unpack(raw: bytes) -> list[np.ndarray]:
    """The columns, as unsigned numbers."""
    m = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
    at, out = 8 + 16 * m, []
    for n, size in np.frombuffer(raw, dtype="<i8", count=2 * m, offset=8).reshape(-1, 2).tolist():
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").ravel())
        at += n * size
    return out


#: What a dealt row has: a batch's documents, what the target asks for, what a batch asks for or
#: what it is answered.
DOCS, TARGET, WORDS = range(3)
DEALT = "slice int, kind int, batch long, data binary"
_DEALT = pa.schema([("slice", pa.int32()), ("kind", pa.int32()), ("batch", pa.int64()), ("data", pa.binary())])
#: Of a rare word: it ends its text, the word before is rare, the word after is frequent.
LAST, AFTER_RARE, HOT_NEXT = 1, 2, 4


def _dealt(rows: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3])
        if size > 8_000_000:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), _DEALT)], schema=_DEALT)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), _DEALT)], schema=_DEALT)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for b in batches:
        slices, kinds, numbers = (c.to_pylist() for c in b.columns[:3])
        for k in range(b.num_rows):
            yield slices[k], kinds[k], numbers[k], b.column(3)[k].as_py()


def _asked(word: np.ndarray, number: np.ndarray, starts: np.ndarray, ends: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Iterator[tuple[int, bytes]]]:
    """Places of rare words in the order of their digests, what is known of them, how many there
    are of each, and by slice: distinct rare words and what they meet."""
    rare = np.flatnonzero(number == 1)
    place = rare[np.argsort(word[rare])]
    own = word[place]
    new = np.diff(own, prepend=np.uint64(0)) != 0
    words, of = own[new], np.cumsum(new) - 1
    last = np.zeros(len(word), dtype=bool)
    last[ends] = True
    flags = last[place].astype(np.uint8)
    before_number = _before(number, starts)[place]
    flags |= np.where(before_number == 1, np.uint8(AFTER_RARE), np.uint8(0))
    next_number = number[np.minimum(place + 1, len(number) - 1)]
    flags |= np.where((flags & LAST == 0) & (next_number > 1), np.uint8(HOT_NEXT), np.uint8(0))

    def by_slice() -> Iterator[tuple[int, bytes]]:
        after_rare, hot_next = flags & AFTER_RARE > 0, flags & HOT_NEXT > 0
        met = [
            (hot_next, next_number.astype(np.uint16)),
            (~after_rare, before_number.astype(np.uint16)),
            (after_rare, word[place - 1]),
        ]
        columns = [(np.bincount(of[some], minlength=len(words)).astype(np.uint32), x[some]) for some, x in met]
        upto = [np.concatenate([[0], np.cumsum(n, dtype=np.int64)]) for n, _ in columns]
        some, first = np.unique((((words >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)).astype(np.int32), return_index=True)
        for k, lo, hi in zip(some.tolist(), first.tolist(), [*first[1:].tolist(), len(words)]):
            yield k, _pack(words[lo:hi], *(n[lo:hi] for n, _ in columns), *(x[u[lo] : u[hi]] for (_, x), u in zip(columns, upto)))

    return place, flags, np.bincount(of, minlength=len(words)).astype(np.uint32), by_slice()


def _target(numbers, slices: int) -> callable:
    """What the target has of words and bigrams, less those of frequent words only."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        for _, word, length in _groups(batches):
            *_, asked = _asked(word, numbers.value.of_digests(word), *_edges(length), slices)
            for k, data in asked:
                yield k, TARGET, 0, data

    return lambda batches: _dealt(rows(batches))


def _documents(numbers, models, slices: int) -> callable:
    """Documents with the losses of their frequent bigrams, and what they ask of other bigrams."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        task = TaskContext.get().partitionId()
        for made, (ids, word, length) in enumerate(_groups(batches)):
            batch = task << 32 | made
            number, (starts, ends) = numbers.value.of_digests(word), _edges(length)
            doc = np.repeat(np.arange(len(ids), dtype=np.uint16), length)
            before = _before(number, starts)
            here = np.flatnonzero((number > 1) & (before != 1))
            known = number > 1
            known[ends] = False
            sums = np.zeros((2, len(ids)))
            for k, m in enumerate(models.value):
                sums[k] += np.bincount(doc[here], m.pair_loss(m.pair[before[here] * np.int64(len(m.word)) + number[here]], m.word[number[here]]), len(ids))
                sums[k] += np.bincount(doc[known], m.history_loss(m.word[number[known]]), len(ids))
                sums[k] += (length > 0) * m.history_loss(m.word[0])
            del before, here, known
            place, flags, each, asked = _asked(word, number, starts, ends, slices)
            for k, data in asked:
                yield k, WORDS, batch, data
            known_id = np.array([x is not None for x in ids], dtype=np.uint8)
            yield batch * 0x9E3779B1 % slices, DOCS, batch, _pack(np.array([x or 0 for x in ids], dtype=np.int64), known_id, length, *sums, each, doc[place], flags)

    return lambda batches: _dealt(rows(batches))


def _score_slice(size: int, target: list[bytes], parts: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Counts of all that is asked for in one slice, by batch: of words, then of bigrams."""
    rows = [_unpack(raw) for raw in [*(raw for _, raw in parts), *target]]
    own = len(parts)
    words = np.concatenate([r[0] for r in rows]).astype(np.uint64)
    _, word_of = np.unique(words, return_inverse=True)

    def counts(key_of: np.ndarray, mine: int, n: np.ndarray | None = None) -> list[np.ndarray]:
        """How often corpus and target have what stands at each of my places."""
        top = int(key_of.max()) + 1 if len(key_of) else 0
        of_both = (np.bincount(key_of[some], None if n is None else n[some], top) for some in (slice(mine), slice(mine, None)))
        return [x.astype(np.int64)[key_of[:mine]] for x in of_both]

    def cut(x: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
        return np.split(x, np.cumsum(sizes)[:-1])

    sizes = [len(r[0]) for r in rows[:own]]
    n = np.concatenate([r[2].astype(np.int64) + r[3] for r in rows])
    answers = [cut(x, sizes) for x in counts(word_of, sum(sizes), n)]
    for j in range(3):
        each = np.concatenate([r[1 + j] for r in rows])
        met = np.concatenate([r[4 + j] for r in rows])
        key = _mix(np.repeat(words, each), met.astype(np.uint64)) if j == 2 else np.repeat(word_of, each) * np.int64(size) + met.astype(np.int64)
        del each, met
        _, key_of = np.unique(key, return_inverse=True)
        del key
        sizes = [len(r[4 + j]) for r in rows[:own]]
        answers += [cut(x, sizes) for x in counts(key_of, sum(sizes))]
    for k, (batch, _) in enumerate(parts):
        yield batch, _pack(rows[k][4], *(x[k] for x in answers))


def _scored(numbers) -> callable:
    """Rows of sorted slices: documents as they are, answers to what was asked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        key, target, parts = None, [], []

        def out() -> Iterator[tuple[int, int, int, bytes]]:
            if parts:
                for batch, data in _score_slice(numbers.value.size, target, parts):
                    yield key, WORDS, batch, data

        for k, kind, batch, raw in _rows(batches):
            if kind == DOCS:
                yield k, kind, batch, raw
                continue
            if k != key:
                yield from out()
                key, target, parts = k, [], []
            if kind == TARGET:
                target.append(raw)
            else:
                parts.append((batch, raw))
        yield from out()

    return lambda batches: _dealt(rows(batches))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])


def _gather(models) -> callable:
    """Documents of the batches' rows, which come sorted: the documents, then answers by slice."""

    def out(raw: bytes, answers: list[list[np.ndarray]]) -> pa.RecordBatch:
        ids, known, n, *sums, each, doc, flags = _unpack(raw)
        n = n.astype(np.int64)
        if answers:
            number, *counts = (np.concatenate(x) for x in zip(*answers))
            after_rare, hot_next, ended = flags & AFTER_RARE > 0, flags & HOT_NEXT > 0, flags & LAST > 0
            for k, m in enumerate(models.value):
                of_word, of_next, of_hot, of_rare = counts[1 - k :: 2]
                count = np.repeat(of_word, each)
                pair = np.empty(len(doc), dtype=np.int64)
                pair[~after_rare], pair[after_rare] = of_hot, of_rare
                loss = m.pair_loss(pair, count) + np.where(ended, 0.0, m.history_loss(count))
                loss[hot_next] += m.pair_loss(of_next, m.word[number])
                sums[k] = sums[k].astype(np.uint64).view(np.float64) + np.bincount(doc, loss, len(ids))
        else:
            sums = [x.astype(np.uint64).view(np.float64) for x in sums]
        mean = [x / np.maximum(n, 1) for x in sums]
        return pa.record_batch([pa.array(ids.astype(np.uint64).view(np.int64), mask=known == 0), pa.array(n), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[0] - mean[1])], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, answers = None, []
        for _, kind, _, raw in _rows(batches):
            if kind == DOCS:
                if docs is not None:
                    yield out(docs, answers)
                docs, answers = raw, []
            else:
                answers.append(_unpack(raw))
        if docs is not None:
            yield out(docs, answers)

    return run


def cross_entropy_difference(docs: DataFrame, target: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for all ``docs``; ``target`` has text
    and is a part of ``docs``."""
    spark = docs.sparkSession
    C.prepare(spark)
    target = C.cut(target.select("text"), "lm-target")
    C.release(spark)
    own = vocabulary(docs, hot)
    numbers = spark.sparkContext.broadcast(own)
    models = spark.sparkContext.broadcast((count_table(target, numbers, own.size), count_table(docs.select("text"), numbers, own.size)))
    C.release(spark)
    n = C.partitions(spark)
    slices = n * max(1, -(-int(models.value[1].word[1]) // (n * SLICE_WORDS)))
    rows = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(_documents(numbers, models, slices), DEALT)
    rows = rows.unionByName(target.mapInArrow(_target(numbers, slices), DEALT))
    sums = rows.repartitionById(n, "slice").sortWithinPartitions("slice", "kind").mapInArrow(_scored(numbers), DEALT)
    out = sums.repartition(n, "batch").sortWithinPartitions("batch", "kind", "slice").mapInArrow(_gather(models), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
    return out


def labelled_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text of all rows of ``docs`` that a label calls good.

    A bitmap of hashed ids, of fixed size, keeps most other texts out of the join's shuffle; the
    join alone decides.
    """
    spark = docs.sparkSession
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    place = F.xxhash64("doc_id").bitwiseAND(BITS - 1)
    rows = good.select((place + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    for r in rows:
        bits[(r.k - 1) << 12 : r.k << 12] = np.frombuffer(r.bits, dtype=np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def may_be(at: pa.Array) -> pa.Array:
        x = at.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    return rows.where(may_be(place)).join(good, "doc_id", "left_semi")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return cross_entropy_difference(docs, labelled_good(docs, C.table(spark, sf_dir, "labels")))
