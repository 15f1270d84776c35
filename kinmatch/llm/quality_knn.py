"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

A text is a bag of hashed terms: its words, the shapes of its words (runs of lower case, upper
case and digits reduced to one character each), and terms for the tenth in which each of its shares
of repeated neighbours, distinct words and repeated lines lies.
Log term frequencies times the inverse document frequencies of the training sample are projected
on the leading singular vectors of that sample. The labelled vectors are broadcast; blocks of
documents are multiplied with all of them, exact cosines throughout, and the ``NEIGHBOURS``
nearest vote with their similarity as weight. Labelled documents that tie for the last places share
them, so neither their order nor that of the blocks matters.

The training sample has at most ``LABELLED`` documents, all of them rows whose crc32(doc_id as
text) mod 3 is not 1; its size bounds the broadcast. Scores use the text alone.

Edge cases: a null or empty text, or one without any known term, scores the share of label 1 in
the sample (0.5 without labels); a repeated row scores again, the same; very long texts are read
whole; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import common as C
from kinmatch.llm import sparse

LABELLED = 3_000
BUCKETS = 1 << 15
DIMENSIONS = 48
NEIGHBOURS = 15
FOLDS, HELD_OUT = 3, 1
#: Words whose term numbers a worker keeps.
KEEP = 300_000

_RUNS = ((re.compile(r"[^\W\d_A-Z]+"), "x"), (re.compile(r"[A-Z]+"), "X"), (re.compile(r"\d+"), "9"), (re.compile(r"(\W)\1+"), r"\1\1"))


def shape(word: str) -> str:
    for pattern, to in _RUNS:
        word = pattern.sub(to, word)
    return word


class Terms(dict):
    """Word to (bucket of the word, bucket of its shape)."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= KEEP:
            self.clear()
        got = (zlib.crc32(word.lower().encode()) % BUCKETS, zlib.crc32(b"\0" + shape(word).encode()) % BUCKETS)
        if len(word) <= 64:
            self[word] = got
        return got


#: How often a share counts as a term.
SHARE_WEIGHT = 20


def bag(text: str, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and log term frequencies of one whole text."""
    words = text.split()
    count: Counter[int] = Counter()
    for w, n in Counter(words).items():
        a, b = terms[w]
        count[a] += n
        count[b] += n
    if words:
        lines = [x for x in text.split("\n") if x]
        shares = {
            "again": sum(map(str.__eq__, words, words[1:])) / len(words),
            "distinct": len(set(words)) / len(words),
            "lines": 1 - len(set(lines)) / max(1, len(lines)),
        }
        for name, x in shares.items():
            count[zlib.crc32(f"\0\0{name}{int(10 * x)}".encode()) % BUCKETS] += SHARE_WEIGHT
    col = np.fromiter(count.keys(), dtype=np.int64, count=len(count))
    val = np.fromiter(count.values(), dtype=np.float32, count=len(count))
    return col, np.log1p(val)


@dataclass
class Neighbours:
    """Fitted model; everything in it is bounded by LABELLED, BUCKETS and DIMENSIONS."""

    idf: np.ndarray
    axes: np.ndarray  # bucket to latent dimensions
    vectors: np.ndarray  # labelled documents, of length 1
    y: np.ndarray
    prior: float
    terms: Terms = field(default_factory=Terms)

    def embed(self, texts: list[str]) -> np.ndarray:
        bags = [bag(t, self.terms) for t in texts]
        rows = sparse.from_lists([c for c, _ in bags], [v for _, v in bags])
        rows.val = rows.val * self.idf[rows.col]
        return _unit(rows.dot(self.axes))

    def score(self, texts: list[str], block: int = 256) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.y):
            return out
        vectors = self.embed(texts)
        k = min(NEIGHBOURS, len(self.y))
        for at in range(0, len(texts), block):
            v = vectors[at : at + block]
            cosine = v @ self.vectors.T
            # all labelled documents as near as the k-th share the places that are left
            last = np.partition(cosine, len(self.y) - k, axis=1)[:, [len(self.y) - k]]
            nearer, tied = cosine > last, cosine == last
            places = nearer + tied * ((k - nearer.sum(axis=1)) / tied.sum(axis=1))[:, None]
            weight = places * np.maximum(cosine, 0.0)
            total = weight.sum(axis=1)
            ok = total > 1e-6
            out[at : at + block][ok] = np.clip((weight @ self.y)[ok] / total[ok], 0.0, 1.0)
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"terms": Terms()}


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-9)


def fit(texts: list[str], y: np.ndarray, **how) -> Neighbours:
    terms = Terms()
    return fit_bags([bag(t, terms) for t in texts], y, **how)


def fit_bags(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7) -> Neighbours:
    """Truncated SVD of the weighted bags by subspace iteration."""
    rows = sparse.from_lists([c for c, _ in bags], [v for _, v in bags])
    df = np.bincount(rows.col, minlength=BUCKETS)
    idf = (np.log((len(bags) + 1) / (df + 1)) * (df > 1)).astype(np.float32)
    rows.val = rows.val * idf[rows.col]
    d = max(1, min(dimensions, len(bags)))
    if not len(bags):
        return Neighbours(idf, np.zeros((BUCKETS, d), np.float32), np.zeros((0, d), np.float32), np.zeros(0), 0.5)
    back = rows.transposed(BUCKETS)
    basis = np.random.default_rng(seed).standard_normal((BUCKETS, d)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(back.dot(rows.dot(basis)))
    axes = basis.astype(np.float32)
    vectors = _unit(rows.dot(axes))
    return Neighbours(idf, axes, vectors, y.astype(np.float64), float(y.mean()))


def labelled_bags(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, y, terms, values) of the sample: at most ``BUCKETS`` terms a document go to the
    driver, not texts."""
    sample = C.labelled(docs, labels, "quality", limit, C.crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            bags = [bag(t, terms) for t in b.column(2).to_pylist()]
            columns = [pa.array([c.astype(np.int32) for c, _ in bags], pa.list_(pa.int32())), pa.array([v for _, v in bags], pa.list_(pa.float32()))]
            yield pa.record_batch([b.column(0), b.column(1), *columns], names=["doc_id", "y", "terms", "values"])

    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "text")
    return rows.mapInArrow(run, "doc_id long, y int, terms array<int>, values array<float>")


def fit_labels(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Neighbours:
    C.prepare(docs.sparkSession)
    rows = labelled_bags(docs, labels, limit).toArrow().sort_by("doc_id")
    bags = [(c.values.to_numpy().astype(np.int64), v.values.to_numpy()) for c, v in zip(rows["terms"], rows["values"])]
    return fit_bags(bags, rows["y"].to_numpy().astype(np.float64))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Neighbours, held_out) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    C.prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.score([t or "" for t in b.column(2).to_pylist()])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=_SCHEMA)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = fit_labels(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, model, C.crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT)
