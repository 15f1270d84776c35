"""Toxicity: a factorization machine over hashed terms.

A text is the set of its hashed terms: lower-cased words without outer punctuation, and their
first 4, 5 and 6 characters, so that inflected forms share a term. The machine adds a weight for
each term and, for each pair of terms, the product of their learned factors; a term that is
harmless alone can thus count next to another, and two that are toxic each alone can be harmless
together.

It is fitted with adaptive steps on log loss over at most ``LABELLED`` labelled documents, rows
whose crc32(doc_id as text) mod 5 is not 0. Every term of at least ``LEAST`` of them takes part;
an L1 penalty within the fit leaves most weights at zero. Weights are fitted first. What they
leave unexplained tells which terms act in pairs: pairs that ``PAIR_LEAST`` texts share and on
which the residuals sum to ``PAIR_SURE`` standard deviations, either way. Terms of such pairs get
factors, and weights and factors are fitted together. No term is judged by what it does alone.

Limits, all of the fit: ``LABELLED`` rows; pairs among the ``PAIR_TERMS`` terms that the most
unexplained texts have.

Edge cases: a null or empty text, or one without known terms, scores the bias alone; one label
class only, or no labels, gives a constant; a repeated row scores again, the same, and equal
scores are equal verdicts (1 from 0.5 on); very long texts are read whole; an empty table gives no
rows; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import common as C
from kinmatch.llm import sparse

LABELLED = 12_000
BUCKETS = 1 << 18
FACTORS = 4
LEAST = 3
#: A text is unexplained from this residual on.
UNEXPLAINED = 0.2
PAIR_LEAST, PAIR_SURE, PAIR_TERMS = 8, 5.0, 8192
#: Terms whose pairs are counted at a time, as a matrix product.
PAIR_BLOCK = 1024
FOLDS, HELD_OUT = 5, 0
KEEP = 300_000
_OUTER = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»¡¿…“”‘’—–"


def term_ids(word: str) -> tuple[int, ...]:
    w = word.lower().strip(_OUTER)
    if not w:
        return ()
    out = [zlib.crc32(w.encode())]
    out += [zlib.crc32(f"{n}^{w[:n]}".encode()) for n in (4, 5, 6) if len(w) >= n]
    return tuple(x % BUCKETS for x in out)


class Terms(dict):
    """Word to its terms, less those that ``known`` lacks."""

    def __init__(self, known: np.ndarray | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KEEP:
            self.clear()
        got = term_ids(word)
        if self.known is not None:
            got = tuple(x for x in got if self.known[x])
        if len(word) <= 64:
            self[word] = got
        return got


def bag(text: str, terms: Terms) -> np.ndarray:
    """The distinct terms of one whole text, in order."""
    ids: set[int] = set()
    for w in set(text.split()):
        ids.update(terms[w])
    return np.array(sorted(ids), dtype=np.int64)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factors: np.ndarray
    known: np.ndarray
    terms: Terms = field(default=None)

    def margin(self, rows: sparse.Rows) -> np.ndarray:
        both = np.concatenate([self.weight[:, None], self.factors, (self.factors**2).sum(axis=1, keepdims=True)], axis=1)
        got = rows.dot(both)
        return self.bias + got[:, 0] + 0.5 * ((got[:, 1:-1] ** 2).sum(axis=1) - got[:, -1])

    def score(self, texts: list[str]) -> np.ndarray:
        if self.terms is None:
            self.terms = Terms(self.known)
            at = np.flatnonzero(self.known)
            self.place = np.zeros(len(self.known), dtype=np.int64)
            self.place[at] = np.arange(len(at))
            self.small = Machine(self.bias, self.weight[at], self.factors[at], None)
        cols = [self.place[bag(t, self.terms)] for t in texts]
        rows = sparse.from_lists(cols, [np.ones(len(c)) for c in cols])
        return 1.0 / (1.0 + np.exp(-np.clip(self.small.margin(rows).astype(np.float64), -30, 30)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("bias", "weight", "factors", "known")} | {"terms": None}


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def _block_of(rows: sparse.Rows, place: np.ndarray, lo: int, width: int) -> np.ndarray:
    """Rows by the columns whose places lie in a block, as a dense matrix of 0 and 1."""
    at = place[rows.col]
    some = (at >= lo) & (at < lo + width)
    x = np.zeros((len(rows), width), dtype=np.float32)
    x[rows.row_of()[some], at[some] - lo] = 1
    return x


def acting_in_pairs(rows: sparse.Rows, width: int, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Columns of pairs on which the residuals of the scores ``p`` sum to ``PAIR_SURE`` deviations.

    Pairs are found among the unexplained rows and then tested over all of them.
    """
    r = (y - p).astype(np.float32)
    odd = np.flatnonzero(np.abs(r) >= UNEXPLAINED)
    part = rows.take(odd)
    count = np.bincount(part.col, minlength=width)
    at = np.flatnonzero((count >= PAIR_LEAST) & (np.bincount(rows.col, minlength=width) < len(rows)))
    at = np.sort(at[np.argsort(-count[at], kind="stable")[:PAIR_TERMS]])
    place = np.full(width, -1)
    place[at] = np.arange(len(at))
    keep = place[rows.col] >= 0
    rows = sparse.Rows(np.concatenate([[0], np.cumsum(keep)])[rows.ptr], rows.col[keep], rows.val[keep])
    part = rows.take(odd)
    spread = (p * (1 - p)).astype(np.float32)[:, None]
    hit = np.zeros(len(at), dtype=bool)
    for lo in range(0, len(at), PAIR_BLOCK):
        left = _block_of(part, place, lo, min(PAIR_BLOCK, len(at) - lo))
        for lo2 in range(lo, len(at), PAIR_BLOCK):
            right = left if lo2 == lo else _block_of(part, place, lo2, min(PAIR_BLOCK, len(at) - lo2))
            i, j = np.nonzero((left.T @ right >= PAIR_LEAST) & (np.abs((left * r[odd, None]).T @ right) >= PAIR_LEAST * UNEXPLAINED))
            one = i + lo < j + lo2
            i, j = i[one], j[one]
            if not len(i):
                continue
            # the same sums over all rows, of the columns of such pairs alone
            a, b = np.unique(i), np.unique(j)
            x = _block_of(rows, place, lo, left.shape[1])[:, a]
            z = _block_of(rows, place, lo2, right.shape[1])[:, b]
            i, j = np.searchsorted(a, i), np.searchsorted(b, j)
            total, var = ((x * r[:, None]).T @ z)[i, j], ((x * spread).T @ z)[i, j]
            sure = np.abs(total) >= PAIR_SURE * np.sqrt(var + 1e-9)
            hit[a[i[sure]] + lo] = True
            hit[b[j[sure]] + lo2] = True
    return at[hit]


def _steps(
    rows: sparse.Rows,
    y: np.ndarray,
    bias: float,
    weight: np.ndarray,
    factors: np.ndarray | None,
    some: np.ndarray | None,
    steps: int,
    rng: np.random.Generator,
    batch: int,
    rate: float,
    sparsity: float,
    ridge: float,
) -> float:
    """Fits weights, and the factors of the columns ``some``, in place; returns the bias."""
    seen_b, seen_w = 1e-8, np.full(len(weight), 1e-8, dtype=np.float32)
    if some is not None:
        place = np.full(len(weight), -1)
        place[some] = np.arange(len(some))
        keep = place[rows.col] >= 0
        paired = sparse.Rows(np.concatenate([[0], np.cumsum(keep)])[rows.ptr], place[rows.col[keep]], rows.val[keep])
        seen_f = np.full(factors.shape, 1e-8, dtype=np.float32)
    for _ in range(-(-steps * batch // max(1, len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            take = order[at : at + batch]
            part = rows.take(take)
            margin = bias + part.dot(weight[:, None])[:, 0]
            if some is not None:
                two = paired.take(take)
                both = two.dot(factors)
                margin = margin + 0.5 * ((both**2).sum(axis=1) - two.dot((factors**2).sum(axis=1, keepdims=True))[:, 0])
            g = ((_probability(margin) - y[take]) / len(take)).astype(np.float32)
            if some is not None:
                row = two.row_of()
                own = np.bincount(two.col, g[row], len(some))
                grad = np.stack([np.bincount(two.col, g[row] * both[row, f], len(some)) for f in range(FACTORS)], axis=1)
                grad = (grad + (ridge - own[:, None]) * factors).astype(np.float32)
                seen_f += grad**2
                factors -= 0.3 * rate * grad / np.sqrt(seen_f)
            grad = np.bincount(part.col, g[part.row_of()], len(weight)).astype(np.float32)
            seen_b += float(g.sum()) ** 2
            bias -= rate * float(g.sum()) / seen_b**0.5
            seen_w += grad**2
            step = rate / np.sqrt(seen_w)
            weight -= step * grad
            weight[:] = np.sign(weight) * np.maximum(np.abs(weight) - step * sparsity, 0)
    return bias


def fit_bags(
    cols: list[np.ndarray],
    y: np.ndarray,
    steps: int = 1000,
    pair_steps: int = 1000,
    batch: int = 128,
    rate: float = 0.5,
    sparsity: float = 1e-3,
    ridge: float = 1e-4,
    seed: int = 5,
) -> Machine:
    whole = np.concatenate([*cols, np.zeros(0, dtype=np.int64)])
    known = np.bincount(whole, minlength=BUCKETS) >= LEAST
    width = int(known.sum())
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    bias = float(np.log(share / (1 - share)))
    weight = np.zeros(BUCKETS, dtype=np.float32)
    factors = np.zeros((BUCKETS, FACTORS), dtype=np.float32)
    if 0 < y.sum() < len(y) and width:
        place = np.cumsum(known) - 1
        cols = [place[c[known[c]]] for c in cols]
        rows = sparse.from_lists(cols, [np.ones(len(c)) for c in cols])
        rng = np.random.default_rng(seed)
        w = np.zeros(width, dtype=np.float32)
        bias = _steps(rows, y, bias, w, None, None, steps, rng, batch, rate, sparsity, ridge)
        some = acting_in_pairs(rows, width, y, _probability(bias + rows.dot(w[:, None])[:, 0]))
        if len(some):
            v = rng.normal(0, 0.1, (len(some), FACTORS)).astype(np.float32)
            bias = _steps(rows, y, bias, w, v, some, pair_steps, rng, batch, rate, sparsity, ridge)
            factors[np.flatnonzero(known)[some]] = v
        weight[known] = w
    return Machine(bias, weight, factors, (weight != 0) | (factors != 0).any(axis=1))


def fit(texts: list[str], y: np.ndarray, **how) -> Machine:
    terms = Terms()
    return fit_bags([bag(t, terms) for t in texts], y, **how)


def labelled_bags(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, y, terms) of the sample: distinct terms, not texts, go to the driver."""
    sample = C.labelled(docs, labels, "toxic", limit, C.crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            bags = [bag(t, terms).astype(np.int32) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(bags, pa.list_(pa.int32()))], names=["doc_id", "y", "terms"])

    return sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "text").mapInArrow(run, "doc_id long, y int, terms array<int>")


def fit_labels(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Machine:
    C.prepare(docs.sparkSession)
    rows = labelled_bags(docs, labels, limit).toArrow().sort_by("doc_id")
    return fit_bags([x.values.to_numpy().astype(np.int64) for x in rows["terms"]], rows["y"].to_numpy().astype(np.float64))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Machine, held_out) -> DataFrame:
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


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = fit_labels(docs, C.table(spark, sf_dir, "labels"))
    return score(docs, model, C.crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT)
