"""TF-IDF views, query pruning, and ranked retrieval by products of sparse blocks.

Country and source are columns of every key: one plan serves all partitions. A cap on document
frequency bounds the work a term makes; queries keep their rarest terms within a budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions import text as X
from kinmatch.sources import working

#: Records and queries of one block; a task holds one of each.
POOL_BLOCK, QUERY_BLOCK = 1 << 15, 1 << 15
#: Terms that a task holds before it hands on their lists.
SLICE = 2_000_000


@dataclass(frozen=True)
class ViewSpec:
    """What a view indexes and its caps."""

    name: str
    view: str
    kind: str = "char+word"
    n: int = 4
    max_df_abs: int = 20_000
    max_df_frac: float = 0.02
    min_df: int = 2


#: The four views with their caps.
SPECS = (
    ViewSpec("na", "index"),
    ViewSpec("nm", "name"),
    ViewSpec("ad", "addr"),
    ViewSpec("sk", "skeleton", kind="char", n=3, max_df_abs=200_000, max_df_frac=0.03),
)


@dataclass(frozen=True)
class BlockingConfig:
    k: int = 30
    k_keys: int = 20
    max_per_source: int = 80
    rrf_k: int = 60
    budget: int = 60_000
    min_query_terms: int = 6
    max_query_terms: int = 96
    prune_min: int = 15
    prune_max: int = 60
    prune_eps: float = 0.002

    def fingerprint(self, specs: tuple[ViewSpec, ...] = SPECS) -> str:
        """Identity of a result path: changes with every knob."""
        import hashlib

        return hashlib.sha256(repr((self, specs)).encode()).hexdigest()[:16]


def terms(rec: DataFrame, spec: ViewSpec) -> DataFrame:
    """(country, src, id, term, tf)."""
    view = X.make_view(spec.view, F.col("name"), F.col("addr"))
    rows = rec.select("country", "src", "id", view.alias("v")).select("country", "src", "id", F.explode(X.analyse(F.col("v"), spec.kind, spec.n)).alias("term"))
    return rows.groupBy("country", "src", "id", "term").agg(F.count("*").alias("tf"))


def vocabulary(pool: DataFrame, rec: DataFrame, spec: ViewSpec) -> DataFrame:
    """(country, src, term, df, idf) of the terms within the caps; all of them where none is."""
    return _capped(pool.groupBy("country", "src", "term").agg(F.count("*").alias("df")), rec, spec)


def _capped(df: DataFrame, rec: DataFrame, spec: ViewSpec) -> DataFrame:
    part = ["country", "src"]
    n = rec.where("src > 1").groupBy(*part).agg(F.count("*").alias("n"))
    df = df.join(F.broadcast(n), part)
    cap = F.least(F.lit(spec.max_df_abs), F.greatest(F.lit(1), F.floor(spec.max_df_frac * F.col("n"))))
    ok = (F.col("df") >= spec.min_df) & (F.col("df") <= cap)
    some = df.groupBy(*part).agg(F.max(ok).alias("some"))
    kept = df.join(F.broadcast(some), part).where(ok | ~F.col("some"))
    return kept.select(*part, "term", "df", (F.ln(F.col("n") / F.col("df")) + 1).alias("idf"))


def postings(pool: DataFrame, vocab: DataFrame) -> DataFrame:
    """(country, src, id, term, w): unit vectors of (1 + ln tf) idf, after the caps."""
    raw = pool.join(vocab, ["country", "src", "term"]).withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    norm = raw.groupBy("country", "src", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, ["country", "src", "id"]).select("country", "src", "id", "term", (F.col("w") / F.col("norm")).alias("w"))


def query_vectors(queries: DataFrame, vocab: DataFrame, budget: int, min_terms: int = 6, max_terms: int = 96) -> DataFrame:
    """(country, s1, src, term, df, w): each query against each source's vocabulary, rare terms
    first while the sum of their frequencies keeps the budget, at least ``min_terms``; unit length
    after pruning."""
    j = queries.select("country", F.col("id").alias("s1"), "term", "tf").join(vocab, ["country", "term"])
    w = Window.partitionBy("country", "s1", "src").orderBy("df", "term")
    run = j.withColumn("rn", F.row_number().over(w)).withColumn("cum", F.sum("df").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = run.where((F.col("rn") <= min_terms) | ((F.col("cum") <= budget) & (F.col("rn") <= max_terms)))
    raw = kept.withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("country", "s1", "src")))
    return raw.select("country", "s1", "src", "term", "df", (F.col("w") / norm).alias("w"))


def _sizes(rows: DataFrame, by: list[str], key: str, size: int, name: str) -> DataFrame:
    """(by..., name): in how many blocks of about ``size`` keys the rows of a part fall."""
    return F.broadcast(rows.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.approx_count_distinct(key) / size)).cast("int").alias(name)))


def _best(k: int, s1: np.ndarray, term: np.ndarray, w: np.ndarray, cids: np.ndarray, row: np.ndarray, at: np.ndarray, weight: np.ndarray, terms: int) -> tuple[np.ndarray, ...]:
    """(s1, cid, score) of the k nearest records for each query: rows (s1, term, w) that follow each
    other by query, against rows (row, at, weight) of the records ``cids``; ``term`` and ``at`` are
    numbers below ``terms``. What a query does not meet is no pair."""
    order = np.argsort(at, kind="stable")
    row, weight, ends = row[order], weight[order], np.searchsorted(at[order], np.arange(terms + 1))
    got: list[tuple[np.ndarray, ...]] = []
    first = np.flatnonzero(np.diff(s1, prepend=s1[:1] - 1))
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(s1)]):
        spans = [(ends[x], ends[x + 1]) for x in term[lo:hi].tolist()]
        met = np.concatenate([row[a:b] for a, b in spans])
        score = np.bincount(met, np.concatenate([weight[a:b] * x for (a, b), x in zip(spans, w[lo:hi].tolist())]), minlength=len(cids))
        # weights are positive; a margin keeps what rounding makes equal to the last
        least = np.partition(score, -k)[-k] - 2e-6 if len(score) > k else 0.0
        near = np.flatnonzero((score > 0) & (score >= least))
        rounded = np.floor(score[near] * 1e6 + 0.5) / 1e6
        best = np.lexsort((cids[near], -rounded))[:k]
        got.append((np.full(len(best), s1[lo]), cids[near[best]], rounded[best]))
    return tuple(np.concatenate([g[i] for g in got]) if got else np.zeros(0, dtype=t) for i, t in enumerate(("int64", "int64", "float64")))


def _near_table(key: tuple, s1: np.ndarray, cid: np.ndarray, score: np.ndarray) -> pa.Table:
    src, _, _, country = key[0].as_py().split("|", 3)
    return pa.table({"country": pa.array([country] * len(s1), pa.string()), "s1": s1, "src": pa.array(np.full(len(s1), int(src)), pa.int32()), "cid": cid, "score": score})


_NEAR = "country string, s1 long, src int, cid long, score double"
_NONE = np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"), np.zeros(0)


def _known(terms: pa.Array, of: pa.Array) -> np.ndarray:
    """The places of terms among others, -1 for what is not there."""
    return pc.fill_null(pc.index_in(terms, value_set=of), -1).to_numpy(zero_copy_only=False)


def _nearest(k: int) -> callable:
    """The k nearest records of a block for each query of a block, from rows of weights."""

    def run(key, queries: pa.Table, pool: pa.Table) -> pa.Table:
        if not queries.num_rows or not pool.num_rows:
            return _near_table(key, *_NONE)
        cids, row = np.unique(pool["cid"].to_numpy(), return_inverse=True)
        terms = pool["term"].combine_chunks().dictionary_encode()
        known = _known(queries["term"].combine_chunks(), terms.dictionary)
        some = np.flatnonzero(known >= 0)
        some = some[np.argsort(queries["s1"].to_numpy()[some], kind="stable")]
        return _near_table(key, *_best(k, queries["s1"].to_numpy()[some], known[some], queries["w"].to_numpy()[some], cids, row, terms.indices.to_numpy(), pool["pw"].to_numpy(), len(terms.dictionary)))

    return run


def _postings_of(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, and by posting: place of the term, list it is from, id, weight before its norm)."""
    terms = t["term"].combine_chunks().dictionary_encode()
    ids, tfs = t["ids"].combine_chunks(), t["tfs"].combine_chunks()
    of = np.repeat(np.arange(len(ids)), pc.list_value_length(ids).to_numpy())
    w = (1 + np.log(tfs.flatten().to_numpy())) * t["idf"].to_numpy()[of]
    return terms.dictionary, terms.indices.to_numpy()[of], of, ids.flatten().to_numpy(), w


def _nearest_of_lists(k: int, budget: int, min_terms: int, max_terms: int) -> callable:
    """The same from lists (term, idf, ids, tfs) of a block: queries are pruned and all vectors
    brought to unit length where they meet, as a block has all terms of its records."""

    def run(key, queries: pa.Table, pool: pa.Table) -> pa.Table:
        if not queries.num_rows or not pool.num_rows:
            return _near_table(key, *_NONE)
        words, term, of, s1, w = _postings_of(queries)
        place = np.empty(len(words), dtype=np.int64)
        place[pc.array_sort_indices(words).to_numpy()] = np.arange(len(words))
        df = queries["df"].to_numpy()[of]
        order = np.lexsort((place[term], df, s1))
        term, s1, w, df = term[order], s1[order], w[order], df[order]
        first = np.flatnonzero(np.diff(s1, prepend=s1[0] - 1))
        group = np.repeat(np.arange(len(first)), np.diff(first, append=len(s1)))
        total = np.cumsum(df)
        rn, cum = np.arange(len(s1)) - first[group] + 1, total - (total - df)[first][group]
        kept = (rn <= min_terms) | ((cum <= budget) & (rn <= max_terms))
        term, s1, w, group = term[kept], s1[kept], w[kept], group[kept]
        w = w / np.sqrt(np.bincount(group, w * w))[group]
        theirs, at, _, ids, pw = _postings_of(pool)
        known = _known(words, theirs)[term]
        cids, row = np.unique(ids, return_inverse=True)
        pw = pw / np.sqrt(np.bincount(row, pw * pw))[row]
        some = known >= 0
        return _near_table(key, *_best(k, s1[some], known[some], w[some], cids, row, at, pw, len(theirs)))

    return run


def _ranked(dot: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("country", "s1", "src").orderBy(F.col("score").desc(), "cid")
    return dot.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def top_k(qv: DataFrame, post: DataFrame, k: int) -> DataFrame:
    """(country, s1, src, cid, score, rank): the k nearest of each source; ranks from 0.

    Blocks of queries meet blocks of the pool of their country and source, so pairs are counted
    where they arise and only each block's k nearest move.
    """
    part = ["country", "src"]
    pools, asked = _sizes(post, part, "id", POOL_BLOCK, "_np"), _sizes(qv, part, "s1", QUERY_BLOCK, "_nq")
    side = lambda rows: rows.join(pools, part).join(asked, part)
    place = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = side(post).withColumn("_p", place("id", "_np")).withColumn("_q", each("_nq"))
    q = side(qv).withColumn("_q", place("s1", "_nq")).withColumn("_p", each("_np"))
    block = F.concat_ws("|", "src", "_p", "_q", "country").alias("block")
    p = p.select(block, F.col("id").alias("cid"), F.col("term").alias("term"), F.col("w").alias("pw")).groupBy("block")
    q = q.select(block, *[F.col(c).alias(c) for c in ("s1", "term", "w")]).groupBy("block")
    return _ranked(q.cogroup(p).applyInArrow(_nearest(k), _NEAR), k)


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (country, src, part, term, ids, tfs) from records (country, src, part, id, terms), a row
    a term of each slice of ``SLICE`` terms."""
    names = ("country", "src", "part")
    held: list[pa.RecordBatch] = []

    def lists() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        words = t["terms"].combine_chunks()
        row, term = pc.list_parent_indices(words).to_numpy(), words.flatten().dictionary_encode()
        parts = pc.binary_join_element_wise(t["src"].cast(pa.string()), t["part"].cast(pa.string()), t["country"], "|").combine_chunks().dictionary_encode().indices.to_numpy()
        # postings by part, term and record, each once with its count
        key, tf = _counted(parts[row], term.indices.to_numpy(), row)
        new = np.flatnonzero((np.diff(key[0], prepend=-1) != 0) | (np.diff(key[1], prepend=-1) != 0))
        ends = pa.array(np.append(new, len(tf)), pa.int32())
        at = pa.array(key[2][new])
        return pa.record_batch(
            [
                *[t[n].combine_chunks().take(at) for n in names], term.dictionary.take(pa.array(key[1][new])),
                pa.ListArray.from_arrays(ends, pa.array(t["id"].to_numpy()[key[2]], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())),
            ],
            names=[*names, "term", "ids", "tfs"],
        )

    size = 0
    for b in batches:
        held.append(b)
        size += len(b.column(4).flatten())
        if size >= SLICE:
            yield lists()
            size = 0
    if size:
        yield lists()


def _counted(part: np.ndarray, term: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (part, term, row) in order, as three rows, and how often each occurs."""
    order = np.lexsort((row, term, part))
    key = np.stack([part[order], term[order], row[order]])
    new = np.flatnonzero(np.append(True, (np.diff(key, axis=1) != 0).any(axis=0)))
    return key[:, new], np.diff(new, append=len(order))


def retrieve(rec: DataFrame, spec: ViewSpec, k: int, budget: int = 60_000, min_terms: int = 6, max_terms: int = 96) -> DataFrame:
    """One view end to end: what ``terms``, ``vocabulary``, ``query_vectors``, ``postings`` and
    ``top_k`` give in turn. Texts move once, to bring rows of one id together; then only lists
    of ids by term, to the vocabulary and to the blocks, never a row for each posting."""
    spark = rec.sparkSession
    rec = rec.where("src >= 1")
    size = F.when(F.col("src") == 1, QUERY_BLOCK).otherwise(POOL_BLOCK)
    sizes = working.cut(rec.groupBy("country", "src").agg(F.count("*").alias("n")).select("country", "src", F.ceil(F.col("n") / size).cast("int").alias("parts")), "sizes")
    # terms lie within words, so the texts of rows that share an id make one text
    view = X.make_view(spec.view, F.col("name"), F.col("addr")).alias("v")
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    texts = rec.select("country", "src", "id", view).repartition(spread, "country", "src", "id").groupBy("country", "src", "id").agg(F.concat_ws(" ", F.collect_list("v")).alias("v"))
    bags = texts.join(F.broadcast(sizes), ["country", "src"]).select("country", "src", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").cast("long").alias("id"), X.analyse(F.col("v"), spec.kind, spec.n).alias("terms"))
    lists = working.cut(bags.mapInArrow(_inverted, "country string, src int, part int, term string, ids array<long>, tfs array<int>"), "lists")
    pool = lists.where("src > 1")
    vocab = working.cut(_capped(pool.groupBy("country", "src", "term").agg(F.sum(F.size("ids")).alias("df")), rec, spec), "vocabulary")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked, pools = sizes.where("src = 1").select("country", F.col("parts").alias("n")), sizes.where("src > 1").select("country", "src", F.col("parts").alias("n"))
    p = pool.join(vocab.drop("df"), ["country", "src", "term"]).join(F.broadcast(asked), "country").select("*", F.col("part").alias("_p"), each("n").alias("_q"))
    q = lists.where("src = 1").drop("src").join(vocab, ["country", "term"]).join(F.broadcast(pools), ["country", "src"]).select("*", F.col("part").alias("_q"), each("n").alias("_p"))
    block = F.concat_ws("|", "src", "_p", "_q", "country").alias("block")
    p = p.select(block, *[F.col(c).alias(c) for c in ("term", "idf", "ids", "tfs")]).groupBy("block")
    q = q.select(block, *[F.col(c).alias(c) for c in ("term", "df", "idf", "ids", "tfs")]).groupBy("block")
    return _ranked(q.cogroup(p).applyInArrow(_nearest_of_lists(k, budget, min_terms, max_terms), _NEAR), k)
