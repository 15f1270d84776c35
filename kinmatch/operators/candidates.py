"""Key blocks, rank fusion, two-hop expansion, dense neighbours and pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions import text as X

VIEWS = ("na", "nm", "ad", "sk")
MISSING_RANK = 999


# ---- keys
def record_keys(rec: DataFrame) -> DataFrame:
    """(country, src, id, key): a key for every house number with the first core word's skeleton,
    and one of the sorted skeleton of the whole core. Needs ``core``."""
    root = X.skeleton(F.get("core", F.lit(0)))
    root = F.coalesce(F.nullif(root, F.lit("")), F.get("core", F.lit(0)))
    number = F.transform(X.house_numbers(F.col("addr")), lambda n: F.concat(F.lit("n:"), n, F.lit("|"), root))
    sk = F.array_join(F.array_sort(F.filter(F.split(X.skeleton(F.array_join("core", " ")), " "), lambda w: w != "")), " ")
    whole = F.when(sk != "", F.array(F.concat(F.lit("s:"), sk))).otherwise(F.array().cast("array<string>"))
    return rec.where(F.size("core") > 0).select("country", "src", "id", F.explode(F.array_distinct(F.concat(number, whole))).alias("key"))


def key_blocks(pool_keys: DataFrame, max_block: int = 50) -> DataFrame:
    """The first records of every key's block, a top-k a key."""
    w = Window.partitionBy("country", "src", "key").orderBy("id")
    return pool_keys.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_block).drop("_r")


def key_candidates(query_keys: DataFrame, blocks: DataFrame, k: int = 20) -> DataFrame:
    """(country, s1, src, cid): the lowest pool records that share a key."""
    b = blocks.select("country", "key", "src", F.col("id").alias("cid"))
    hit = query_keys.select("country", F.col("id").alias("s1"), "key").join(b, ["country", "key"]).select("country", "s1", "src", "cid").distinct()
    w = Window.partitionBy("country", "s1", "src").orderBy("cid")
    return hit.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


# ---- fusion
def rank_within(df: DataFrame, group: list[str], score: str, tie: list[str], name: str = "rank") -> DataFrame:
    """Ranks from 0, best first."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(F.col(score).desc(), *tie)) - 1)


def fuse(views: dict[str, DataFrame], keys: DataFrame | None, max_per_source: int = 80, rrf_k: int = 60) -> DataFrame:
    """Union of the ranked lists with reciprocal-rank fusion; a pivot by view in one aggregation.

    Key hits add neither to the fused score nor to the number of views; per query and source the
    best ``max_per_source`` stay.
    """
    parts = [df.select("country", "s1", "src", "cid", F.lit(v).alias("view"), "score", "rank") for v, df in views.items()]
    if keys is not None:
        parts.append(keys.select("country", "s1", "src", "cid", F.lit("key").alias("view"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # rows move once, as they are: neither the counts nor the ranks need another exchange
    rows = rows.repartition("country", "s1", "src")
    is_key = F.col("view") == "key"
    aggs = []
    for v in VIEWS:
        mine = F.col("view") == v
        aggs += [F.coalesce(F.max(F.when(mine, F.col("score"))), F.lit(0.0)).alias(f"{v}_score"), F.coalesce(F.min(F.when(mine, F.col("rank"))), F.lit(MISSING_RANK)).alias(f"{v}_rank")]
    aggs += [
        F.max(is_key.cast("int")).alias("key_hit"),
        F.round(F.coalesce(F.sum(F.when(~is_key, 1.0 / (rrf_k + F.col("rank") + 1))), F.lit(0.0)), 9).alias("rrf"),
        F.count_if(~is_key).cast("int").alias("nret"),
    ]
    fused = rows.groupBy("country", "s1", "src", "cid").agg(*aggs)
    w = Window.partitionBy("country", "s1", "src").orderBy(F.col("rrf").desc(), "cid")
    return fused.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_per_source).drop("_r")


# ---- expansion
def two_hop(cand: DataFrame, neighbours: DataFrame, top_seeds: int = 5, per_seed: int = 3) -> DataFrame:
    """New (country, s1, src, cid): neighbours in the other source of a query's best candidates.

    ``neighbours``: (src, cid, n_src, n_cid, n_rank). Pairs already there are left out.
    """
    w = Window.partitionBy("country", "s1").orderBy(F.col("rrf").desc(), "src", "cid")
    seeds = cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_seeds).select("country", "s1", "src", "cid")
    near = neighbours.where(F.col("n_rank") < per_seed)
    new = seeds.join(near, ["src", "cid"]).select("country", "s1", F.col("n_src").alias("src"), F.col("n_cid").alias("cid")).distinct()
    return new.join(cand.select("country", "s1", "src", "cid"), ["country", "s1", "src", "cid"], "left_anti")


def expand_two_hop(cand: DataFrame, neighbours: DataFrame, **how) -> DataFrame:
    """Candidates and the new ones, those with missing scores and ranks."""
    new = two_hop(cand, neighbours, **how)
    whole = cand.unionByName(new, allowMissingColumns=True)
    fill = {c: (MISSING_RANK if c.endswith("_rank") else 0) for c in cand.columns if c not in ("country", "s1", "src", "cid")}
    return whole.fillna(fill)


def union_candidates(*lists: DataFrame) -> DataFrame:
    """Set union by query."""
    out = lists[0].select("s1", "cid")
    for x in lists[1:]:
        out = out.union(x.select("s1", "cid"))
    return out.distinct()


# ---- dense
#: Queries and pool rows of one block; a task holds one of each, and products of some queries.
DENSE_QUERIES, DENSE_POOL, DENSE_ROWS = 1 << 13, 1 << 14, 256


def _vectors(col: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors without nulls, and their matrix."""
    col = col.combine_chunks()
    length = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False).copy()
    bad = pc.list_parent_indices(col).filter(col.flatten().is_null())
    length[bad.to_numpy(zero_copy_only=False)] = -1
    out = {}
    for n in np.unique(length[length >= 0]).tolist():
        at = np.flatnonzero(length == n)
        out[n] = at, col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
    return out


def _best(q: np.ndarray, p: np.ndarray, cids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row of q, cid, score): matrix products tell what may be among the k best; these are added up
    once more from left to right, as a fold over the vector does."""
    s = q @ p.T
    if len(cids) > k:
        last = np.partition(s, -k, axis=1)[:, -k, None]
        row, col = np.nonzero((s >= last - 2e-6 - 1e-9 * np.abs(last)) | ~np.isfinite(s) | ~np.isfinite(last))
    else:
        row, col = (x.ravel() for x in np.indices(s.shape))
    exact = np.zeros(len(row))
    for d in range(q.shape[1]):
        exact += q[row, d] * p[col, d]
    score = np.copysign(np.floor(np.abs(exact) * 1e6 + 0.5) / 1e6, exact) + 0.0
    order = np.lexsort((cids[col], -score, ~np.isnan(score), row))
    row, cid, score = row[order], cids[col][order], score[order]
    first = np.searchsorted(row, np.arange(len(q)))
    top = np.arange(len(row)) - first[row] < k
    return row[top], cid[top], score[top]


def _dense_block(k: int) -> callable:
    def run(queries: pa.Table, pool: pa.Table) -> pa.Table:
        s1, cids = queries["s1"].to_numpy(), pool["cid"].to_numpy()
        got: list[tuple] = []
        if len(s1) and len(cids):
            mine, theirs = _vectors(queries["q"]), _vectors(pool["p"])
            paired = {n: v for n, v in mine.items() if n in theirs}
            met = np.zeros(len(s1), dtype=np.int64)  # pool rows that each query has a product with
            for n, (at, q) in paired.items():
                where, p = theirs[n]
                met[at] = len(where)
                for lo in range(0, len(at), DENSE_ROWS):
                    row, cid, score = _best(q[lo : lo + DENSE_ROWS], p, cids[where], k)
                    got.append((s1[at[lo + row]], cid, score, np.zeros(len(row), dtype=bool)))
            # pairs without a product have no score and come last
            length = {int(i): n for n, (at, _) in paired.items() for i in at} if (met < k).any() else {}
            for i in np.flatnonzero(met < min(k, len(cids))).tolist():
                other = np.sort(np.delete(cids, theirs[length[i]][0]) if i in length else cids)[: k - met[i]]
                got.append((np.full(len(other), s1[i]), other, np.zeros(len(other)), np.ones(len(other), dtype=bool)))
        a, b, c, none = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, dtype=t) for i, t in enumerate(("int64", "int64", "float64", "bool")))
        return pa.table({"s1": pa.array(a), "cid": pa.array(b), "score": pa.array(c, mask=none)})

    return run


def dense_topk(queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(s1, cid, score, rank): exact inner products of a query set against the whole pool.

    Blocks of queries meet blocks of the pool in matrix products, and only each block's k best move.
    Vectors of other lengths or with nulls have no product; such pairs come last.
    """
    n_q, n_p = (max(1, -(-x.count() // size)) for x, size in ((queries, DENSE_QUERIES), (pool, DENSE_POOL)))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.select(F.col("id").cast("long").alias("s1"), F.col("vec").alias("q"), place(n_q).alias("_q")).withColumn("_p", every(n_p))
    p = pool.select(F.col("id").cast("long").alias("cid"), F.col("vec").alias("p"), place(n_p).alias("_p")).withColumn("_q", every(n_q))
    block = (F.col("_q") * n_p + F.col("_p")).alias("block")
    scored = q.select(block, "s1", "q").groupBy("block").cogroup(p.select(block, "cid", "p").groupBy("block")).applyInArrow(_dense_block(k), "s1 long, cid long, score double")
    w = Window.partitionBy("s1").orderBy(F.col("score").desc(), "cid")
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def filter_mined_negatives(df: DataFrame, margin: float = 0.95) -> DataFrame:
    """Negatives whose score stays below ``margin`` times the weakest positive of their query."""
    weakest = F.min(F.when(F.col("y") == 1, F.col("score"))).over(Window.partitionBy("s1"))
    return df.withColumn("_w", weakest).where((F.col("y") == 1) | (F.col("score") < margin * F.col("_w"))).drop("_w")


def collisions(claims: DataFrame, owner: DataFrame, limit: int = 8) -> DataFrame:
    """(a, b): pairs of clusters that a candidate of one and the owner of it put together, both
    ways, at most ``limit`` a cluster."""
    pairs = claims.select(F.col("s1").alias("a"), "src", "cid").join(owner.select("src", "cid", F.col("s1").alias("b")), ["src", "cid"]).where("a <> b").select("a", "b")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    w = Window.partitionBy("a").orderBy("b")
    return both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


# ---- labels and pruning
def label(cand: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidates with y: 1 if the pair is in the truth."""
    t = truth.select("s1", "src", "cid", F.lit(1).alias("_y")).distinct()
    return cand.join(t, ["s1", "src", "cid"], "left").withColumn("y", F.coalesce("_y", F.lit(0))).drop("_y")


def cluster_size(entities: DataFrame, truth: DataFrame) -> DataFrame:
    n = truth.groupBy("s1").agg(F.count("*").alias("size"))
    return entities.join(n, "s1", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))


def distractors(pool: DataFrame, used: DataFrame, keys: tuple[str, ...] = ("src", "cid")) -> DataFrame:
    """Pool records that no truth pair uses."""
    return pool.join(used.select(*keys).distinct(), list(keys), "left_anti")


def prune(scored: DataFrame, min_keep: int = 15, max_keep: int = 60, eps: float = 0.002, group: tuple[str, ...] = ("s1", "src")) -> DataFrame:
    """Per query and source: always the best ``min_keep``, and up to ``max_keep`` of those that
    reach ``eps``."""
    w = Window.partitionBy(*group).orderBy(F.col("p").desc(), "cid")
    keep = (F.col("_r") <= min_keep) | ((F.col("p") >= eps) & (F.col("_r") <= max_keep))
    return scored.withColumn("_r", F.row_number().over(w)).where(keep).drop("_r")
