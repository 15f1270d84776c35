"""Families, folds, samples, roles and weights of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions import text as X

FOLDS = 5
ROLES = {0: "val", 1: "m1", 2: "m1", 3: "pre"}


def families(rec: DataFrame) -> DataFrame:
    """(country, id, family, fold): records of one name skeleton share a family and a fold."""
    words = F.filter(F.split(X.skeleton(F.array_join("core", " ")), " "), lambda w: w != "")
    key = F.array_join(F.array_sort(words), " ")
    key = F.coalesce(F.nullif(key, F.lit("")), F.nullif(X.skeleton(F.col("name")), F.lit("")), F.lit("<empty>"))
    return rec.select("country", "id", key.alias("family")).withColumn("fold", (X.stable_hash(F.col("family")) % FOLDS).cast("int"))


def roles(fam: DataFrame, cut: int = 500) -> DataFrame:
    """(country, id, role): folds 1 and 2 fit the first model, 3 the pre-ranker, 0 validates;
    fold 4 is split by family between the second model and the calibrator."""
    of = F.lit(None).cast("string")
    for fold, role in ROLES.items():
        of = F.when(F.col("fold") == fold, role).otherwise(of)
    last = F.when(X.stable_hash(F.col("family")) % 1000 < cut, "m2").otherwise("cal")
    return fam.select("country", "id", F.when(F.col("fold") == 4, last).otherwise(of).alias("role"))


def fold_ids(fam: DataFrame, *folds: int) -> DataFrame:
    return fam.where(F.col("fold").isin(*folds)).select("country", "id")


def sample_ids(ids: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n ids of each country in the order of a seeded hash."""
    w = Window.partitionBy("country").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "id").cast("binary")), "id")
    return ids.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def sample_by_family(fam: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Whole families in seeded order until a country has n records; overshoots by one family."""
    size = fam.groupBy("country", "family").agg(F.count("*").alias("m"))
    w = Window.partitionBy("country").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "family").cast("binary")), "family").rowsBetween(Window.unboundedPreceding, -1)
    taken = size.withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0))).where(F.col("before") < n)
    return fam.join(taken.select("country", "family"), ["country", "family"], "left_semi")


def holdout_by_entity(df: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """``held``: all rows of an entity fall on one side."""
    return df.withColumn("held", F.pmod(F.xxhash64("s1", F.lit(seed)), F.lit(10_000)) < int(share * 10_000))


def loco_pairs(countries: DataFrame) -> DataFrame:
    """(train, score): ordered pairs of different countries; one row a country goes in."""
    a, b = countries.select(F.col("country").alias("train")), countries.select(F.col("country").alias("score"))
    return a.join(b, F.col("train") != F.col("score"))


def test_mix_weights(test: DataFrame, known: DataFrame) -> DataFrame:
    """(country, weight): shares of known countries; all others together as LOCO."""
    n = test.groupBy("country").agg(F.count("*").alias("n"))
    named = n.join(known.select("country", F.lit(True).alias("_k")), "country", "left")
    label = F.when(F.col("_k"), F.col("country")).otherwise("LOCO")
    per = named.groupBy(label.alias("country")).agg(F.sum("n").alias("n"))
    return per.select("country", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("weight"))


def reweighted_score(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: the mean of the scores that exist under the weights, plain mean if no weight fits."""
    j = scores.join(weights, "country", "left").where(F.col("score").isNotNull())
    return j.agg(F.coalesce(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum(F.when(F.col("weight").isNotNull(), F.col("weight")))), F.avg("score")).alias("score"))


def build_slice(queries: DataFrame, truth: DataFrame, pool: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """Pool of a small retrieval problem: all matches of the queries, then distractors in seeded
    order up to ``size``."""
    need = truth.join(queries.select("s1"), "s1", "left_semi").select("src", "cid").distinct()
    inside = pool.join(need, ["src", "cid"], "left_semi").withColumn("_o", F.lit(""))
    outside = pool.join(need, ["src", "cid"], "left_anti").withColumn("_o", F.md5(F.concat_ws(":", F.lit(seed), "src", "cid").cast("binary")))
    return inside.unionByName(outside).orderBy("_o", "src", "cid").limit(size).drop("_o")
