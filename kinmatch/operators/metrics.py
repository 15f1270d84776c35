"""Scores of decisions, candidate lists and probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions import text as X


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F of beta 0.5 from counts; two empty sets score 1."""
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when((n_pred == 0) | (n_true == 0), 0.0).otherwise(1.25 * tp / (0.25 * n_true + n_pred))


def truth_sizes(claims: DataFrame) -> DataFrame:
    return claims.groupBy("country", "s1").agg(F.sum("y").cast("long").alias("n_true"))


def entity_counts(entities: DataFrame, predicted: DataFrame, truth_size: DataFrame) -> DataFrame:
    """(country, s1, n_pred, tp, n_true, f05) for every entity, those without any row included."""
    per = predicted.groupBy("country", "s1").agg(F.count("*").alias("n_pred"), F.sum("y").cast("long").alias("tp"))
    whole = entities.join(per, ["country", "s1"], "left").join(truth_size, ["country", "s1"], "left").fillna(0)
    return whole.withColumn("f05", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def matching_report(counts: DataFrame, *by: str) -> DataFrame:
    """Macro F, micro precision and recall, singleton accuracy and sizes, by any columns."""
    single = F.col("n_true") == 0
    return counts.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("f05").alias("macro_f05"),
        F.try_divide(F.sum("tp"), F.sum("n_pred")).alias("micro_precision"),
        F.try_divide(F.sum("tp"), F.sum("n_true")).alias("micro_recall"),
        F.count_if(single).alias("singletons"),
        F.avg(F.when(single, (F.col("n_pred") == 0).cast("double"))).alias("singleton_accuracy"),
        F.avg("n_pred").alias("avg_pred"),
    )


def size_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").when(n <= 5, "4-5").otherwise("6+")


def segment_report(counts: DataFrame) -> DataFrame:
    return matching_report(counts.withColumn("bucket", size_bucket(F.col("n_true"))), "country", "bucket")


def blocking_report(entities: DataFrame, cand: DataFrame, truth: DataFrame, pool_size: int) -> DataFrame:
    """Pair recall, full-cluster recall, mean list, best F within reach, reduction ratio."""
    hit = truth.join(cand.select("s1", "src", "cid").distinct().withColumn("_h", F.lit(1)), ["s1", "src", "cid"], "left")
    per_truth = hit.groupBy("s1").agg(F.count("*").alias("n_true"), F.count("_h").alias("tp"))
    per_cand = cand.groupBy("s1").agg(F.count("*").alias("n_cand"))
    whole = entities.select("s1").join(per_truth, "s1", "left").join(per_cand, "s1", "left").fillna(0)
    ceiling = f05(F.col("tp"), F.col("tp"), F.col("n_true"))
    return whole.agg(
        F.try_divide(F.sum("tp"), F.sum("n_true")).alias("pair_recall"),
        F.avg(F.when(F.col("n_true") > 0, (F.col("tp") == F.col("n_true")).cast("double"))).alias("full_cluster_recall"),
        F.avg("n_cand").alias("avg_candidates"),
        F.avg(ceiling).alias("f05_ceiling"),
        (1 - F.sum("n_cand") / (F.count("*") * F.lit(pool_size))).alias("reduction_ratio"),
    )


def recall_at_k(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, hits, total, recall) of ranked lists."""
    j = truth.join(ranked.select("s1", "cid", "rank"), ["s1", "cid"], "left")
    one = j.agg(F.count("*").alias("total"), *[F.count_if(F.col("rank") < k).alias(f"h{k}") for k in ks])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])
    return one.select("total", F.explode(rows).alias("x")).select("x.k", "x.hits", "total", F.try_divide("x.hits", "total").alias("recall"))


def _bins(scored: DataFrame, bins: int) -> DataFrame:
    return scored.withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    return _bins(scored, bins).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("mean_p"), F.round(F.avg("y"), 4).alias("share_positive"))


def expected_calibration_error(scored: DataFrame, bins: int = 20) -> DataFrame:
    per = _bins(scored, bins).groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return per.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def number_relation(a: Column, b: Column) -> Column:
    """0 missing, 1 shared, 2 one cut short, 3 within 2, 4 within 20, 5 other."""

    def cut(x: Column) -> Column:
        long = lambda y: (F.length(x) > 1) & (F.length(y) > 1)
        ends = lambda y: F.endswith(x, y) | F.endswith(y, x) | F.startswith(x, y) | F.startswith(y, x)
        return F.exists(b, lambda y: long(y) & ends(y))

    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), 0)
        .when(F.arrays_overlap(a, b), 1)
        .when(F.exists(a, cut), 2)
        .when(min_gap(a, b) <= 2, 3)
        .when(min_gap(a, b) <= 20, 4)
        .otherwise(5)
    )


def min_gap(a: Column, b: Column) -> Column:
    """Smallest difference of two lists of digit runs, by their first nine digits."""
    number = lambda x: F.substring(x, 1, 9).cast("long")
    return F.array_min(F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: F.abs(number(x) - number(y))))))


# The names of the patterns, those of numbers by their relation (0 to 5).
NUMBER_PATTERNS = (
    "no house number on one side",
    None,
    "house number truncated (1447 -> 447)",
    "house numbers differ by 1-2 (same street, next door)",
    "house numbers differ by 3-20 (same street, a few doors away)",
    "house numbers unrelated",
)
ADDRESS_PATTERN = "missing address on one side"
SCRIPT_PATTERN, DOMAIN_PATTERN = "native-script name", "domain-style name"
#: By how names overlap: the same words, none in common, at most two apart, else.
WORD_PATTERNS = ("identical name, same number", "no shared name token", "name differs by a legal form or one token", "name partly overlapping")


def error_pattern(qn: Column, qa: Column, cn: Column, ca: Column) -> Column:
    """Why a pair is hard: what its addresses, else its numbers, else its names say.

    Each of the three looks at both sides at once and is null if it has nothing to say.
    """
    either = lambda test, *sides: F.exists(F.array(*sides), test)
    address = F.when(either(lambda x: F.trim(x) == "", qa, ca), ADDRESS_PATTERN)
    relation = number_relation(X.house_numbers(qa), X.house_numbers(ca))
    number = F.element_at(F.array(*[F.lit(x) for x in NUMBER_PATTERNS]), relation + 1)
    words = [F.array_distinct(X.tokens(c)) for c in (qn, cn)]
    shared = F.size(F.array_intersect(*words))
    apart = F.size(words[0]) + F.size(words[1]) - 2 * shared
    overlap = F.when(apart == 0, 1).when(shared == 0, 2).otherwise(F.when(apart > 2, 4).otherwise(3))
    name = F.element_at(F.array(*[F.lit(x) for x in WORD_PATTERNS]), overlap)
    kind = F.coalesce(F.when(either(X.has_native_script, cn, qn), SCRIPT_PATTERN), F.when(either(X.is_domain_name, cn, qn), DOMAIN_PATTERN))
    return F.coalesce(address, number, kind, name)


def error_examples(scored: DataFrame, taken: Column, top: int = 5) -> DataFrame:
    """(kind, rank, country, s1, src, cid, p): of each country the surest false positives and the
    least likely false negatives."""
    kind = F.when(taken & (F.col("y") == 0), "false positive").when(~taken & (F.col("y") == 1), "false negative")
    surest = F.when(F.col("kind") == "false positive", -F.col("p")).otherwise(F.col("p"))
    w = Window.partitionBy("country", "kind").orderBy(surest, "s1", "src", "cid")
    rows = scored.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("rank", F.row_number().over(w))
    return rows.where(F.col("rank") <= top).select("kind", "rank", "country", "s1", "src", "cid", "p")


def blocking_stats(entities: DataFrame, cand: DataFrame, pool: DataFrame) -> DataFrame:
    """(country, entities, pairs, average, reduction) of a candidate table; ``pool`` has a row a
    record of the other side."""
    own = entities.groupBy("country").agg(F.count("*").alias("entities"))
    size = pool.groupBy("country").agg(F.count("*").alias("pool"))
    pairs = cand.groupBy("country").agg(F.count("*").alias("pairs"))
    j = own.join(pairs, "country", "left").join(size, "country", "left").fillna(0)
    return j.select(
        "country",
        "entities",
        "pairs",
        (F.col("pairs") / F.col("entities")).alias("average"),
        (1 - F.try_divide(F.col("pairs"), F.col("entities") * F.col("pool"))).alias("reduction"),
    )


def top_patterns(labelled: DataFrame, top: int = 8) -> DataFrame:
    """(kind, pattern, n, share): the most frequent patterns of each kind of error."""
    n = labelled.groupBy("kind", "pattern").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind")
    ranked = n.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6)).withColumn("_r", F.row_number().over(w.orderBy(F.col("n").desc(), "pattern")))
    return ranked.where(F.col("_r") <= top).drop("_r")
