"""From pair probabilities to decisions: meta features, exclusivity, expected F, rules.

Competition is computed over the whole scored table; filter entities only afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions import kernels

THRESHOLDS = tuple(round(0.30 + 0.025 * k, 3) for k in range(27))
TEMPERATURES = (0.6, 0.8, 1.0, 1.25, 1.6)
#: Added before rounding, so that decimal ties fall one way whatever the order of a sum.
TIE = 1e-12
_RECORD = ("country", "src", "cid")


def odds(p: Column) -> Column:
    q = F.least(p, F.lit(1 - 1e-12))
    return q / F.greatest(1 - q, F.lit(1e-9))


def exclusivity(scored: DataFrame, p: str = "p", out: str = "p_excl") -> DataFrame:
    """A record belongs to one entity at most: p' = o / (1 + the odds of all claims on it)."""
    o = odds(F.col(p))
    return scored.withColumn(out, o / (1 + F.sum(o).over(Window.partitionBy(*_RECORD))))


def temper(p: Column, t: Column | float) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    t = t if isinstance(t, Column) else F.lit(float(t))
    return F.when(t == 1.0, p).otherwise(1 / (1 + F.pow((1 - q) / q, 1 / t)))


def resolve_claims(scored: DataFrame) -> DataFrame:
    """One owner a record: the most probable claim, then the smaller entity."""
    w = Window.partitionBy(*_RECORD).orderBy(F.col("p").desc(), "s1")
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def meta_features(scored: DataFrame) -> DataFrame:
    """The nine columns about a pair's standing among its entity's pairs and its record's claims."""
    entity = Window.partitionBy("country", "s1")
    ranked = entity.orderBy(F.col("p").desc(), "src", "cid")
    record = Window.partitionBy(*_RECORD)
    total = F.sum("p").over(entity)
    best_2 = F.max(F.when(F.col("src") == 2, F.col("p"))).over(entity)
    best_3 = F.max(F.when(F.col("src") == 3, F.col("p"))).over(entity)
    return exclusivity(scored, out="m_excl_prob").select(
        *scored.columns,
        F.col("p").alias("m_prob"),
        (F.row_number().over(ranked) - 1).alias("m_rank"),
        (F.max("p").over(entity) - F.col("p")).alias("m_gap_to_best"),
        F.when(total > 0, F.col("p") / total).otherwise(0.0).alias("m_score_share"),
        F.count_if(F.col("p") >= 0.5).over(entity).alias("m_n_strong"),
        "m_excl_prob",
        (F.row_number().over(record.orderBy(F.col("p").desc(), "s1")) - 1).alias("m_excl_rank"),
        F.count("*").over(record).alias("m_n_competitors"),
        F.coalesce(F.when(F.col("src") == 2, best_3).otherwise(best_2), F.lit(0.0)).alias("m_best_other_source"),
    )


def poisson_binomial(p: Column) -> Column:
    """Distribution of the number of successes of an array of probabilities."""
    start = F.array(F.lit(1.0).cast("double"))

    def step(acc: Column, x: Column) -> Column:
        lost = F.transform(acc, lambda a: a * (1 - x))
        won = F.transform(acc, lambda a: a * x)
        zero = F.array(F.lit(0.0))
        return F.zip_with(F.concat(lost, zero), F.concat(zero, won), lambda a, b: a + b)

    return F.aggregate(p, start, step)


def expected_f(scored: DataFrame, miss: float = 0.0, beta2: float = 0.25) -> DataFrame:
    """(country, s1, k, value): expected F of taking the k most probable candidates, all k.

    Built from array folds; meant for lists of some dozens, see ``decide_expected``.
    """
    sorted_p = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("n"), "src", "cid"))), lambda x: -x["n"])
    lists = scored.groupBy("country", "s1").agg(sorted_p.alias("q"))
    at = lists.select("country", "s1", "q", F.explode(F.sequence(F.lit(0), F.size("q"))).alias("k"))
    n = F.size("q")
    parts = at.withColumn("a", poisson_binomial(F.slice("q", F.lit(1), F.col("k")))).withColumn("b", poisson_binomial(F.slice("q", F.col("k") + 1, n - F.col("k"))))

    def inner(i: Column, weight: Column) -> Column:
        def term(j: Column) -> Column:
            s = (i + j).cast("double")
            gain = (1 - miss) / (beta2 * s + F.col("k")) + miss / (beta2 * (s + 1) + F.col("k"))
            return weight * F.get("b", j) * gain

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.size("b") - 1), term), F.lit(0.0), lambda x, y: x + y)

    rows = F.transform("a", lambda x, i: inner(i, i * x))
    value = (1 + beta2) * F.aggregate(rows, F.lit(0.0), lambda x, y: x + y)
    none = F.aggregate("q", F.lit(1.0), lambda acc, x: acc * (1 - x)) * (1 - miss)
    return parts.select("country", "s1", "k", F.round(F.when(F.col("k") == 0, none).otherwise(value) + TIE, 9).alias("value"))


def decide_expected(scored: DataFrame, arrays: bool = True) -> DataFrame:
    """(country, s1, k, value): the best number of candidates, the smaller on ties.

    ``arrays=False`` counts with the convolution kernel in Arrow batches, for long lists.
    """
    if not arrays:
        lists = scored.groupBy("country", "s1").agg(F.collect_list("p").alias("q"))
        return lists.select("country", "s1", kernels.decide_count("q").alias("k"))
    w = Window.partitionBy("country", "s1").orderBy(F.col("value").desc(), "k")
    return expected_f(scored).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def decide_threshold(scored: DataFrame, t: float) -> DataFrame:
    return scored.where(F.col("p") >= t)


def apply_decision(scored: DataFrame, chosen: DataFrame) -> DataFrame:
    """The k most probable pairs of every entity."""
    w = Window.partitionBy("country", "s1").orderBy(F.col("p").desc(), "src", "cid")
    return scored.withColumn("_r", F.row_number().over(w)).join(chosen.select("country", "s1", "k"), ["country", "s1"]).where(F.col("_r") <= F.col("k")).drop("_r", "k")


def uncertain_band(scored: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    return scored.where(F.col("p").between(low, high))


def search_thresholds(scored: DataFrame, entities: DataFrame, truth_size: DataFrame, grid: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(country, t, macro_f): macro F of every threshold, in one aggregation.

    Every pair counts for all thresholds up to its own probability; the grid is a short list.
    """
    from kinmatch.operators import metrics

    per = scored.groupBy("country", "s1").agg(
        *[F.count_if(F.col("p") >= t).alias(f"n{i}") for i, t in enumerate(grid)],
        *[F.count_if((F.col("p") >= t) & (F.col("y") == 1)).alias(f"t{i}") for i, t in enumerate(grid)],
    )
    whole = entities.join(per, ["country", "s1"], "left").join(truth_size, ["country", "s1"], "left").fillna(0)
    f = [F.avg(metrics.f05(F.col(f"t{i}"), F.col(f"n{i}"), F.col("n_true"))).alias(f"f{i}") for i in range(len(grid))]
    wide = whole.groupBy("country").agg(*f)
    pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.round(F.col(f"f{i}"), 9).alias("macro_f")) for i, t in enumerate(grid)])
    return wide.select("country", F.explode(pairs).alias("x")).select("country", "x.t", "x.macro_f")


def search_decision(scored: DataFrame, entities: DataFrame, truth_size: DataFrame) -> DataFrame:
    """(country, rule, value, macro_f): the best threshold or temperature; thresholds on ties."""
    from kinmatch.operators import metrics

    best = search_thresholds(scored, entities, truth_size).select("country", F.lit("threshold").alias("rule"), F.col("t").alias("value"), "macro_f")
    for t in TEMPERATURES:
        warm = scored.withColumn("p", temper(F.col("p"), t))
        taken = apply_decision(warm, decide_expected(warm, arrays=False))
        per = metrics.entity_counts(entities, taken, truth_size)
        best = best.unionByName(per.groupBy("country").agg(F.round(F.avg("f05"), 9).alias("macro_f")).select("country", F.lit("expected_f").alias("rule"), F.lit(float(t)).alias("value"), "macro_f"))
    w = Window.partitionBy("country").orderBy(F.col("macro_f").desc(), F.col("rule").desc(), "value")
    return best.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pick_rule(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(rule, value, score): the rule of the best weighted mean over countries."""
    got = scores.join(weights.select("country", "weight"), "country").groupBy("rule", "value").agg((F.sum(F.col("macro_f") * F.col("weight")) / F.sum("weight")).alias("score"))
    return got.orderBy(F.col("score").desc(), "rule", "value").limit(1)
