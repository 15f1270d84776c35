"""Corpus statistics: document frequencies, weights, affixes, core words, name frequencies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AFFIX_SHARE, EDGE_SHARE, BIGRAM_SHARE = 0.003, 0.85, 0.002
#: The limits of affixes, then of affix pairs.
SHARES = (AFFIX_SHARE, EDGE_SHARE, BIGRAM_SHARE, EDGE_SHARE)
UNKNOWN_COUNTRY = 10.0
DAMPING = 0.1


def country_totals(rec: DataFrame) -> DataFrame:
    """(country, nd, n3, nad): records, names of three words or more, non-empty addresses."""
    return rec.groupBy("country").agg(
        F.count("*").alias("nd"), F.count_if(F.size("tok") >= 3).alias("n3"), F.count_if(F.size("atok") > 0).alias("nad")
    )


def token_df(rec: DataFrame, col: str = "tok") -> DataFrame:
    """(country, token, df): records that have the word."""
    return rec.select("country", F.explode(F.array_distinct(col)).alias("token")).groupBy("country", "token").agg(F.count("*").alias("df"))


def idf(rec: DataFrame, col: str = "tok", min_df: int = 1) -> DataFrame:
    """(country, token, df, idf) with idf = ln(N / df); rarer words fall back to ``max_idf``."""
    total = country_totals(rec).select("country", F.col("nd" if col == "tok" else "nad").alias("n"))
    return token_df(rec, col).where(F.col("df") >= min_df).join(total, "country").select("country", "token", "df", F.ln(F.col("n") / F.col("df")).alias("idf"))


def max_idf(rec: DataFrame) -> DataFrame:
    t = country_totals(rec)
    return t.select("country", F.ln(F.greatest("nd", F.lit(2))).alias("max_idf"), F.ln(F.greatest("nad", F.lit(2))).alias("addr_max_idf"))


def affixes(rec: DataFrame, min_share: float = AFFIX_SHARE, edge_share: float = EDGE_SHARE) -> DataFrame:
    """(country, token, df, edge): words at the edge of names so often that they carry no identity.

    Edge counts come from names of three words or more, first and last place; frequencies from
    all names.
    """
    long = rec.where(F.size("tok") >= 3)
    edge = long.select("country", F.explode(F.array(F.element_at("tok", 1), F.element_at("tok", -1))).alias("token")).groupBy("country", "token").agg(F.count("*").alias("edge"))
    total = country_totals(rec).select("country", "n3")
    return (
        token_df(rec).join(edge, ["country", "token"]).join(total, "country")
        .where((F.col("df") >= min_share * F.greatest("n3", F.lit(1))) & (F.col("edge") / F.col("df") >= edge_share))
        .select("country", "token", "df", "edge")
    )


def affix_bigrams(rec: DataFrame, min_share: float = BIGRAM_SHARE, edge_share: float = EDGE_SHARE) -> DataFrame:
    """(country, first, second, n, edge): word pairs at the edge of names of three words or more."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("tok") - 1), lambda i: F.struct(i.alias("at"), F.element_at("tok", i).alias("first"), F.element_at("tok", i + 1).alias("second")))
    rows = rec.where(F.size("tok") >= 2).select("country", F.size("tok").alias("m"), F.explode(pairs).alias("b")).select("country", "m", "b.*")
    at_edge = (F.col("m") >= 3) & ((F.col("at") == 1).cast("int") + (F.col("at") == F.col("m") - 1).cast("int") > 0)
    count = rows.groupBy("country", "first", "second").agg(F.count("*").alias("n"), F.count_if(at_edge).alias("edge"))
    total = country_totals(rec).select("country", "n3")
    return (
        count.join(total, "country")
        .where((F.col("edge") > 0) & (F.col("n") >= min_share * F.greatest("n3", F.lit(1))) & (F.col("edge") / F.col("n") >= edge_share))
        .select("country", "first", "second", "n", "edge")
    )


def with_core(rec: DataFrame, affix: DataFrame, bigram: DataFrame) -> DataFrame:
    """Records with ``core``: their words without affixes, never empty if there are words.

    Affix lists hold at most a few hundred words a country (a share of all names each), so one
    row a country is joined.
    """
    a = affix.groupBy("country").agg(F.array_sort(F.collect_set("token")).alias("_affix"))
    b = bigram.groupBy("country").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "first", "second"))).alias("_bigram"))
    none = F.array().cast("array<string>")
    j = rec.join(a, "country", "left").join(b, "country", "left").withColumn("_affix", F.coalesce("_affix", none)).withColumn("_bigram", F.coalesce("_bigram", none))
    m = F.size("tok")
    head = (m >= 3) & F.array_contains("_bigram", F.concat_ws(" ", F.get("tok", F.lit(0)), F.get("tok", F.lit(1))))
    tail = (m >= 3) & F.array_contains("_bigram", F.concat_ws(" ", F.get("tok", m - 2), F.get("tok", m - 1)))
    j = j.withColumn("_head", head).withColumn("_tail", tail)
    at = F.transform("tok", lambda w, i: F.struct(w.alias("w"), (~((F.col("_head") & (i < 2)) | (F.col("_tail") & (i >= m - 2)))).alias("k")))
    words = lambda x: F.transform(x, lambda y: y["w"])
    outside = lambda y: ~F.array_contains(F.col("_affix"), y["w"])
    tries = [
        words(F.filter(at, lambda y: y["k"] & outside(y))),
        words(F.filter(at, outside)),
        words(F.filter(at, lambda y: y["k"])),
    ]
    core = F.col("tok")
    for t in reversed(tries):
        core = F.when(F.size(t) > 0, t).otherwise(core)
    return j.withColumn("core", core).drop("_affix", "_bigram", "_head", "_tail")


def weighted(rows: DataFrame, weights: DataFrame, fallback: DataFrame, affix: DataFrame | None = None) -> DataFrame:
    """(country, token, ...) rows with ``weight``: idf, the country's largest for unseen words,
    a constant for unseen countries, damped for affixes."""
    out = rows.join(weights.select("country", "token", "idf"), ["country", "token"], "left").join(fallback.select("country", F.col(fallback.columns[1]).alias("_max")), "country", "left")
    weight: Column = F.coalesce("idf", "_max", F.lit(UNKNOWN_COUNTRY))
    if affix is not None:
        out = out.join(affix.select("country", "token", F.lit(DAMPING).alias("_damp")), ["country", "token"], "left")
        weight = weight * F.coalesce("_damp", F.lit(1.0))
    return out.withColumn("weight", weight).drop("idf", "_max", "_damp")


def name_freq_pct(rec: DataFrame) -> DataFrame:
    """Records with ``freq``: how common the exact normalised name is in its country, 0 to 1."""
    key = F.array_join("tok", " ")
    n = rec.groupBy("country", key.alias("_key")).agg(F.count("*").alias("_n"))
    total = country_totals(rec).select("country", "nd")
    return (
        rec.withColumn("_key", key).join(n, ["country", "_key"]).join(total, "country")
        .withColumn("freq", F.ln(F.lit(1.0) + F.col("_n")) / F.ln(F.lit(1.0) + F.greatest("nd", F.lit(2))))
        .drop("_key", "_n", "nd")
    )


def describe_affixes(affix: DataFrame, totals: DataFrame, top: int = 10) -> DataFrame:
    """(country, token, rank, share): the most frequent affixes of each country."""
    w = Window.partitionBy("country").orderBy(F.col("df").desc(), "token")
    return (
        affix.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).join(totals.select("country", "nd"), "country")
        .select("country", "token", "rank", (F.col("df") / F.col("nd")).alias("share"))
    )


def merge_totals(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Counts of several batches added up; equals the counts of all rows at once."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    sums = [c for c in whole.columns if c not in keys]
    return whole.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def share_of(idf_value: float) -> float:
    """The share of records that an idf stands for."""
    return math.exp(-idf_value)
