"""The record model and how the driver's tables bind to it.

A record has id, src (1 the query side, 2 and 3 the pool), country, name and addr; missing text is
empty. Country is an open set and a column of every key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions import text as X
from kinmatch.functions.romanise import romanised

VIEWS = {"na": "index", "nm": "name", "ad": "addr", "sk": "skeleton"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source(c: str) -> F.Column:
    return (F.col(c) % 3 + 1).cast("int")


def doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records, whole: the first line is the name, all other lines are the address;
    ``text`` has both."""
    t = F.coalesce(F.col("text"), F.lit(""))
    first = F.substring_index(t, "\n", 1)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        _source("doc_id").alias("src"),
        F.coalesce("lang", F.lit("")).alias("country"),
        t.alias("text"),
        first.alias("name"),
        F.substring(t, F.length(first) + 2, F.length(t)).alias("addr"),
    )


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as records that are short by nature: the title is the name, the URL the address, the
    first part of its path the country; romanised where other scripts occur."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"),
        _source("page_id").alias("src"),
        F.regexp_extract(url, "^https?://[^/]*/([a-z]*)", 1).alias("country"),
        F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1).alias("name"),
        url.alias("addr"),
    )
    return romanised(rows)


def page_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1, src, cid): pool pages whose title has the same letters as a query page's."""
    key = F.regexp_replace(F.lower("name"), "[^a-z]", "")
    rows = page_rows(spark, sf_dir).select("id", "src", key.alias("key")).where("key <> ''")
    a = rows.where("src = 1").select(F.col("id").alias("s1"), "key")
    b = rows.where("src > 1").select(F.col("id").alias("cid"), "src", "key")
    return a.join(b, "key").select("s1", "src", "cid")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entities and parts as records: (country, s1, src, cid, p, y), one row a claim."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("s1"),
        (F.col("l_suppkey") % 2 + 2).cast("int").alias("src"),
        F.col("l_partkey").alias("cid"),
        (F.lit(0.05) + F.lit(9.0) * F.col("l_discount")).alias("p"),
        (F.col("l_linestatus") == "F").cast("int").alias("y"),
    )
    one = li.groupBy("s1", "src", "cid").agg(F.max("p").alias("p"), F.max("y").alias("y"))
    return one.join(entities(spark, sf_dir), "s1").select("country", "s1", "src", "cid", "p", "y")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, those without claims included: (country, s1)."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("country"), F.col("o_orderkey").alias("s1"))


#: Characters of benchmark items that one pass over the documents searches for.
ITEM_CHARS = 32_000_000


def leak_pairs(spark: SparkSession, sf_dir: str, most: int = ITEM_CHARS) -> DataFrame:
    """(item_id, doc_id) of benchmark items found in documents, items of any length.

    An automaton over all items reads every document once. Items beyond ``most`` characters, counted
    first, are searched in further passes, so what a worker holds is bounded.
    """
    items = table(spark, sf_dir, "benchmark").where("text <> ''").select("item_id", "text")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    passes = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // most))
    out = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).collect() if passes > 1 else items.collect()
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in part])
        got = docs.mapInArrow(_found(shared), "item_id long, doc_id long")
        out = got if out is None else out.unionAll(got)
    return out


def _found(items) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ids: dict[str, list[int]] = {}
        for i, t in items.value:
            ids.setdefault(t, []).append(i)
        search = ahocorasick.Automaton()
        for t in ids:
            search.add_word(t, t)
        search.make_automaton()
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hit = {x for _, x in search.iter(t)} if ids else ()
                rows += [(i, d) for x in hit for i in ids[x]]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["item_id", "doc_id"])

    return run


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, id, p, y): labelled documents with a made-up score of quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("country"), "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    p = F.round((F.col("n_chars") % 97) / 97.0 * 0.5 + F.col("y") * 0.4 + 0.05, 6)
    return docs.join(lab, "doc_id").select("country", F.col("doc_id").alias("id"), p.alias("p"), "y")


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, title, host) of the pages."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("url", "https?://([^/]*)", 1).alias("host"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("vec_id") % 3 + 1).cast("int").alias("src"), F.col("embedding").alias("vec"), "label"
    )


def record_tokens(records: DataFrame) -> DataFrame:
    """Records with their words and address words, computed once a record."""
    return records.withColumn("tok", X.tokens(F.col("name"))).withColumn("atok", X.tokens(F.col("addr")))
