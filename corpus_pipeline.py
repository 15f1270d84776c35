"""The corpus pipeline: five stages of kinmatch.llm over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. As a stage's
result is written before the next one is called, each call first deletes the working tables that
the stage before it left in the shared folder; one pipeline runs at a time in a driver. ``run``
also deletes each stage's result once the next one's is written; the last one stays.

Edge cases are those of the operators: a null or empty text fails the quality rules and goes; of
equal or near-equal texts the one with most code points, or the smallest doc_id, stays; rows
without doc_id are kept by the near-duplicate stage; a null source is a source of its own; very long
texts are read whole; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from kinmatch.llm import bpe, exact_dedup, mixing, ngram_join, quality_rules
from kinmatch.llm import common as C


_before: list[str] = []


def _stage(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        C.delete(spark, _before)
        start = len(C.made)
        out = fn(spark, docs, sf_dir)
        _before[:] = C.made[start:]
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    C.prepare(spark)
    return quality_rules.keep_good(docs, quality_rules.fit_rules(docs, C.table(spark, sf_dir, "labels")))


@_stage
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.keep_longest(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest id stays."""
    return ngram_join.keep_one(docs, n=5, percent=80)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources has them."""
    C.prepare(spark)
    return mixing.mix(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the text decoded from them."""
    return bpe.digests(docs, bpe.vocabulary_path())


STAGES = [
    ("quality rules", quality),
    ("exact dedup", dedup),
    ("n-gram jaccard join", near_dedup),
    ("mix sources", mix),
    ("bpe", encode),
]

#: The trees of the first stage and the byte pairs of the last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = C.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = C.cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            C.delete(spark, [before])
        before = C.made[-1]
    C.delete(spark, _before)
    _before.clear()
    return docs
