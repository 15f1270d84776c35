"""Mix sources to target weights by capped water-filling.

Every source has a weight; together the sources share ``share`` times all words. Targets above
``max_epochs`` times a source's own size are clamped there and the excess is dealt again to the
others in proportion to their weights, until none is above. A document then is repeated
floor(epochs) times, and a seeded part of the documents once more: documents of a source are
ordered by md5(seed, doc_id) and taken while the middle of a document still lies below the
fraction wanted, so a source misses its target by half a document at most and reruns agree.

The order is never a sort of a whole source, and texts are never sorted or shuffled: one scan writes
id, source, size and key of every document; they are summed by (source, leading hex digits of the
md5), the running sums of those at most ``16**DIGITS`` slots a source tell in which slot the part
ends, and only that one slot a source is sorted. What is taken is a prefix of the order, so one
row a source, its last document taken, decides for all others. All of it is built-in SQL; a hot
source only adds to partial sums. The water level comes from windows over one row a source.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its own,
last in order; rows that repeat an id are ordered by size, then by a hash of the text, and count
each; a source without words gets target 0; very long texts count whole; an empty table gives no
rows; columns besides doc_id, text and source pass ``mix`` unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch.llm import common as C

DIGITS = 3
SEED = 11


def water_fill(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Clamping in rounds ends where sources with the smallest cap per weight are clamped and one
    level holds for the others; running sums in that order find it without a loop. The window
    holds one row a source.
    """
    cap = F.col("source_size") * max_epochs
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    names = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy("ratio", "rank")
    everything = Window.partitionBy()
    out = (
        names.withColumn("weight", weight.cast("double"))
        .withColumn("cap", cap.cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("pool", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        # a source is free once the level of all from it on reaches no cap
        .withColumn("level", (F.col("pool") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("free_level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything))
    )
    free = (F.col("ratio") > F.col("free_level.ratio")) | (
        (F.col("ratio") == F.col("free_level.ratio")) & (F.col("rank") >= F.col("free_level.rank"))
    )
    target = F.when(F.col("free_level").isNotNull() & free, F.col("weight") * F.col("free_level.level")).otherwise(F.col("cap"))
    return out.select("source", "source_size", target.alias("target"))


_ORDER = ("key", "id", "size", "tie")


def _keyed(docs: DataFrame, seed: int) -> dict[str, Column]:
    """What orders a document within its source."""
    text = F.col("text")
    return {
        "id": F.col("doc_id"),
        "key": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")),
        "size": F.coalesce(F.regexp_count(text, F.lit(C.WORD)), F.lit(0)).cast("long"),
        "tie": F.xxhash64("text"),
    }


def plan(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(documents, sources): id, source, size, key and tie of every document; and of every source
    its size, target, ``whole`` repetitions of all and the ``last`` document that has one more."""
    rows = C.cut(docs.select("source", *[c.alias(n) for n, c in _keyed(docs, seed).items()]), "mix-rows")
    rows = rows.withColumn("slot", F.substring("key", 1, DIGITS))
    slots = C.cut(rows.groupBy("source", "slot").agg(F.sum("size").alias("slot_size")), "mix-slots")
    sources = water_fill(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("whole", whole.cast("long")).withColumn(
        "part", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    )
    named = sources.select(F.col("source").alias("s"), "part")
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    # the slot in which the part ends: the last that begins below it
    ends = (
        slots.withColumn("slot_before", F.coalesce(F.sum("slot_size").over(before), F.lit(0)))
        .join(named, F.col("source").eqNullSafe(F.col("s")))
        .where("slot_before < part")
        .groupBy("source", "part")
        .agg(F.max(F.struct("slot", "slot_before")).alias("end"))
        .select(F.col("source").alias("e_source"), "part", "end.*")
        .withColumnRenamed("slot", "e_slot")
    )
    in_slot = Window.partitionBy("source").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("slot_before") + F.coalesce(F.sum("size").over(in_slot), F.lit(0)) + F.col("size") / 2.0
    last = (
        rows.join(ends, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("slot") == F.col("e_slot")))
        .withColumn("in", middle <= F.col("part"))
        .groupBy("source", "e_slot")
        .agg(F.max(F.when(F.col("in"), F.struct(*_ORDER))).alias("last"))
    )
    # where not even the first of the slot is in, all before the slot are
    none = F.struct(F.col("e_slot").alias("key"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in _ORDER[1:]])
    last = last.select(F.col("source").alias("l_source"), F.coalesce("last", none).alias("last"))
    sources = sources.join(last, F.col("source").eqNullSafe(F.col("l_source")), "left").select("source", "source_size", "target", "whole", "last")
    return rows.drop("slot"), C.cut(sources, "mix-sources")


def _reps() -> Column:
    """How often the mix has a document, from its size and order and its source's plan."""
    extra = F.coalesce(F.struct(*_ORDER) <= F.col("last"), F.lit(False)).cast("long")
    return F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(0).cast("long")


def epochs(docs: DataFrame, **how) -> DataFrame:
    """id, source, size, source_size, target and reps (how often the mix has it) of every row."""
    rows, sources = plan(docs, **how)
    named = sources.withColumnRenamed("source", "s")
    return rows.join(named, F.col("source").eqNullSafe(F.col("s"))).select("id", "source", "size", "source_size", "target", _reps().alias("reps"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as the mix has it."""
    _, sources = plan(docs, **how)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(own, F.col("source").alias("d_source"), *[c.alias(n) for n, c in _keyed(docs, how.get("seed", SEED)).items()])
    return (
        rows.join(sources, F.col("d_source").eqNullSafe(F.col("source")))
        .select("doc", _reps().alias("reps"))
        .where("reps > 0")
        .select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("reps"))).alias("copy"))
        .select("doc.*")
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    C.prepare(spark)
    return epochs(C.table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken")
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('11:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, cap / weight AS ratio,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
f AS (SELECT ratio AS fr, rank AS fk, level AS fl FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
t AS (
  SELECT l.source, l.source_size,
         CASE WHEN fl IS NOT NULL AND (l.ratio > fr OR (l.ratio = fr AND l.rank >= fk)) THEN l.weight * fl ELSE l.cap END AS target
  FROM l LEFT JOIN f ON TRUE),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
         greatest(p.target - p.whole * p.source_size, 0.0) AS part,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN before + size / 2.0 <= part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
