"""Exact dedup by a content sort.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Sampled
splitters (Spark's range partitioning) deal the normalised texts out, an external sort places
equal ones next to each other, and each row is compared in full with its neighbour. The sort
key ends in (length of the original, doc_id), so a group of copies of any size is split over
several partitions instead of filling one; runs that a splitter cut are joined again by comparing
the last text of a partition in full with the first text of the next one.

Splitters are sampled over a 64-character prefix and a digest, never over whole texts, so what
the driver sees of a sampled row is bounded however long the texts are.

Edge cases: a null text counts as empty and equals other empty or blank texts; a null doc_id
sorts after every other id; a row listed twice is two copies, of which one stays; very long texts are
sorted and compared whole; an empty table gives no rows; columns besides doc_id and text are not
read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.llm import common as C

_FIELDS = [("doc_id", pa.int64()), ("text_sha256", pa.string()), ("pid", pa.int64()), ("run", pa.int64()), ("head_id", pa.int64()), ("is_head", pa.bool_()), ("n", pa.int64())]
#: edge is 0 for a row, 1 for the partition's first text, 2 for its last.
_EDGE = [("edge", pa.int32()), ("norm", pa.string())]
_RUN_SCHEMA = "doc_id long, text_sha256 string, pid long, run long, head_id long, is_head boolean, n long, edge int, norm string"


class _Runs:
    """The runs of equal neighbours of one sorted partition; full comparisons throughout."""

    def __init__(self) -> None:
        self.pid = TaskContext.get().partitionId()
        self.run = -1
        self.first = self.last = self.sha = self.head = None
        self.n = 0
        self.ends: list[tuple] = []

    def starts(self, batch: pa.RecordBatch) -> list[int]:
        """The places of a batch at which runs start."""
        norm = batch.column("norm")
        k = batch.num_rows
        out = [] if self.last is not None and norm[0].as_py() == self.last else [0]
        if k > 1:
            out += (np.flatnonzero(pc.not_equal(norm.slice(1), norm.slice(0, k - 1)).to_numpy(zero_copy_only=False)) + 1).tolist()
        self.last = norm[k - 1].as_py()
        return out

    def begin(self, batch: pa.RecordBatch, at: int) -> None:
        self.close()
        self.run += 1
        self.n = 0
        self.head, self.sha = batch.column("doc_id")[at].as_py(), batch.column("text_sha256")[at].as_py()
        if not self.run:
            self.first = batch.column("norm")[at].as_py()

    def close(self) -> None:
        """Remember the first run of the partition, when it is complete."""
        if self.run == 0 and not self.ends:
            self.ends = [(self.run, self.head, self.sha, self.n, 1, self.first)]

    def edges(self) -> dict[str, list]:
        """Two rows that tell the first and the last text, to join runs over partitions."""
        self.close()
        rows = [*self.ends, (self.run, self.head, self.sha, self.n, 2, self.last)]
        return {
            "text_sha256": [r[2] for r in rows], "pid": [self.pid] * 2, "run": [r[0] for r in rows], "head_id": [r[1] for r in rows],
            "n": [r[3] for r in rows], "edge": [r[4] for r in rows], "norm": [r[5] for r in rows],
        }


def _batch(columns: dict, kinds: list[tuple], k: int) -> pa.RecordBatch:
    return pa.record_batch([pa.nulls(k, t) if n not in columns else pa.array(columns[n], t) for n, t in kinds], names=[n for n, _ in kinds])


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number, head and size of their run within the partition; the ids of one run
    wait for its end, the texts do not. The last two rows are the edges."""
    runs, kinds = _Runs(), _FIELDS + _EDGE
    done: list[tuple] = []  # (ids, run, head, sha, n) of complete runs
    held: list[np.ndarray] = []
    known: list[np.ndarray] = []
    size = 0

    def complete() -> int:
        if held:
            done.append((np.concatenate(held), np.concatenate(known), runs.run, runs.head, runs.sha))
            held.clear()
            known.clear()
            return len(done[-1][0])
        return 0

    def out() -> pa.RecordBatch:
        counts = [len(d[0]) for d in done]
        whole = lambda k: [x for d, n in zip(done, counts) for x in [d[k]] * n]
        total = sum(counts)
        columns = {
            "doc_id": pa.array(np.concatenate([d[0] for d in done]), pa.int64(), mask=~np.concatenate([d[1] for d in done])),
            "text_sha256": whole(4), "pid": [runs.pid] * total, "run": whole(2), "head_id": whole(3),
            "is_head": [k == 0 for n in counts for k in range(n)], "n": np.repeat(counts, counts), "edge": [0] * total,
        }
        done.clear()
        return _batch(columns, kinds, total)

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("doc_id")
        values, valid = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_valid(ids).to_numpy(zero_copy_only=False)
        places = runs.starts(batch)
        for lo, hi in zip([0, *places], [*places, batch.num_rows]):
            if lo < hi:
                if lo or places and places[0] == 0:
                    size += complete()
                    runs.begin(batch, lo)
                held.append(values[lo:hi])
                known.append(valid[lo:hi])
                runs.n += hi - lo
        if size >= C.BATCH_ROWS:
            yield out()
            size = 0
    if runs.run >= 0:
        complete()
        yield out()
        yield _batch(runs.edges(), kinds, 2)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each run with the columns it carries, then the edges."""
    runs, kinds = _Runs(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [(f.name, f.type) for f in batch.schema if f.name not in ("norm", "doc_id", "text_sha256")]
        kinds = _FIELDS + _EDGE + own
        places = runs.starts(batch)
        numbers = []
        for lo, hi in zip([0, *places], [*places, batch.num_rows]):
            if lo < hi:
                if lo or places and places[0] == 0:
                    runs.begin(batch, lo)
                    numbers.append(runs.run)
                runs.n += hi - lo
        rows = batch.take(pa.array(places, pa.int64()))
        ids = rows.column("doc_id")
        columns = {n: rows.column(n) for n, _ in own} | {
            "doc_id": ids, "text_sha256": rows.column("text_sha256"), "pid": [runs.pid] * len(places), "run": numbers, "head_id": ids,
            "is_head": [True] * len(places), "edge": [0] * len(places),
        }
        yield _batch(columns, kinds, len(places))
    if kinds is not None:
        yield _batch(runs.edges(), kinds, 2)


def sorted_runs(docs: DataFrame, parts: int) -> DataFrame:
    """Range-partition and sort the normalised texts, number their runs per partition."""
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("len"), norm.alias("norm"))
    return _ordered(rows, parts).select("norm", "doc_id", "text_sha256").mapInArrow(_mark_runs, _RUN_SCHEMA)


def _ordered(rows: DataFrame, parts: int) -> DataFrame:
    """Range partitions over sampled splitters, each sorted by its whole texts."""
    keyed = rows.select(
        "*",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.substring("norm", 1, 64).alias("lead"),
    )
    order = [F.col("lead"), F.col("text_sha256"), F.col("len").desc(), F.col("doc_id").asc_nulls_last()]
    full = [order[0], order[1], F.col("norm"), *order[2:]]
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*full)


def _joined_runs(spark: SparkSession, marked: DataFrame) -> DataFrame:
    """(pid, run, keep_id, total, joined): the runs that splitters cut into parts, with the size of
    the whole; ``joined`` tells those that continue one of an earlier partition.

    Two edge texts a partition are compared in full on the executors; the driver sees numbers
    only, some for each partition.
    """
    edges = marked.where("edge > 0")
    schema = "pid long, run long, keep_id long, total long, joined boolean"
    rows = edges.select("pid", "edge", "run", "head_id", "n").collect()
    # partitions may be empty: neighbours are neighbours in this list of non-empty ones
    pids = sorted({r.pid for r in rows})
    if len(pids) < 2:
        return spark.createDataFrame([], schema)
    after = spark.createDataFrame(list(zip(pids, pids[1:])), "pid long, next long")
    ends = edges.where("edge = 2").select("pid", F.col("norm").alias("norm_a"))
    starts = edges.where("edge = 1").select(F.col("pid").alias("next"), F.col("norm").alias("norm_b"))
    same = {r.next for r in ends.join(F.broadcast(after), "pid").join(starts, "next").where("norm_a = norm_b").select("next").collect()}
    at = {(r.pid, r.edge): (r.pid, r.run, r.head_id, r.n) for r in rows}
    out, parts = [], []

    def close() -> None:
        total = sum(n for *_, n in parts)
        out.extend((p, run, parts[0][2], total, k > 0) for k, (p, run, _, _) in enumerate(parts))
        parts.clear()

    for before, p in zip(pids, pids[1:]):
        if p not in same:
            close()
            continue
        # the run that ends the partition before: already in, if that partition has no other
        if not parts or at[before, 2][:2] != parts[-1][:2]:
            close()
            parts.append(at[before, 2])
        parts.append(at[p, 1])
    close()
    return spark.createDataFrame(out, schema)


def exact_dedup(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Of equal texts the row with the most code points stays, then the smallest doc_id. Sizes come
    from the runs themselves: no group of copies ever meets in one task.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    marked = C.cut(sorted_runs(docs, parts or C.partitions(spark)), "dedup-runs")
    cut = _joined_runs(spark, marked)
    return (
        marked.where("edge = 0")
        .join(F.broadcast(cut), ["pid", "run"], "left")
        .select(
            "doc_id",
            F.when(F.col("total").isNotNull(), F.col("keep_id")).otherwise(F.col("head_id")).alias("keep_id"),
            F.coalesce("total", "n").alias("group_size"),
            (F.col("is_head") & ~F.coalesce("joined", F.lit(False))).alias("kept"),
            "text_sha256",
        )
    )


def keep_longest(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with their columns as they were.

    The columns ride along in the sort, so rows that share a doc_id, or have none, are told apart.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [f"_c{k}" for k in range(len(docs.columns))]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text).alias("len"),
        F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").alias("norm"),
        *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)],
    )
    ordered = _ordered(rows, parts or C.partitions(spark)).select("norm", "doc_id", "text_sha256", *names)
    kind = T.StructType([*T.StructType.fromDDL(_RUN_SCHEMA).fields, *[T.StructField(f.name, f.dataType) for f in ordered.schema.fields if f.name in names]])
    marked = C.cut(ordered.mapInArrow(_heads, kind), "dedup-heads")
    gone = _joined_runs(spark, marked).where("joined").select("pid", "run")
    return (
        marked.where("edge = 0")
        .join(F.broadcast(gone), ["pid", "run"], "left_anti")
        .select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(C.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id NULLS LAST)
"""
