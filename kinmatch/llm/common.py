"""What the operators share: the shared folder, table reading, word rules, label samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract in this subpackage: ASCII blanks only (``bytes.split()`` agrees).
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes in one Arrow batch, so that a batch of long texts stays within a worker's memory.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20

_own_dir: list[str] = []

#: Paths of the tables that ``cut`` has written, in order.
made: list[str] = []


#: What passes keep in a Python worker from task to task.
kept_in_workers: list[dict] = []


def forget() -> None:
    """Drop what earlier operators' passes have left in this worker, which is used again."""
    if any(kept_in_workers):
        for x in kept_in_workers:
            x.clear()
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches; a number of rows the user set below the bound stays, and so does
    any number of bytes."""
    rows, size = (f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if not 0 < int(spark.conf.get(rows, "0")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only where that is unset and one
    machine does everything (tests, local mode). A cluster without the setting is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="kinmatch-"))
        at = _own_dir[0]
    return at.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/kinmatch/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: ends the lineage, survives
    executors, and fixes what later steps see."""
    path = shared_path(df.sparkSession, tag)
    made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that no later step reads."""
    jvm = spark._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep_only(spark: SparkSession, start: int, *read: DataFrame) -> None:
    """Delete the tables that ``cut`` made from number ``start`` on, but for those that the given
    lazy results read."""
    need = {x.rsplit("/", 1)[0].split("/")[-1] for df in read for x in df.inputFiles()}
    delete(spark, [x for x in made[start:] if x.split("/")[-1] not in need])


def release(spark: SparkSession) -> None:
    """Have the driver forget the shuffles of plans that nothing refers to any more, so that
    their files go while a long operator still runs."""
    gc.collect()
    spark._jvm.System.gc()


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of ``cut`` by path, and what the driver still holds of their plans."""
    jvm = spark._jvm
    for at in paths:
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def most_frequent(counts: DataFrame, key: str, n: str, limit: int) -> DataFrame:
    """The ``limit`` rows of the largest ``n``, ties by key; all rows where there are fewer.

    A histogram of the logarithms of ``n``, some thousand rows at most, tells which rows are in
    whatever their order; only the level in which the limit falls is sorted.
    """
    level = F.floor(F.log2(F.col(n).cast("double")) * 64).cast("long")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("m")).collect()
    left, above = limit, None
    for r in sorted(sizes, key=lambda r: -r.level):
        if r.m > left:
            # the last rows come from this level, in order
            last = counts.where(level == r.level).orderBy(F.col(n).desc(), key).limit(left).select(key, n)
            return last if above is None else counts.where(level >= above).select(key, n).unionAll(last)
        left, above = left - r.m, r.level
    return counts.select(key, n)


def labelled(
    docs: DataFrame, labels: DataFrame, target: str, limit: int, keep=None
) -> DataFrame:
    """At most ``limit`` labelled texts (text, y), in the order of a hash of doc_id.

    The label side is cut to the ``limit`` first ids, which bounds its broadcast; rows with a
    null id, text or label teach nothing and are left out. A doc_id labelled twice counts once
    with its largest label, a document listed twice once with its largest text.
    """
    lab = labels.select(F.col("doc_id"), F.col(target).alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isNotNull()
    )
    if keep is not None:
        lab = lab.where(keep)
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    lab = lab.groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    n = labels.count()
    if n > 4 * limit:
        # only a little more than the sample is sorted; the first of the order are all below
        lab = lab.where(order < int(2.0 * limit / n * 2.0**64 - 2.0**63))
    lab = lab.orderBy(order, "doc_id").limit(limit)
    hit = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    return (
        hit.join(F.broadcast(lab), "doc_id")
        .groupBy("doc_id")
        .agg(F.max("text").alias("text"), F.first("y").alias("y"))
        .select("doc_id", "text", "y")
    )


def crc_mod(col, m: int):
    """crc32 of the id as text, modulo m; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % m
