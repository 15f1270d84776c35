"""WARC archives and a Merkle fixity audit of their replicas.

Records stand in order of their ids, then of their digests; each ``RECORDS`` of them are an archive,
and their byte offsets are running sums within it. The order is sorted on ids, digests and lengths
alone, over sampled ranges, so neither one id nor missing ids can fill a task, and records do not
move. The leaf of a record is the digest of its bytes; each level above digests ``FAN`` neighbours,
an ordered range of offsets, up to one root an archive. An audit joins the roots of two replicas
and descends only below nodes that differ, level by level, to the damaged records. Digests and
comparisons are built-in functions; a group is ``FAN`` rows or one archive, never more.

Edge cases: null html is an empty payload, a null url an empty target, a null page_id sorts last
and is written as an empty id; equal rows are records of their own, told apart by their place; a
record missing in one replica counts as damaged; very long pages are hashed whole; an empty table
gives no archive; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch.llm import common as C

RECORDS = 1_000
FAN = 16
#: In the registered query the second replica has one byte changed in these records.
DAMAGE_EVERY, DAMAGE_AT = 101, 7

_HEAD = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{0}>\r\nWARC-Target-URI: {1}\r\nContent-Type: text/html\r\nContent-Length: {2}\r\n\r\n"


def to_record(page_id: object, url: str, payload: bytes) -> bytes:
    return _HEAD.format(page_id, url, len(payload)).encode() + payload + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of every record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at offset {at}")
        heads = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        size = int(heads["Content-Length"])
        stop = end + size + 4
        if data[end + size : stop] != b"\r\n\r\n":
            raise ValueError(f"record at offset {at} does not end where its length says")
        yield at, stop - at, heads, data[end : end + size]
        at = stop


def scan(files: DataFrame) -> DataFrame:
    """(archive, pos, offset, length, record) from Spark's binaryFile rows; whole archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = [(pos, at, n, data[at : at + n]) for pos, (at, n, _, _) in enumerate(read_records(data))]
                yield pa.record_batch(
                    [
                        pa.array([path] * len(got), pa.string()),
                        pa.array([g[0] for g in got], pa.int64()),
                        pa.array([g[1] for g in got], pa.int64()),
                        pa.array([g[2] for g in got], pa.int64()),
                        pa.array([g[3] for g in got], pa.binary()),
                    ],
                    names=["archive", "pos", "offset", "length", "record"],
                )

    return files.select("path", "content").mapInArrow(run, "archive string, pos long, offset long, length long, record binary")


def records(pages: DataFrame) -> DataFrame:
    """(uid, page_id, record) of all pages, written once; uid tells rows apart."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    parts = _HEAD.split("{")
    head = F.concat(F.lit(parts[0]), text("page_id"), F.lit(parts[1][2:]), text("url"), F.lit(parts[2][2:]), F.octet_length(payload).cast("string"), F.lit(parts[3][2:]))
    record = F.concat(head.cast("binary"), payload, F.lit("\r\n\r\n").cast("binary"))
    return C.cut(pages.select(F.monotonically_increasing_id().alias("uid"), F.col("page_id").cast("long").alias("page_id"), record.alias("record")), "warc-records")


def places(recs: DataFrame, size: int = RECORDS) -> DataFrame:
    """(uid, page_id, archive, pos, offset, length): where each record stands."""
    spark = recs.sparkSession
    order = [F.col("page_id").asc_nulls_last(), F.col("sha"), F.col("uid")]
    keys = C.cut(recs.select("uid", "page_id", F.sha2("record", 256).alias("sha"), F.octet_length("record").cast("long").alias("length")), "warc-keys")
    sorted_keys = keys.repartitionByRange(C.partitions(spark), *order).sortWithinPartitions(*order)
    # a row's number in its partition; partitions follow each other
    at = F.monotonically_increasing_id()
    numbered = C.cut(sorted_keys.select("uid", "page_id", "length", F.spark_partition_id().alias("part"), at.bitwiseAND((1 << 33) - 1).alias("k")), "warc-order")
    before, starts = 0, []
    for r in numbered.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r.part, before))
        before += r.n
    starts = spark.createDataFrame(starts, "part int, start long")
    rank = F.col("start") + F.col("k")
    rows = numbered.join(F.broadcast(starts), "part").select("uid", "page_id", "length", F.floor(rank / size).cast("long").alias("archive"), (rank % size).alias("pos"))
    order = Window.partitionBy("archive").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("offset", F.sum("length").over(order) - F.col("length"))


def archive(pages: DataFrame, size: int = RECORDS) -> DataFrame:
    """(archive, pos, offset, length, page_id, record) of all pages."""
    recs = records(pages)
    return recs.select("uid", "record").join(places(recs, size), "uid").select("archive", "pos", "offset", "length", "page_id", "record")


def leaves(replica: DataFrame) -> DataFrame:
    return replica.select("archive", F.col("pos").alias("node"), F.sha2("record", 256).alias("hash"), "offset", (F.col("offset") + F.col("length")).alias("end"))


def leaves_of(recs: DataFrame, at: DataFrame) -> DataFrame:
    """The same from records (uid, record) and their places; only digests move."""
    hashes = recs.select("uid", F.sha2("record", 256).alias("hash"))
    return hashes.join(at, "uid").select("archive", F.col("pos").alias("node"), "hash", "offset", (F.col("offset") + F.col("length")).alias("end"))


def parents(level: DataFrame) -> DataFrame:
    """The level above: a digest of the digests of up to FAN neighbours and of their range."""
    below = F.array_sort(F.collect_list(F.struct("node", "hash")))
    joined = F.array_join(F.transform(below, lambda x: x["hash"]), "")
    return (
        level.groupBy("archive", F.floor(F.col("node") / FAN).alias("node"))
        .agg(F.min("offset").alias("offset"), F.max("end").alias("end"), joined.alias("joined"))
        .select("archive", "node", F.sha2(F.concat_ws(":", "offset", "end", "joined").cast("binary"), 256).alias("hash"), "offset", "end")
    )


def tree(level: DataFrame, tag: str) -> list[DataFrame]:
    """Levels from the leaves to the roots, each written once."""
    levels = [C.cut(level, f"{tag}-leaves")]
    top = levels[0].agg(F.max("node")).first()[0]
    while top:
        levels.append(C.cut(parents(levels[-1]), f"{tag}-level"))
        top //= FAN
    return levels


def audit(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """(archive, pos) of the records in which two replicas differ.

    Trees of unequal height differ in their number of records; the lower one ends in its root.
    """
    height = min(len(left), len(right))
    below = None
    for a, b in zip(left[:height][::-1], right[:height][::-1]):
        if below is not None:
            a, b = (x.withColumn("up", F.floor(F.col("node") / FAN)).join(below, ["archive", "up"], "left_semi").drop("up") for x in (a, b))
        a = a.select("archive", "node", F.col("hash").alias("hash_a"))
        b = b.select("archive", "node", F.col("hash").alias("hash_b"))
        differ = a.join(b, ["archive", "node"], "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        below = C.cut(differ.select("archive", F.col("node").alias("up")), "audit")
    return below.withColumnRenamed("up", "pos")


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per record: archive, pos, offset, length, page_id, leaf_sha256, intact.

    The second replica is the first, read again with one byte changed in some records, so there
    is something to find; all its records are hashed like the first one's."""
    C.prepare(spark)
    start = len(C.made)
    one = records(C.table(spark, sf_dir, "pages"))
    hit = (F.col("page_id") % DAMAGE_EVERY) == DAMAGE_AT
    flipped = F.concat(F.expr("substring(record, 1, length(record) - 5)"), F.lit("\x01").cast("binary"), F.expr("substring(record, length(record) - 3, 4)"))
    two = one.select("uid", F.when(hit, flipped).otherwise(F.col("record")).alias("record"))
    at = C.cut(places(one), "warc-places")
    left, right = tree(leaves_of(one, at), "left"), tree(leaves_of(two, at), "right")
    damaged = audit(left, right).withColumn("damaged", F.lit(True))
    hashes = left[0].select("archive", F.col("node").alias("pos"), F.col("hash").alias("leaf_sha256"))
    out = (
        at.join(hashes, ["archive", "pos"])
        .join(damaged, ["archive", "pos"], "left")
        .select("archive", "pos", "offset", "length", "page_id", "leaf_sha256", F.col("damaged").isNull().alias("intact"))
    )
    C.keep_only(spark, start, out)
    return out


ORACLE = r"""
WITH r AS (
  SELECT page_id,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
         || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10)
         || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
s AS (SELECT page_id, strlen(record)::BIGINT AS length, sha256(record) AS leaf_sha256 FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS LAST, leaf_sha256) - 1 AS k FROM s)
SELECT k // 1000 AS archive, k % 1000 AS pos,
       (sum(length) OVER (PARTITION BY k // 1000 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length)::BIGINT AS "offset",
       length, page_id, leaf_sha256, NOT coalesce(page_id % 101 = 7, false) AS intact
FROM o
"""
