"""Readers and writers of record files: TSV in, Parquet between, id lists out.

Files have no quoting and no null marker: ``NA``, ``NULL`` and ``NaN`` are names. Spark's reader
turns empty fields into nulls whatever it is told, hence the coalesce.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])


@dataclass(frozen=True)
class Places:
    """Where the files of a run lie."""

    data: str
    work: str
    output: str

    def source(self, split: str, source: int) -> str:
        return f"{self.data}/{split}_source{source}.tsv"

    def cache(self, split: str, source: int) -> str:
        return f"{self.work}/cache/split={split}/source={source}"


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A TSV with header; missing columns raise, empty fields are empty text."""
    head = spark.read.text(path).first()
    names = (head.value if head else "").split("\t")
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    whole = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(whole).csv(path, sep="\t", header=True, quote="", escape="", nullValue="\0", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return raw.select(*[F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) for f in schema])


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """Records (id, name, addr, country, row_no); row_no follows the file order."""
    rows = read_tsv(spark, path, RECORD)
    return rows.select(
        F.expr("cast(substring(entity_id, 4) AS bigint)").alias("id"),
        F.col("business_name").alias("name"),
        F.col("business_address").alias("addr"),
        "country",
        F.monotonically_increasing_id().alias("row_no"),
    )


def stream_source(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as a stream over the files of a folder."""
    rows = spark.readStream.schema(RECORD).csv(folder, sep="\t", header=True, quote="", escape="")
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in RECORD.names])


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, ids array) of a ground truth, match or candidate file; empty lists stay."""
    head = spark.read.text(path).first()
    names = (head.value if head else "").split("\t")
    if len(names) != 2 or names[0] != "source1_entity_id":
        raise ValueError(f"{path}: unexpected header {names}")
    rows = read_tsv(spark, path, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    ids = F.filter(F.split(F.col(names[1]), ","), lambda x: x != "")
    return rows.select(F.col(names[0]).alias("entity_id"), ids.alias("ids"))


def explode_truth(lists: DataFrame) -> DataFrame:
    """(s1, src, cid) of an id list; entities without matches drop out."""
    one = lists.select(F.expr("cast(substring(entity_id, 4) AS bigint)").alias("s1"), F.explode("ids").alias("x"))
    return one.select("s1", F.expr("cast(substring(x, 2, 1) AS int)").alias("src"), F.expr("cast(substring(x, 4) AS bigint)").alias("cid"))


def build_cache(spark: SparkSession, path: str, cache: str, force: bool = False) -> DataFrame:
    """The records of a file as Parquet partitioned by country; kept if already complete."""
    read_source(spark, path).write.mode("overwrite" if force else "ignore").partitionBy("country").parquet(cache)
    return load_frame(spark, cache)


def load_frame(spark: SparkSession, cache: str, columns: list[str] | None = None, country: str | None = None) -> DataFrame:
    """Cached records; columns and the country reach the scan."""
    schema = "id long, name string, addr string, row_no long, country string"
    df = spark.read.schema(schema).parquet(cache)
    if country is not None:
        df = df.where(F.col("country") == country)
    return df.select(*columns) if columns else df


def countries(df: DataFrame) -> DataFrame:
    return df.select("country").distinct().orderBy("country")


def semi_filter(df: DataFrame, ids: DataFrame, key: str = "s1") -> DataFrame:
    """Rows whose key is listed."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def id_lists(entities: DataFrame, pairs: DataFrame, order: str = "s1") -> DataFrame:
    """(s1, ids, n): a comma list for every entity, in the order of (src, cid), repeats once;
    entities without pairs have an empty list."""
    ids = F.transform(F.array_sort(F.collect_set(F.struct("src", "cid"))), lambda x: F.concat(F.lit("S"), x["src"].cast("string"), F.lit("-"), x["cid"].cast("string")))
    lists = pairs.where("src IN (2, 3)").groupBy("s1").agg(ids.alias("ids"))
    return entities.join(lists, "s1", "left").select(
        *[c for c in dict.fromkeys(("s1", order))],
        F.coalesce(F.array_join("ids", ","), F.lit("")).alias("ids"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n"),
    )


def write_id_lists(lists: DataFrame, path: str, column: str, order: str = "s1") -> dict[str, int]:
    """One TSV in the order of ``order``, LF only, no quotes; returns the counts."""
    body = lists.select(F.col(order).cast("long").alias("o"), F.concat(F.lit("S1-"), F.col("s1").cast("string"), F.lit("\t"), "ids").alias("value"))
    head = lists.sparkSession.createDataFrame([(-1, f"source1_entity_id\t{column}")], "o long, value string")
    head.union(body).coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(path, lineSep="\n")
    got = lists.agg(F.count("*").alias("rows"), F.count_if(F.col("n") > 0).alias("non_empty"), F.sum("n").alias("total")).first()
    return got.asDict()


def first_rows(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The n first records of each country."""
    w = Window.partitionBy("country").orderBy(key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
