"""Canonical records as JSON lines, buckets that are never overwritten, and batches of the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import store


def write_records(df: DataFrame, path: str, order: tuple[str, ...] = ("urn", "revision_digest")) -> None:
    """JSON lines in one order over all files, nulls written; never over existing ones."""
    body = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(body.alias("value")).write.mode("errorifexists").text(path)


def numbered(lines: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(file, line, value) of lines, or of those wanted, numbered from 1 in their files. lines, and wanted as rows of it: (file,
    value, _block, _id) as text_lines gives them. A file's blocks are counted apart and add up, so a large file is read in as
    many tasks as it has blocks, and only wanted lines meet the counts: a row for each block."""
    n = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = n.select("file", "_block", "_first", before.alias("_before"))
    t = (lines if wanted is None else wanted).join(starts, ["file", "_block"])
    return t.select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, _block, _id): lines with the block of the file that they are in, and their place in the task."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors): lines that are no JSON of the schema come as (file, line, value); blank lines are left out."""
    raw = text_lines(spark, path)
    parsed = raw.withColumn("r", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    blank = F.length(F.btrim("value")) == 0
    bad = (F.col("r").isNull() | F.col("r._corrupt").isNotNull()) & ~blank
    return parsed.where(~bad & ~blank).select("r.*").drop("_corrupt"), numbered(raw, parsed.where(bad).drop("r"))


def iter_records(heads: DataFrame, kind: str, source: str | None = None, scope: str | None = None, tombstoned: bool = False) -> DataFrame:
    """Records of a kind in the order of their urns; kind is the partition column."""
    out = heads.where(F.col("kind") == kind)
    if source:
        out = out.where(F.col("source") == source)
    if scope:
        out = out.where(F.col("scope") == scope)
    return (out if tombstoned else out.where(~F.coalesce("tombstoned", F.lit(False)))).orderBy("urn")


def write_feed_batch(journal: DataFrame, path: str, stream: str, after: int, limit: int, max_bytes: int) -> tuple[int, str] | None:
    """The next batch of a stream at a place named by its bounds; None if there is nothing. A batch that is there
    already, from before a crash, stays if it holds the same events; another one is an error."""
    batch = store.next_batch(journal, after, limit, max_bytes).drop("size", "total")
    through = batch.agg(F.max("seq")).first()[0]
    if through is None:
        return None
    where = f"{path.rstrip('/')}/{stream}-{after}-{through}"
    spark = batch.sparkSession
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        line = F.to_json(F.struct(*sorted(batch.columns)))
        digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(line).cast("decimal(38,0)"))).first()
        if digest(batch) != digest(read_feed(spark, [where]).select(*batch.columns)):
            raise ValueError(f"another batch is at {where}")
    else:
        batch.orderBy("seq").coalesce(1).write.mode("overwrite").json(where)
    return through, where


def read_feed(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema("seq long, producer string, operation string, urn string, observed_at long, data string").json(paths)
