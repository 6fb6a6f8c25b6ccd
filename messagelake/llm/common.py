"""What the training-data operators share: text buffers, complete groups, checkpoints, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once; a longer text is a step of its own.
STEP_BYTES = 8 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; the quick built-in serves texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each text starts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(at: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts, each of at most so many bytes or of one text."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 50_000, most_bytes: int = 64 << 20) -> Iterator[pa.Table]:
    """Tables of rows sorted by key in which no group is cut; for use after repartition and sortWithinPartitions. A table
    goes out once so many rows or bytes are there."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows < least and size < most_bytes:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k = t[key].chunk(0)
        last, lo, hi = k[-1], 0, len(k) - 1
        while lo < hi:  # the first row of the last group
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if k[mid] == last else (mid + 1, hi)
        if lo:
            yield t.slice(0, lo).combine_chunks()
        held = t.slice(lo).to_batches()
        rows = t.num_rows - lo
        size = sum(b.nbytes for b in held) if lo else 0  # a group that is larger waits for as much again
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def shared(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names; only where it names none (tests) to a temporary one."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster shares, for tables that a job writes and reads again."""
    shared(spark)
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, folder: str) -> None:
    """Removes a folder that scratch gave."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder: a lost executor takes nothing with it."""
    shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in a new shared folder: computed once, where a checkpoint's last stage runs twice."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a file in a small table that one step writes for the next, about.
FILE_ROWS = 50_000


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """df in partitions by its number of rows, which is known, so a small table isn't written by hundreds of tasks with a few rows
    each; no task gets more than about FILE_ROWS rows more than it had."""
    return df.coalesce(max(8, -(-rows // FILE_ROWS)))


#: An end of an edge is hot if more than one in so many rows names it; so there are fewer hot ones than this.
HOT_SHARE = 50_000


def spread_join(rows: DataFrame, facts: DataFrame, key: str | list[str], count: str, total: int, least: int = 1000) -> DataFrame:
    """rows joined with facts (key, count, ...), one for each key that rows hold; count says how many rows hold it.

    Keys that more than total / HOT_SHARE of the rows hold are fewer than HOT_SHARE, so they are broadcast and their
    rows stay where they are; only the others meet by a shuffle.
    """
    limit = max(least, total // HOT_SHARE)
    hot = facts.where(F.col(count) > limit).drop(count)
    cold = facts.where(F.col(count) <= limit).drop(count)
    there = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(there)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root the smallest node that it reaches.

    Alternates large-star and small-star steps: each makes nodes point to smaller neighbours, and the work of a
    round is in proportion to the edges. Nodes without an edge have no row. Goes on until all edges lead to roots; a
    node that many edges share is broadcast with its smallest neighbour, so its edges don't meet in one task. What a
    round wrote goes with the next one; the last facts are the result.
    """
    spark, folders = edges.sparkSession, []

    def put(df: DataFrame) -> DataFrame:
        folders.append(scratch(spark, "components"))
        df.write.parquet(folders[-1])
        return spark.read.schema(df.schema).parquet(folders[-1])

    def drop() -> None:
        for folder in folders[:-1]:
            dropped(spark, folder)
        del folders[:-1]

    now = put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    while True:
        both = now.select("a", "b", F.lit(1).alias("up")).union(now.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("up")))
        facts = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"), F.sum("up").alias("up"))
        facts = put(few_files(facts.withColumn("low", F.least("low", "a")), 2 * now.count()))
        open_ = F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("n") > F.col("up"))))
        state = facts.agg(open_.alias("open"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        if not state["open"]:
            break  # every node points to a root, once
        large = spread_join(both.where("up = 0").select("a", "b"), facts.select("a", "low", "n"), "a", "n", state["total"])
        large = put(few_files(large.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), state["total"]))
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = spread_join(large, low, "a", "n", state["total"])
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.*")
        now = put(few_files(small.where("a != b").distinct(), state["total"]))
        drop()
    drop()
    return facts.select(F.col("a").alias("node"), F.col("low").alias("root"))


def before(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the last value that isn't null among the rows before each one, in order, of its key.

    Rows are sorted by ranges; a range looks back over its own rows of a key, and the last values of the ranges before
    are handed on. So a key that a third of the rows have is dealt over many ranges, and no window holds it whole.
    """
    placed = kept(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_place", 33))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy("_range", *by).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    ends = placed.groupBy(*by, "_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_place"))).alias("_end"))
    handed = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*(F.col(c).alias(f"_e{k}") for k, c in enumerate(by)), F.col("_range").alias("_e_range"), handed.alias("_handed"))
    same = F.col("_range") == F.col("_e_range")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_e{k}"))
    met = placed.withColumn("_own", own).join(ends, same)
    return met.select(*rows.columns, F.coalesce("_own", "_handed").alias(name))


def over_batches(work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None]) -> Callable:
    """For mapInArrow: applies the work to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return run
