"""Exact top-k search: everything is scored, histograms of the scores are refined to each kth value, then rows are filtered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .centroids import pack
from .common import kept

#: Bins of a histogram, as bits: a round narrows a kth value down by so many bits.
BITS = 10
#: Integers of this size or more may have scores beyond a long.
LIMIT = 1 << 27
#: Numbers (rows times dimensions) that a block holds, at most; blocks that a small table is dealt into; scores held at once.
BLOCK_NUMBERS, LEAST_BLOCKS, LEAST_ROWS, AT_ONCE = 1 << 22, 16, 1024, 1 << 20

#: What a query knows of its kth value. Places count from the best: of scores, how far below `top`; then, among scores
#: equal to `tie`, of ids, how far above the smallest. The kth lies from `base` on, in bins of 2**shift places.
STATE = ["id", "v", "top", "by_id", "tie", "base", "shift", "above"]


def _scores(members: np.ndarray, queries: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as longs: in doubles if no sum reaches 2**53."""
    return (queries.astype(np.float64) @ members.T).astype(np.int64) if exact else queries @ members.T


def _scanned(rows: DataFrame, asked: DataFrame, blocks: int, dims: int, exact: bool, work: Callable, schema: str) -> DataFrame:
    """work(ids of a block, query columns, scores) for all queries and blocks. A task holds one block: its members come
    first, then the queries pass by in batches; members are sent once."""
    columns = [c for c in asked.columns if c not in ("id", "v")]

    def matrix(batches: list[pa.RecordBatch]) -> np.ndarray:
        return np.concatenate([np.frombuffer(b"".join(b["v"].to_pylist()), np.int32).reshape(b.num_rows, dims) for b in batches]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, members, ids = [], None, None
        for batch in batches:
            late = batch["late"].to_numpy(zero_copy_only=False)
            first = int(late.argmax()) if late.any() else len(late)
            if first:
                held.append(batch.slice(0, first))
            batch = batch.slice(first)
            if not batch.num_rows or not held:
                continue
            if members is None:
                members, ids = matrix(held), np.concatenate([b["id"].to_numpy() for b in held])
                members = members.astype(np.float64) if exact else members
            step = max(1, AT_ONCE // len(ids))
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                told = {c: part[c].to_numpy(zero_copy_only=False) for c in ("id", *columns)}
                found = work(ids, told, _scores(members, matrix([part]), exact))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=[f.split()[0] for f in schema.split(", ")])

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    nothing = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in columns]
    members = rows.select(block, F.lit(False).alias("late"), "id", "v", *nothing)
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("late"), "id", "v", *columns)
    return members.union(every).repartitionById(blocks, "block").sortWithinPartitions("block", "late").mapInArrow(run, schema)


def _counted(least: int, k: int) -> Callable:
    """(query_id, bin, n) of a block: how many of its rows fall in each bin of a query. Bins below those that hold the
    block's own k best aren't sent, since the kth of all is no worse than the kth of a block."""

    def work(ids: np.ndarray, q: dict, scores: np.ndarray) -> tuple[np.ndarray, ...]:
        place = q["top"][:, None] - scores
        by_id = q["by_id"].astype(bool)
        if by_id.any():
            there = scores[by_id] == q["tie"][by_id][:, None]
            place[by_id] = np.where(there, ((ids >> 1) - (least >> 1))[None, :], -1)
        at = (place - q["base"][:, None]) >> q["shift"][:, None]
        at[(place < 0) | (at < 0) | (at >= 1 << BITS) | (ids[None, :] == q["id"][:, None])] = 1 << BITS
        at += np.arange(len(at))[:, None] * ((1 << BITS) + 1)
        n = np.bincount(at.ravel(), minlength=len(at) * ((1 << BITS) + 1)).reshape(len(at), -1)[:, : 1 << BITS]
        needed = np.cumsum(n, 1) - n < k
        query, bin_ = np.nonzero(needed & (n > 0))
        return q["id"][query], bin_, n[query, bin_]

    return work


def _taken(least: int) -> Callable:
    """(query_id, vec_id, score) of a block's rows beyond the query's floor, or at it with an id up to the cut."""

    def work(ids: np.ndarray, q: dict, scores: np.ndarray) -> tuple[np.ndarray, ...]:
        floor, cut = q["floor"][:, None], q["cut"][:, None]
        good = (scores > floor) | ((scores == floor) & (((ids >> 1) - (least >> 1))[None, :] <= cut))
        query, member = np.nonzero(good & (ids[None, :] != q["id"][:, None]))
        return q["id"][query], ids[member], scores[query, member]

    return work


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block_numbers: int = BLOCK_NUMBERS, slack: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of integers floor(scale * x), exactly.

    Each round scores all vectors against the queries that are still open and counts, over all blocks, how many scores
    fall in each of 1,024 bins; the bin that holds the kth is cut into 1,024 again. A query is settled once at most
    slack * k rows are in or above that bin. If more rows than that share the kth score, the round after counts their ids in
    the same way, so ties of any number are cut at an id and no task gathers them. At the end all rows are scored once
    more, those beyond each query's cut are kept, slack * k at most, and ranked; ties go to the smaller id.

    Vectors are dealt into blocks by a hash, so equal ones are spread; they are sent once a round, queries once to
    each block; blocks send counts of k rows, no pairs. is_query must depend on id_col alone.

    Vectors that are null or hold null or non-finite components take no part, nor empty ones, those whose length is
    not the most frequent one, or with an integer of 2**27 or more in size, whose scores may not fit a long. Of rows
    that repeat an id one vector stays, that with the smallest bytes; an id is not its own neighbour. Rows without id
    take no part. Other columns are ignored; without vectors or queries there are no rows.
    """
    spark = vectors.sparkSession
    packed = pack(vectors, id_col, vector_col, scale, None, LIMIT).where("id is not null")
    rows = packed.groupBy("id").agg(F.min("v").alias("v")).withColumnRenamed("id", id_col)
    rows = kept(rows.select(F.col(id_col).alias("id"), "v", F.coalesce(is_query, F.lit(False)).alias("query")))
    shape = rows.groupBy(F.octet_length("v").alias("n")).agg(F.count("*").alias("rows"), F.count_if("query").alias("queries"), F.min("id").alias("least"), F.max("id").alias("most")).orderBy(F.desc("rows"), "n").first()
    schema = "query_id long, rank int, vec_id long, score long"
    if shape is None or not shape["queries"] or shape["rows"] < 2:
        return spark.createDataFrame([], schema)
    rows, dims = rows.where(F.octet_length("v") == shape["n"]).select("id", "v", "query"), shape["n"] // 4
    longest = max(1.0, rows.mapInArrow(_lengths, "id long, length double").agg(F.max("length")).first()[0])
    exact = longest * longest < (1 << 52)
    blocks = max(1, -(-shape["rows"] * dims // block_numbers), min(LEAST_BLOCKS, shape["rows"] // LEAST_ROWS))
    wanted, least = min(k, shape["rows"] - 1), shape["least"]
    id_shift = max(0, ((shape["most"] >> 1) - (least >> 1)).bit_length() - BITS)

    queries = rows.where("query").select("id", "v")
    tops = queries.mapInArrow(_lengths, "id long, length double").select("id", (F.ceil(F.col("length") * longest * (1 + 1e-9)) + 1).alias("top"))
    bits = F.length(F.bin(F.col("top") * 2 + 1)).cast("int")
    state = queries.join(tops, "id").select("id", "v", "top", F.lit(0).alias("by_id"), F.lit(0).cast("long").alias("tie"), F.lit(0).cast("long").alias("base"), F.greatest(F.lit(0), bits - BITS).alias("shift"), F.lit(0).cast("long").alias("above"))
    state, settled = kept(state), None
    while True:
        bins = _scanned(rows.select("id", "v"), state, blocks, dims, exact, _counted(least, k), "query_id long, bin long, n long")
        bins = bins.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("query_id").orderBy("bin"))  # a row for each bin
        met = bins.withColumn("upto", upto).join(state, F.col("query_id") == F.col("id"))
        met = met.where((F.col("above") + F.col("upto") >= wanted) & (F.col("above") + F.col("upto") - F.col("n") < wanted))
        met = met.withColumn("base", F.col("base") + F.expr("shiftleft(bin, shift)")).withColumn("reached", F.col("above") + F.col("upto"))
        met = met.withColumn("last", F.col("base") + F.expr("shiftleft(1L, shift)") - 1)
        found = kept(met.withColumn("settled", (F.col("reached") <= slack * k) | ((F.col("by_id") == 1) & (F.col("shift") == 0))).withColumn("above", F.col("reached") - F.col("n")))
        # settled: by scores, all from the bin's last place up; by ids, all above the tie and its ids up to the last place
        floor = F.when(F.col("by_id") == 1, F.col("tie")).otherwise(F.col("top") - F.col("last") - 1)
        ended = found.where("settled").select("id", "v", floor.alias("floor"), F.when(F.col("by_id") == 1, F.col("last")).otherwise(F.lit(-1)).alias("cut"))
        settled = ended if settled is None else settled.union(ended)
        rest = found.where("not settled")
        if rest.isEmpty():
            break
        tied = (F.col("by_id") == 0) & (F.col("shift") == 0)
        changed = {"by_id": F.when(tied, 1).otherwise(F.col("by_id")), "tie": F.when(tied, F.col("top") - F.col("base")).otherwise(F.col("tie")), "base": F.when(tied, F.lit(0).cast("long")).otherwise(F.col("base")), "shift": F.when(tied, id_shift).otherwise(F.greatest(F.lit(0), F.col("shift") - BITS))}
        state = rest.withColumns(changed).select(*STATE)
    out = _scanned(rows.select("id", "v"), settled, blocks, dims, exact, _taken(least), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, length) of packed vectors."""
    for b in batches:
        if b.num_rows:
            x = np.frombuffer(b"".join(b["v"].to_pylist()), np.int32).reshape(b.num_rows, -1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(np.sqrt((x * x).sum(1)))], ["id", "length"])
