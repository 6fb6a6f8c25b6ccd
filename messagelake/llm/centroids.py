"""Centroid clustering with heap-ordered bounds: gaps between the two nearest centroids, offset by drift; expired ones are rescanned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, scratch, written

#: Integers of this size or more have squared distances beyond a long.
LIMIT = 1 << 27
#: What rounding of distances may amount to, relative and absolute: gaps are held so much smaller.
SLACK = 1e-9
#: Bytes of a row group of a heap: the smaller, the less is read to pop its head.
ROW_GROUP = 4 << 20


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Packed integers as rows."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.int32)
    return data.reshape(len(column), dims).astype(np.int64)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exactly, rows by centroids: in doubles where all sums stay below 2**53, else in longs."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if most * most * x.shape[1] * 4 < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, the smaller number on ties; how much farther the second one is, at least)."""
    d = squared_distances(x, c)
    best = d.argmin(1)
    if len(c) == 1:
        return best, np.full(len(x), np.inf)
    upper, lower = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64)).T
    return best, lower - upper - SLACK * (lower + upper) - SLACK


def _pushed(popped: DataFrame, centroids: np.ndarray, offsets: np.ndarray) -> DataFrame:
    """(id, v, was, cluster, key): rows scanned against all centroids. The key is the gap above what their new cluster has
    drifted so far; a row expires once the offset reaches it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                best, gap = nearest(_matrix(b["v"], centroids.shape[1]), centroids)
                yield pa.RecordBatch.from_arrays([b["id"], b["v"], b["was"], pa.array(best.astype(np.int32)), pa.array(offsets[best] + gap)], ["id", "v", "was", "cluster", "key"])

    return popped.mapInArrow(run, "id long, v binary, was int, cluster int, key double")


def _moved(pushed: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What changed clusters give and take: componentwise sums and counts, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x = _matrix(b["v"], dims)
            for column, sign in (("cluster", 1), ("was", -1)):
                at = b[column].to_numpy()
                for j in np.unique(at[at >= 0]).tolist():
                    sums[j] += sign * x[at == j].sum(0)
                    n[j] += sign * int((at == j).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(n), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = pushed.where("cluster != was").mapInArrow(run, "cluster long, n long, sums array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dims))).alias("sums")).collect()
    sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for r in rows:  # a row for each centroid
        sums[r["cluster"]], n[r["cluster"]] = r["sums"], r["n"]
    return sums, n


def _reached(offsets: np.ndarray, before: np.ndarray | None) -> Column:
    """Rows whose gap is used up by now, and wasn't before: one range of keys for each cluster, which the scan takes."""
    each = [(F.col("cluster") == j) & (F.col("key") <= float(now)) & (F.lit(True) if before is None else F.col("key") > float(before[j])) for j, now in enumerate(offsets)]
    out = each[0]
    for e in each[1:]:
        out = out | e
    return out


def pack(vectors: DataFrame, id_col: str, vector_col: str, scale: int, dims: int | None, limit: int = LIMIT) -> DataFrame:
    """(id, v): vectors as packed 32-bit integers floor(scale * x). Vectors that are null, hold null or non-finite
    components, or an integer of `limit` or more in size, or that haven't `dims` components (if told), are left out."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= limit / scale)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(~F.exists("v", bad) & (F.lit(True) if dims is None else F.size("v") == dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                whole = np.floor(b["v"].flatten().to_numpy() * float(scale)).astype(np.int32)
                ends = np.cumsum(b["v"].value_lengths().to_numpy()) * 4
                packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([b["id"], packed], ["id", "v"])

    return rows.mapInArrow(run, "id long, v binary")


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1", scale: int = 64, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid) of every vector with so many components, exactly.

    Components become integers floor(scale * x). Centroids start as the k vectors whose sha256 of "seed:id" is
    smallest; each round assigns all vectors to the nearest (squared distance, ties to the smaller number) and moves
    each centroid that has vectors to the floor of their mean; at the end vectors are assigned once more.

    A cluster's heap is a table of its vectors sorted by key: the gap between second nearest and nearest centroid
    when the vector was scanned, plus the cluster's offset then. When centroids move, a cluster's offset grows by its
    own drift and the largest of the others'; as long as it stays below the key, the nearest centroid can't have
    changed. So a round reads only the heads of the heaps, by ranges of keys that skip the row groups beyond, scans
    those vectors against all centroids, and pushes them to new heaps; all others stay where they are. Sums change by
    the vectors that changed clusters. Each vector is written once at the start and once when popped; nothing is shuffled
    but a row for each centroid and task.

    Vectors that are null, hold null or non-finite components or have another length take no part, nor those with an
    integer of 2**27 or more in size, whose distances don't fit a long. Rows that repeat an id each count; as starts
    they come in the order of their components' bytes. A row without id is no start if k others are there. Fewer than
    k vectors give as many centroids. Other columns are ignored; without vectors there are no rows.
    """
    spark = vectors.sparkSession
    rows = pack(vectors, id_col, vector_col, scale, dims)
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = rows.orderBy(first.asc_nulls_last(), "v").limit(k).collect()
    if not starts:
        return _named(spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"), id_col)
    centroids = np.stack([np.frombuffer(r["v"], np.int32) for r in starts]).astype(np.int64)
    k, folder, offsets = len(centroids), scratch(spark, "heaps"), [np.zeros(len(centroids))]
    sums, n, heaps = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), []

    def push(popped: DataFrame) -> DataFrame:
        path = f"{folder}/{len(heaps)}"
        _pushed(popped, centroids, offsets[-1]).sortWithinPartitions("cluster", "key").write.option("parquet.block.size", ROW_GROUP).parquet(path)
        heaps.append(spark.read.parquet(path))
        return heaps[-1]

    latest = push(rows.withColumn("was", F.lit(-1)))
    for _ in range(rounds):
        more, gained = _moved(latest, k, dims)
        sums, n = sums + more, n + gained
        moved = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)
        drift = np.sqrt(((moved - centroids) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        others = np.array([np.delete(drift, j).max(initial=0.0) for j in range(k)])
        centroids = moved
        offsets.append(offsets[-1] + drift + others)
        heads = [h.where(_reached(offsets[-1], None if g == len(heaps) - 1 else offsets[-2])) for g, h in enumerate(heaps)]
        latest = push(_all(heads).select("id", "v", F.col("cluster").alias("was")))
    live = _all([h if g == len(heaps) - 1 else h.where(~_reached(offsets[-1], None)) for g, h in enumerate(heaps)])
    out = written(_distances(live, centroids), "clusters")
    dropped(spark, folder)

    inertias = {r["cluster"]: r["total"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # a row for each centroid
    table = [(j, total, sum(inertias.values()), centroids[j].tolist()) for j, total in sorted(inertias.items())]
    facts = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return _named(out.join(F.broadcast(facts), "cluster"), id_col)


def _named(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _distances(live: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                off = _matrix(b["v"], centroids.shape[1]) - centroids[b["cluster"].to_numpy()]
                yield pa.RecordBatch.from_arrays([b["id"], b["cluster"], pa.array((off * off).sum(1))], ["id", "cluster", "distance"])

    return live.mapInArrow(run, "id long, cluster int, distance long")
