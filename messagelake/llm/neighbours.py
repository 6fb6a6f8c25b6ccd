"""Nearest neighbours by multi-index hashing: learned rotated binary codes in substrings, probed by the pigeonhole rule, floats reranked."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

#: Vectors that the rotations and the radius are fitted on, at most; those with the smallest hashes of their ids.
FIT_ROWS = 10_000
#: Share of true neighbours, within the fitted sample, that the probes must reach.
TARGET = 0.95
#: Bits of a code and of a substring; an index has a table of 2**16 values for each substring.
BITS, SUBSTRING = 384, 16
#: Numbers (rows times dimensions) of an index block, at most, and blocks that a small table is dealt into for its tasks.
BLOCK_FLOATS, LEAST_BLOCKS, LEAST_ROWS = 1 << 22, 16, 8192


@dataclass
class Coder:
    """Centred vectors, lengthened so that the largest inner product is the smallest angle, rotated; bits are signs."""

    mean: np.ndarray
    rotation: np.ndarray
    longest: float
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as 16-bit substrings. Inner products order as angles once all items have one length; the query is the
        same vector with nothing added, so its bits compare with the items'."""
        extra = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return self._bits(np.concatenate([x, extra[:, None]], 1))

    def encode_queries(self, x: np.ndarray) -> np.ndarray:
        return self._bits(np.concatenate([x, np.zeros((len(x), 1))], 1) * (self.longest / np.maximum(np.linalg.norm(x, axis=1), 1e-300))[:, None])

    def _bits(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1).view(np.uint16)

    def reach(self) -> list[int]:
        """How far each substring is probed. Radius m * r + a: of m substrings one of the first a + 1 is within r of the
        query's, or one of the others within r - 1; so these probes retrieve every code within the radius."""
        m = self.rotation.shape[1] // SUBSTRING
        r, a = divmod(min(self.radius, SUBSTRING * m), m)
        return [min(r if j <= a else r - 1, SUBSTRING) for j in range(m)]


def learned_rotation(centred: np.ndarray, bits: int, rounds: int, r: np.random.Generator) -> np.ndarray:
    """Principal directions turned until their signs lose least (iterative quantisation); as many turns, each from a start
    of its own, as give so many bits."""
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]  # directions, largest spread first
    base = axes[:, : min(bits, axes.shape[1])]
    turned, parts = centred @ base, []
    while sum(p.shape[1] for p in parts) < bits:
        rotation = np.linalg.qr(r.normal(size=(base.shape[1], base.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(turned @ rotation).T @ turned)
            rotation = (u @ v).T
        parts.append(base @ rotation)
    return np.concatenate(parts, 1)[:, :bits]


def fit_coder(x: np.ndarray, longest: float, top: int, target: float = TARGET, bits: int = BITS, rounds: int = 15, probes: int = 200) -> Coder:
    """Rotations learned on a sample, and the smallest radius whose probes retrieve the target share of the sample's own
    nearest. A table larger than the sample has nearer neighbours, so they are found more often."""
    full = np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))[:, None]], 1)
    mean = full.mean(0)
    rotation = learned_rotation(full - mean, bits, rounds, np.random.default_rng(11))
    coder = Coder(mean, rotation, longest, bits)
    m = bits // SUBSTRING
    q = np.arange(0, len(x), max(1, len(x) // probes))
    codes, asked = coder.encode(x), coder.encode_queries(x[q])
    near = x[q] @ x.T
    near[np.arange(len(q)), q] = -np.inf
    best = np.argsort(-near, 1)[:, : min(top, max(1, len(x) - 1))]
    far = np.bitwise_count(asked[:, None, :] ^ codes[best]).astype(np.int64)  # query, neighbour, substring
    needed = (far * m + np.arange(m)).min(2).ravel()  # the smallest radius whose probes retrieve it
    coder.radius = int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) if len(needed) else bits
    return coder


@functools.cache
def _masks(reach: int) -> np.ndarray:
    """The 16-bit numbers with so many ones at most."""
    every = np.arange(1 << SUBSTRING, dtype=np.uint16)
    return every[np.bitwise_count(every) <= reach]


class MultiIndex:
    """The codes of a block, by the value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.order = [np.argsort(codes[:, j], kind="stable").astype(np.int32) for j in range(codes.shape[1])]
        self.begin = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, j], minlength=1 << SUBSTRING))]).astype(np.int32) for j in range(codes.shape[1])]

    def probe(self, asked: np.ndarray, reach: list[int]) -> np.ndarray:
        """Queries x members: which members some probe of a query finds. A probe looks up every value within reach of a
        substring's."""
        seen = np.zeros((len(asked), self.n), bool)
        for j, r in enumerate(reach):
            if r >= SUBSTRING:
                seen[:] = True
            elif r >= 0:
                value = asked[:, j, None] ^ _masks(r)
                low = self.begin[j][value]
                size = self.begin[j][value.astype(np.int32) + 1] - low
                query, at = np.nonzero(size)
                low, size = low[query, at], size[query, at]
                place = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                seen[np.repeat(query, size), self.order[j][place]] = True
        return seen


class Block:
    """Members of the index with their codes, ids and vectors; unit-scaled copies in single precision rank roughly."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, coder: Coder):
        self.x, self.ids, self.coder = x, ids, coder
        self.index = MultiIndex(coder.encode(x))
        self.rough = (x / coder.longest).astype(np.float32)

    def nearest(self, queries: np.ndarray, ids: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query ids, ids, scores) of each query's best among the members that its probes find. Only what single precision
        can't rule out is scored in double."""
        reach, slack = self.coder.reach(), np.float32(4e-7 * (queries.shape[1] + 8))
        for low in range(0, len(queries), 64):
            q, own = queries[low : low + 64], ids[low : low + 64]
            seen = self.index.probe(self.coder.encode_queries(q), reach)
            seen &= own[:, None] != self.ids
            unit = (q / np.linalg.norm(q, axis=1)[:, None]).astype(np.float32)
            for k in range(len(q)):
                found = np.flatnonzero(seen[k])
                if len(found) > top:
                    near = self.rough[found] @ unit[k]
                    found = found[near >= np.partition(near, len(found) - top)[len(found) - top] - slack]
                score = np.add.reduce(self.x[found] * q[k], axis=1)  # one order of adding for all, so equal vectors tie
                order = np.lexsort((self.ids[found], -score))[:top]
                yield np.full(len(order), own[k]), self.ids[found[order]], score[order]


def _matrix(batches: list[pa.RecordBatch]) -> np.ndarray:
    """Vectors of one length as rows."""
    rows = sum(b.num_rows for b in batches)
    return np.concatenate([b["v"].flatten().to_numpy() for b in batches]).reshape(rows, -1)


def _searched(rows: DataFrame, queries: DataFrame, coder: Coder, blocks: int, top: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each index block for each query. A task holds one block: its members come
    first and are indexed once, then the queries pass by in batches."""
    sent = rows.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, block = [], None
        for batch in batches:
            asked = batch["asked"].to_numpy(zero_copy_only=False)
            first = int(asked.argmax()) if asked.any() else len(asked)
            if first:
                members.append(batch.slice(0, first))
            batch = batch.slice(first)
            if not batch.num_rows or not members:
                continue
            if block is None:
                block = Block(_matrix(members), np.concatenate([b["id"].to_numpy() for b in members]), sent.value)
            found = list(block.nearest(_matrix([batch]), batch["id"].to_numpy(), top))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    members = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asked"), "id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asked"), "id", "v")
    dealt = members.union(asked).repartitionById(blocks, "block").sortWithinPartitions("block", "asked")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest_neighbours(vectors: DataFrame, is_query: Column, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS, target: float = TARGET, block_floats: int = BLOCK_FLOATS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest by inner product in double precision, among those probed.

    Every vector is coded and indexed; only rotations and radius are fitted on a sample. The index is dealt into blocks
    by a hash, so a vector that a third of the rows share is spread evenly. Members are sent once, queries once to
    each block, and a block sends on its best for each query, no pairs; the best of all blocks are ranked with partial
    limits. The probes retrieve every code within the fitted Hamming radius, and all that they retrieve is reranked on
    the vectors. A query that has fewer than `top` that way is searched once more with the radius of all codes.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length is
    not the most frequent one. Of rows that repeat an id one vector stays, that with the smallest hash; an id is not
    its own neighbour. Ties go to the smaller id. Without vectors or queries there are no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda e: e != 0))
    rows = rows.groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"), F.max("query").alias("query"))
    shape = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.sum(F.col("query").cast("long")).alias("queries"), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)).alias("square")).orderBy(F.desc("rows"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if shape is None or not shape["queries"]:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == shape["n"])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("v").toPandas()
    coder = fit_coder(np.array(sample.v.tolist(), float).reshape(-1, shape["n"]), float(np.sqrt(shape["square"])) * (1 + 1e-12), top, target)
    blocks = max(1, -(-shape["rows"] * shape["n"] // block_floats), min(LEAST_BLOCKS, shape["rows"] // LEAST_ROWS))

    queries = rows.where("query").select("id", "v")
    found = kept(_searched(rows, queries, coder, blocks, top))
    count = queries.select("id").join(found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")), "id", "left")
    few = kept(count.where(F.coalesce("n", F.lit(0)) < min(top, shape["rows"] - 1)).select("id"))
    if not few.isEmpty():
        all_codes = Coder(coder.mean, coder.rotation, coder.longest, 1 << 30)
        more = _searched(rows, queries.join(few, "id", "left_semi"), all_codes, blocks, top)
        found = found.join(few.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
