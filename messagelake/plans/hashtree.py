"""Digests of a merged table by ranges of hashes, kept with its versions, so that comparing two descends into what differs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.routing import diff
from .mergeable import MergeTable
from .state import kept

FAN = 4  # bits of a level: a node has up to 16 children


class TreedTable:
    """A MergeTable with a tree over each of its buckets. A leaf is a range of key hashes, a node holds the number of the rows
    below it and two sums of 60 bits of their SHA-256, so a repeated or hot key is summed before it is shuffled and a parent is
    the sum of its children. Different rows pass as equal with a chance of about 2^-120.

    merge() brings the tree up to date from the buckets that have new files, and writes only nodes that changed. A crash
    between the two leaves the tree of the version before; the next merge() or update() catches up.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str], buckets: int = 16, depth: int = 3):
        self.table = MergeTable(spark, f"{path}/rows", schema, keys, buckets)
        self.nodes = MergeTable(spark, f"{path}/tree", "part int, level int, node long, n long, a decimal(38,0), b decimal(38,0)", ["part", "level", "node"], buckets, F.col("part"))
        self.depth = depth
        self.shape = (buckets, depth, tuple(keys), tuple(self.table.columns))

    def _placed(self, rows: DataFrame) -> DataFrame:
        leaf = F.pmod(F.xxhash64(*self.table.keys, F.lit("leaf")), F.lit(1 << (FAN * self.depth)))
        return rows.withColumns({"part": self.table.bucket, "node": leaf})

    def _tree(self, rows: DataFrame) -> DataFrame:
        whole = F.sha2(F.to_json(F.struct(*self.table.columns), {"ignoreNullFields": "false"}), 256)
        number = lambda start: F.conv(F.substring("h", start, 15), 16, 10).cast("decimal(20,0)")
        summed = lambda df, n: df.agg(n.alias("n"), F.sum("a").cast("decimal(38,0)").alias("a"), F.sum("b").cast("decimal(38,0)").alias("b"))
        leaves = self._placed(rows).withColumn("h", whole).withColumns({"a": number(1), "b": number(16)})
        level = kept(summed(leaves.groupBy("part", "node"), F.count("*")).withColumn("level", F.lit(self.depth)))
        out = level
        for k in range(self.depth - 1, -1, -1):
            up = F.shiftright("node", FAN * (self.depth - k))
            out = out.unionByName(summed(level.groupBy("part", up.alias("node")), F.sum("n")).withColumn("level", F.lit(k)))
        return out

    def merge(self, batch: DataFrame, gone: DataFrame | None = None, consumer: str | None = None, number: int | None = None) -> int:
        version = self.table.merge(batch, gone, consumer, number)
        self.update()
        return version

    def update(self) -> None:
        """The tree of the table's latest version."""
        known, done = self.table.versions(), self.nodes.done("tree")
        if not known or done == known[-1]:
            return
        now = self.table.manifest(known[-1])["files"]
        before = self.table.manifest(done)["files"] if done in known else {}
        new = sorted(int(b) for b, f in now.items() if f != before.get(b))
        tree = self._tree(self.table.read(known[-1], new))
        old = self.nodes.read(buckets=new) if self.nodes.versions() else tree.limit(0)
        place = ["part", "level", "node"]
        gone = old.join(tree, place, "left_anti").select(*place)
        moved = tree.select(*self.nodes.columns).join(old, [*place, "n", "a", "b"], "left_anti")
        self.nodes.merge(moved, gone, "tree", known[-1])

    def tree(self, version: int | None = None) -> int:
        """The tree's version that belongs to a version of the table."""
        wanted = self.table.versions()[-1] if version is None else version
        for v in reversed(self.nodes.versions()):
            if self.nodes.manifest(v)["applied"]["tree"] == wanted:
                return v
        raise ValueError(f"no tree of version {wanted}")

    def rows(self, version: int | None, parts: Sequence[int], leaves: DataFrame) -> DataFrame:
        """The rows of some leaves, from the files of their buckets alone."""
        return self._placed(self.table.read(version, parts)).join(leaves, ["part", "node"], "left_semi").select(*self.table.columns)


def differing(old: TreedTable, new: TreedTable, old_version: int | None = None, new_version: int | None = None) -> tuple[list[int], DataFrame]:
    """The buckets that differ, at most as many numbers as there are, and the leaves (part, node) of them that do: from the
    roots down, each level reads only the buckets, and keeps only the children, of nodes that differ."""
    if old.shape != new.shape:
        raise ValueError("tables of different keys, columns or trees can't be compared by their trees")
    x, y = old.tree(old_version), new.tree(new_version)
    parts = None
    if old.nodes.path == new.nodes.path:  # buckets with the same files need no look
        a, b = old.nodes.manifest(x)["files"], new.nodes.manifest(y)["files"]
        parts = sorted(int(p) for p in a.keys() | b.keys() if a.get(p) != b.get(p))
    above = None
    for level in range(old.depth + 1):
        side = lambda t, v, name: t.nodes.read(v, parts).where(F.col("level") == level).select("part", "node", F.struct("n", "a", "b").alias(name))  # noqa: B023, E731
        one, two = side(old, x, "one"), side(new, y, "two")
        if above is not None:
            up = F.shiftright("node", FAN).alias("up")
            one, two = (df.select("*", up).join(above, ["part", "up"], "left_semi").drop("up") for df in (one, two))
        found = kept(one.join(two, ["part", "node"], "full_outer").where(~F.col("one").eqNullSafe(F.col("two"))).select("part", "node"))
        if above is None:
            parts = sorted(r[0] for r in found.select("part").distinct().collect())
        above = found.withColumnRenamed("node", "up")
    return parts, found


def tree_diff(old: TreedTable, new: TreedTable, values: Sequence[str], old_version: int | None = None, new_version: int | None = None) -> DataFrame:
    """What routing.diff says of two versions or tables with one key column, reading rows of differing leaves only."""
    (key,) = old.table.keys
    parts, leaves = differing(old, new, old_version, new_version)
    return diff(old.rows(old_version, parts, leaves), new.rows(new_version, parts, leaves), key, values)


def tree_compare(a: TreedTable, b: TreedTable) -> DataFrame:
    """What archive.compare_stores says of two tables (urn, digest): rows of equal leaves are counted by the trees."""
    from ..operators.archive import compare_stores

    parts, leaves = differing(a, b)
    one, two = a.rows(None, parts, leaves), b.rows(None, parts, leaves)
    level = a.nodes.read(a.tree()).where(F.col("level") == a.depth)
    same = level.join(leaves, ["part", "node"], "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("same"))
    total: Column = F.col("equal") + F.col("same")
    return compare_stores(one, two).crossJoin(same).withColumn("equal", total).drop("same")  # one row each
