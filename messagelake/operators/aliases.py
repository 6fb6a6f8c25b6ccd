"""Groups of addresses that aliases join, however long the chains are, kept as aliases arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.mergeable import MergeTable
from ..plans.state import kept


def _roots(up: DataFrame) -> DataFrame:
    """(u, p) of a forest of parents, with each p its root, by doubling. A root is its own parent."""
    while True:
        far = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
        ahead = kept(up.join(far, "p").select("u", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
        if ahead.where("moved").isEmpty():
            return ahead.select("u", "p")
        up = ahead.select("u", "p")


def groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(member, root) of all that pairs join; the root is the smallest member. Null ends and circles do no harm, and an address
    joined with itself only is a group of its own.

    Star contraction: in a round each address hooks onto that of its neighbours with the smallest hash, drawn anew for each
    round, trees are drawn together by doubling, and pairs between the roots are left. A round takes away half of the
    addresses or more on average, whatever the chain or hub looks like, so rounds follow the logarithm of their number.
    """
    both = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = kept(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    alone = both.where("a = b").select(F.col("a").alias("member"))
    edges, rounds = both.where("a != b"), []
    while not edges.isEmpty():
        draw = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = ends.groupBy("u").agg(F.min(draw("v")).alias("least"))
        up = _roots(kept(low.select("u", F.when(F.col("least") < draw("u"), F.col("least.x")).otherwise(F.col("u")).alias("p"))))
        rounds.append(up)
        at = lambda c: up.select(F.col("u").alias(c), F.col("p").alias(f"p{c}"))  # noqa: B023, E731
        left = edges.join(at("a"), "a").join(at("b"), "b").where("pa != pb")
        edges = kept(left.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not rounds:
        return alone.select("member", F.col("member").alias("root"))
    top = rounds.pop()
    while rounds:  # where the roots of a round went in the rounds after it
        later = top.select(F.col("u").alias("p"), F.col("p").alias("q"))
        top = kept(rounds.pop().join(later, "p", "left").select("u", F.coalesce("q", "p").alias("p")))
    joined = top.join(top.groupBy("p").agg(F.min("u").alias("root")), "p").select(F.col("u").alias("member"), "root")
    return joined.unionByName(alone.join(joined.select("member"), "member", "left_anti").select("member", F.col("member").alias("root")))


def closure(seeds: DataFrame, grouped: DataFrame) -> DataFrame:
    """The seeds (one column) and all members of their groups."""
    (name,) = seeds.columns
    own = grouped.join(seeds.select(F.col(name).alias("member")), "member", "left_semi").select("root").distinct()
    return seeds.union(grouped.join(own, "root", "left_semi").select("member")).distinct()


MEMBERS = "member string, root string"


def add_aliases(table: MergeTable, pairs: DataFrame, a: str, b: str, consumer: str = "aliases", number: int | None = None) -> int:
    """Takes new pairs into a table of MEMBERS keyed by member; the version. Only the buckets of their ends are looked up,
    only roots and new addresses are grouped, and only members whose root moved are written; the table is read whole
    where two groups of it become one. A number that was taken before changes nothing."""
    if number is not None and (table.done(consumer) if table.done(consumer) is not None else -1) >= number:
        return table.versions()[-1]
    new = kept(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct())
    ends = kept(new.select(F.col("a").alias("member")).union(new.select("b")).distinct())
    known = kept(table.read(buckets=table.touched(ends)).join(ends, "member", "left_semi"))
    at = lambda c: known.select(F.col("member").alias(c), F.col("root").alias(f"r{c}"))
    between = new.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    now = kept(groups(between, "a", "b"))
    moved = now.where("member != root")
    fresh = ends.join(known, "member", "left_anti").join(now, "member")
    old_roots = moved.join(known.select(F.col("root").alias("member")), "member", "left_semi").select(F.col("member").alias("root"), F.col("root").alias("to"))
    if old_roots.isEmpty():
        return table.merge(fresh, None, consumer, number)
    changed = table.read().join(old_roots, "root").select("member", F.col("to").alias("root"))
    return table.merge(fresh.unionByName(changed), None, consumer, number)
