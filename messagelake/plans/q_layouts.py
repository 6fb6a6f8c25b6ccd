"""Layouts that spare reading: trees of digests under versions and stores, files clustered by the order of pages."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aliases as A
from ..plans.clustered import ClusteredTable
from ..plans.hashtree import TreedTable, tree_compare, tree_diff
from ..plans.mergeable import MergeTable
from ..session import table
from .bindings import ORDERS_SQL, order_messages, with_sql
from .q_streams import folder
from .registry import query


@query("r1_tree_diff", with_sql(ORDERS_SQL) + " SELECT urn, CASE WHEN urn % 103 <> 0 THEN kind END AS before, CASE WHEN urn % 103 = 0 THEN kind WHEN urn % 97 <> 0 THEN 'X' END AS after FROM om WHERE urn % 97 = 0 AND urn % 103 <> 0 OR urn % 101 = 0 AND urn % 97 <> 0 OR urn % 103 = 0 AND urn % 97 <> 0")
def r1_tree(spark, sf):
    """Two versions of one table: rows come, change and go by a merge; the diff reads leaves of the tree that differ."""
    m = order_messages(spark, sf).select("urn", "kind", "chat")
    t = TreedTable(spark, folder(spark), "urn long, kind string, chat long", ["urn"])
    first = t.merge(m.where("urn % 103 != 0"))
    new = m.where("urn % 103 = 0 or urn % 101 = 0").where("urn % 97 != 0")
    new = new.withColumn("kind", F.when((F.col("urn") % 101 == 0) & (F.col("urn") % 103 != 0), "X").otherwise(F.col("kind")))
    t.merge(new, m.where("urn % 97 = 0 and urn % 103 != 0").select("urn"))
    return tree_diff(t, t, ["kind", "chat"], first).select("urn", F.col("before.kind").alias("before"), F.col("after.kind").alias("after"))


@query("a24_tree_compare", with_sql(ORDERS_SQL) + " SELECT count(*) FILTER (urn % 97 <> 0 AND urn % 89 <> 0 AND urn % 101 <> 0) AS equal, count(*) FILTER (urn % 97 <> 0 AND urn % 89 <> 0 AND urn % 101 = 0) AS different, count(*) FILTER (urn % 97 = 0 AND urn % 89 <> 0) AS only_a, count(*) FILTER (urn % 89 = 0 AND urn % 97 <> 0) AS only_b FROM om")
def a24_tree(spark, sf):
    m = order_messages(spark, sf).select("urn", F.col("kind").alias("digest"))
    a, b = (TreedTable(spark, f"{folder(spark)}", "urn long, digest string", ["urn"]) for _ in range(2))
    a.merge(m.where("urn % 89 != 0"))
    b.merge(m.where("urn % 97 != 0").withColumn("digest", F.when(F.col("urn") % 101 == 0, "X").otherwise(F.col("digest"))))
    return tree_compare(a, b)


def clustered(spark, sf, order):
    """Orders in two runs whose ranges overlap; every 50th without a time."""
    m = order_messages(spark, sf).select("urn", "chat", F.when(F.col("urn") % 50 != 0, F.col("utc_ms")).alias("utc_ms"))
    t = ClusteredTable(spark, folder(spark), "urn long, chat long, utc_ms long", order, 5000)
    t.append(m.where("urn % 3 != 0"))
    t.append(m.where("urn % 3 = 0"))
    return t


TIMED = with_sql(ORDERS_SQL) + ", tm AS (SELECT urn, chat, CASE WHEN urn % 50 <> 0 THEN utc_ms END AS utc_ms FROM om)"


@query("q6_clustered_pages", TIMED + " SELECT urn, utc_ms FROM (SELECT *, row_number() OVER (ORDER BY utc_ms NULLS FIRST, urn) AS r FROM tm) WHERE r <= 600 AND r > 200")
def q6_clustered(spark, sf):
    """The second and third page of 200, by cursors, over files in the order of time."""
    t = clustered(spark, sf, ("utc_ms", "urn"))
    pages, after = [], None
    for _ in range(3):
        rows = sorted(((r.utc_ms, r.urn) for r in t.page(200, after).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))[:200]
        pages, after = [*pages, rows], rows[-1]
    return spark.createDataFrame([(u, ms) for rows in pages[1:] for ms, u in rows], "urn long, utc_ms long")


@query("q7_clustered_chats", TIMED + " SELECT urn, chat, utc_ms FROM (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY utc_ms DESC NULLS LAST, urn DESC) AS r FROM tm WHERE chat IN (SELECT min(chat) FROM tm UNION SELECT max(chat) FROM tm)) WHERE r <= 6")
def q7_clustered(spark, sf):
    """The newest of the first and the last chat, over files in the order of chats."""
    t = clustered(spark, sf, ("chat", "utc_ms", "urn"))
    ends = t.bounds.read().agg(F.min("lo.chat"), F.max("hi.chat")).first()
    one, two = (t.page(5, None, True, (c,)) for c in ends)
    return one.unionByName(two).select("urn", "chat", "utc_ms")


@query("x18_alias_groups", """WITH p AS (SELECT o_custkey AS c, o_orderkey AS o, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM orders)
  SELECT 'o' || lpad(CAST(o AS VARCHAR), 12, '0') AS member, 'o' || lpad(CAST(min(o) OVER (PARTITION BY c) AS VARCHAR), 12, '0') AS root FROM p QUALIFY count(*) OVER (PARTITION BY c) > 1""")
def x18_groups(spark, sf):
    """Each customer's orders as a chain of aliases that comes in two batches, the second joins what the first left apart."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.concat(F.lit("o"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("o"))
    links = o.withColumn("next", F.lead("o").over(Window.partitionBy("c").orderBy("o"))).where("next is not null")
    t = MergeTable(spark, folder(spark), A.MEMBERS, ["member"], 8)
    first = F.pmod(F.xxhash64("o"), F.lit(3)) > 0
    A.add_aliases(t, links.where(first), "o", "next", number=0)
    A.add_aliases(t, links.where(~first), "o", "next", number=1)
    return t.read()
