"""Interval queries over event ids."""

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..session import table
from .registry import query

ISLANDS = """i AS (SELECT user_id, min(event_id) AS lo, max(event_id) AS hi FROM (SELECT user_id, event_id, event_id - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g
  FROM (SELECT DISTINCT user_id, event_id // 4 AS event_id FROM events)) GROUP BY user_id, g)"""
CELLS = """SELECT k, x FROM (SELECT DISTINCT event_type AS k, unnest(range(user_id * 3, user_id * 3 + 1 + event_id % 11)) AS x FROM events WHERE event_id % 2 {a})"""
RUNS = """SELECT k, min(x) AS lo, max(x) AS hi FROM (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM ({cells})) GROUP BY k, g"""


def ids(spark, sf):
    return table(spark, sf, "events").select("user_id", F.floor(F.col("event_id") / 4).alias("id"))


def spans(spark, sf, part=None):
    """The spans of all events, or of those with even or odd ids as the two sides of an operator."""
    t = table(spark, sf, "events")
    t = t.where(f"event_id % 2 {part}") if part else t
    lo = F.col("user_id") * 3
    return t.select(F.col("event_type").alias("k"), lo.alias("lo"), (lo + F.col("event_id") % 11).alias("hi"))


@query("w5_islands", f"WITH {ISLANDS} SELECT * FROM i")
def w5(spark, sf):
    return I.islands(ids(spark, sf), ["user_id"])


@query("c9_merge_spans", RUNS.format(cells=CELLS.format(a=">= 0")))
def c9(spark, sf):
    return I.merge_spans(spans(spark, sf), ["k"], 6)


@query("c10_subtract_spans", RUNS.format(cells=CELLS.format(a="= 0") + " EXCEPT " + CELLS.format(a="= 1").replace("user_id * 3", "user_id * 3 * 7")))
def c10(spark, sf):
    b = spans(spark, sf, "= 1").select("k", (F.col("lo") * 7).alias("lo"), (F.col("hi") - F.col("lo") + F.col("lo") * 7).alias("hi"))
    return I.subtract_spans(spans(spark, sf, "= 0"), b, ["k"], 6)


@query("e4_intersect_spans", RUNS.format(cells=CELLS.format(a="= 0") + " INTERSECT " + CELLS.format(a="= 1").replace("user_id * 3", "user_id * 3 * 7")))
def e4(spark, sf):
    b = spans(spark, sf, "= 1").select("k", (F.col("lo") * 7).alias("lo"), (F.col("hi") - F.col("lo") + F.col("lo") * 7).alias("hi"))
    return I.intersect_spans(spans(spark, sf, "= 0"), b, ["k"], 6)


STAMPED = """WITH s AS (SELECT event_type AS k, user_id * 3 AS lo, user_id * 3 + event_id % 11 AS hi, event_id % 50 AS "at", CAST(event_id % 4 AS VARCHAR) AS run, event_id AS arrival FROM events), o AS (SELECT event_type AS k, user_id * 3 AS lo, user_id * 3 + 40 AS hi, 25 AS "at", 'old' AS run, -1 AS arrival FROM (SELECT DISTINCT event_type, user_id FROM events WHERE user_id % 14 = 0)),
  c AS (SELECT k, unnest(range(lo, hi + 1)) AS x, "at", run, arrival FROM (SELECT * FROM s UNION ALL SELECT * FROM o)), b AS (SELECT k, x, max(struct_pack("at" := "at", arrival := arrival, run := run)) AS m FROM c GROUP BY k, x),
  g AS (SELECT k, x, m."at" AS "at", m.run AS run, x - row_number() OVER (PARTITION BY k, m."at", m.run ORDER BY x) AS g FROM b)
  SELECT k, min(x) AS lo, max(x) AS hi, "at", run FROM g GROUP BY k, "at", run, g"""


@query("c6_stamp", STAMPED)
def c6(spark, sf):
    t = table(spark, sf, "events")
    lo = F.col("user_id") * 3
    old = t.where("user_id % 14 = 0").select(F.col("event_type").alias("k"), lo.alias("lo"), (lo + 40).alias("hi"), F.lit(25).alias("at"), F.lit("old").alias("run")).distinct()
    s = t.select(F.col("event_type").alias("k"), lo.alias("lo"), (lo + F.col("event_id") % 11).alias("hi"), (F.col("event_id") % 50).alias("at"), (F.col("event_id") % 4).cast("string").alias("run"), F.col("event_id").alias("arrival"))
    return I.stamp(old.withColumn("at", F.lit(25).cast("long")), s, ["k"], 10)


@query("j9_asof_interval", f"""WITH {ISLANDS} SELECT event_id, i.lo AS island_lo FROM (SELECT event_id, user_id, event_id // 4 + event_id % 3 AS key FROM events) e LEFT JOIN i ON i.user_id = e.user_id AND key BETWEEN lo AND hi""")
def j9(spark, sf):
    i = I.islands(ids(spark, sf), ["user_id"]).withColumn("island_lo", F.col("lo"))
    keys = table(spark, sf, "events").select("event_id", "user_id", (F.floor(F.col("event_id") / 4) + F.col("event_id") % 3).alias("key"))
    return I.asof_interval(keys, i, ["user_id"], "key", ["island_lo"]).select("event_id", "island_lo")


@query("j10_overlap_join", """SELECT k, count(*) AS pairs, sum(least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1)::BIGINT AS ids FROM (SELECT event_type AS k, user_id * 3 AS lo, user_id * 3 + event_id % 11 AS hi FROM events WHERE event_id % 2 = 0) a
  JOIN (SELECT event_type AS k, user_id * 3 AS lo, user_id * 3 + event_id % 11 AS hi FROM events WHERE event_id % 2 = 1) b USING (k) WHERE a.lo <= b.hi AND b.lo <= a.hi GROUP BY k""")
def j10(spark, sf):
    t = table(spark, sf, "events")
    lo = F.col("user_id") * 3
    part = lambda r: t.where(f"event_id % 2 = {r}").select(F.col("event_type").alias("k"), lo.alias("lo"), (lo + F.col("event_id") % 11).alias("hi"))
    return I.overlap_totals(part(0), part(1), ["k"])


WIDE = """w AS (SELECT o_custkey % 7 AS k, o_orderkey * 4194304 AS lo, o_orderkey * 4194304 + (1::BIGINT << (o_orderkey % 40)) AS hi, o_orderkey AS id FROM orders)"""


def wide(spark, sf):
    """Orders as spans of 2 to 2**39 ids."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("k"), (key * 4194304).alias("lo"), (key * 4194304 + F.pow(F.lit(2.0), key % 40).cast("long")).alias("hi"), key.alias("id"))


@query("j10_overlap_pairs", f"WITH {WIDE} SELECT a.id, b.o_orderkey AS held, b.at - a.lo AS offset FROM w a JOIN (SELECT o_orderkey, o_custkey % 7 AS k, o_orderkey * 4194304 + 5 AS at FROM orders WHERE o_orderkey % 16 = 0) b ON a.k = b.k AND b.at BETWEEN a.lo AND a.hi WHERE a.id % 40 < 30")
def j10_pairs(spark, sf):
    w = wide(spark, sf)
    points = w.where("id % 16 = 0").select("k", (F.col("lo") + 5).alias("lo"), (F.col("lo") + 5).alias("hi"), F.col("id").alias("held"))
    return I.overlap_join(w.where("id % 40 < 30"), points, ["k"]).select("id", "held", (F.col("b_lo") - F.col("lo")).alias("offset"))


@query("c9_wide_spans", f"""WITH {WIDE}, s AS (SELECT k, lo, hi, CASE WHEN lo <= max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM w),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT k, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY k, g""")
def c9_wide(spark, sf):
    return I.merge_spans(wide(spark, sf), ["k"])


@query("c8_forget", """WITH s AS (SELECT DISTINCT event_type AS k, event_id // 2 AS x FROM events), d AS (SELECT k, x FROM s WHERE x % 5 <> 0), g AS (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM d)
  SELECT k, min(x) AS lo, max(x) AS hi, 1 AS run FROM g GROUP BY k, g""")
def c8(spark, sf):
    s = table(spark, sf, "events").select(F.col("event_type").alias("k"), F.floor(F.col("event_id") / 2).alias("id"))
    i = I.islands(s, ["k"]).withColumn("run", F.lit(1))
    return I.forget(i, s.where("id % 5 = 0"), ["k"], ["run"]).select("k", "lo", "hi", "run")


@query("c18_translate", """WITH x AS (SELECT DISTINCT user_id % 5 AS k, event_id AS p, event_id + 1000 * (event_id // 100 % 3) AS l, event_id % 7 <> 0 AS eligible FROM events), w AS (SELECT k, l AS x FROM x WHERE eligible)
  SELECT k, min(x) AS lo, max(x) AS hi FROM (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM (SELECT DISTINCT k, x FROM w)) GROUP BY k, g""")
def c18(spark, sf):
    t = table(spark, sf, "events")
    pairs = t.select((F.col("user_id") % 5).alias("k"), F.col("event_id").alias("producer_id"), (F.col("event_id") + 1000 * (F.floor(F.col("event_id") / 100) % 3)).alias("local_id"), (F.col("event_id") % 7 != 0).alias("eligible"))
    asked = I.islands(pairs.select("k", F.col("producer_id").alias("id")), ["k"])
    return I.local_spans(asked, I.affine_map(pairs, ["k"]), ["k"])  # islands are disjoint, and the map is of the same ids


@query("w7_contiguous", "SELECT l_orderkey AS k, count(*) = max(l_linenumber) - min(l_linenumber) + 1 AND count(*) = count(DISTINCT l_linenumber) AS contiguous FROM lineitem GROUP BY 1")
def w7(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("seq"))
    return I.contiguous(t, ["k"])
