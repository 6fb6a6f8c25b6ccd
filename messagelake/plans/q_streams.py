"""Streams over files of the event log, driven to their end by availableNow."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import store
from ..plans.mergeable import MergeTable
from ..plans.state import VersionedTable, kept, own_folder
from ..streaming import streams as T
from .bindings import OBSERVATIONS_SQL, ORDERS_SQL, observations, order_messages, with_sql
from .registry import query


def folder(spark) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark, "stream")
    return f"{top.rstrip('/')}/stream-{uuid.uuid4().hex}"


def log(spark, sf, where, files=1000):
    """The log as files of a few days each, the last days first, and as a stream of so many files a batch."""
    o = observations(spark, sf).withColumns({"live": F.lit(True), "producer": F.lit("p"), "seq": F.col("pos"), "operation": F.lit("record"), "data": F.col("digest")})
    for part in range(3):
        o.where(F.pmod(F.dayofmonth("day"), F.lit(3)) == 2 - part).write.mode("append").parquet(f"{where}/log")
    return T.file_stream(spark, f"{where}/log", o.schema.simpleString()[7:-1].replace(":", " "), files)


@query("t3_stream_heads", with_sql(OBSERVATIONS_SQL) + """ SELECT urn, pos, CASE WHEN p IS NULL THEN 'inserted' WHEN p = digest THEN 'unchanged' ELSE 'updated' END AS outcome FROM (SELECT urn, pos, digest, lag(digest) OVER (PARTITION BY urn ORDER BY pos) AS p FROM ob)""")
def t3(spark, sf):
    for k, v in T.STATE_STORE.items():
        spark.conf.set(k, v)
    where = folder(spark)
    out = T.stream_heads(log(spark, sf, where).select("urn", "digest", F.lit(None).cast("string").alias("previous"), "observed_at", "pos", "live"))
    T.run_available(out, lambda df, i: df.write.mode("overwrite").parquet(f"{where}/out/batch={i}"), f"{where}/checkpoint", "update")
    return spark.read.parquet(f"{where}/out").select("urn", "pos", "outcome")


FEED_SQL = """f AS (SELECT *, pos % 97 = 0 AND row_number() OVER (PARTITION BY urn ORDER BY pos) > 1 AS stray FROM ob)"""


def feed(spark, sf, where):
    """The log as an ordered feed in five files: each event names the digest before it, some name one that never was."""
    o = observations(spark, sf)
    own = Window.partitionBy("urn").orderBy("pos")
    o = o.withColumn("stray", (F.col("pos") % 97 == 0) & (F.row_number().over(own) > 1))
    good = o.where("not stray").withColumn("previous", F.lag("digest").over(own))
    events = good.unionByName(o.where("stray").withColumn("previous", F.lit("none")))
    events = kept(events.select(F.lit("p").alias("producer"), F.col("pos").alias("seq"), F.lit("record").alias("operation"), F.col("urn").cast("string").alias("urn"), "digest", "previous", F.col("pos").alias("observed_at"), F.concat(F.col("digest"), F.lit("@"), F.col("pos").cast("string")).alias("data")))
    step = -(-(events.agg(F.max("seq")).first()[0] + 1) // 5)
    for part in range(5):  # one after the other: a stream takes files in the order of their times
        events.where(F.floor(F.col("seq") / step) == part).coalesce(1).write.mode("append").parquet(f"{where}/feed")
    return T.file_stream(spark, f"{where}/feed", events.schema.simpleString()[7:-1].replace(":", " "), 1)


@query("t4_stream_replay", with_sql(OBSERVATIONS_SQL, FEED_SQL) + """, g AS (SELECT *, lag(digest) OVER (PARTITION BY urn ORDER BY pos) AS was FROM f WHERE NOT stray),
  h AS (SELECT urn, arg_max(digest, pos) AS digest, arg_max(digest || '@' || pos, pos) FILTER (was IS NULL OR was <> digest) AS data FROM g GROUP BY urn),
  c AS (SELECT f.urn, count(*) AS conflicts FROM f ASOF JOIN g ON f.urn = g.urn AND f.pos >= g.pos WHERE f.stray AND f.digest <> g.digest GROUP BY f.urn)
  SELECT CAST(h.urn AS VARCHAR) AS urn, digest, data, coalesce(conflicts, 0) AS conflicts FROM h LEFT JOIN c ON c.urn = h.urn""")
def t4(spark, sf):
    where = folder(spark)
    heads = MergeTable(spark, f"{where}/heads", T.HEADS, ["urn"])
    T.stream_replay(feed(spark, sf, where), VersionedTable(spark, f"{where}/applied"), heads, f"{where}/checkpoint", outcomes=lambda df, i: df.write.parquet(f"{where}/told/batch={i}"))
    told = spark.read.parquet(f"{where}/told").where("outcome = 'conflict'").groupBy("urn").agg(F.count("*").alias("conflicts"))
    return heads.read().join(told, "urn", "left").select("urn", "digest", "data", F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


VERSIONS_SQL = """v AS (SELECT o_orderkey AS k, n AS version, CASE WHEN o_orderkey % 7 < n THEN o_orderstatus || n ELSE o_orderstatus END AS x FROM orders, range(3) r(n) WHERE (o_orderkey + n) % 5 <> 0)"""


@query("t2_stream_changes", f"""WITH {VERSIONS_SQL} SELECT n.k, n.version, CASE WHEN o.k IS NULL THEN 'inserted' ELSE 'updated' END AS change FROM v n LEFT JOIN v o ON o.k = n.k AND o.version = n.version - 1 WHERE o.k IS NULL OR o.x <> n.x
  UNION ALL SELECT o.k, o.version + 1, 'deleted' FROM v o LEFT JOIN v n ON o.k = n.k AND o.version = n.version - 1 WHERE n.k IS NULL AND o.version < 2""")
def t2(spark, sf):
    """Three versions of a table: rows come, change and go."""
    where = folder(spark)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    for n in range(3):
        x = F.when(F.col("o_orderkey") % 7 < n, F.concat("o_orderstatus", F.lit(str(n)))).otherwise(F.col("o_orderstatus"))
        orders.where((F.col("o_orderkey") + n) % 5 != 0).select(F.lit(n).cast("long").alias("version"), F.col("o_orderkey").alias("k"), x.alias("x")).coalesce(1).write.mode("append").parquet(f"{where}/versions")
    state = MergeTable(spark, f"{where}/state", "k long, x string", ["k"])
    T.stream_changes(T.file_stream(spark, f"{where}/versions", "version long, k long, x string", 1), state, lambda df, i: df.write.parquet(f"{where}/out/batch={i}"), "k", ["x"], f"{where}/checkpoint")
    return spark.read.parquet(f"{where}/out").select("k", "version", "change")


@query("u2_u3_merged_table", with_sql(OBSERVATIONS_SQL) + """, b AS (SELECT urn, digest, pos, CASE WHEN pos < m / 2 THEN 0 ELSE 1 END AS part FROM ob, (SELECT max(pos) AS m FROM ob)), l AS (SELECT urn, arg_max(digest, pos) AS digest FROM b GROUP BY urn)
  SELECT urn, CASE WHEN urn % 3 = 0 THEN 'imported' ELSE digest END AS digest, CASE WHEN urn % 3 = 0 THEN 'updated' WHEN urn % 3 = 1 THEN 'conflict' END AS outcome FROM l""")
def u2_merged(spark, sf):
    """Two live batches and one import: heads of a known digest give way, the others are conflicts."""
    o = observations(spark, sf)
    half = o.agg(F.max("pos")).first()[0] / 2
    heads = MergeTable(spark, f"{folder(spark)}/heads", "urn long, digest string, observed_at long", ["urn"])
    for k, part in enumerate((o.where(F.col("pos") < half), o.where(F.col("pos") >= half))):
        store.merge_live(heads, part, "live", k)
    now = heads.read()
    known = now.where("urn % 3 = 0").select("urn", "digest")
    batch = now.where("urn % 3 < 2").select("urn", F.lit("imported").alias("digest"), (F.col("observed_at") + 1).alias("observed_at"))
    told = store.merge_import(heads, batch, known, "import", 0)
    return heads.read().join(told, "urn", "left").select("urn", "digest", "outcome")


@query("t9_stream_counts", with_sql(OBSERVATIONS_SQL) + " SELECT digest AS scope, count(*) AS n FROM ob GROUP BY digest")
def t9(spark, sf):
    where = folder(spark)
    counts = T.stream_counts(log(spark, sf, where).select(F.col("digest").alias("scope")))
    T.run_available(counts, lambda df, i: df.write.mode("overwrite").parquet(f"{where}/out/batch={i}"), f"{where}/checkpoint", "complete")
    return spark.read.parquet(f"{where}/out").groupBy("scope").agg(F.max("n").alias("n"))


MOVES_SQL = """c AS (SELECT urn, CASE WHEN urn % 11 = 0 THEN NULL WHEN urn % 7 = 0 THEN 'moved' WHEN kind = 'P' THEN NULL ELSE kind END AS scope FROM om)"""


@query("t9_signed_counts", with_sql(ORDERS_SQL, MOVES_SQL) + " SELECT scope, count(*) AS n FROM c WHERE scope IS NOT NULL GROUP BY scope")
def t9_signed(spark, sf):
    """Orders come, are edited in place, move to another scope and go again; one scope ends empty."""
    for k, v in T.STATE_STORE.items():
        spark.conf.set(k, v)
    where, none = folder(spark), F.lit(None).cast("string")
    m = order_messages(spark, sf).select("urn", "kind")
    deleted, moved = F.col("urn") % 11 == 0, F.col("urn") % 7 == 0
    now = F.when(moved, "moved").otherwise(F.col("kind"))
    steps = [
        m.select("urn", none.alias("before"), F.col("kind").alias("after")),
        m.where(moved).select("urn", F.col("kind").alias("before"), now.alias("after")).union(m.where(~moved).select("urn", "kind", "kind")),
        m.where(deleted | (~moved & (F.col("kind") == "P"))).select("urn", now.alias("before"), none.alias("after")),
    ]
    for s in steps:  # one after the other: a stream takes files in the order of their times
        s.coalesce(1).write.mode("append").parquet(f"{where}/changes")
    counts = MergeTable(spark, f"{where}/counts", T.COUNTS, ["scope", "share"], 4)
    T.stream_signed_counts(T.file_stream(spark, f"{where}/changes", "urn long, before string, after string", 1), counts, f"{where}/checkpoint")
    return T.live_counts(counts)
