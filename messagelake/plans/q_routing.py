"""Routing of changed rows: orders against a changed version of themselves."""

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import routing as R
from ..session import table
from .bindings import ORDERS_SQL, order_messages, with_sql
from .registry import query


def versions(spark, sf):
    m = order_messages(spark, sf).select("urn", "chat", "kind")
    new = m.where("urn % 97 != 0").withColumn("kind", F.when(F.col("urn") % 101 == 0, "X").otherwise(F.col("kind")))
    return m, new


@query("r1_diff", with_sql(ORDERS_SQL) + " SELECT urn, kind AS before, CASE WHEN urn % 97 <> 0 THEN 'X' END AS after FROM om WHERE urn % 97 = 0 OR urn % 101 = 0")
def r1(spark, sf):
    old, new = versions(spark, sf)
    return R.diff(old, new, "urn", ["kind", "chat"]).select("urn", F.col("before.kind").alias("before"), F.col("after.kind").alias("after"))


@query("r2_route_b", with_sql(ORDERS_SQL) + """ SELECT urn AS message_id FROM om WHERE urn % 101 = 0 OR (urn > 1 AND (urn - 1) % 101 = 0) OR chat % 50 = 7 OR chat % 60 = 11 OR urn IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 40 = 0)""")
def r2(spark, sf):
    m = order_messages(spark, sf)
    null = F.lit(None).cast("string")
    message = m.select(F.col("urn").alias("ROWID"), F.col("urn").cast("string").alias("guid"), (F.col("chat") % 50).alias("handle_id"), F.lit(-1).alias("other_handle"), F.when(F.col("urn") > 1, (F.col("urn") - 1).cast("string")).alias("thread_originator_guid"), null.alias("associated_message_guid"), null.alias("ck_chat_id"))
    joins = m.select((F.col("chat") % 60).alias("chat_id"), F.col("urn").alias("message_id"))
    attached = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_partkey").alias("attachment_id"))
    image = lambda df, key, *f: df.select(F.col(key).alias("ROWID"), F.struct(*f).alias("before"), F.struct(*f).alias("after")).distinct()
    changes = {
        "message": image(message.where("ROWID % 101 = 0"), "ROWID", "guid"), "handle": image(message.where("handle_id = 7"), "handle_id", "handle_id"),
        "chat": image(joins.where("chat_id = 11"), "chat_id", F.lit("none").alias("chat_identifier")), "attachment": image(attached.where("attachment_id % 40 = 0"), "attachment_id", "attachment_id"),
    }
    return R.route_b(changes, message, joins, attached)


@query("r3_route_a", with_sql(ORDERS_SQL) + """, u AS (SELECT urn, chat, urn // 2 AS stanza FROM om) SELECT DISTINCT chat, CAST(stanza AS VARCHAR) AS stanza FROM u WHERE urn % 101 = 0 OR (urn - 3) % 101 = 0 OR urn % 77 = 5""")
def r3(spark, sf):
    m = order_messages(spark, sf)
    rows = m.select(F.col("urn").alias("Z_PK"), F.col("chat").alias("ZCHATSESSION"), F.floor(F.col("urn") / 2).cast("string").alias("ZSTANZAID"), (F.col("urn") - 3).alias("ZPARENTMESSAGE"), F.lit(None).cast("long").alias("ZMEDIAITEM"))
    image = F.struct("ZCHATSESSION", "ZSTANZAID")
    changed = rows.where("Z_PK % 101 = 0").select("Z_PK", image.alias("before"), image.alias("after"))
    media = rows.where("Z_PK % 77 = 5").select((-F.col("Z_PK")).alias("Z_PK"), F.struct(F.col("Z_PK").alias("ZMESSAGE")).alias("before"), F.struct(F.col("Z_PK").alias("ZMESSAGE")).alias("after"))
    return R.route_a({"messages": changed, "media": media}, rows, media)


@query("r5_changed_header_keys", """WITH a AS (SELECT c_nationkey AS key, md5(string_agg(c_name, '|' ORDER BY c_name)) AS h FROM customer WHERE c_nationkey <> 3 GROUP BY 1), b AS (SELECT c_nationkey AS key, md5(string_agg(c_name, '|' ORDER BY c_name)) AS h FROM customer WHERE c_nationkey <> 4 AND NOT (c_nationkey = 5 AND c_custkey < 100) GROUP BY 1)
  SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'appeared' WHEN b.key IS NULL THEN 'vanished' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.key = b.key WHERE a.h IS DISTINCT FROM b.h""")
def r5(spark, sf):
    t = table(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("fingerprint"), "c_custkey")
    return R.changed_header_keys(t.where("key != 3"), t.where("key != 4 and not (key = 5 and c_custkey < 100)"))


@query("r8_reuse_units", with_sql(ORDERS_SQL) + " SELECT urn % 5 <> 0 AND urn % 7 <> 0 AND urn % 11 <> 0 AS reused, count(*) AS n FROM om GROUP BY 1")
def r8(spark, sf):
    u = order_messages(spark, sf).select(F.col("urn").alias("unit"), F.lit("v2").alias("signature"), F.col("kind").alias("fingerprint"))
    memo = u.where("unit % 5 != 0").withColumn("fingerprint", F.when(F.col("unit") % 7 == 0, "?").otherwise(F.col("fingerprint"))).withColumn("valid", F.col("unit") % 11 != 0)
    return R.reuse_units(u, memo).groupBy("reused").agg(F.count("*").alias("n"))


@query("r9_r10_memos", "SELECT count(*) AS saved FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_partkey % 13 <> 0 AND l_suppkey % 17 <> 0))")
def r9(spark, sf):
    t = table(spark, sf, "lineitem")
    members = t.select(F.col("l_orderkey").alias("unit"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("urn"), F.col("l_returnflag").alias("digest"), "l_partkey", "l_suppkey")
    heads = members.select("urn", F.when(F.col("l_partkey") % 13 == 0, "?").otherwise(F.col("digest")).alias("digest"))
    saved = R.save_units(members, heads).withColumn("valid", F.lit(True))
    return R.invalidate_units(saved, members, members.where("l_suppkey % 17 = 0")).agg(F.count_if("valid").alias("saved"))


@query("j12_sharing_units", "SELECT DISTINCT a.l_suppkey AS unit, b.l_suppkey AS other FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey WHERE a.l_suppkey < 4 AND b.l_suppkey >= 4")
def j12(spark, sf):
    members = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_partkey").alias("urn"))
    return R.sharing_units(members, members.where("unit < 4").select("unit").distinct())


@query("r11_withdraw", "WITH s AS (SELECT DISTINCT l_suppkey % 2 AS kind, l_orderkey AS x FROM lineitem WHERE l_suppkey BETWEEN 10 AND 15 AND l_suppkey <> 12) SELECT kind, min(x) AS lo, max(x) AS hi FROM (SELECT kind, x, x - row_number() OVER (PARTITION BY kind ORDER BY x) AS g FROM s) GROUP BY kind, g")
def r11(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit"), (F.col("l_suppkey") % 2).alias("kind"), F.col("l_orderkey").alias("id"))
    units = t.where("unit between 10 and 15").select("unit").distinct()
    memo = units.withColumn("valid", F.col("unit") != 12)
    members = t.select("unit", F.col("unit").alias("urn")).distinct()
    return R.withdraw(units, memo, members, I.islands(t, ["unit", "kind"]))[0]


@query("r14_finish_coverage", """WITH p AS (SELECT DISTINCT l_linenumber AS kind, l_orderkey AS x FROM lineitem WHERE l_orderkey % 2 = 0 OR l_orderkey % 3 = 0), s AS (SELECT kind, x FROM p WHERE x % 3 <> 0 UNION SELECT DISTINCT l_linenumber, l_orderkey FROM lineitem WHERE l_orderkey % 5 = 0)
  SELECT kind, min(x) AS lo, max(x) AS hi FROM (SELECT kind, x, x - row_number() OVER (PARTITION BY kind ORDER BY x) AS g FROM s) GROUP BY kind, g""")
def r14(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("kind"), F.col("l_orderkey").alias("id"))
    of = lambda c: I.islands(t.where(c), ["kind"])
    return R.finish_coverage(of("id % 2 = 0 or id % 3 = 0"), of("id % 3 = 0"), of("id % 5 = 0"), absent=False)["coverage"]


@query("r16_dirty_media", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN page_id % 5 = 0 THEN 'new' WHEN page_id % 5 = 1 THEN 'moved' WHEN page_id % 5 = 2 THEN 'changed' WHEN page_id > 200 THEN 'racy' END AS reason FROM pages) WHERE reason IS NOT NULL GROUP BY reason")
def r16(spark, sf):
    now = table(spark, sf, "pages").select(F.col("page_id").alias("row"), F.col("url").alias("path"), F.octet_length("html").alias("size"), F.col("page_id").alias("modified_ms"))
    k = F.col("row") % 5
    before = now.where(k != 0).withColumn("path", F.when(k == 1, "?").otherwise(F.col("path"))).withColumn("size", F.when(k == 2, -1).otherwise(F.col("size")))
    return R.dirty_media(before, now, 100, 300).groupBy("reason").agg(F.count("*").alias("n"))


@query("r17_reset_detected", with_sql(ORDERS_SQL) + " SELECT kind AS \"table\", kind = 'P' AS reset FROM om GROUP BY kind")
def r17(spark, sf):
    m = order_messages(spark, sf).select(F.col("kind").alias("table"), F.col("urn").alias("Z_PK"))
    mark = m.groupBy("table").agg((F.max("Z_PK") + F.when(F.first("table") == "P", 1).otherwise(0)).alias("max_id"))
    return R.reset_detected(m, mark)


@query("r18_run_ranges", "WITH s AS (SELECT DISTINCT event_type AS kind, event_id AS x FROM events WHERE event_id % 4 <> 0) SELECT kind, min(x) AS lo, max(x) AS hi FROM (SELECT kind, x, x - row_number() OVER (PARTITION BY kind ORDER BY x) AS g FROM s) GROUP BY kind, g")
def r18(spark, sf):
    t = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 == 0, "other").otherwise("run").alias("run"))
    written, sighted = t.where("id % 4 = 1"), t.where("id % 4 > 1")
    return R.run_ranges(written, I.islands(sighted, ["kind", "run"]), "run")
