"""Curation over customers and suppliers as identities."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import curation as K
from ..session import table
from .bindings import IDENTITIES_SQL, MESSAGES_SQL, ORDERS_SQL, SCOPE, identities, messages, order_messages, urn_sql, with_sql
from .registry import query

OTHER_SCOPE = "00000000-0000-4000-8000-000000000002"


@query("k1_k2_links", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'rejected' ELSE 'confirmed' END AS state FROM customer WHERE c_nationkey < 20 AND c_custkey % 3 <> 0) GROUP BY state")
def k1(spark, sf):
    pairs = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("person_urn"), F.concat(F.lit("c"), "c_custkey").alias("identity_urn"))
    people = table(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("urn"))
    links = K.link(pairs, people, identities(spark, sf).where("urn not like 's%' and cast(substr(urn, 2) as int) % 3 != 0"))
    return K.unlink(links, pairs.where("identity_urn like '%0'")).groupBy("state").agg(F.count("*").alias("n"))


@query("k3_suggest", with_sql(IDENTITIES_SQL) + " SELECT link AS address, count(*) AS identities, count(DISTINCT source) AS sources FROM ids WHERE link % 6 <> 0 AND link % 5 <> 0 GROUP BY link HAVING count(*) >= 2 AND count(DISTINCT source) >= 2")
def k3(spark, sf):
    i = identities(spark, sf).withColumnRenamed("link", "address")
    links = i.where("address % 6 = 0").select(F.col("urn").alias("identity_urn"), F.lit("confirmed").alias("state")).union(i.where("address % 5 = 0").select("urn", F.lit("rejected")))
    return K.suggest(i, links)


@query("k4_map_scope", with_sql(MESSAGES_SQL) + " SELECT count(*) AS n, count(DISTINCT urn) AS old, count(DISTINCT urn) AS new FROM messages WHERE turn % 4 <> 0")
def k4(spark, sf):
    m = messages(spark, sf)
    o = m.select("urn", S.composite_key(F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("native_key"), (F.col("turn") % 4 == 0).alias("minted"))
    return K.map_scope(o, m, "conversations", OTHER_SCOPE).agg(F.count("*").alias("n"), F.count_distinct("old_urn").alias("old"), F.count_distinct("new_urn").alias("new"))


KEY_SQL = "CAST(to_json([CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)]) AS VARCHAR)"
SAME_SQL = urn_sql("conversations", "event", f"CAST(to_json(['scope_map', urn, '{OTHER_SCOPE}']) AS VARCHAR)")


@query("k4_same_scope", with_sql(MESSAGES_SQL) + f""", t AS (SELECT urn, turn, {urn_sql('conversations', 'message', KEY_SQL).replace(SCOPE, OTHER_SCOPE)} AS new_urn FROM messages WHERE turn % 4 <> 0 AND turn % 3 <> 0 AND turn % 5 <> 0)
  SELECT {SAME_SQL} AS urn, urn AS old_urn, new_urn FROM t UNION ALL SELECT 'skipped', 'runs', CAST((SELECT count(*) FROM messages WHERE turn % 4 <> 0 AND turn % 3 = 0) AS VARCHAR)""")
def k4_same(spark, sf):
    """Turns of one scope as turns of another: minted ones (turn % 4 = 0), ones of a kind without urns (turn % 3 = 0), and aliases
    that are known (turn % 5 = 0) are left out."""
    m = messages(spark, sf)
    key = S.composite_key(F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    o = m.select("urn", "source", F.lit(SCOPE).alias("scope"), key.alias("native_key"), (F.col("turn") % 4 == 0).alias("minted"))
    heads = m.select("urn", F.when(F.col("turn") % 3 == 0, "runs").otherwise("messages").alias("kind"), "source", F.lit(SCOPE).alias("scope"))
    known = m.where("turn % 5 = 0").select(F.col("urn").alias("old_urn"), S.urn("conversations", OTHER_SCOPE, "message", key).alias("new_urn"))
    configured = spark.createDataFrame([("conversations", OTHER_SCOPE)], "source string, scope string")
    aliases, skipped = K.declare_same_scope(o, heads, configured, known, SCOPE, OTHER_SCOPE)
    return aliases.select("urn", "old_urn", "new_urn").unionByName(skipped.select(F.lit("skipped").alias("urn"), F.col("kind").alias("old_urn"), F.col("n").cast("string").alias("new_urn")))


@query("k5_g7_scopes", with_sql(ORDERS_SQL) + """ SELECT coalesce(a.scope, b.scope) AS scope, coalesce(a.source, b.source) AS source, coalesce(records, 0) AS records, CASE WHEN b.scope IS NULL THEN 'imported' ELSE 'configured' END AS origin, CASE WHEN coalesce(a.scope, b.scope) = 'O' THEN 'F' END AS mapped_to
  FROM (SELECT kind AS scope, source, count(*) AS records FROM om GROUP BY ALL) a FULL JOIN (SELECT 'O' AS scope, r_name AS source FROM region) b ON a.scope = b.scope AND a.source = b.source""")
def k5(spark, sf):
    heads = order_messages(spark, sf).select(F.col("kind").alias("scope"), "source")
    configured = table(spark, sf, "region").select(F.lit("O").alias("scope"), F.col("r_name").alias("source"))
    mappings = table(spark, sf, "region").select(F.lit("O").alias("from_scope"), F.lit("F").alias("to_scope")).distinct()
    return K.scopes(heads, configured, mappings)


@query("k7_k8_purge", with_sql(ORDERS_SQL) + " SELECT (SELECT count(*) FROM om WHERE chat % 10 <> 0) AS messages, (SELECT count(*) FROM lineitem JOIN om ON urn = l_orderkey WHERE chat % 10 <> 0) AS attachments")
def k7(spark, sf):
    m = order_messages(spark, sf).select(F.concat(F.lit("m"), "urn").alias("urn"), F.concat(F.lit("c"), "chat").alias("chat_urn"))
    a = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("urn"), F.concat(F.lit("m"), "l_orderkey").alias("message_urn"))
    chosen = m.where("chat_urn like '%0'").select(F.col("chat_urn").alias("urn")).distinct()
    gone = K.children(chosen, m, [a], m.limit(0))
    left = K.purge({"m": m, "a": a}, gone)
    return left["m"].agg(F.count("*").alias("messages")).crossJoin(left["a"].agg(F.count("*").alias("attachments")))  # one row each
