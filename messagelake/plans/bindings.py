"""How the given tables stand for canonical roles, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import table

SCOPE = "00000000-0000-4000-8000-000000000001"


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as messages: urn, chat, sender, kind, source, utc_ms, text."""
    t = table(spark, sf, "conversations")
    key = S.composite_key(F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return t.select(
        S.urn("conversations", SCOPE, "message", key).alias("urn"), "conv_id", "turn",
        S.urn("conversations", SCOPE, "chat", F.col("conv_id").cast("string")).alias("chat_urn"), F.col("role").alias("sender"),
        F.when(F.col("role") == "system", "system").otherwise("message").alias("kind"), F.lit("conversations").alias("source"),
        (F.lit(1704067200000) + F.col("conv_id") * 3600000 + F.col("turn") * 60000).alias("utc_ms"), "text",
    )


def urn_sql(source: str, entity: str, key: str) -> str:
    name = f"""to_json(['{S.ID_VERSION}', '{source}', '{SCOPE}', '{entity}', {key}])"""
    d = f"sha1(unhex('{S.NAMESPACE.replace('-', '')}') || encode(CAST({name} AS VARCHAR)))"
    return (
        f"(SELECT 'urn:uuid:' || d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || "
        f"substr('89ab', (instr('0123456789abcdef', d[17:17]) - 1) % 4 + 1, 1) || d[18:20] || '-' || d[21:32] FROM (SELECT {d} AS d))"
    )


MESSAGES_SQL = f"""
messages AS (SELECT {urn_sql('conversations', 'message', "CAST(to_json([CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)]) AS VARCHAR)")} AS urn,
  conv_id, turn, {urn_sql('conversations', 'chat', 'CAST(conv_id AS VARCHAR)')} AS chat_urn, role AS sender,
  CASE WHEN role = 'system' THEN 'system' ELSE 'message' END AS kind, 'conversations' AS source,
  1704067200000 + conv_id * 3600000 + turn * 60000 AS utc_ms, text FROM conversations)
"""


def order_messages(spark: SparkSession, sf: str) -> DataFrame:
    """orders as messages: urn, chat, kind, utc_ms."""
    t = table(spark, sf, "orders")
    return t.select(F.col("o_orderkey").alias("urn"), F.col("o_custkey").alias("chat"), F.col("o_orderstatus").alias("kind"), S.ms_of("o_orderdate").alias("utc_ms"), F.col("o_totalprice"), F.col("o_orderpriority").alias("source"))


ORDERS_SQL = "om AS (SELECT o_orderkey AS urn, o_custkey AS chat, o_orderstatus AS kind, (epoch_us(o_orderdate) // 1000) AS utc_ms, o_totalprice, o_orderpriority AS source FROM orders)"


def attachments(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as attachments: urn, message, availability, bytes, source."""
    t = table(spark, sf, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    availability = F.when(F.col("l_returnflag") == "A", "available").when(F.col("l_returnflag") == "N", "missing").otherwise("not_downloaded")
    return t.select(key.alias("urn"), F.col("l_orderkey").alias("message"), availability.alias("availability"), F.col("l_quantity").cast("long").alias("bytes"), F.col("l_linestatus").alias("source"), S.ms_of("l_shipdate").alias("shipped_ms"))


ATTACHMENTS_SQL = """att AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS urn, l_orderkey AS message,
  CASE l_returnflag WHEN 'A' THEN 'available' WHEN 'N' THEN 'missing' ELSE 'not_downloaded' END AS availability,
  CAST(l_quantity AS BIGINT) AS bytes, l_linestatus AS source, (epoch_us(l_shipdate) // 1000) AS shipped_ms FROM lineitem)"""


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """events as a log of observations: urn, digest, observed_at, pos."""
    t = table(spark, sf, "events")
    return t.select(F.col("user_id").alias("urn"), F.col("event_type").alias("digest"), S.ms_of("ts").alias("observed_at"), F.col("event_id").alias("pos"), F.to_date("ts").cast("string").alias("day"))


OBSERVATIONS_SQL = "ob AS (SELECT user_id AS urn, event_type AS digest, (epoch_us(ts) // 1000) AS observed_at, event_id AS pos, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events)"


def identities(spark: SparkSession, sf: str) -> DataFrame:
    """customer and supplier as identities of two sources: urn, source, name, link (what may join them)."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("urn"), F.lit("customer").alias("source"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("link"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("urn"), F.lit("supplier").alias("source"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("link"))
    return c.unionByName(s)


IDENTITIES_SQL = """ids AS (SELECT 'c' || c_custkey AS urn, 'customer' AS source, c_name AS name, c_nationkey AS link FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name, s_nationkey FROM supplier)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)
