"""Scalar functions over the given tables: times, keys, identifiers, digests, addresses, labels."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import table
from .bindings import ATTACHMENTS_SQL, MESSAGES_SQL, SCOPE, attachments, messages, urn_sql, with_sql
from .registry import query


@query("f1_f2_times", """SELECT event_id, CAST((epoch_us(ts) // 1000) AS VARCHAR) AS raw, (epoch_us(ts) // 1000) AS from_ms, (epoch_us(ts) // 1000) // 1000 * 1000 + 978307200000 AS from_s_2001,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso FROM events""")
def f1_f2(spark, sf):
    t = table(spark, sf, "events").select("event_id", S.ms_of("ts").alias("ms"))
    ts = S.ts_struct("ms", "ms", "1970")
    return t.select("event_id", ts["raw"].alias("raw"), ts["utc_ms"].alias("from_ms"), S.utc_ms(F.floor(F.col("ms") / 1000), "s").alias("from_s_2001"), S.iso_utc("ms").alias("iso"))


@query("f4_composite_key", "SELECT doc_id, sha256(CAST(to_json([source, lang, CAST(doc_id AS VARCHAR)]) AS VARCHAR)) AS key_sha256 FROM documents")
def f4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(S.composite_key("source", "lang", F.col("doc_id").cast("string")), 256).alias("key_sha256"))


@query("f5_urn", f"SELECT user_id, {urn_sql('events', 'identity', 'CAST(user_id AS VARCHAR)')} AS urn FROM (SELECT DISTINCT user_id FROM events)")
def f5(spark, sf):
    return table(spark, sf, "events").select("user_id").distinct().select("user_id", S.urn("events", SCOPE, "identity", F.col("user_id").cast("string")).alias("urn"))


@query("f6_revision_digest", """SELECT o_orderkey, 'sha256:' || sha256('{"key":' || o_orderkey || ',"kind":' || to_json(o_orderstatus) || ',"source":' || to_json(o_orderpriority) || '}') AS digest FROM orders""")
def f6(spark, sf):
    t = table(spark, sf, "orders")
    fields = {"kind": F.col("o_orderstatus"), "key": F.col("o_orderkey"), "source": F.col("o_orderpriority"), "observed_at": F.col("o_orderdate")}
    return t.select("o_orderkey", S.revision_digest(fields).alias("digest"))


@query("f8_normalise_address", """SELECT c_custkey, CASE WHEN length(d) >= 8 THEN 'phone:' || right(d, 10) END AS phone, 'email:' || lower(c_name || '@X.org') AS email
  FROM (SELECT c_custkey, c_name, regexp_replace(c_name, '\\D+', '', 'g') AS d FROM customer)""")
def f8(spark, sf):
    t = table(spark, sf, "customer")
    return t.select("c_custkey", S.normalise_address(F.lit("phone"), "c_name").alias("phone"), S.normalise_address(F.lit("email"), F.concat("c_name", F.lit("@X.org"))).alias("email"))


@query("f9_f10_labels", """SELECT conv_id, turn, CASE WHEN role = 'system' THEN role ELSE 'chat ' || conv_id END AS chat_label, CASE role WHEN 'user' THEN 'me' ELSE role END AS sender_label FROM conversations""")
def f9_f10(spark, sf):
    t = table(spark, sf, "conversations")
    name = F.when(F.col("role") == "system", F.col("role"))
    key = S.composite_key(F.lit("guid"), F.concat(F.lit("SMS;-;chat "), F.col("conv_id").cast("string")))
    names = F.array(F.struct(F.col("role").alias("name"), F.lit("push").alias("origin")))
    return t.select("conv_id", "turn", S.chat_label(name, key).alias("chat_label"), S.identity_label(F.col("role") == "user", names, "role").alias("sender_label"))


@query("f12_native_keys", """SELECT o_orderkey, '["c' || o_custkey || '@g.us","' || CASE WHEN o_orderstatus = 'F' THEN 'me' ELSE 's' || o_orderkey % 7 || '@x' END || '","' || o_orderkey || '"]' AS message_key,
  '["handle","' || o_orderpriority || '","c' || o_custkey || '"]' AS handle_key FROM orders""")
def f12(spark, sf):
    t = table(spark, sf, "orders")
    key = S.message_key(F.concat(F.lit("C"), "o_custkey", F.lit("@g.us")), F.concat(F.lit("S"), F.col("o_orderkey") % 7, F.lit("@X")), F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string"))
    return t.select("o_orderkey", key.alias("message_key"), S.handle_key("o_orderpriority", F.concat(F.lit("c"), "o_custkey")).alias("handle_key"))


@query("f13_f14_members", """SELECT c_custkey, array_to_string(list_filter(list_transform(string_split_regex(lower(c_name || ';' || ' ,' || c_nationkey), '[,;]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS members,
  '["groupchange","' || lower(c_name) || '","1","2","' || array_to_string(list_filter(list_transform(string_split_regex(lower(c_name || ';' || ' ,' || c_nationkey), '[,;]'), lambda x: trim(x)), lambda x: x <> ''), ',') || '"]' AS key FROM customer""")
def f13_f14(spark, sf):
    t = table(spark, sf, "customer")
    members = S.member_list(F.concat("c_name", F.lit("; ,"), "c_nationkey"))
    base = S.group_event_key("c_name", F.lit("1"), F.lit("2"))
    return t.select("c_custkey", F.array_join(members, "|").alias("members"), S.extended_key(base, members).alias("key"))


@query("f15_attachment_kind", """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' WHEN 3 THEN 'contact' WHEN 4 THEN 'document' ELSE 'other' END AS kind FROM part""")
def f15(spark, sf):
    t = table(spark, sf, "part")
    mimes = F.array(*map(F.lit, ("image/png", "video/mp4", "audio/amr", "text/vcard", "application/pdf", "")))
    return t.select("p_partkey", S.attachment_kind(F.element_at(mimes, (F.col("p_size") % 6 + 1).cast("int")), F.lit(None).cast("string")).alias("kind"))


@query("f17_months", with_sql(ATTACHMENTS_SQL) + """ SELECT strftime(make_timestamp(shipped_ms * 1000), '%Y-%m') AS month, min((epoch_us(date_trunc('month', make_timestamp(shipped_ms * 1000))) // 1000)) AS start_ms,
  max(epoch_us(CAST(date_trunc('month', make_timestamp(shipped_ms * 1000)) + INTERVAL 1 MONTH AS TIMESTAMP)) // 1000) AS next_ms, count(*) AS n FROM att GROUP BY 1""")
def f17(spark, sf):
    a = attachments(spark, sf)
    return a.groupBy(S.month_label("shipped_ms").alias("month")).agg(F.min(S.month_start("shipped_ms")).alias("start_ms"), F.max(S.next_month("shipped_ms")).alias("next_ms"), F.count("*").alias("n"))


@query("f21_patterns", with_sql(MESSAGES_SQL) + " SELECT count(*) AS n, count(*) FILTER (turn % 3 = 0) AS urns, count(*) FILTER (turn % 3 = 1) AS digests FROM messages")
def f21(spark, sf):
    m = messages(spark, sf)
    x = F.when(F.col("turn") % 3 == 0, F.col("urn")).when(F.col("turn") % 3 == 1, F.concat(F.lit("sha256:"), F.sha2("urn", 256))).otherwise(F.concat("urn", F.lit("0")))
    return m.agg(F.count("*").alias("n"), F.count_if(S.is_urn(x)).alias("urns"), F.count_if(S.is_digest(x)).alias("digests"))


@query("f24_json_get", """SELECT event_id, json_extract_string(props, '$.k') AS k, md5(coalesce(CAST(json_extract(props, '$') AS VARCHAR), '')) <> '' AS parsed FROM events""")
def f24(spark, sf):
    t = table(spark, sf, "events")
    return t.select("event_id", S.json_get("props", "$.k").alias("k"), S.json_get("props", "$").isNotNull().alias("parsed"))


@query("f26_p7_paths", """SELECT page_id, string_split(url, '/')[-1] AS base, starts_with(url, '/') OR list_contains(string_split(url, '/'), '..') AS unsafe FROM pages""")
def f26(spark, sf):
    t = table(spark, sf, "pages")
    return t.select("page_id", S.basename("url").alias("base"), S.unsafe_path("url").alias("unsafe"))


@query("f3_f23_fold", "SELECT doc_id, md5(strip_accents(lower(text))) AS folded, md5(nfc_normalize(text)) AS composed FROM documents")
def f3_f23(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.fold("text")).alias("folded"), F.md5(S.nfc("text")).alias("composed"))
