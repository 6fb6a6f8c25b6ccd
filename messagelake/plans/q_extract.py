"""Extraction of both source families, on native tables that the given tables stand for."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import extract_a as A
from ..operators import extract_b as B
from ..operators import reads as R
from ..session import table
from .bindings import SCOPE, urn_sql
from .registry import query

# Family A: a conversation is a session; every third message has a second row with a negative sort.
JID_SQL = "CASE conv_id % 3 WHEN 0 THEN 'g' || conv_id || '@g.us' WHEN 1 THEN conv_id || '@s.whatsapp.net' ELSE conv_id || '@lid' END"


def native_a(spark, sf):
    t = table(spark, sf, "conversations")
    c = t.select("conv_id").distinct()
    jid = F.concat(F.when(F.col("conv_id") % 3 == 0, "G").otherwise(""), F.col("conv_id").cast("string"), F.when(F.col("conv_id") % 3 == 0, "@G.us").when(F.col("conv_id") % 3 == 1, "@s.whatsapp.net").otherwise("@lid"))
    sessions = c.where("conv_id % 11 != 10").select(F.col("conv_id").alias("Z_PK"), jid.alias("ZCONTACTJID"), F.lit(0).alias("ZSESSIONTYPE"), F.concat(F.lit("Chat "), "conv_id").alias("ZPARTNERNAME"), (F.col("conv_id") % 5 == 0).cast("int").alias("ZARCHIVED"))
    groups = c.where("conv_id % 3 = 0").select(F.col("conv_id").alias("ZCHATSESSION"), F.col("conv_id").cast("double").alias("ZCREATIONDATE"))
    members = t.where("conv_id % 3 = 0").select("conv_id", "role").distinct().select((F.col("conv_id") * 10 + F.length("role") % 10).alias("Z_PK"), (F.col("role") == "user").cast("int").alias("ZISADMIN"), F.lit(1).alias("ZISACTIVE"), F.col("conv_id").alias("ZCHATSESSION"), F.concat("role", F.lit("@lid")).alias("ZMEMBERJID"), F.col("role").alias("ZCONTACTNAME"))
    push = t.select("role").distinct().select(F.concat("role", F.lit("@lid")).alias("ZJID"), F.upper("role").alias("ZPUSHNAME"))
    n = F.col("conv_id") * 1000000 + F.col("turn")
    null = lambda kind: F.lit(None).cast(kind)
    rows = t.select(
        (n * 2).alias("Z_PK"), F.lit(0).alias("ZGROUPEVENTTYPE"), (F.col("role") == "user").cast("int").alias("ZISFROMME"), F.lit(1).alias("ZMESSAGESTATUS"), F.when(F.col("role") == "system", 6).when(F.col("turn") % 7 == 6, 99).when(F.col("turn") % 7 == 5, 1).otherwise(0).alias("ZMESSAGETYPE"),
        n.alias("ZSORT"), F.col("conv_id").alias("ZCHATSESSION"), null("long").alias("ZMEDIAITEM"), F.when(F.col("turn") > 0, (n - 1) * 2).alias("ZPARENTMESSAGE"), n.cast("double").alias("ZMESSAGEDATE"), null("double").alias("ZSENTDATE"),
        F.when(F.col("turn") != 4, F.concat("role", F.lit("@lid"))).alias("ZFROMJID"), n.cast("string").alias("ZSTANZAID"), F.col("text").alias("ZTEXT"), F.when(F.col("role") != "user", F.lit("owner@lid")).alias("ZTOJID"),
    )
    rows = rows.unionByName(rows.where("ZSORT % 3 = 0").withColumn("Z_PK", F.col("Z_PK") + 1).withColumn("ZSORT", -F.col("ZSORT")))
    media = rows.where("ZMESSAGETYPE = 1").select(F.col("Z_PK"), F.col("Z_PK").alias("ZMESSAGE"), F.lit(5).cast("long").alias("ZFILESIZE"), null("double").alias("ZLATITUDE"), null("double").alias("ZLONGITUDE"), F.when(F.col("Z_PK") % 4 == 0, F.lit("../x")).otherwise(F.concat(F.lit("Media/"), F.col("Z_PK").cast("string"))).alias("ZMEDIALOCALPATH"), null("string").alias("ZTITLE"), null("string").alias("ZVCARDNAME"), F.encode(F.lit("m"), "UTF-8").alias("ZMETADATA"))
    items = rows.where("Z_PK % 10 = 0").select(F.col("Z_PK"), F.lit(0).alias("ZINDEX"), F.col("Z_PK").alias("ZMESSAGE"), F.lit("t").alias("ZTITLE"), null("string").alias("ZSUMMARY"), F.lit("https://x.org").alias("ZMATCHEDTEXT"))
    return {"sessions": sessions, "groups": groups, "members": members, "push_names": push, "messages": rows, "media": media, "items": items}


A_SQL = f"""t AS (SELECT *, conv_id * 1000000 + turn AS n, {JID_SQL} AS jid FROM conversations)"""
GOOD = "conv_id % 11 <> 10 AND (role = 'user' OR turn <> 4)"


@query("x1_collapse_messages", f"WITH {A_SQL} SELECT conv_id AS chat, CAST(n AS VARCHAR) AS stanza, n * 2 AS rep, CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END AS rows FROM t")
def x1(spark, sf):
    out = A.collapse_messages(native_a(spark, sf)["messages"])
    return out.select("chat", "stanza", F.when(F.col("rep.ZSORT") == 0, F.floor(F.col("rep.Z_PK") / 2) * 2).otherwise(F.col("rep.Z_PK")).alias("rep"), "rows")


@query("x2_x5_x10_messages", f"""WITH {A_SQL} SELECT count(*) AS n, CASE WHEN role = 'system' THEN 'system' WHEN turn % 7 = 6 THEN 'unknown:99' ELSE 'message' END AS kind, CASE WHEN role = 'user' THEN 'sent' ELSE 'unknown' END AS state,
  count(*) FILTER (role <> 'system' AND turn % 7 = 5) AS with_media, CAST(sum(CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS rows FROM t WHERE {GOOD} GROUP BY 2, 3""")
def x2(spark, sf):
    m = A.messages(native_a(spark, sf), SCOPE)["messages"]
    return m.groupBy("kind", "state").agg(F.count("*").alias("n"), F.count_if("has_attachments").alias("with_media"), F.sum("duplicate_rows").alias("rows"))


@query("x4_resolve_reply", f"""WITH {A_SQL} SELECT t.conv_id, t.turn, CASE WHEN p.n IS NOT NULL AND (p.role = 'user' OR p.turn <> 4) THEN '["' || t.jid || '","' || CASE WHEN p.role = 'user' THEN 'me' ELSE p.role || '@lid' END || '","' || p.n || '"]' END AS reply_to
  FROM t LEFT JOIN t p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1 WHERE t.conv_id % 11 <> 10 AND (t.role = 'user' OR t.turn <> 4)""")
def x4(spark, sf):
    m = A.messages(native_a(spark, sf), SCOPE)["messages"]
    n = F.floor(F.element_at("row_ids", 1) / 2)
    return m.select(F.floor(n / 1000000).alias("conv_id"), (n % 1000000).alias("turn"), F.col("reply_to_native").alias("reply_to"))


@query("x6_rejects", f"""WITH {A_SQL} SELECT code, count(*) AS count, 'Z_PK=' || min(n * 2) AS sample FROM (SELECT n, CASE WHEN conv_id % 11 = 10 THEN 'message_without_chat_session' WHEN role <> 'user' AND turn = 4 THEN 'incoming_without_sender' END AS code FROM t) WHERE code IS NOT NULL GROUP BY code""")
def x6(spark, sf):
    return R.tally_errors(A.messages(native_a(spark, sf), SCOPE)["rejects"])


@query("x7_parts", f"""WITH {A_SQL}, p AS (SELECT n, unnest(list_filter([CASE WHEN text <> '' THEN 'text' END, CASE WHEN role <> 'system' AND turn % 7 = 5 THEN 'attachment' END, CASE WHEN role <> 'system' AND turn % 7 = 5 THEN 'opaque' END,
  CASE WHEN n > 0 AND n * 2 % 10 = 0 THEN 'link' END], lambda x: x IS NOT NULL)) AS type FROM t WHERE {GOOD}) SELECT type, count(*) AS n FROM p GROUP BY type""")
def x7(spark, sf):
    return A.messages(native_a(spark, sf), SCOPE)["parts"].groupBy("type").agg(F.count("*").alias("n"))


@query("x8_attachments", f"""WITH {A_SQL} SELECT CASE WHEN n * 2 % 4 = 0 THEN 'unknown' ELSE 'missing' END AS availability, 'image' AS kind, count(*) AS n FROM t WHERE {GOOD} AND role <> 'system' AND turn % 7 = 5 GROUP BY 1""")
def x8(spark, sf):
    return A.messages(native_a(spark, sf), SCOPE)["attachments"].groupBy("availability", "kind").agg(F.count("*").alias("n"))


@query("x12_group_change_events", """WITH c AS (SELECT 'g' || l_suppkey % 20 || '@g.us' AS g, l_linenumber AS d, l_orderkey * 10 + l_linenumber AS pk, CASE WHEN l_quantity > 25 THEN 'a@lid,b@lid' ELSE 'c@lid' END AS m FROM lineitem),
  u AS (SELECT g, d, m, min(pk) AS first, count(*) AS n FROM c GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY g, d ORDER BY first, m) AS r FROM u)
  SELECT '["groupchange","' || g || '","' || d || '","2"' || CASE WHEN r = 1 THEN ']' ELSE ',"' || m || '"]' END AS key, n FROM h""")
def x12(spark, sf):
    t = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("Z_PK"), F.lit("2").alias("ZCHANGETYPE"), F.col("l_linenumber").cast("string").alias("ZCHANGEDATE"), F.concat(F.lit("G"), F.col("l_suppkey") % 20, F.lit("@g.us")).alias("ZGROUPJID"), F.when(F.col("l_quantity") > 25, "A@lid; b@lid").otherwise(",C@lid").alias("ZMEMBERJIDS"))
    return A.group_change_events(t).select("key", F.size("row_ids").cast("long").alias("n"))


@query("x13_chats", f"""WITH {A_SQL} SELECT DISTINCT jid, {urn_sql('whatsapp', 'chat', 'jid')} AS urn, CASE conv_id % 3 WHEN 0 THEN 'group' ELSE 'direct' END AS kind, conv_id % 5 = 0 AS is_archived, CASE WHEN conv_id % 3 = 0 THEN conv_id * 1000 + 978307200000 END AS created_ms FROM t WHERE conv_id % 11 <> 10""")
def x13(spark, sf):
    n = native_a(spark, sf)
    return A.chats(n["sessions"], n["groups"], SCOPE).select("jid", "urn", "kind", "is_archived", F.col("created_at.utc_ms").alias("created_ms"))


@query("x14_x15_memberships", f"""WITH {A_SQL} SELECT 'direct' AS part, count(*) * 2 AS n, 0 AS admins, 0 AS rejected FROM (SELECT DISTINCT conv_id FROM t WHERE conv_id % 11 <> 10 AND conv_id % 3 <> 0)
  UNION ALL SELECT 'group', count(*) FILTER (conv_id % 11 <> 10), count(*) FILTER (conv_id % 11 <> 10 AND role = 'user'), count(*) FILTER (conv_id % 11 = 10) FROM (SELECT DISTINCT conv_id, role FROM t WHERE conv_id % 3 = 0)""")
def x14(spark, sf):
    n = native_a(spark, sf)
    c = A.chats(n["sessions"], n["groups"], SCOPE)
    good, bad = A.group_memberships(n["members"], c, SCOPE)
    direct = A.direct_memberships(c, SCOPE).agg(F.lit("direct").alias("part"), F.count("*").alias("n"), F.lit(0).cast("long").alias("admins"), F.lit(0).cast("long").alias("rejected"))
    group = good.agg(F.lit("group").alias("part"), F.count("*").alias("n"), F.count_if(F.col("role") == "admin").alias("admins"))
    return direct.unionByName(group.crossJoin(bad.agg(F.count("*").alias("rejected"))))  # one row each


@query("x16_x17_identities", f"""WITH {A_SQL}, d AS (SELECT DISTINCT conv_id, jid FROM t WHERE conv_id % 11 <> 10) SELECT jid AS address, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'Chat ' || conv_id END AS names, false AS is_me FROM d
  UNION ALL SELECT role || '@lid', upper(role) || CASE WHEN bool_or(conv_id % 3 = 0) THEN '|' || role ELSE '' END, false FROM t GROUP BY role UNION ALL SELECT 'owner@lid', '', true UNION ALL SELECT '777@s.whatsapp.net', '', true UNION ALL SELECT NULL, '', true""")
def x16(spark, sf):
    n = native_a(spark, sf)
    c = A.chats(n["sessions"], n["groups"], SCOPE)
    pairs = A.alias_pairs(table(spark, sf, "region").limit(1).select(F.lit("Owner@lid").alias("lid"), F.lit("+7 77").alias("phone"), F.lit("one").alias("source")))
    out = A.identities(n, c, pairs, SCOPE)
    return out.select("address", F.array_join(F.transform("observed_names", lambda x: x["name"]), "|").alias("names"), "is_me")


@query("x19_x20_aliases", """WITH p AS (SELECT DISTINCT 'l' || o_custkey % 5000 || '@lid' AS lid, o_custkey // 7 * 10 || '@s.whatsapp.net' AS phone FROM orders), c AS (SELECT lid, count(*) AS n FROM p GROUP BY lid)
  SELECT lid, phone, 2 AS evidence FROM p JOIN c USING (lid) WHERE n = 1""")
def x19(spark, sf):
    t = table(spark, sf, "orders").select(F.concat(F.lit("L"), F.col("o_custkey") % 5000, F.lit("@lid")).alias("lid"), F.concat(F.lit("+"), F.floor(F.col("o_custkey") / 7) * 10).alias("phone"))
    pairs = A.alias_pairs(t.withColumn("source", F.lit("one")).union(t.withColumn("source", F.lit("two"))))
    return A.unambiguous_aliases(pairs)[0].select("lid", "phone", F.size("evidence").alias("evidence"))


# Family B: a conversation is a chat, roles are handles, turns are decoded messages.


def handles(spark, sf):
    t = table(spark, sf, "customer")
    return t.select(F.col("c_custkey").alias("ROWID"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("A"), F.col("c_custkey") % 100, F.lit("@X.org"))).otherwise(F.concat(F.lit("+1555000"), F.col("c_custkey") % 100 + 1000)).alias("id"), F.when(F.col("c_nationkey") % 2 == 0, "SMS").otherwise("iMessage").alias("service"), F.col("c_mktsegment").alias("uncanonicalized_id"), F.col("c_nationkey").cast("string").alias("person_centric_id"))


@query("m1_identities", """SELECT address, service, count(*) AS rows, count(DISTINCT c_mktsegment) AS names FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey % 100 || '@x.org' ELSE '+1555000' || (c_custkey % 100 + 1000) END AS address,
  CASE WHEN c_nationkey % 2 = 0 THEN 'SMS' ELSE 'iMessage' END AS service, c_mktsegment FROM customer) GROUP BY ALL""")
def m1(spark, sf):
    out = B.identities(handles(spark, sf), SCOPE)
    return out.select("address", "service", F.size("row_ids").cast("long").alias("rows"), F.size("observed_names").cast("long").alias("names"))


@query("m2_person_groups", "SELECT count(*) AS groups FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)")
def m2(spark, sf):
    return B.person_groups(handles(spark, sf))


@query("m5_m6_chat_inference", """WITH c AS (SELECT s_suppkey AS chat_id, 'id' || s_suppkey % 40 AS ident, CASE WHEN s_nationkey % 2 = 0 THEN 'SMS' ELSE 'RCS' END AS service FROM supplier), m AS (SELECT o_orderkey AS message_id, 'id' || o_custkey % 50 AS tail, CASE WHEN o_custkey % 2 = 0 THEN 'SMS' ELSE 'RCS' END AS service
  FROM orders WHERE o_orderkey % 3 <> 0), j AS (SELECT message_id, arg_min(chat_id, (m.service <> c.service, chat_id)) AS chat_id FROM m JOIN c ON c.ident = m.tail GROUP BY message_id)
  SELECT 'inferred' AS part, count(*) AS n, CAST(sum(chat_id) AS BIGINT) AS chats FROM j UNION ALL SELECT 'stub', count(DISTINCT tail), 0 FROM m WHERE message_id NOT IN (SELECT message_id FROM j)""")
def m5(spark, sf):
    chat = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ROWID"), F.concat(F.lit("id"), F.col("s_suppkey") % 40).alias("chat_identifier"), F.when(F.col("s_nationkey") % 2 == 0, "SMS").otherwise("RCS").alias("service_name"))
    o = table(spark, sf, "orders")
    message = o.select(F.col("o_orderkey").alias("ROWID"), F.when(F.col("o_custkey") % 2 == 0, "SMS").otherwise("RCS").alias("service"), F.concat(F.lit("SMS;-;id"), F.col("o_custkey") % 50).alias("ck_chat_id"))
    joins = o.where("o_orderkey % 3 = 0").select(F.lit(1).alias("chat_id"), F.col("o_orderkey").alias("message_id"))
    found = B.infer_chat(message, joins, chat)
    stubs = B.stub_chats(message, joins, found, SCOPE)
    return found.agg(F.lit("inferred").alias("part"), F.count("*").alias("n"), F.sum("chat_id").alias("chats")).unionByName(stubs.agg(F.lit("stub").alias("part"), F.count("*").alias("n"), F.lit(0).cast("long").alias("chats")))


@query("m7_g12_attachment_owner", "SELECT l_partkey AS attachment_id, min(l_orderkey) AS owner FROM lineitem GROUP BY 1")
def m7(spark, sf):
    return B.attachment_owner(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("attachment_id"), F.col("l_orderkey").alias("message_id")))


def feed(spark, sf):
    t = table(spark, sf, "conversations")
    turn = F.col("turn") % 8
    doc = F.struct(
        F.lit("message").alias("type"), (F.col("conv_id") * 100 + F.col("turn")).alias("rowid"), F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("guid"), F.when(F.col("conv_id") % 7 != 6, F.col("conv_id")).alias("chat_id"), F.length("role").cast("long").alias("handle_id"), F.lit("SMS").alias("service"),
        ((F.col("conv_id") * 100 + F.col("turn")) * 1_000_000_000).alias("date"), (F.col("role") == "user").alias("is_from_me"), F.lit(0).alias("item_type"), F.when(turn == 3, "fully_unsent").when(turn == 4, "group_action").alias("announcement"), F.when(turn == 4, F.struct(F.lit("name_change").alias("kind"), F.lit("n").alias("name"))).alias("group_action"),
        F.when(turn == 2, "tapback").otherwise("normal").alias("variant"), F.when(turn == 2, F.struct(F.lit(0).alias("part_index"), F.lit("added").alias("action"), F.lit("loved").alias("kind"), F.concat_ws("-", F.lit("m"), "conv_id", F.col("turn") - 1).alias("target_guid"))).alias("tapback"), F.when(turn == 1, "Subject").alias("subject"), F.lit("decoded").alias("parser_status"),
        F.array(F.struct(F.lit(0).alias("index"), F.lit("text").alias("kind"), F.col("text"), F.lit(None).cast("string").alias("attachment_guid"), F.when(turn == 0, F.array(F.struct(F.lit(1).alias("date"), F.lit("a").alias("text")), F.struct(F.lit(2).alias("date"), F.lit("b").alias("text")), F.struct(F.lit(3).alias("date"), F.lit("c").alias("text")))).alias("edit_history")),
                F.struct(F.lit(1).alias("index"), F.when(turn == 5, "attachment").otherwise("none").alias("kind"), F.lit(None).cast("string").alias("text"), F.when(turn == 5, F.concat_ws("-", F.lit("at"), "conv_id", "turn")).alias("attachment_guid"), F.lit(None).cast("array<struct<date:int,text:string>>").alias("edit_history"))).alias("parts"),
        F.when(turn == 6, F.array(F.struct(F.col("turn").cast("long").alias("rowid"), F.concat_ws("-", F.lit("a"), "conv_id", "turn").alias("guid"), F.when(F.col("conv_id") % 4 == 1, "f.png").when(F.col("conv_id") % 4 == 2, "/x/f.png").when(F.col("conv_id") % 4 == 3, F.concat(F.lit("~/in/"), "conv_id", F.lit(".png"))).alias("filename"), F.lit("image/png").alias("mime_type")))).otherwise(F.expr("cast(array() as array<struct<rowid:bigint,guid:string,filename:string,mime_type:string>>)")).alias("attachments"),
    )
    return t.select(F.from_json(F.to_json(doc), B.FEED).alias("m")).select("m.*")


def messages_b(spark, sf):
    chat = table(spark, sf, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("ROWID"), F.concat(F.lit("SMS;-;"), "conv_id").alias("guid"), F.lit(45).alias("style"), F.col("conv_id").cast("string").alias("chat_identifier"), F.lit("SMS").alias("service_name"), F.lit("").alias("display_name"), F.lit(0).alias("is_archived"))
    who = table(spark, sf, "conversations").select("role").distinct().where("role = 'assistant'").select(F.length("role").cast("long").alias("handle_id"), S.urn("messages", SCOPE, "identity", S.handle_key(F.lit("SMS"), F.col("role"))).alias("identity_urn"))
    files = chat.select(F.concat(F.lit("~/in/"), "ROWID", F.lit(".png")).alias("path"), F.sha2(F.concat(F.lit("file "), "ROWID"), 256).alias("sha256"), (F.col("ROWID") + 1).alias("size"))
    return B.messages(feed(spark, sf), B.chats(chat, SCOPE), who, SCOPE, files=files)


@query("m8_m13_m15_messages", """SELECT CASE turn % 8 WHEN 2 THEN 'reaction' WHEN 3 THEN 'retraction' WHEN 4 THEN 'system' ELSE 'message' END AS kind, CASE WHEN conv_id % 7 <> 6 THEN 'join_table' ELSE 'none' END AS chat_assignment, CASE WHEN role = 'user' THEN 'sent' ELSE 'unknown' END AS state,
  count(*) AS n, count(*) FILTER (role <> 'system') AS with_sender, CAST(coalesce(sum(CASE WHEN turn % 8 = 2 THEN 0 ELSE length(text) + CASE WHEN turn % 8 = 1 THEN 8 ELSE 0 END END), 0) AS BIGINT) AS chars FROM conversations GROUP BY 1, 2, 3""")
def m8(spark, sf):
    m = messages_b(spark, sf)["messages"]
    return m.groupBy("kind", "chat_assignment", "state").agg(F.count("*").alias("n"), F.count("sender_urn").alias("with_sender"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


GONE_KEY = """CAST(to_json(['purged', 'at-' || conv_id || '-' || turn]) AS VARCHAR)"""
PART_KEY = """CAST(to_json(['part', 'm-' || conv_id || '-' || turn, CAST(k - 1 AS VARCHAR)]) AS VARCHAR)"""


@query("m9_m11_parts", f"""WITH p AS (SELECT conv_id, turn, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT *, list_filter([CASE WHEN turn % 8 = 1 THEN {{'type': 'text', 'text': 'Subject'}} END, {{'type': 'text', 'text': text}}, CASE WHEN turn % 8 IN (5, 6) THEN {{'type': 'attachment', 'text': NULL}} END], lambda x: x IS NOT NULL) AS ps FROM conversations))
  SELECT {urn_sql("messages", "event", PART_KEY)} AS urn, {urn_sql("messages", "message", "'m-' || conv_id || '-' || turn")} AS message_urn, CAST(k - 1 AS INTEGER) AS index, p.type AS type, p.text AS text,
  CASE WHEN p.type = 'attachment' THEN CASE turn % 8 WHEN 5 THEN {urn_sql("messages", "attachment", GONE_KEY)} ELSE {urn_sql("messages", "attachment", "'a-' || conv_id || '-' || turn")} END END AS attachment_urn FROM p""")
def m9(spark, sf):
    return messages_b(spark, sf)["parts"].select("urn", "message_urn", F.col("index").cast("int").alias("index"), "type", "text", "attachment_urn")


@query("m10_m18_attachments", f"""SELECT CASE turn % 8 WHEN 5 THEN {urn_sql("messages", "attachment", GONE_KEY)} ELSE {urn_sql("messages", "attachment", "'a-' || conv_id || '-' || turn")} END AS urn, {urn_sql("messages", "message", "'m-' || conv_id || '-' || turn")} AS message_urn,
  CASE WHEN turn % 8 = 5 THEN 'other' ELSE 'image' END AS kind, CASE WHEN turn % 8 = 5 OR conv_id % 4 = 2 THEN 'missing' WHEN conv_id % 4 = 0 THEN 'not_downloaded' WHEN conv_id % 4 = 1 THEN 'unknown' ELSE 'available' END AS availability,
  CASE WHEN turn % 8 = 6 AND conv_id % 4 = 3 THEN sha256('file ' || conv_id) END AS blob_sha256, CASE WHEN turn % 8 = 6 AND conv_id % 4 = 3 THEN conv_id + 1 END AS declared_size,
  CASE WHEN turn % 8 = 5 OR conv_id % 4 = 0 THEN NULL WHEN conv_id % 4 = 3 THEN 'in/' || conv_id || '.png' ELSE 'f.png' END AS source_path_hint, CASE turn % 8 WHEN 5 THEN 1 END AS part_index FROM conversations WHERE turn % 8 IN (5, 6)""")
def m10(spark, sf):
    return messages_b(spark, sf)["attachments"].select("urn", "message_urn", "kind", "availability", "blob_sha256", "declared_size", "source_path_hint", F.col("part_index").cast("int").alias("part_index"))


EVENT_KEY = """CASE WHEN k = 1 THEN 'm-' || conv_id || '-' || turn ELSE CAST(to_json(['m-' || conv_id || '-' || turn, 'event', CAST(k - 1 AS VARCHAR)]) AS VARCHAR) END"""


@query("m12_m16_events", f"""WITH e AS (SELECT conv_id, turn, unnest(ks) AS kind, generate_subscripts(ks, 1) AS k FROM (SELECT *, CASE turn % 8 WHEN 0 THEN ['edit', 'edit'] WHEN 2 THEN ['reaction'] WHEN 3 THEN ['retraction'] WHEN 4 THEN ['subject_change'] ELSE [] END AS ks FROM conversations))
  SELECT {urn_sql("messages", "event", EVENT_KEY)} AS urn, kind, CASE kind WHEN 'reaction' THEN 'm-' || conv_id || '-' || (turn - 1) END AS target_native, {urn_sql("messages", "message", "'m-' || conv_id || '-' || turn")} AS carrier_message_urn FROM e""")
def m12(spark, sf):
    return messages_b(spark, sf)["events"].select("urn", "kind", "target_native", "carrier_message_urn")


@query("m13_rejects", "SELECT 'unknown_handle_id' AS code, count(*) AS count FROM conversations WHERE role = 'system'")
def m13(spark, sf):
    return R.tally_errors(messages_b(spark, sf)["rejects"]).select("code", "count")
