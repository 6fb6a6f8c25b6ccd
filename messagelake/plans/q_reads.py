"""Reading queries: search, pages, context, listings, resolution, media, summaries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import reads as R
from ..session import table
from .bindings import ATTACHMENTS_SQL, IDENTITIES_SQL, MESSAGES_SQL, OBSERVATIONS_SQL, ORDERS_SQL, attachments, identities, messages, observations, order_messages, with_sql
from .registry import query

TOKENS_SQL = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}\p{Co}\p{So}\p{Sk}\p{Mn}]+')"
LINE_SQL = f"(' ' || array_to_string({TOKENS_SQL}, ' ') || ' ')"
START = 1704067200000


@query("q1_search_literal", with_sql(MESSAGES_SQL) + f""" SELECT urn, conv_id, turn, sender, utc_ms, 'Chat ' || conv_id AS chat_label,
  array_to_string(list_transform(list_slice(tk, greatest(p - 4, 1), greatest(p - 4, 1) + 11), lambda x: CASE WHEN x IN ('of', 'the') THEN '[' || x || ']' ELSE x END), ' ') AS snippet
  FROM (SELECT *, least(list_position(tk, 'of'), list_position(tk, 'the')) AS p FROM (SELECT *, {TOKENS_SQL} AS tk FROM messages
  WHERE kind = 'message' AND utc_ms >= {START} AND {LINE_SQL} LIKE '% of %' AND {LINE_SQL} LIKE '% the %')) ORDER BY utc_ms, urn LIMIT 51""")
def q1(spark, sf):
    m = R.message_filters(messages(spark, sf), since=START)
    hits = m.where(R.literal("text", "of the"))
    out = R.page(hits, [("utc_ms", False), ("urn", False)], 50)
    return out.select("urn", "conv_id", "turn", "sender", "utc_ms", F.concat(F.lit("Chat "), "conv_id").alias("chat_label"), R.snippet("text", ["of", "the"], 12).alias("snippet"))


@query("q1_search_documents", f"SELECT doc_id, lang FROM documents WHERE {LINE_SQL} LIKE '% of the %'")
def q1_documents(spark, sf):
    t = table(spark, sf, "documents")
    return t.where(S.token_line("text").contains(" of the ")).select("doc_id", "lang")


@query("q3_search_terms", f"""SELECT doc_id FROM documents WHERE list_contains({TOKENS_SQL}, 'the') AND list_has_any({TOKENS_SQL}, ['and', 'with']) AND NOT list_contains({TOKENS_SQL}, 'password')
  AND {LINE_SQL} LIKE '% in the %' AND len(list_filter({TOKENS_SQL}, lambda x: starts_with(x, 'th'))) > 0""")
def q3(spark, sf):
    t = table(spark, sf, "documents")
    return t.where(R.search_terms("text", all_of=["the"], any_of=["and", "with"], none_of=["password"], phrase="in the", prefix="th")).select("doc_id")


@query("q5_token_index", f"""SELECT token, count(DISTINCT k) AS messages, count(*) AS uses FROM (SELECT conv_id * 1000 + turn AS k, unnest({TOKENS_SQL}) AS token FROM conversations) GROUP BY token HAVING count(DISTINCT k) >= 3""")
def q5(spark, sf):
    t = table(spark, sf, "conversations").withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    return R.token_index(t, "k").groupBy("token").agg(F.count("*").alias("messages"), F.sum(F.size("positions")).alias("uses")).where("messages >= 3")


@query("q5_indexed_phrase", f"SELECT doc_id FROM documents WHERE {LINE_SQL} LIKE '% of the %'")
def q5_phrase(spark, sf):
    return R.indexed_phrase(R.token_index(table(spark, sf, "documents"), "doc_id"), ["of", "the"], "doc_id")


@query("p1_message_filters", with_sql(MESSAGES_SQL) + f" SELECT urn, sender, utc_ms FROM messages WHERE kind = 'message' AND utc_ms >= {START + 7200000} AND utc_ms < {START + 360000000} AND sender IN ('user')")
def p1(spark, sf):
    return R.message_filters(messages(spark, sf), since=START + 7200000, until=START + 360000000, senders=["user"], source="conversations").select("urn", "sender", "utc_ms")


@query("p2_sender_set", """SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 3) GROUP BY user_id""")
def p2(spark, sf):
    t = table(spark, sf, "events").withColumnRenamed("user_id", "sender")
    links = t.select("sender").distinct().select((F.col("sender") % 10).cast("string").alias("person_urn"), F.col("sender").alias("identity_urn"), F.lit("confirmed").alias("state"))
    return R.sender_set(t, links, "3").groupBy(F.col("sender").alias("user_id")).agg(F.count("*").alias("n"))


@query("p3_attachment_filters", with_sql(ATTACHMENTS_SQL, ORDERS_SQL) + " SELECT att.urn, availability, bytes FROM att LEFT JOIN om ON att.message = om.urn WHERE availability = 'missing' AND att.source = 'O' AND utc_ms >= 900000000000")
def p3(spark, sf):
    a, m = attachments(spark, sf), order_messages(spark, sf).select(F.col("urn").alias("message"), "utc_ms")
    return a.join(m, "message", "left").where("availability = 'missing' and source = 'O' and utc_ms >= 900000000000").select("urn", "availability", "bytes")


@query("q7_read_chat", with_sql(MESSAGES_SQL) + """, p AS (SELECT *, row_number() OVER (PARTITION BY chat_urn ORDER BY utc_ms, urn) AS r FROM messages WHERE kind = 'message'),
  b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY chat_urn ORDER BY utc_ms, urn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM p WHERE r <= 10)
  SELECT urn, conv_id, turn, used + length(text) > 800 AS truncated, CASE WHEN used + length(text) > 800 THEN substr(text, 1, greatest(800 - used, 0)::BIGINT) ELSE text END AS text FROM b""")
def q7(spark, sf):
    order = Window.partitionBy("chat_urn").orderBy("utc_ms", "urn")
    first = R.message_filters(messages(spark, sf)).withColumn("r", F.row_number().over(order)).where("r <= 10")
    return R.budget(first, 800, [F.col("utc_ms"), F.col("urn")], ["chat_urn"]).select("urn", "conv_id", "turn", "truncated", "text")


@query("q6_keyset_page", with_sql(ORDERS_SQL) + " SELECT urn, utc_ms FROM om WHERE utc_ms > 883612800000 OR (utc_ms = 883612800000 AND urn > 100) ORDER BY utc_ms, urn LIMIT 101")
def q6(spark, sf):
    return R.page(order_messages(spark, sf), [("utc_ms", False), ("urn", False)], 100, (883612800000, 100)).select("urn", "utc_ms")


@query("o1_latest_page", with_sql(ORDERS_SQL) + " SELECT urn, utc_ms FROM om ORDER BY utc_ms DESC, urn DESC LIMIT 51")
def o1(spark, sf):
    return R.page(order_messages(spark, sf), [("utc_ms", True), ("urn", True)]).select("urn", "utc_ms")


@query("q9_context", with_sql(MESSAGES_SQL) + """, r AS (SELECT *, row_number() OVER (PARTITION BY chat_urn ORDER BY utc_ms, urn) AS n FROM messages)
  SELECT a.urn AS anchor, m.urn, m.n - a.n AS "offset" FROM r a JOIN r m ON m.chat_urn = a.chat_urn AND m.n BETWEEN a.n - 2 AND a.n + 1 WHERE a.turn = 2""")
def q9(spark, sf):
    m = messages(spark, sf)
    anchors = m.where("turn = 2").select(F.col("urn").alias("anchor"))
    return R.neighbours(m, anchors, 2, 1).select("anchor", "urn", F.col("offset").cast("long").alias("offset"))


@query("q8_hydrate", with_sql(ATTACHMENTS_SQL, ORDERS_SQL) + " SELECT om.urn, count(att.urn) AS attachments, coalesce(min(att.urn), '') AS first FROM om LEFT JOIN att ON att.message = om.urn WHERE om.kind = 'P' GROUP BY om.urn")
def q8(spark, sf):
    m = order_messages(spark, sf).where("kind = 'P'").select("urn")
    a = attachments(spark, sf).select(F.col("message").alias("urn"), F.col("urn").alias("order"), F.col("urn").alias("row"))
    out = R.attach_children(m, "urn", attachments=a)
    return out.select("urn", F.size("attachments").cast("long").alias("attachments"), F.coalesce(F.try_element_at("attachments", F.lit(1)), F.lit("")).alias("first"))


@query("q11_counterparts", """SELECT conv_id AS chat, max(role) FILTER (role <> 'user') AS label FROM (SELECT DISTINCT conv_id, role FROM conversations) GROUP BY conv_id HAVING count(*) FILTER (role <> 'user') = 1""")
def q11(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "role").distinct()
    return R.counterpart_labels(t.select(F.col("conv_id").alias("chat"), F.col("role").alias("identity"), (F.col("role") == "user").alias("is_me"), F.col("role").alias("label")))


@query("q12_expand_participant", with_sql(IDENTITIES_SQL) + """, al AS (SELECT 'c' || s_suppkey AS o, 's' || s_suppkey AS n FROM supplier), base AS (SELECT urn FROM ids WHERE link = 3)
  SELECT urn FROM base UNION SELECT n FROM al JOIN base ON o = urn UNION SELECT o FROM al JOIN base ON n = urn""")
def q12(spark, sf):
    aliases = table(spark, sf, "supplier").select(F.concat(F.lit("c"), "s_suppkey").alias("old_urn"), F.concat(F.lit("s"), "s_suppkey").alias("new_urn"))
    return R.expand_participant(identities(spark, sf).where("link = 3"), aliases)


@query("q13_list_chats", with_sql(ORDERS_SQL) + """ SELECT c_custkey AS chat, c_name AS label, n, last_ms FROM (SELECT c_custkey, c_name, count(urn) AS n, max(utc_ms) AS last_ms FROM customer LEFT JOIN om ON chat = c_custkey AND kind = 'O'
  GROUP BY ALL) WHERE contains(lower(c_name), '1') ORDER BY last_ms DESC NULLS LAST, chat LIMIT 101""")
def q13(spark, sf):
    chats = table(spark, sf, "customer").select(F.col("c_custkey").alias("chat"), F.col("c_name").alias("label"), F.array("c_name").alias("participants"))
    out = R.by_label(R.chat_activity(chats, order_messages(spark, sf).where("kind = 'O'")), "1")
    return out.orderBy(F.desc_nulls_last("last_ms"), "chat").limit(101).select("chat", "label", "n", "last_ms")


@query("g1_chat_activity", with_sql(ORDERS_SQL) + " SELECT chat, count(*) AS n, max(utc_ms) AS last_ms FROM om GROUP BY chat HAVING max(utc_ms) >= 980000000000")
def g1(spark, sf):
    m = order_messages(spark, sf)
    return R.chat_activity(m.select("chat").distinct(), m, 980000000000)


@query("q14_o6_participants", """SELECT s_nationkey AS chat, count(*) AS total, array_to_string(list_slice(list_sort(list(s_name)), 1, 3), '|') AS children FROM supplier GROUP BY s_nationkey""")
def q14(spark, sf):
    t = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("chat"), "s_name")
    return R.cap_children(t, ["chat"], "s_name", 3).select("chat", "total", F.array_join("children", "|").alias("children"))


@query("q14_hydrate_chats", with_sql(ORDERS_SQL) + """, mem AS (SELECT DISTINCT chat, 's' || l_suppkey AS who FROM om JOIN lineitem ON l_orderkey = urn WHERE l_suppkey IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY who) AS r FROM mem),
  p AS (SELECT chat, string_agg(who || '=' || coalesce(s_name, '?'), '|' ORDER BY who) AS participants FROM r LEFT JOIN supplier ON who = 's' || s_suppkey AND s_suppkey % 3 <> 0 WHERE r <= 5 GROUP BY chat), n AS (SELECT chat, count(*) AS n, max(utc_ms) AS ms FROM om GROUP BY chat)
  SELECT 'c' || c_custkey AS urn, c_mktsegment AS chat_kind, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS label, coalesce(n, 0) AS message_count, ms AS last_message_utc_ms, coalesce(participants, '') AS participants, 'customer/' || c_nationkey AS provenance FROM customer LEFT JOIN n ON n.chat = c_custkey LEFT JOIN p ON p.chat = c_custkey""")
def q14_chats(spark, sf):
    """Customers as chats, orders as their messages, suppliers as participants: the first five of each."""
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    chat = F.concat(F.lit("c"), "chat")
    m = order_messages(spark, sf)
    parts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("urn"), F.concat(F.lit("s"), "l_suppkey").alias("identity_urn"))
    members = m.select("urn", chat.alias("chat_urn")).join(parts, "urn").select("chat_urn", "identity_urn")
    labels = c.where("c_custkey % 4 != 0").select(F.concat(F.lit("c"), "c_custkey").alias("urn"), F.col("c_name").alias("label")).union(s.where("s_suppkey % 3 != 0").select(F.concat(F.lit("s"), "s_suppkey"), "s_name"))
    null = F.lit(None).cast("string")
    chats = c.select(F.concat(F.lit("c"), "c_custkey").alias("urn"), F.col("c_mktsegment").alias("kind"), null.alias("service"), null.alias("assignment"), F.lit("customer").alias("source"), F.col("c_nationkey").cast("string").alias("account_scope"))
    out = R.hydrate_chats(chats, m.select(chat.alias("chat_urn"), "utc_ms"), members, labels, 5)
    shown = F.array_join(F.transform("participants", lambda p: F.concat(p["urn"], F.lit("="), F.coalesce(p["label"], F.lit("?")))), "|")
    return out.select("urn", "chat_kind", "label", "message_count", "last_message_utc_ms", shown.alias("participants"), F.concat_ws("/", "provenance.source", "provenance.account_scope").alias("provenance"))


@query("q23_render_messages", with_sql(ORDERS_SQL) + """, l AS (SELECT l_orderkey AS urn, l_linenumber AS n, l_returnflag AS flag, l_linestatus AS status FROM lineitem),
  a AS (SELECT urn, string_agg('[attachment ' || status || ' ' || n || ' ' || flag || ']', ' ' ORDER BY n, flag, status) AS files FROM l WHERE n % 2 = 1 GROUP BY urn),
  e AS (SELECT urn, string_agg('[reaction ' || CASE WHEN flag = 'N' THEN '' ELSE flag END || ']', ' ' ORDER BY n, flag) AS marks FROM l WHERE n % 2 = 0 AND status = 'O' GROUP BY urn)
  SELECT om.urn, strftime(make_timestamp(utc_ms * 1000 + 5400000000), '%Y-%m-%d %H:%M') || '  ' || CASE WHEN om.urn % 5 = 0 THEN 'me' WHEN om.urn % 5 = 1 THEN '?' ELSE 'c' || chat END || ': ' || source || CASE WHEN files IS NULL AND marks IS NULL AND kind = 'O' THEN '' ELSE '  ' || concat_ws(' ', files, marks, CASE WHEN kind <> 'O' THEN '[' || kind || ']' END) END
    || CASE WHEN om.urn % 7 = 0 THEN ' …[truncated]' ELSE '' END || chr(10) || '    ' || om.urn AS line FROM om LEFT JOIN a ON a.urn = om.urn LEFT JOIN e ON e.urn = om.urn""")
def q23_whole(spark, sf):
    """Orders as messages whose odd lines are attachments and whose even ones are events, some of them reactions."""
    m = order_messages(spark, sf)
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("urn"), line.alias("l")).groupBy("urn").agg(F.array_sort(F.collect_list("l")).alias("lines"))
    odd, even = F.filter("lines", lambda x: x["n"] % 2 == 1), F.filter("lines", lambda x: x["n"] % 2 == 0)
    files = F.transform(odd, lambda x: F.struct(x["status"].alias("kind"), x["n"].alias("filename"), x["flag"].alias("availability")))
    events = F.transform(even, lambda x: F.struct(F.when(x["status"] == "O", "reaction").otherwise("edit").alias("kind"), F.when(x["flag"] != "N", x["flag"]).alias("emoji")))
    own = F.col("urn")
    sender = F.when(own % 5 == 1, F.lit("")).otherwise(F.concat(F.lit("c"), F.col("chat").cast("string")))
    kind = F.when(F.col("kind") == "O", "message").otherwise(F.col("kind"))
    text = R.render_message(own.cast("string"), F.col("utc_ms"), sender, own % 5 == 0, F.col("source"), kind, files, events, own % 7 == 0, "+01:30")
    return m.join(lines, "urn", "left").select("urn", text.alias("line"))


@query("p2_person_or_senders", "SELECT user_id, count(*) AS n FROM events WHERE user_id % 10 = 3 OR user_id = 7 GROUP BY user_id")
def p2_senders(spark, sf):
    t = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("sender"))
    links = t.distinct().select(F.col("sender").alias("identity_urn"), F.substring("sender", -1, 1).alias("person_urn"), F.lit("confirmed").alias("state"))
    return t.join(R.senders(links, "3", ["7"]), "sender", "left_semi").groupBy(F.col("sender").cast("long").alias("user_id")).agg(F.count("*").alias("n"))


#: Citations of urns with heads (1 to 4 of 5), at the end of a chain of 20 aliases, in a circle, of several aliases, and of none.
CITED = """SELECT DISTINCT CASE WHEN urn % 10 = 0 THEN urn WHEN urn % 10 = 5 THEN urn WHEN urn % 4 = 1 THEN urn + 20000000 WHEN urn % 4 = 3 AND urn % 3 = 0 THEN urn + 90000000 ELSE urn END AS urn, digest, urn AS own FROM ob"""


@query("q16_resolve", with_sql(OBSERVATIONS_SQL) + f""", h AS (SELECT urn, arg_max(digest, (observed_at, pos)) AS digest, urn % 7 = 0 AS dead, urn % 9 = 0 AS stub FROM ob WHERE urn % 5 <> 0 GROUP BY urn),
  rv AS (SELECT DISTINCT urn, digest FROM ob WHERE urn % 5 <> 0 AND urn % 2 = 0), ct AS ({CITED}),
  r AS (SELECT ct.*, CASE WHEN ct.urn >= 90000000 THEN NULL ELSE own END AS resolved_urn FROM ct)
  SELECT r.urn, r.digest, r.resolved_urn, CASE WHEN h.urn IS NULL AND own % 10 = 0 THEN 'ambiguous' WHEN h.urn IS NULL THEN 'unknown' WHEN h.digest <> r.digest AND rv.urn IS NOT NULL THEN 'revision_superseded' WHEN h.digest <> r.digest THEN 'unknown_revision'
  WHEN h.dead THEN 'tombstoned' WHEN h.stub THEN 'unavailable' ELSE 'current' END AS status
  FROM r LEFT JOIN h ON h.urn = r.resolved_urn LEFT JOIN rv ON rv.urn = r.resolved_urn AND rv.digest = r.digest""")
def q16(spark, sf):
    o = observations(spark, sf)
    own = o.where("urn % 5 != 0")
    heads = own.groupBy("urn").agg(F.max_by("digest", F.struct("observed_at", "pos")).alias("digest")).withColumns({"tombstoned": F.col("urn") % 7 == 0, "stub": F.col("urn") % 9 == 0})
    users = o.select("urn").distinct()
    step = lambda df, n, m: df.select((F.col("urn") + n).alias("old_urn"), (F.col("urn") + m).alias("new_urn"))
    chain = users.where("urn % 5 != 0 and urn % 4 = 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20)))).select((F.col("urn") + F.col("k") * 1000000).alias("old_urn"), (F.col("urn") + (F.col("k") - 1) * 1000000).alias("new_urn"))
    circle = users.where("urn % 5 != 0 and urn % 4 = 3 and urn % 3 = 0")
    several = users.where("urn % 10 = 0")
    aliases = chain.union(step(circle, 90000000, 91000000)).union(step(circle, 91000000, 90000000)).union(step(several, 0, 1)).union(step(several, 0, 2))
    u = F.col("urn")
    cited = F.when(u % 5 == 0, u).when(u % 4 == 1, u + 20000000).when((u % 4 == 3) & (u % 3 == 0), u + 90000000).otherwise(u)
    return R.resolve(o.select(cited.alias("urn"), "digest").distinct(), heads, own.where("urn % 2 = 0").select("urn", "digest"), aliases)


@query("q17_media_summary", with_sql(ATTACHMENTS_SQL) + " SELECT source, availability, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM att GROUP BY ALL")
def q17(spark, sf):
    return R.availability_summary(attachments(spark, sf), ["source", "availability"])


@query("q18_media_by_chat", with_sql(ATTACHMENTS_SQL, ORDERS_SQL) + """ SELECT chat, count(*) FILTER (availability = 'missing') AS missing, count(*) FILTER (availability = 'not_downloaded') AS not_downloaded,
  CAST(sum(CASE WHEN availability <> 'available' THEN bytes ELSE 0 END) AS BIGINT) AS bytes, max(utc_ms) AS last_ms, arg_max(att.source, (utc_ms, att.urn)) AS source, count(*) FILTER (availability <> 'available') AS unavailable
  FROM att JOIN om ON att.message = om.urn GROUP BY chat HAVING count(*) FILTER (availability <> 'available') > 0 ORDER BY unavailable DESC, chat LIMIT 20""")
def q18(spark, sf):
    return R.unavailable_by_chat(attachments(spark, sf), order_messages(spark, sf), 20)


@query("q19_media_list", with_sql(ATTACHMENTS_SQL, ORDERS_SQL) + " SELECT att.urn, availability, coalesce(utc_ms, 0) AS utc_ms FROM att LEFT JOIN om ON att.message = om.urn WHERE availability = 'missing' ORDER BY coalesce(utc_ms, 0) DESC, att.urn LIMIT 101")
def q19(spark, sf):
    a, m = attachments(spark, sf), order_messages(spark, sf).select(F.col("urn").alias("message"), "utc_ms")
    out = a.where("availability = 'missing'").join(m, "message", "left").withColumn("utc_ms", F.coalesce("utc_ms", F.lit(0)))
    return R.page(out, [("utc_ms", True), ("urn", False)], 100).select("urn", "availability", "utc_ms")


@query("q20_local_state", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'restored' WHEN page_id % 3 = 1 THEN 'source_file' ELSE 'absent' END AS local_state FROM (SELECT min(page_id) AS page_id FROM pages GROUP BY html)""")
def q20(spark, sf):
    t = table(spark, sf, "pages").groupBy("html").agg(F.min("page_id").alias("page_id")).select("page_id", F.sha2("html", 256).alias("blob_sha256"), F.col("page_id").cast("string").alias("source_path_hint"))
    blobs = t.where("page_id % 3 = 0").select(F.col("blob_sha256").alias("sha256"))
    files = t.where("page_id % 3 < 2").select(F.col("source_path_hint").alias("path"))
    return R.local_state(t, blobs, files).select("page_id", "local_state")


@query("g5_coverage", with_sql(ORDERS_SQL) + " SELECT source, count(*) AS n, min(utc_ms) AS first_ms, max(utc_ms) AS last_ms FROM om GROUP BY source")
def g5(spark, sf):
    return R.coverage(order_messages(spark, sf), ["source"])


@query("g4_count_by_kind", with_sql(ORDERS_SQL) + " SELECT kind, count(*) AS n FROM om GROUP BY kind")
def g4(spark, sf):
    return order_messages(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query("g8_latest_runs", with_sql(OBSERVATIONS_SQL) + " SELECT day, arg_max(pos, (observed_at, pos)) AS urn, arg_max(digest, (observed_at, pos)) AS status FROM ob GROUP BY day")
def g8(spark, sf):
    o = observations(spark, sf).select("day", F.col("pos").alias("urn"), F.col("digest").alias("status"), "observed_at")
    return R.latest_runs(o, ["day"])


@query("g9_tally_errors", with_sql(OBSERVATIONS_SQL) + " SELECT digest AS code, count(*) AS count, arg_min(urn, pos) AS sample FROM ob GROUP BY digest")
def g9(spark, sf):
    return R.tally_errors(observations(spark, sf).select(F.col("digest").alias("code"), F.col("urn").alias("sample"), F.col("pos").alias("order")))


@query("g17_run_status", with_sql(OBSERVATIONS_SQL) + " SELECT 'partial' AS status, CAST(count(*) AS BIGINT) AS errors FROM ob")
def g17(spark, sf):
    return R.run_status(R.tally_errors(observations(spark, sf).select(F.col("digest").alias("code"), F.col("urn").alias("sample"), F.col("pos").alias("order"))))


@query("q23_render", with_sql(MESSAGES_SQL) + " SELECT conv_id, turn, '[' || strftime(make_timestamp(utc_ms * 1000), '%Y-%m-%d %H:%M') || '] ' || sender || ': ' || text AS line FROM messages")
def q23(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", R.render(F.col("sender"), F.col("utc_ms"), F.col("text")).alias("line"))


@query("g13_suggestion_groups", with_sql(IDENTITIES_SQL) + " SELECT link, count(DISTINCT source) AS sources, count(*) AS n FROM ids GROUP BY link HAVING count(DISTINCT source) > 1")
def g13(spark, sf):
    return identities(spark, sf).groupBy("link").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("n")).where("sources > 1")


CHANGED_SQL = """now AS (SELECT conv_id * 1000 + turn AS key, CASE WHEN (conv_id + turn) % 4 = 1 THEN 'edited on the ' || coalesce(text, '') WHEN (conv_id + turn) % 4 = 2 THEN 'other words' ELSE text END AS text FROM conversations WHERE (conv_id + turn) % 5 <> 3)"""


def stored_index(spark, sf):
    """The turns in an index: all as they are, then half of them edited and a fifth removed, then compacted."""
    from ..operators.textindex import TextIndex
    from .q_streams import folder

    t = table(spark, sf, "conversations").withColumns({"key": F.col("conv_id") * 1000 + F.col("turn"), "n": F.col("conv_id") + F.col("turn")})
    edited = F.when(F.col("n") % 4 == 1, F.concat(F.lit("edited on the "), F.coalesce("text", F.lit("")))).otherwise("other words")
    index = TextIndex(spark, folder(spark), key_type="long", groups=4, spread=2)
    index.update(t.select("key", "text"), number=0)
    index.update(t.where("n % 4 in (1, 2) and n % 5 != 3").select("key", edited.alias("text")), t.where("n % 5 = 3").select("key"), number=1)
    index.compact(0)
    return index


@query("q5_stored_index", with_sql(CHANGED_SQL) + f""", w AS (SELECT key, {TOKENS_SQL} AS tk, {LINE_SQL} AS line FROM now)
  SELECT 'literal' AS search, key FROM w WHERE line LIKE '% on the %' AND line LIKE '% edited %'
  UNION ALL SELECT 'terms', key FROM w WHERE list_contains(tk, 'the') AND list_has_any(tk, ['and', 'with']) AND NOT list_contains(tk, 'edited') AND len(list_filter(tk, lambda x: starts_with(x, 'th'))) > 0
  UNION ALL SELECT 'prefix', key FROM w WHERE len(list_filter(tk, lambda x: starts_with(x, 'oth'))) > 0""")
def q5_stored(spark, sf):
    index = stored_index(spark, sf)
    found = {"literal": index.literal('on-the edited'), "terms": index.terms(all_of=["the"], any_of=["and", "with"], none_of=["edited"], prefix="th"), "prefix": index.terms(prefix="oth")}
    parts = [df.select(F.lit(name).alias("search"), "key") for name, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
