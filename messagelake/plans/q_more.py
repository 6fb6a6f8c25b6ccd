"""Further queries: history, labels, people, status, sets and joins that the others use in passing."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import extract_b as B
from ..operators import reads as R
from ..operators import routing as RT
from ..operators import store as U
from ..session import table
from .bindings import ATTACHMENTS_SQL, IDENTITIES_SQL, MESSAGES_SQL, OBSERVATIONS_SQL, ORDERS_SQL, SCOPE, attachments, identities, messages, observations, order_messages, with_sql
from .q_reads import LINE_SQL
from .registry import query


@query("q2_search_history", f"""WITH l AS (SELECT source, arg_max(doc_id, doc_id) AS head FROM documents GROUP BY source) SELECT source AS urn, doc_id AS digest, CASE WHEN doc_id = head THEN 'current' ELSE 'revision_superseded' END AS revision_status FROM documents JOIN l USING (source) WHERE {LINE_SQL} LIKE '% of the %'""")
def q2(spark, sf):
    rev = table(spark, sf, "documents").select(F.col("source").alias("urn"), F.col("doc_id").alias("digest"), "text")
    heads = rev.groupBy("urn").agg(F.max("digest").alias("digest"))
    hits = R.search_history(rev, heads, "of")
    return hits.where(S.token_line("text").contains(" of the ")).select("urn", "digest", "revision_status")


@query("q4_snippet", r"""SELECT conv_id, turn, array_to_string(list_transform(list_slice(tk, greatest(p - 4, 1), greatest(p - 4, 1) + 11), lambda x: CASE WHEN x = 'and' THEN '[and]' ELSE x END), ' ') AS snippet
  FROM (SELECT conv_id, turn, tk, list_position(tk, 'and') AS p FROM (SELECT *, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}\p{Co}\p{So}\p{Sk}\p{Mn}]+') AS tk FROM conversations) WHERE list_contains(tk, 'and'))""")
def q4(spark, sf):
    t = table(spark, sf, "conversations")
    return t.where(R.search_terms("text", all_of=["and"])).select("conv_id", "turn", R.snippet("text", ["and"], 12).alias("snippet"))


@query("q10_labels", with_sql(IDENTITIES_SQL) + " SELECT urn, label FROM (SELECT urn, name AS label FROM ids UNION ALL SELECT 'chat' || n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN 'only ' || n_nationkey ELSE '+' || n_nationkey END FROM nation UNION ALL SELECT 'p' || r_regionkey, r_name FROM region)")
def q10(spark, sf):
    i = identities(spark, sf).select("urn", F.col("name").alias("label"))
    n = table(spark, sf, "nation")
    chats = n.select(F.concat(F.lit("chat"), "n_nationkey").alias("urn"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("observed_name"), S.chat_key(F.concat(F.lit("SMS;-;+"), "n_nationkey")).alias("native_key"))
    counterparts = n.where("n_nationkey % 3 = 1").select(F.concat(F.lit("chat"), "n_nationkey").alias("chat"), F.concat(F.lit("only "), "n_nationkey").alias("label"))
    people = table(spark, sf, "region").select(F.concat(F.lit("p"), "r_regionkey").alias("urn"), F.col("r_name").alias("label"))
    return R.labels(i.select("urn").union(chats.select("urn")).union(people.select("urn")), i, chats, people, counterparts)


@query("q15_list_people", with_sql(IDENTITIES_SQL) + " SELECT n_nationkey AS urn, n_name AS label, count(ids.urn) AS identities, coalesce(string_agg(ids.urn, ',' ORDER BY ids.urn), '') AS list FROM nation LEFT JOIN ids ON link = n_nationkey AND n_nationkey % 5 <> 4 GROUP BY ALL")
def q15(spark, sf):
    i = identities(spark, sf)
    people = table(spark, sf, "nation").select(F.col("n_nationkey").alias("urn"), F.col("n_name").alias("label"))
    links = i.where("link % 5 != 4").select(F.col("link").alias("person_urn"), F.col("urn").alias("identity_urn"), F.lit("confirmed").alias("state"))
    out = R.list_people(people, links, i.select("urn", F.col("name").alias("label")))
    names = F.coalesce(F.array_join(F.transform("identities", lambda x: x["identity_urn"]), ","), F.lit(""))
    return out.select("urn", "label", F.when(F.col("identities").isNull(), 0).otherwise(F.size("identities")).cast("long").alias("identities"), names.alias("list"))


@query("q21_q22_status", with_sql(ORDERS_SQL, OBSERVATIONS_SQL) + """ SELECT 'records' AS part, kind AS name, CAST(count(*) AS VARCHAR) AS value FROM om GROUP BY kind UNION ALL SELECT 'messages', source, CAST(count(*) AS VARCHAR) FROM om GROUP BY source UNION ALL SELECT 'conflicts', 'open', CAST(count(*) AS VARCHAR) FROM om WHERE urn % 50 = 1
  UNION ALL SELECT 'run', r_name || '/x', coalesce(s, 'never') FROM region LEFT JOIN (SELECT urn % 4 AS k, arg_max(digest, (observed_at, pos)) AS s FROM ob GROUP BY 1) ON k = r_regionkey""")
def q21(spark, sf):
    m = order_messages(spark, sf)
    reg = table(spark, sf, "region")
    scopes = reg.select(F.col("r_name").alias("source"), F.lit("x").alias("scope"))
    runs = observations(spark, sf).join(reg, F.col("urn") % 4 == F.col("r_regionkey")).select(F.col("r_name").alias("source"), F.lit("x").alias("scope"), F.col("pos").alias("urn"), F.col("digest").alias("status"), "observed_at")
    conflicts = m.where("urn % 50 < 2").select(F.when(F.col("urn") % 50 == 0, 1).alias("resolved_at"))
    return R.status(scopes, runs, m, m, conflicts)


@query("q24_add_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS at_iso FROM events")
def q24(spark, sf):
    t = table(spark, sf, "events").select("event_id", S.ts_struct(S.ms_of("ts"), "ms", "1970").alias("at"))
    return R.add_iso(t).select("event_id", "at_iso")


@query("p4_allowlisted", "SELECT o_orderkey, array_to_string(list_filter(['kind=' || o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'source=' || o_orderpriority END], lambda x: x IS NOT NULL), ',') AS kept FROM orders")
def p4(spark, sf):
    t = table(spark, sf, "orders")
    m = F.create_map(F.lit("kind"), F.col("o_orderstatus"), F.lit("secret"), F.lit("x"), F.lit("source"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))
    kept = R.allowlisted(m, ["kind", "source"])
    return t.select("o_orderkey", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("kept"))


@query("w3_budget_remaining", with_sql(MESSAGES_SQL) + """ SELECT conv_id, turn, length(text) > greatest(600 - used, 0) AS truncated, CASE WHEN length(text) > greatest(600 - used, 0) THEN substr(text, 1, greatest(600 - used, 0)::BIGINT) ELSE text END AS text
  FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM messages)""")
def w3(spark, sf):
    return R.budget_remaining(messages(spark, sf), 600, [F.col("turn")], ["conv_id"]).select("conv_id", "turn", "truncated", "text")


@query("u5_set_head", with_sql(OBSERVATIONS_SQL) + " SELECT urn, CASE WHEN urn % 3 = 0 AND bool_or(digest = 'click') THEN 'click' ELSE arg_max(digest, (observed_at, pos)) END AS digest, CASE WHEN urn % 3 = 0 AND bool_or(digest = 'click') THEN 99 ELSE max(observed_at) END AS observed_at FROM ob GROUP BY urn")
def u5(spark, sf):
    o = observations(spark, sf)
    heads = o.groupBy("urn").agg(F.max_by("digest", F.struct("observed_at", "pos")).alias("digest"), F.max("observed_at").alias("observed_at"))
    chosen = o.where("urn % 3 = 0").select("urn").distinct().withColumn("digest", F.lit("click"))
    return U.set_head(heads, o.select("urn", "digest").distinct(), chosen, 99)


def evidence(spark, sf, where, shift):
    o = observations(spark, sf).where(where).groupBy("urn").agg(F.max_by("digest", "pos").alias("fingerprint"), F.max("observed_at").alias("observed_at"))
    text = F.lit("x")
    return o.select("urn", text.alias("source"), text.alias("scope"), text.alias("native_table"), F.array(F.col("urn").cast("string")).alias("native_row_ids"), F.lit(None).cast("string").alias("native_key"), F.lit(False).alias("minted"), "fingerprint", text.alias("adapter_version"), F.lit("present").alias("present"), (F.col("observed_at") + shift).alias("observed_at"))


EVIDENCE_SQL = """a AS (SELECT urn, arg_max(digest, pos) AS f, max(observed_at) AS at FROM ob WHERE day < '2024-01-15' AND urn % 5 <> 0 GROUP BY urn), b AS (SELECT urn, arg_max(digest, pos) AS f, max(observed_at) - (urn % 2) * 9000000000 AS at FROM ob WHERE day >= '2024-01-15' AND urn % 7 <> 0 GROUP BY urn)""".replace(" at ", ' "at" ').replace("AS at", 'AS "at"')


@query("u6_observe_live", with_sql(OBSERVATIONS_SQL, EVIDENCE_SQL) + " SELECT count(*) AS n, count(*) FILTER (b.urn IS NOT NULL AND (a.f IS DISTINCT FROM b.f)) AS written FROM a FULL JOIN b ON a.urn = b.urn")
def u6(spark, sf):
    shift = -(F.col("urn") % 2) * 9000000000
    after, written = U.observe_live(evidence(spark, sf, "day >= '2024-01-15' and urn % 7 != 0", shift), evidence(spark, sf, "day < '2024-01-15' and urn % 5 != 0", F.lit(0)))
    return after.agg(F.count("*").alias("n")).crossJoin(written.agg(F.count("*").alias("written")))  # one row each


@query("u7_observe_merge", with_sql(OBSERVATIONS_SQL, EVIDENCE_SQL) + ' SELECT coalesce(a.urn, b.urn) AS urn, CASE WHEN a.urn IS NULL OR b."at" >= a."at" THEN b.f ELSE a.f END AS fingerprint FROM a FULL JOIN b ON a.urn = b.urn')
def u7(spark, sf):
    shift = -(F.col("urn") % 2) * 9000000000
    return U.observe_merge(evidence(spark, sf, "day >= '2024-01-15' and urn % 7 != 0", shift), evidence(spark, sf, "day < '2024-01-15' and urn % 5 != 0", F.lit(0))).select("urn", "fingerprint")


@query("u9_k6_conflicts", with_sql(ORDERS_SQL) + " SELECT count(*) FILTER (urn % 3 <> 0) AS open, count(*) FILTER (urn % 6 = 0) AS heads, count(*) FILTER (urn % 6 = 3) AS branches FROM om WHERE urn % 10 = 0 OR urn % 10 = 3")
def u9(spark, sf):
    m = order_messages(spark, sf).where("urn % 10 in (0, 3)")
    ledger = m.select(F.col("urn").alias("conflict_id"), "urn", F.when(F.col("urn") % 2 == 0, "content").otherwise("branch").alias("kind"), F.lit(None).cast("long").alias("resolved_at"))
    now, heads, branches = U.resolve_conflicts(ledger, m.where("urn % 3 = 0").select(F.col("urn").alias("conflict_id"), F.lit("d").alias("keep")), 5)
    return now.agg(F.count_if(F.col("resolved_at").isNull()).alias("open")).crossJoin(heads.agg(F.count("*").alias("heads"))).crossJoin(branches.agg(F.count("*").alias("branches")))  # one row each


@query("u11_u12_lookups", with_sql(OBSERVATIONS_SQL) + " SELECT urn, digest, max(observed_at) AS observed_at FROM ob WHERE urn % 25 = 1 GROUP BY urn, digest")
def u11(spark, sf):
    rev = observations(spark, sf).groupBy("urn", "digest").agg(F.max("observed_at").alias("observed_at"))
    links = rev.select((F.col("urn") % 25).alias("person_urn"), F.col("urn").alias("identity_urn"), F.lit("confirmed").alias("state"))
    own = U.identities_of_person(links, rev.where("urn = 1").select("urn")).select(F.col("identity_urn").alias("urn"))
    return U.revisions_of(rev, own)


@query("u10_checkpoints", "SELECT c_name AS source, 'x' AS scope, 'k' AS key, CASE WHEN c_custkey % 5 = 1 THEN 'new' ELSE 'old' END AS value FROM customer WHERE c_custkey % 5 <> 2")
def u10(spark, sf):
    t = table(spark, sf, "customer").select(F.col("c_name").alias("source"), F.lit("x").alias("scope"), F.lit("k").alias("key"), F.lit("old").alias("value"), (F.col("c_custkey") % 5).alias("part"))
    new = t.where("part in (1, 2)").withColumn("value", F.when(F.col("part") == 1, "new"))
    return U.put_checkpoint(t.drop("part"), new.drop("part"))


@query("c17_check_parent", "SELECT CAST(o_orderkey AS VARCHAR) AS producer, CASE o_custkey % 4 WHEN 1 THEN 'gap' WHEN 2 THEN 'other parent' ELSE 'other content' END AS problem FROM orders WHERE o_custkey % 4 > 0")
def c17(spark, sf):
    k = F.col("o_custkey") % 4
    t = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("producer"), k.alias("k"))
    head = t.select("producer", F.lit(10).alias("sequence"), F.lit("a").alias("archive_id"), F.lit("h").alias("sha256"))
    batch = t.select("producer", F.when(F.col("k") == 1, 12).otherwise(10).alias("after"), F.when(F.col("k") == 2, "b").otherwise("a").alias("parent_id"), F.when(F.col("k") == 3, "?").otherwise("h").alias("parent_sha256"))
    return U.check_parent(batch, head)


@query("r7_observed_keys", """SELECT DISTINCT '["groupchange","g' || l_suppkey % 20 || '","' || l_linenumber || '","2"' || CASE WHEN l_quantity > 25 THEN ',"x,y"]' ELSE ']' END AS key FROM lineitem WHERE l_suppkey % 20 < 3""")
def r7(spark, sf):
    t = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("g"), "l_linenumber", "l_quantity")
    base = S.composite_key(F.lit("groupchange"), F.concat(F.lit("g"), "g"), F.col("l_linenumber").cast("string"), F.lit("2"))
    key = F.when(F.col("l_quantity") > 25, S.extended_key(base, F.array(F.lit("x"), F.lit("y")))).otherwise(base)
    return RT.observed_keys(t.where("g < 3").select(base.alias("key")), t.select(key.alias("key")))


@query("m3_m4_memberships", """SELECT kind, count(*) AS chats, CAST(sum(members) AS BIGINT) AS members FROM (SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'group' WHEN 1 THEN 'direct' ELSE 'unknown:' || n_regionkey END AS kind, (SELECT count(DISTINCT s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 9 <> 0) AS members FROM nation) GROUP BY kind""")
def m3(spark, sf):
    n = table(spark, sf, "nation")
    chat = n.select(F.col("n_nationkey").cast("long").alias("ROWID"), F.col("n_name").alias("guid"), F.when(F.col("n_regionkey") == 0, 43).when(F.col("n_regionkey") == 1, 45).otherwise(F.col("n_regionkey")).alias("style"), F.col("n_name").alias("chat_identifier"), F.lit("SMS").alias("service_name"), F.lit("").alias("display_name"), F.lit(0).alias("is_archived"))
    chats = B.chats(chat, SCOPE)
    s = table(spark, sf, "supplier")
    joins = s.select(F.col("s_nationkey").cast("long").alias("chat_id"), F.col("s_suppkey").alias("handle_id"))
    who = s.where("s_suppkey % 9 != 0").select(F.col("s_suppkey").alias("handle_id"), F.col("s_name").alias("identity_urn"), F.col("s_name").alias("identity_key"))
    good, _ = B.memberships(joins, chats, who, SCOPE)
    n_members = good.groupBy(F.col("chat_urn").alias("urn")).agg(F.count("*").alias("m"))
    return chats.join(n_members, "urn", "left").groupBy("kind").agg(F.count("*").alias("chats"), F.sum(F.coalesce("m", F.lit(0))).alias("members"))


@query("j3_e1_e3_sets", with_sql(ORDERS_SQL, ATTACHMENTS_SQL) + " SELECT availability, count(*) AS n, count(utc_ms) AS with_message FROM att LEFT JOIN (SELECT * FROM om WHERE kind <> 'P' AND urn IN (SELECT urn FROM om WHERE chat % 2 = 0 UNION SELECT urn FROM om WHERE urn % 5 = 0 EXCEPT SELECT urn FROM om WHERE urn % 7 = 0)) o ON o.urn = message GROUP BY availability")
def j3(spark, sf):
    m = order_messages(spark, sf)
    wanted = m.where("chat % 2 = 0").select("urn").union(m.where("urn % 5 = 0").select("urn")).distinct().join(m.where("urn % 7 = 0").select("urn"), "urn", "left_anti")
    own = m.where("kind != 'P'").join(wanted, "urn", "left_semi").select(F.col("urn").alias("message"), "utc_ms")
    return attachments(spark, sf).join(own, "message", "left").groupBy("availability").agg(F.count("*").alias("n"), F.count("utc_ms").alias("with_message"))


@query("w1_top_of_group", with_sql(ORDERS_SQL) + " SELECT chat, arg_max(urn, (utc_ms, urn)) AS urn FROM om GROUP BY chat")
def w1(spark, sf):
    order = Window.partitionBy("chat").orderBy(F.desc("utc_ms"), F.desc("urn"))
    return order_messages(spark, sf).withColumn("r", F.row_number().over(order)).where("r = 1").select("chat", "urn")
