"""Projections of heads, routing of headers, coverage, runs and purging, over orders, line items and events."""

from pyspark.sql import functions as F

from ..operators import curation as K
from ..operators import intervals as I
from ..operators import projections as P
from ..operators import reads as R
from ..operators import routing as W
from ..operators import store as U
from ..plans.state import VersionedTable
from ..session import table
from ..streaming import streams as T
from .bindings import ATTACHMENTS_SQL, OBSERVATIONS_SQL, ORDERS_SQL, attachments, observations, order_messages, with_sql
from .q_streams import folder, log
from .registry import query

RUNS_OF_IDS = "SELECT kind, min(x) AS lo, max(x) AS hi FROM (SELECT kind, x, x - row_number() OVER (PARTITION BY kind ORDER BY x) AS g FROM s) GROUP BY kind, g"


def text_json(**fields):
    """A JSON object of columns that hold JSON."""
    body = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *body), F.lit("}"))


def quoted(c):
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


@query("p5_project_messages", with_sql(ORDERS_SQL) + """ SELECT urn, CAST(chat AS VARCHAR) AS chat_urn, kind, source, CASE WHEN urn % 3 = 2 THEN utc_ms WHEN urn % 4 <> 0 THEN utc_ms + 5 END AS utc_ms, urn % 2 = 1 AS is_from_me, false AS has_attachments, CASE WHEN urn % 7 <> 0 THEN 't' || urn END AS text FROM om""")
def p5(spark, sf):
    n = F.col("urn")
    at = lambda ms: F.concat(F.lit('{"utc_ms":'), ms.cast("string"), F.lit("}"))
    body = text_json(
        chat_urn=quoted(F.col("chat")), kind=quoted(F.col("kind")), source=quoted(F.col("source")), text=quoted(F.concat(F.lit("t"), n)), is_from_me=(n % 2 == 1).cast("string"),
        sent_at=F.when(n % 3 == 0, "null").when(n % 3 == 1, "{}").otherwise(at(F.col("utc_ms"))), received_at=F.when(n % 4 == 0, "null").otherwise(at(F.col("utc_ms") + 5)),
        tombstone=F.when(n % 7 == 0, '{"at":1}').otherwise("null"),
    )
    heads = order_messages(spark, sf).select("urn", F.lit("messages").alias("kind"), body.alias("record"))
    return P.project_messages(heads).select("urn", "chat_urn", "kind", "source", "utc_ms", "is_from_me", "has_attachments", "text")


@query("p6_project_events", with_sql(OBSERVATIONS_SQL) + " SELECT pos AS urn, CAST(urn AS VARCHAR) AS target_urn, digest AS kind, CASE WHEN pos % 3 > 0 THEN observed_at END AS at_ms FROM ob")
def p6_events(spark, sf):
    body = text_json(target_urn=quoted(F.col("urn")), kind=quoted(F.col("digest")), at=F.when(F.col("pos") % 3 == 0, "null").otherwise(F.concat(F.lit('{"utc_ms":'), F.col("observed_at").cast("string"), F.lit("}"))))
    heads = observations(spark, sf).select(F.col("pos").alias("urn"), F.lit("events").alias("kind"), body.alias("record"))
    return P.project_events(heads).select("urn", "target_urn", "kind", "at_ms")


@query("p6_project_attachments", with_sql(ATTACHMENTS_SQL) + " SELECT urn, CAST(message AS VARCHAR) AS message_urn, availability, CASE WHEN bytes % 2 = 0 THEN sha256(urn) END AS blob_sha256 FROM att")
def p6_attachments(spark, sf):
    blob = F.when(F.col("bytes") % 2 == 0, quoted(F.sha2("urn", 256))).otherwise("null")
    body = text_json(message_urn=quoted(F.col("message")), availability=quoted(F.col("availability")), blob_sha256=blob)
    return P.project(attachments(spark, sf).select("urn", F.lit("attachments").alias("kind"), body.alias("record")), "attachments")


@query("p8_in_state", with_sql(ORDERS_SQL) + " SELECT urn, chat FROM om WHERE urn % 3 = 1 OR urn % 3 = 2 AND urn % 2 = 0")
def p8(spark, sf):
    n = F.col("urn")
    state = F.when(n % 3 == 1, P.PRESENT).when((n % 3 == 2) & (n % 2 == 0), P.DELETED).when(n % 3 == 2, P.ABSENT)
    return P.in_state(order_messages(spark, sf).withColumn("present", state), P.PRESENT, P.DELETED).select("urn", "chat")


@query("r6_changed_event_keys", with_sql(ORDERS_SQL) + """, o AS (SELECT urn AS row_id, chat AS event_key FROM om), n AS (SELECT row_id, CASE WHEN row_id % 97 = 0 THEN event_key + 1 ELSE event_key END AS event_key FROM o WHERE row_id % 101 <> 0),
  t AS (SELECT event_key FROM o WHERE row_id % 97 = 0 OR row_id % 101 = 0 UNION SELECT event_key FROM n WHERE row_id % 97 = 0) SELECT row_id, event_key FROM n WHERE event_key IN (SELECT event_key FROM t)""")
def r6(spark, sf):
    owned = order_messages(spark, sf).select(F.col("urn").alias("row_id"), F.col("chat").alias("event_key"))
    current = owned.where("row_id % 101 != 0").withColumn("event_key", F.col("event_key") + F.when(F.col("row_id") % 97 == 0, 1).otherwise(0))
    return W.changed_event_keys(owned, current, owned.where("row_id % 97 = 0 or row_id % 101 = 0"))[1]


@query("r12_withdraw_headers", with_sql(OBSERVATIONS_SQL) + """, c AS (SELECT pos, urn FROM ob JOIN customer ON c_custkey = urn WHERE pos % 10 <> 0 AND (digest = 'click' OR digest = 'view' AND urn % 50 IN (3, 4))),
  s AS (SELECT 'observation' AS kind, pos AS x FROM c UNION SELECT 'record', urn FROM c) """ + RUNS_OF_IDS)
def r12(spark, sf):
    o = observations(spark, sf)
    rows = o.select(F.col("pos").alias("id"), "urn", F.col("digest").alias("native_table"), (F.col("urn") % 50).alias("native_key"), F.when(F.col("pos") % 10 == 0, P.ABSENT).otherwise(P.PRESENT).alias("present"))
    entities = table(spark, sf, "customer").select(F.col("c_custkey").alias("urn"), F.col("c_custkey").alias("id"))
    keyed = rows.where("native_table = 'view' and native_key in (3, 4)").select("native_table", "native_key")
    return W.withdraw_headers(rows, entities, ["click"], keyed)


def ids_of_lines(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("kind"), F.col("l_orderkey").alias("id"))


@query("r13_retained", "WITH s AS (SELECT DISTINCT l_linenumber AS kind, l_orderkey AS x FROM lineitem WHERE l_orderkey % 5 <> 0) " + RUNS_OF_IDS)
def r13(spark, sf):
    t = ids_of_lines(spark, sf)
    return W.retained(I.islands(t, ["kind"]), I.islands(t.where("id % 5 = 0"), ["kind"]))


@query("r15_resight", """WITH i AS (SELECT DISTINCT l_linenumber AS kind, l_orderkey AS x, CASE WHEN x % 3 = 0 OR x % 5 = 0 THEN 60 ELSE 50 END AS t FROM lineitem WHERE x % 2 = 0 OR x % 3 = 0 OR x % 5 = 0)
  SELECT kind, min(x) AS lo, max(x) AS hi, CAST(t AS BIGINT) AS "at", CASE t WHEN 60 THEN 'b' ELSE 'a' END AS run FROM (SELECT *, x - row_number() OVER (PARTITION BY kind, t ORDER BY x) AS g FROM i) GROUP BY kind, t, g""")
def r15(spark, sf):
    t = ids_of_lines(spark, sf)
    fresh = I.islands(t.where("id % 2 = 0 or id % 3 = 0"), ["kind"]).withColumns({"at": F.lit(50).cast("long"), "run": F.lit("a")})
    return W.resight(I.islands(t.where("id % 3 = 0 or id % 5 = 0"), ["kind"]), fresh, 60, "b")[0]


@query("r14_mark_withdrawn", with_sql(ORDERS_SQL) + """ SELECT urn AS id, CASE WHEN urn % 3 = 0 THEN 'deleted_evidence' WHEN urn % 7 < 2 THEN 'absent_from_source' ELSE 'present' END AS present, CASE WHEN urn % 3 <> 0 AND urn % 7 < 2 THEN 9 ELSE utc_ms END AS observed_at, CASE WHEN urn % 3 <> 0 AND urn % 7 < 2 THEN 'now' ELSE 'old' END AS sync_run FROM om""")
def r14_marked(spark, sf):
    o = order_messages(spark, sf).select(F.col("urn").alias("id"), F.when(F.col("urn") % 3 == 0, P.DELETED).otherwise(P.PRESENT).alias("present"), F.col("utc_ms").alias("observed_at"), F.lit("old").alias("sync_run"))
    gone = I.islands(o.where("id % 7 < 2").select(F.lit("observation").alias("kind"), "id"), ["kind"])
    return W.mark_withdrawn(o, gone, 9, "now")


@query("g3_media_summary", with_sql(ATTACHMENTS_SQL) + """ SELECT source, availability, CASE WHEN message % 3 = 0 THEN 'restored' WHEN message % 3 = 1 THEN 'source_file' ELSE 'absent' END AS local_state, count(*) AS n, CAST(coalesce(sum(CASE WHEN bytes % 5 <> 0 THEN bytes END), 0) AS BIGINT) AS declared_bytes, count(*) FILTER (bytes % 2 = 0) AS hashed FROM att GROUP BY ALL""")
def g3(spark, sf):
    k, b = F.col("message") % 3, F.col("bytes")
    a = attachments(spark, sf).withColumns({"local_state": F.when(k == 0, "restored").when(k == 1, "source_file").otherwise("absent"), "declared_size": F.when(b % 5 != 0, b), "blob_sha256": F.when(b % 2 == 0, F.col("urn"))})
    return R.media_summary(a)


@query("g9_g17_run_rows", with_sql(OBSERVATIONS_SQL) + """, e AS (SELECT urn % 9 AS run, * FROM ob), w AS (SELECT run, array_to_string(list_sort(list(digest || '=' || n)), ' ') AS written FROM (SELECT run, digest, count(*) AS n FROM e GROUP BY ALL) GROUP BY run)
  SELECT e.run, CASE WHEN e.run % 3 = 0 THEN 'partial' ELSE 'complete' END AS status, any_value(written) AS written, count(*) FILTER (digest = 'click') AS unsupported, count(*) AS n, min(observed_at) AS first_ms, max(observed_at) AS last_ms FROM e JOIN w ON w.run = e.run GROUP BY e.run""")
def g17(spark, sf):
    e = observations(spark, sf).withColumn("run", F.col("urn") % 9)
    named = lambda df: df.groupBy("run", F.col("digest").alias("name")).agg(F.count("*").alias("n"))
    code = F.when(F.col("run") % 3 == 0, "permission").otherwise(R.HARMLESS)
    errors = e.groupBy("run", code.alias("code")).agg(F.count("*").alias("count"), F.min("digest").alias("sample"))
    seen = R.coverage(e.withColumnRenamed("observed_at", "utc_ms"), ["run"])
    t = R.run_rows(e.select("run").distinct(), named(e), named(e.where("digest = 'click'")), seen, errors)
    written = F.array_join(F.transform(F.map_entries("written"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), " ")
    return t.select("run", "status", written.alias("written"), F.coalesce(F.try_element_at("unsupported", F.lit("click")), F.lit(0)).alias("unsupported"), "coverage.n", "coverage.first_ms", "coverage.last_ms")


@query("q13_list_chats_page", with_sql(ORDERS_SQL) + """, c AS (SELECT c_custkey AS urn, c_name AS label, count(om.urn) AS n, max(utc_ms) AS last_ms FROM customer LEFT JOIN om ON chat = c_custkey AND kind = 'O' WHERE c_nationkey <> 4 GROUP BY ALL)
  SELECT urn, label, n, last_ms FROM c WHERE (urn % 5 <> 0) AND (contains(label, '7') OR urn % 10 = 2) AND (last_ms IS NULL OR last_ms < 880000000000) ORDER BY last_ms DESC NULLS LAST, urn LIMIT 51""")
def q13(spark, sf):
    c = table(spark, sf, "customer")
    chats = c.select(F.col("c_custkey").alias("urn"), F.when(F.col("c_nationkey") == 4, "b").otherwise("a").alias("source"), F.col("c_name").alias("label"))
    members = c.select(F.col("c_custkey").alias("chat_urn"), (F.col("c_custkey") % 5).cast("string").alias("identity_urn"), F.when(F.col("c_custkey") % 10 == 2, "Person 7").otherwise("x").alias("label"))
    m = order_messages(spark, sf).select(F.col("chat").alias("chat_urn"), F.when(F.col("kind") == "O", "message").otherwise("system").alias("kind"), "utc_ms")
    return R.list_chats(chats, m, members, source="a", label="7", participants=["1", "2", "3", "4"], after=(880000000000, 1 << 40)).select("urn", "label", "n", "last_ms")


@query("u11_alias_links", with_sql(ORDERS_SQL) + """, a AS (SELECT DISTINCT chat AS o, chat // 2 AS n FROM om WHERE chat % 3 = 0) SELECT o AS urn, 'to' AS direction, n AS other FROM a WHERE o % 4 = 0 UNION SELECT n, 'from', o FROM a WHERE n IN (SELECT chat FROM om WHERE chat % 4 = 0)""")
def u11(spark, sf):
    m = order_messages(spark, sf)
    aliases = m.where("chat % 3 = 0").select(F.col("chat").alias("old_urn"), F.floor(F.col("chat") / 2).alias("new_urn"))
    return U.alias_links(aliases, m.where("chat % 4 = 0").select(F.col("chat").alias("urn")))


@query("c2_capture_events", with_sql(ORDERS_SQL) + """ SELECT 'record' AS operation, urn, CASE WHEN urn % 5 <> 0 THEN 'd0' END AS previous FROM om WHERE urn % 5 = 0 OR urn % 7 = 0
  UNION ALL SELECT 'revision', urn, NULL FROM om WHERE urn % 5 = 0 OR urn % 7 = 0 OR urn % 11 = 0 UNION ALL SELECT 'observation', urn, NULL FROM om WHERE urn % 13 = 0""")
def c2(spark, sf):
    m = order_messages(spark, sf).select("urn", F.col("urn").alias("id"), F.to_json(F.struct("kind")).alias("record"), F.col("utc_ms").alias("observed_at"), F.lit("r").alias("sync_run"), F.lit(None).cast("string").alias("supersedes"))
    n = F.col("urn")
    before = m.where("urn % 5 != 0").withColumn("digest", F.lit("d0"))
    after = m.withColumn("digest", F.when((n % 5 == 0) | (n % 7 == 0), "d1").otherwise("d0"))
    moved = after.withColumn("observed_at", F.col("observed_at") + F.when((n % 11 == 0) & (n % 5 != 0), 1).otherwise(0))
    seen = lambda present: m.select("urn", "id", *(F.lit("s").alias(c) for c in ("source", "scope", "native_table")), F.array(F.lit("1")).alias("native_row_ids"), *(F.lit("k").alias(c) for c in ("native_key", "fingerprint", "adapter_version")), F.lit(False).alias("minted"), present.alias("present"), "observed_at", "sync_run")
    old = {"records": before, "revisions": before, "observations": seen(F.lit("present"))}
    new = {"records": after, "revisions": moved, "observations": seen(F.when(n % 13 == 0, "absent_from_source").otherwise("present"))}
    return U.capture_events(old, new).select("operation", "urn", F.get_json_object("data", "$.previous_digest").alias("previous"))


@query("k8_purge_source", with_sql(ORDERS_SQL) + """, i AS (SELECT urn AS x, urn % 2 AS t FROM om WHERE kind <> 'O') SELECT 'record' AS kind, min(x) AS lo, max(x) AS hi, CAST(t AS BIGINT) AS "at", 'r' || t AS run FROM (SELECT x, t, x - row_number() OVER (PARTITION BY t ORDER BY x) AS g FROM i) GROUP BY t, g""")
def k8(spark, sf):
    records = order_messages(spark, sf).select("urn", F.col("urn").alias("id"), F.col("kind").alias("source"), F.lit("s").alias("scope"))
    fresh = I.islands(records.select(F.lit("record").alias("kind"), (F.col("id") % 2).alias("at"), "id"), ["kind", "at"]).withColumn("run", F.concat(F.lit("r"), F.col("at")))
    return K.purge_source({}, records, fresh, records.select("source", "scope").distinct(), "O", "s")["fresh"]


@query("t7_runs", with_sql(OBSERVATIONS_SQL) + " SELECT CAST(max(pos) AS VARCHAR) AS checkpoint, CAST(2 AS BIGINT) AS complete, CAST(1 AS BIGINT) AS failed, CAST(3 AS BIGINT) AS running FROM ob")
def t7(spark, sf):
    """Three runs over the log: the first takes its first half, the second fails, the third goes on after the checkpoint."""
    o = observations(spark, sf)
    runs = VersionedTable(spark, f"{folder(spark)}/runs")

    def work(share):
        def run(before):
            left = o.where(F.col("pos") > int(before)) if before else o
            top = left.agg(F.percentile("pos", share).cast("long").alias("p")).first()["p"]
            if share == 0:
                raise ValueError("a run that fails")
            return str(top)

        return run

    T.run_once(runs, "one", 1, work(0.5))
    try:
        T.run_once(runs, "two", 2, work(0.0))
    except ValueError:
        pass
    T.run_once(runs, "three", 3, work(1.0))
    done = runs.appended(T.RUNS)
    n = lambda status: F.count_if(F.col("status") == status).alias(status)
    return done.agg(F.max_by("checkpoint", F.when(F.col("status") == "complete", F.col("at"))).alias("checkpoint"), n("complete"), n("failed"), n("running"))


@query("t8_stream_purge", with_sql(OBSERVATIONS_SQL) + """ SELECT urn, pos, CASE WHEN pos % 11 = 0 THEN 'purged' WHEN p IS NULL THEN 'inserted' WHEN p = digest THEN 'unchanged' ELSE 'updated' END AS outcome
  FROM (SELECT urn, pos, digest, lag(CASE WHEN pos % 11 <> 0 THEN digest END) OVER (PARTITION BY urn ORDER BY pos) AS p FROM ob)""")
def t8(spark, sf):
    for k, v in T.STATE_STORE.items():
        spark.conf.set(k, v)
    where = folder(spark)
    digest = F.when(F.col("pos") % 11 != 0, F.col("digest")).alias("digest")
    out = T.stream_heads(log(spark, sf, where).select("urn", digest, F.lit(None).cast("string").alias("previous"), "observed_at", "pos", "live"))
    T.run_available(out, lambda df, i: df.write.mode("overwrite").parquet(f"{where}/out/batch={i}"), f"{where}/checkpoint", "update")
    return spark.read.parquet(f"{where}/out").select("urn", "pos", "outcome")
