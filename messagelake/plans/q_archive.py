"""Bucket queries: orders as messages, lineitem as attachments, a bucket for each month."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import archive as A
from ..session import table
from .bindings import ATTACHMENTS_SQL, ORDERS_SQL, attachments, order_messages, with_sql
from .registry import query

BUCKETED_SQL = "bm AS (SELECT *, strftime(make_timestamp(utc_ms * 1000), '%Y-%m') AS bucket FROM om)"


def bucketed(spark, sf):
    return A.assign_bucket(order_messages(spark, sf))


@query("a1_plan_buckets", """WITH r AS (SELECT date_trunc('month', min(o_orderdate)) AS lo, TIMESTAMP '1998-06-30' AS hi FROM orders) SELECT strftime(m, '%Y-%m') AS bucket FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m FROM r) UNION SELECT '1990-01' UNION SELECT 'undated'""")
def a1(spark, sf):
    exported = table(spark, sf, "region").select(F.element_at(F.array(F.lit("1990-01"), F.lit("1997-02"), F.lit("2020-01"), F.lit("undated"), F.lit("undated")), (F.col("r_regionkey") + 1).cast("int")).alias("bucket"))
    return A.plan_buckets(order_messages(spark, sf), exported, until=S.parse_date("1998-07-01"))


@query("a2_assign_bucket", with_sql(ORDERS_SQL, BUCKETED_SQL) + " SELECT bucket, count(*) AS n, min(urn) AS first FROM bm GROUP BY bucket")
def a2(spark, sf):
    return bucketed(spark, sf).groupBy("bucket").agg(F.count("*").alias("n"), F.min("urn").alias("first"))


@query("a3_dependants", with_sql(ORDERS_SQL, BUCKETED_SQL, ATTACHMENTS_SQL) + " SELECT bucket, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM att JOIN bm ON bm.urn = message GROUP BY bucket")
def a3(spark, sf):
    a = attachments(spark, sf).withColumnRenamed("message", "message_urn")
    return A.dependants(a, bucketed(spark, sf)).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("j5_orphan_events", "SELECT event_id, user_id FROM events WHERE user_id % 6 = 0 OR user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def j5(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("user_id") % 6 != 0, F.col("user_id")).alias("target_urn"))
    m = table(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("urn"))
    return A.orphan_events(e, m).select("event_id", "user_id")


@query("a4_context", with_sql(ORDERS_SQL, BUCKETED_SQL) + """, c AS (SELECT DISTINCT bucket, 'c' || chat AS urn FROM bm), s AS (SELECT DISTINCT bucket, 's' || urn % 40 AS urn FROM bm), mb AS (SELECT 'c' || c_custkey AS chat, 's' || c_nationkey + 100 AS who FROM customer),
  b AS (SELECT * FROM s UNION SELECT c.bucket, who FROM c JOIN mb ON mb.chat = c.urn) SELECT bucket, count(*) AS n FROM (SELECT * FROM c UNION SELECT * FROM b UNION SELECT bucket, 't' || urn[2:] FROM b WHERE CAST(urn[2:] AS INT) < 10) GROUP BY bucket""")
def a4(spark, sf):
    m = bucketed(spark, sf).select("bucket", F.concat(F.lit("c"), "chat").alias("chat_urn"), F.concat(F.lit("s"), F.col("urn") % 40).alias("sender_urn"))
    members = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("chat_urn"), F.concat(F.lit("s"), F.col("c_nationkey") + 100).alias("identity_urn"))
    aliases = table(spark, sf, "customer").where("c_custkey < 11").select(F.concat(F.lit("s"), F.col("c_custkey") - 1).alias("old_urn"), F.concat(F.lit("t"), F.col("c_custkey") - 1).alias("new_urn"))
    return A.context(m, members, aliases).groupBy("bucket").agg(F.count("*").alias("n"))


@query("a5_stubs", with_sql(ORDERS_SQL, BUCKETED_SQL) + """ SELECT bucket, count(*) AS n, count(*) FILTER (o.urn IS NULL) AS unknown FROM (SELECT DISTINCT bucket, urn - 1 AS ref FROM bm) r LEFT JOIN om o ON o.urn = ref
  WHERE NOT EXISTS (SELECT 1 FROM bm b WHERE b.bucket = r.bucket AND b.urn = ref) GROUP BY bucket""")
def a5(spark, sf):
    b = bucketed(spark, sf)
    out = A.stubs(b.select("bucket", (F.col("urn") - 1).alias("urn")), b.select("bucket", "urn"), b.select("urn", "kind"))
    return out.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "unknown").alias("unknown"))


@query("a6_g16_bounds", with_sql(ORDERS_SQL, BUCKETED_SQL) + " SELECT bucket, min(utc_ms) AS first, max(utc_ms) AS last, array_to_string(list_sort(list(DISTINCT source)), '|') AS runs FROM bm GROUP BY bucket")
def a6(spark, sf):
    o = bucketed(spark, sf).select("bucket", F.col("utc_ms").alias("observed_at"), F.col("source").alias("sync_run"))
    return A.observation_bounds(o, ["bucket"]).withColumn("runs", F.array_join("runs", "|"))


LEVELS_SQL = """pt AS (SELECT bucket, sha256(CAST(urn AS VARCHAR))[1:3] AS part, count(*) AS n, sha256(string_agg(urn || chr(0) || kind, chr(10) ORDER BY urn || chr(0) || kind)) AS h FROM (SELECT DISTINCT bucket, urn, kind FROM bm) GROUP BY ALL),
dg AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS records, sha256(string_agg(h, chr(10) ORDER BY part)) AS digest FROM pt GROUP BY bucket)"""
DIGEST_SQL = "dg AS (SELECT bucket, count(DISTINCT (urn, kind)) AS records, sha256(string_agg(DISTINCT urn || chr(0) || kind, chr(10) ORDER BY urn || chr(0) || kind) || chr(10)) AS digest FROM bm GROUP BY bucket)"


@query("g14_set_digest", with_sql(ORDERS_SQL, BUCKETED_SQL, DIGEST_SQL) + " SELECT * FROM dg")
def g14(spark, sf):
    return A.flat_digest(bucketed(spark, sf).select("bucket", "urn", F.col("kind").alias("digest")), ["bucket"])


@query("g14_two_level_digest", with_sql(ORDERS_SQL, BUCKETED_SQL, LEVELS_SQL) + " SELECT * FROM dg")
def g14_levels(spark, sf):
    return A.set_digest(bucketed(spark, sf).select("bucket", "urn", F.col("kind").alias("digest")), ["bucket"])


@query("a8_revise", with_sql(ORDERS_SQL, BUCKETED_SQL, LEVELS_SQL) + """ SELECT bucket, records, digest, CASE WHEN bucket LIKE '%-01' THEN 'unchanged' ELSE 'write' END AS action, CASE WHEN bucket LIKE '%-01' THEN 2 WHEN bucket LIKE '%-02' THEN 3 ELSE 1 END AS revision,
  CASE WHEN bucket LIKE '%-02' THEN 'x2' END AS supersedes FROM dg""")
def a8(spark, sf):
    now = A.set_digest(bucketed(spark, sf).select("bucket", "urn", F.col("kind").alias("digest")), ["bucket"])
    old = now.where("bucket like '%-01' or bucket like '%-02'").select("bucket", F.explode(F.array(F.lit(1), F.lit(2))).alias("revision"), F.when(F.col("bucket").like("%-01"), F.col("digest")).otherwise("other").alias("digest")).withColumn("export_id", F.concat(F.lit("x"), "revision"))
    return A.revise(now, old)


@query("a9_media_counts", with_sql(ORDERS_SQL, BUCKETED_SQL, ATTACHMENTS_SQL) + """ SELECT bucket, count(*) FILTER (availability = 'available') AS available, count(*) FILTER (availability = 'missing') AS missing, count(*) FILTER (availability = 'not_downloaded') AS not_downloaded,
  CASE WHEN bool_or(availability <> 'available') THEN 'partial' ELSE 'complete' END AS status FROM att JOIN bm ON bm.urn = message GROUP BY bucket""")
def a9(spark, sf):
    a = attachments(spark, sf).withColumnRenamed("message", "message_urn")
    return A.media_counts(A.dependants(a, bucketed(spark, sf)), ["bucket"])


@query("a11_check_manifests", """SELECT s_suppkey AS n, CASE WHEN s_suppkey % 4 = 0 THEN 'bad label' WHEN s_suppkey % 4 = 1 THEN 'bad revision,lineage doesn''t reach the revision' ELSE 'negative count' END AS problems FROM supplier WHERE s_suppkey % 4 < 3""")
def a11(spark, sf):
    n = F.col("s_suppkey")
    key = S.urn("x", "x", "event", n.cast("string"))
    m = table(spark, sf, "supplier").select(n.alias("n"), key.alias("archive_id"), F.lit("bucket").alias("kind"), F.when(n % 4 == 0, "2024-13").otherwise("2024-12").alias("label"), F.when(n % 4 == 1, 0).otherwise(1).alias("revision"), F.array(key).alias("lineage"), F.lit(None).cast("string").alias("supersedes"), F.create_map(F.lit("messages"), F.when(n % 4 == 2, -1).otherwise(1)).alias("counts"), F.concat(F.lit("sha256:"), F.sha2(key, 256)).alias("content_digest"))
    return A.check_manifests(m).join(m.select("archive_id", "n"), "archive_id").select("n", F.array_join("problems", ",").alias("problems"))


@query("a13_a14_check_rows", """SELECT problem AS problems, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey % 3 AS k, CASE o_orderkey % 3 WHEN 0 THEN 'unknown field' WHEN 1 THEN 'missing name' END AS problem FROM orders) WHERE problem IS NOT NULL GROUP BY 1""")
def a13(spark, sf):
    t = table(spark, sf, "orders")
    k, n = F.col("o_orderkey") % 3, F.col("o_custkey").alias("id")
    raw = F.when(k == 0, F.to_json(F.struct(n, F.lit("n").alias("name"), F.lit(1).alias("other")))).when(k == 1, F.to_json(F.struct(n))).otherwise(F.to_json(F.struct(n, F.lit("n").alias("name"))))
    return A.check_rows(t.select(raw.alias("raw")), {"id": "long", "name": "string", "note": "string?"}).groupBy(F.array_join("problems", ",").alias("problems")).agg(F.count("*").alias("n"))


@query("a16_check_counts", with_sql(ORDERS_SQL, BUCKETED_SQL) + " SELECT bucket, count(*) + CASE WHEN bucket LIKE '%-03' THEN 1 ELSE 0 END AS expected, count(*) AS found FROM bm WHERE bucket LIKE '%-03' GROUP BY bucket")
def a16(spark, sf):
    b = bucketed(spark, sf)
    expected = b.groupBy("bucket").agg((F.count("*") + F.max(F.col("bucket").like("%-03").cast("int"))).alias("expected"))
    return A.check_counts(expected, b, ["bucket"])


@query("a17_a25_lineage", """SELECT decision, count(*) AS n, CASE decision WHEN 'branch_conflict' THEN 0 WHEN 'superseded' THEN 1 ELSE 2 END AS severity FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'already_imported' WHEN 1 THEN 'proceed' WHEN 2 THEN 'superseded' WHEN 3 THEN 'proceed' ELSE 'branch_conflict' END AS decision FROM part) GROUP BY 1""")
def a17(spark, sf):
    n = F.col("p_partkey")
    k = n % 5
    name = lambda s: F.concat(F.lit(s), n.cast("string"))
    t = table(spark, sf, "part")
    manifests = t.select(name("l").alias("label"), name("a").alias("archive_id"), F.when(k == 3, F.array(name("old"), name("a"))).otherwise(F.array(name("a"))).alias("lineage"))
    imports = t.where(k != 1).select(name("l").alias("label"), F.when(k == 0, name("a")).when(k == 2, name("new")).when(k == 3, name("old")).otherwise(name("branch")).alias("archive_id"), F.lit(1).alias("revision"), F.when(k == 2, F.array(name("a"), name("new"))).otherwise(F.array(name("x"))).alias("lineage"))
    return A.import_summary(A.lineage(manifests, imports, manifests.select("archive_id").limit(0)))


@query("a19_retire", with_sql(ORDERS_SQL) + " SELECT urn FROM om WHERE urn % 10 < 3 AND urn % 2 = 1 AND urn % 7 <> 0")
def a19(spark, sf):
    m = order_messages(spark, sf).select("urn")
    return A.retire(m.where("urn % 10 < 3"), m.where("urn % 2 = 0"), m.where("urn % 7 = 0"))


@query("a21_unresolved", with_sql(ORDERS_SQL) + " SELECT chat AS urn, count(*) AS uses FROM om WHERE chat NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 4) GROUP BY chat")
def a21(spark, sf):
    return A.unresolved(order_messages(spark, sf).select(F.col("chat").alias("urn")), table(spark, sf, "customer").where("c_nationkey != 4").select(F.col("c_custkey").alias("urn")))


@query("a23_blobs_to_restore", "SELECT DISTINCT sha256(html) AS sha256 FROM pages WHERE html NOT IN (SELECT html FROM pages WHERE page_id % 3 = 0)")
def a23(spark, sf):
    b = table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha256"))
    return A.blobs_to_restore(b, b.where("page_id % 3 = 0")).select("sha256")


@query("a24_compare_stores", with_sql(ORDERS_SQL) + " SELECT count(*) FILTER (urn % 97 <> 0 AND urn % 89 <> 0 AND urn % 101 <> 0) AS equal, count(*) FILTER (urn % 97 <> 0 AND urn % 89 <> 0 AND urn % 101 = 0) AS different, count(*) FILTER (urn % 97 = 0 AND urn % 89 <> 0) AS only_a, count(*) FILTER (urn % 89 = 0 AND urn % 97 <> 0) AS only_b FROM om")
def a24(spark, sf):
    m = order_messages(spark, sf).select("urn", F.col("kind").alias("digest"))
    return A.compare_stores(m.where("urn % 89 != 0"), m.where("urn % 97 != 0").withColumn("digest", F.when(F.col("urn") % 101 == 0, "X").otherwise(F.col("digest"))))


@query("a6_a7_provenance", with_sql(ORDERS_SQL, BUCKETED_SQL) + """, r AS (SELECT l_orderkey AS urn, l_linenumber AS digest, CASE WHEN l_linenumber > 1 THEN 'run' || l_suppkey % 5 END AS sync_run FROM lineitem)
  SELECT bucket, count(*) AS revisions, count(DISTINCT bm.urn) AS urns, (SELECT string_agg(DISTINCT x.sync_run, ',' ORDER BY x.sync_run) FROM r x JOIN bm b ON b.urn = x.urn WHERE b.bucket = bm.bucket) AS runs FROM bm JOIN r ON r.urn = bm.urn GROUP BY bucket
  UNION ALL SELECT 'catalogue', count(*), count(DISTINCT urn), NULL FROM (SELECT urn FROM om WHERE chat % 3 = 0)""")
def a6_a7(spark, sf):
    b = bucketed(spark, sf)
    rev = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("urn"), F.col("l_linenumber").alias("digest"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("run"), F.col("l_suppkey") % 5)).alias("sync_run"))
    r, _, runs = A.provenance(b, rev, rev.limit(0))
    named = runs.groupBy("bucket").agg(F.array_join(F.array_sort(F.collect_list("sync_run")), ",").alias("runs"))
    out = r.groupBy("bucket").agg(F.count("*").alias("revisions"), F.count_distinct("urn").alias("urns")).join(named, "bucket", "left")
    c = A.catalogue(b.select("urn", F.when(F.col("chat") % 3 == 0, "chats").otherwise("messages").alias("kind")))
    return out.unionByName(c.groupBy("bucket").agg(F.count("*").alias("revisions"), F.count_distinct("urn").alias("urns"), F.lit(None).cast("string").alias("runs")))


@query("g15_member_digest", """SELECT l_orderkey AS archive, count(*) AS members, sha256(string_agg(name || chr(0) || h || chr(10), '' ORDER BY name, h)) AS digest FROM (SELECT l_orderkey, 'records/' || l_linenumber AS name, sha256(CAST(l_partkey AS VARCHAR)) AS h FROM lineitem) GROUP BY 1""")
def g15(spark, sf):
    m = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("archive"), F.concat(F.lit("records/"), "l_linenumber").alias("name"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"))
    return A.member_digest(m, ["archive"])


def observation_json(spark, sf):
    k = F.col("o_orderkey") % 6
    urn = S.urn("x", "x", "event", F.col("o_orderkey").cast("string"))
    body = F.struct(
        F.when(k == 0, "nothing").otherwise(urn).alias("entity_urn"), F.lit("s").alias("source"), F.lit("c").alias("account_scope"), F.lit("t").alias("native_table"), F.array(F.col("o_orderkey").cast("string")).alias("native_row_ids"), F.lit("f").alias("fingerprint"), F.when(k != 1, "1").alias("adapter_version"),
        F.when(k != 2, F.col("o_custkey")).alias("observed_at"), F.lit(False).alias("minted"), F.when(k == 3, "perhaps").otherwise("present").alias("present"), F.lit(None).cast("string").alias("native_key"),
    )
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(k == 4, "{broken").otherwise(F.to_json(body)).alias("raw"))


@query("a15_check_observations", """SELECT CASE o_orderkey % 6 WHEN 0 THEN 'observation entity_urn is no urn' WHEN 1 THEN 'observation field adapter_version missing or no string' WHEN 2 THEN 'observation field observed_at missing or no bigint' WHEN 3 THEN 'observation present unknown' ELSE 'no JSON' END AS problem,
  CASE WHEN o_orderkey % 6 = 4 THEN 1 ELSE count(*) END AS n FROM orders WHERE o_orderkey % 6 < 5 GROUP BY o_orderkey % 6""")
def a15(spark, sf):
    return A.check_observations(observation_json(spark, sf)).groupBy("problem").agg(F.count("*").alias("n"))


@query("a12_a13_check_types", """SELECT sha256(raw) AS sha256, problems FROM (SELECT DISTINCT '{"id":' || CASE WHEN o_orderkey % 5 = 0 THEN '"x"' ELSE CAST(o_custkey AS VARCHAR) END || ',"kind":"' || CASE WHEN o_orderkey % 5 = 1 THEN 'odd' ELSE o_orderstatus END || '","at":"' || CASE WHEN o_orderkey % 5 = 2 THEN 'now' ELSE '2024' END || '"}' AS raw,
  CASE o_orderkey % 5 WHEN 0 THEN 'id is no bigint' WHEN 1 THEN 'kind has no such value' WHEN 2 THEN 'at has no such form' END AS problems FROM orders) WHERE problems IS NOT NULL""")
def a12(spark, sf):
    k = F.col("o_orderkey") % 5
    id_ = F.when(k == 0, '"x"').otherwise(F.col("o_custkey").cast("string"))
    raw = F.concat(F.lit('{"id":'), id_, F.lit(',"kind":"'), F.when(k == 1, "odd").otherwise(F.col("o_orderstatus")), F.lit('","at":"'), F.when(k == 2, "now").otherwise("2024"), F.lit('"}'))
    out = A.check_types(table(spark, sf, "orders").select(raw.alias("raw")), {"id": "BIGINT", "kind": "STRING", "at": "STRING", "note": "STRING?"}, {"kind": ["O", "F", "P"]}, {"at": r"^\d{4}$"})
    return out.select("sha256", F.array_join("problems", ",").alias("problems"))


TOMBSTONE = """'sha256:' || sha256('{"kind":"' || kind || '","tombstone":{"export_id":"x2","reason":"retired_by_archive_revision"},"urn":' || urn || '}')"""


@query("a18_a20_import_bucket", with_sql(ORDERS_SQL) + f""", h AS (SELECT urn, kind, CASE WHEN urn % 3 = 0 THEN 'old' ELSE kind END AS digest, utc_ms + CASE WHEN urn % 7 = 0 THEN 1 ELSE 0 END AS observed_at FROM om WHERE urn % 4 <> 0),
  o AS (SELECT coalesce(b.urn, h.urn) AS urn, coalesce(b.kind, h.kind) AS kind, b.kind AS carried, h.digest AS had, h.observed_at AS had_at, b.utc_ms AS at, CASE WHEN h.urn IS NULL THEN 'inserted' WHEN b.urn IS NULL THEN 'none' WHEN h.digest = b.kind THEN 'unchanged' WHEN b.urn % 2 = 0 AND b.utc_ms >= h.observed_at THEN 'updated' WHEN b.urn % 2 = 0 THEN 'older' ELSE 'conflict' END AS outcome,
    b.urn IS NULL AND h.urn % 6 = 1 AS tombstoned FROM (SELECT * FROM om WHERE urn % 5 <> 0) b FULL JOIN h ON h.urn = b.urn),
  r AS (SELECT urn, digest FROM h UNION SELECT urn, 'old' FROM om WHERE urn % 2 = 0 UNION SELECT urn, kind FROM om WHERE urn % 5 <> 0 UNION SELECT urn, {TOMBSTONE} FROM o WHERE tombstoned)
  SELECT urn, outcome, tombstoned, CASE WHEN tombstoned THEN {TOMBSTONE} WHEN outcome IN ('inserted', 'updated') THEN carried ELSE had END AS digest, revisions, 'x2' AS newest, 'x2' AS superseded_by FROM o JOIN (SELECT urn, count(*) AS revisions FROM r GROUP BY urn) n USING (urn)""")
def a18(spark, sf):
    m = order_messages(spark, sf).withColumn("record", F.to_json(F.struct("kind", "urn")))
    heads = m.where("urn % 4 != 0").select("urn", F.when(F.col("urn") % 3 == 0, "old").otherwise(F.col("kind")).alias("digest"), (F.col("utc_ms") + F.when(F.col("urn") % 7 == 0, 1).otherwise(0)).alias("observed_at"), F.lit(False).alias("tombstoned"), "record")
    records = m.where("urn % 5 != 0").select("urn", F.lit("messages").alias("kind"), F.col("kind").alias("digest"), F.col("utc_ms").alias("observed_at"), "record")
    known = m.where("urn % 2 = 0").select("urn", F.lit("old").alias("digest"), F.lit(0).cast("long").alias("observed_at"))
    none = spark.createDataFrame([], "urn long, source string, scope string, native_table string, native_row_ids array<string>, native_key string, minted boolean, fingerprint string, adapter_version string, present string, observed_at long")
    members = m.where("urn % 6 = 1").select(F.lit("x1").alias("export_id"), "urn")
    imports = spark.createDataFrame([("x1", "2024-01", 1, ["x1"], 1, None)], "export_id string, label string, revision int, lineage array<string>, imported_at long, superseded_by string")
    manifest = spark.createDataFrame([("2024-01", 2, ["x1", "x2"])], "label string, revision int, lineage array<string>")
    stored = {"heads": heads, "revisions": heads.select("urn", "digest", "observed_at"), "observations": none, "members": members, "imports": imports}
    out = A.import_bucket({"records": records, "revisions": known, "observations": none, "manifest": manifest}, stored, "x2", 5, ["x1"])
    ledger = out["imports"].agg(F.max_by("export_id", "revision").alias("newest"), F.max("superseded_by").alias("superseded_by"))  # one row
    revisions = out["revisions"].groupBy("urn").agg(F.count("*").alias("revisions"))
    found = out["heads"].join(out["outcomes"], "urn", "left").join(revisions, "urn").crossJoin(F.broadcast(ledger))
    return found.select("urn", F.coalesce("outcome", F.lit("none")).alias("outcome"), "tombstoned", "digest", "revisions", "newest", "superseded_by")


NESTED = {
    "$defs": {"at": {"type": "object", "required": ["utc_ms"], "properties": {"utc_ms": {"type": "integer", "minimum": 0}}, "additionalProperties": False}},
    "type": "object", "required": ["key", "parts"],
    "properties": {"key": {"type": "integer"}, "status": {"enum": ["F", "O", "P"]}, "sent_at": {"$ref": "#/$defs/at"}, "parts": {"type": "array", "items": {"type": "object", "properties": {"type": {"const": "line"}, "at": {"$ref": "#/$defs/at"}}, "if": {"required": ["flag"]}, "then": {"properties": {"flag": {"type": "string", "pattern": "^[AR]$"}}}}}},
}


@query("a12_nested_schemas", """WITH l AS (SELECT l_orderkey AS k, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS i FROM lineitem),
  p AS (SELECT o_orderkey AS k, '$.sent_at: lacks utc_ms' AS p FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, '$.status: not among ["F", "O", "P"]' FROM orders WHERE o_orderkey % 11 = 0
    UNION ALL SELECT k, '$.parts[' || i || '].at.utc_ms: no integer' FROM l WHERE k % 5 = 0 AND i % 3 = 0 UNION ALL SELECT k, '$.parts[' || i || '].at.more: not allowed' FROM l WHERE k % 13 = 0 UNION ALL SELECT k, '$.parts[' || i || '].flag: doesn''t match ^[AR]$' FROM l WHERE flag = 'N')
  SELECT k AS "key", string_agg(p, ';' ORDER BY p) AS problems FROM p WHERE k IN (SELECT o_orderkey FROM orders) GROUP BY k""")
def a12_nested(spark, sf):
    """Orders with their lines as nested records, some broken three levels down, against one compiled schema."""
    from ..operators import schemas as J

    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("flag")).alias("l"))
    lines = t.groupBy("k").agg(F.array_sort(F.collect_list("l")).alias("lines"))
    part = lambda x, i: F.concat(F.lit('{"type":"line","flag":"'), x["flag"], F.lit('","at":{"utc_ms":'), F.when((F.col("k") % 5 == 0) & (i % 3 == 0), F.lit('"x"')).otherwise(i.cast("string")), F.when(F.col("k") % 13 == 0, F.lit(',"more":1')).otherwise(F.lit("")), F.lit("}}"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus").join(lines, "k", "left")
    status = F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("o_orderstatus"))
    sent = F.when(F.col("k") % 7 == 0, F.lit("{}")).otherwise(F.lit('{"utc_ms":5}'))
    body = F.concat(F.lit('{"key":'), F.col("k").cast("string"), F.lit(',"status":"'), status, F.lit('","sent_at":'), sent, F.lit(',"parts":['), F.coalesce(F.array_join(F.transform("lines", part), ","), F.lit("")), F.lit("]}"))
    raw = o.select("k", body.alias("raw"))
    found = J.check_schema(raw, NESTED)
    return found.join(raw.select("k", F.sha2("raw", 256).alias("sha256")), "sha256").select(F.col("k").alias("key"), F.array_join(F.array_sort("problems"), ";").alias("problems"))
