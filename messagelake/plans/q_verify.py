"""Verification of whole archives, and imports in their order, over the given tables."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import archive as A
from ..operators import verify as V
from ..session import table
from .bindings import ORDERS_SQL, order_messages, with_sql
from .registry import query
from .state import kept

#: An archive for each customer with orders; what is broken follows from its key. Names of the orders' member.
MESSAGES, CHANGES = "records/messages.jsonl", "records/changes.jsonl"


def archives(spark, sf):
    """(manifests, rows, members): the orders of each customer as an archive, by number % 12: 1 lacks its export set, 2 a lineage
    that is too long, 3 counts one more, 4 has rows whose digest is another's (order % 3 = 0), 5 a blob under another name,
    6 and 7 are feed batches, 7 with one number left out, 8 has lines that are no JSON (order % 2 = 0), 9 stubs without
    entity, 10 a parent that isn't required, 11 a payload digest of others; 0 is right."""
    o = order_messages(spark, sf).select("urn", "chat", "kind", "utc_ms")
    k = F.col("chat") % 12
    feed = k.isin(6, 7, 10)
    placed = A.dependants(o.withColumnRenamed("urn", "message_urn"), table(spark, sf, "customer").select(F.col("c_custkey").alias("urn"), F.lit(1).alias("bucket")), "chat")
    numbered = placed.withColumn("line", F.expr("row_number() over (partition by chat order by message_urn)"))
    own, record = F.col("own"), F.col("record")
    fields = {"entity": F.lit("messages"), "urn": own, "kind": F.col("kind"), "utc_ms": F.col("utc_ms")}
    digest = F.when((k == 4) & (F.col("message_urn") % 3 == 0), F.concat(F.lit("sha256:"), F.repeat(F.lit("0"), 64))).otherwise(S.revision_digest(fields))
    numbered = numbered.withColumn("own", S.urn("x", "x", "message", F.col("message_urn").cast("string"))).withColumn("digest", digest)
    numbered = numbered.withColumn("record", F.to_json(F.struct(*(c.alias(n) for n, c in fields.items()), F.col("digest").alias("revision_digest"))))
    seq = F.col("line") + F.when((k == 7) & (F.col("line") > 1), 1).otherwise(0)
    event = F.concat(F.lit('{"seq":'), seq.cast("string"), F.lit(',"operation":"record","data":{"entity_id":'), F.col("line").cast("string"), F.lit(',"observed_at":5,"previous_digest":null,"record":'), record, F.lit("}}"))
    raw = F.when(feed, event).when((k == 8) & (F.col("message_urn") % 2 == 0), F.lit("{broken")).when(k == 9, F.to_json(F.struct(own.alias("urn")))).otherwise(record)
    member = F.when(feed, CHANGES).when(k == 9, "records/stubs.jsonl").otherwise(MESSAGES)
    rows = numbered.select("chat", member.alias("member"), "line", raw.alias("raw"))
    n = rows.groupBy("chat").agg(F.count("*").alias("n"))
    name = F.col("own")
    hashed = F.sha2(F.col("chat").cast("string"), 256)
    blob = F.concat(F.lit("blobs/sha256/"), F.substring(hashed, 1, 2), F.lit("/"), F.when(k == 5, F.concat(F.substring(hashed, 1, 2), F.substring(F.sha2(hashed, 256), 3, 62))).otherwise(hashed))
    members = n.select("chat", F.explode(F.array(F.struct(member.alias("name"), hashed.alias("sha256")), F.struct(blob.alias("name"), hashed.alias("sha256")))).alias("m")).select("chat", "m.name", "m.sha256")
    payload = A.member_digest(members, ["chat"]).withColumnRenamed("digest", "payload").drop("members")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    parent = F.lit("urn:uuid:parent")
    body = F.concat(
        F.lit('{"archive_format":'), text(F.when(feed, V.FORMATS[1]).otherwise(V.FORMATS[0])), F.lit(',"export_id":'), text(name), F.when(k == 1, "").otherwise(F.lit(',"export_set":"urn:uuid:set"')), F.lit(',"created_at":1,"kind":'), F.when(feed, '"delta"').otherwise('"undated"'),
        F.lit(',"revision":1,"supersedes":[],"lineage":['), F.when(k == 2, F.lit('"older",')).otherwise(""), text(name), F.lit('],"counts":{"blob_files":1'), F.when(~feed & (k != 9), F.concat(F.lit(',"messages":'), (F.col("n") + F.when(k == 3, 1).otherwise(0)).cast("string"))).otherwise(""),
        F.lit('},"members":['), text(member), F.lit(","), text(blob), F.lit('],"payload_digest":'), text(F.concat(F.lit("sha256:"), F.when(k == 11, hashed).otherwise(F.col("payload")))),
        F.when(feed, F.concat(F.lit(',"feed":{"stream":"s","producer":"p","after":0,"through":'), F.col("n").cast("string"), F.lit('},"requires":['), F.when(k == 10, text(parent)).otherwise(""), F.lit("]"))).otherwise(""), F.lit("}"),
    )
    titled = n.withColumn("own", S.urn("x", "x", "event", F.col("chat").cast("string")))
    manifests = titled.join(payload, "chat").select(F.col("chat").alias("archive_id"), body.alias("raw"))
    named = lambda df: df.withColumnRenamed("chat", "archive_id")
    return kept(manifests), kept(named(rows)), kept(named(members))


@query("a11_a16_verify_archives", with_sql(ORDERS_SQL) + """, n AS (SELECT chat, chat % 12 AS k, sha256(CAST(chat AS VARCHAR)) AS h, count(*) AS n FROM om WHERE chat IN (SELECT c_custkey FROM customer) GROUP BY ALL),
  r AS (SELECT chat, chat % 12 AS k, urn, row_number() OVER (PARTITION BY chat ORDER BY urn) AS line FROM om WHERE chat IN (SELECT c_custkey FROM customer)),
  bad AS (SELECT chat, 'records/messages.jsonl:' || line || ':digest isn''t that of the record' AS p, line FROM r WHERE k = 4 AND urn % 3 = 0 UNION ALL SELECT chat, 'records/messages.jsonl:' || line || ':no JSON', line FROM r WHERE k = 8 AND urn % 2 = 0
    UNION ALL SELECT chat, 'records/stubs.jsonl:' || line || ':stub lacks urn or entity', line FROM r WHERE k = 9),
  b AS (SELECT chat, count(*) AS bad FROM bad GROUP BY chat),
  p AS (SELECT chat, 'manifest:lacks export_set' AS p, 0 AS line FROM n WHERE k = 1 UNION ALL SELECT chat, 'manifest:lineage and revision differ', 0 FROM n WHERE k = 2 UNION ALL SELECT chat, 'archive:counts ' || (n + 1) || ' messages and holds ' || n, 0 FROM n WHERE k = 3
    UNION ALL SELECT chat, 'archive:blobs/sha256/' || h[1:2] || '/' || h[1:2] || sha256(h)[3:64] || ': other content', 0 FROM n WHERE k = 5 UNION ALL SELECT chat, 'archive:events aren''t the manifest''s, each once and in order', 0 FROM n WHERE k = 7 AND n > 1
    UNION ALL SELECT chat, 'manifest:requires another than its parent', 0 FROM n WHERE k = 10 UNION ALL SELECT chat, 'archive:payload digest isn''t that of the members', 0 FROM n WHERE k = 11
    UNION ALL SELECT chat, 'archive:counts ' || n || ' messages and holds ' || (n - bad), 0 FROM n JOIN b USING (chat) WHERE k IN (4, 8) UNION ALL SELECT * FROM bad),
  f AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY line) AS i FROM p)
  SELECT n.chat AS archive, count(p) = 0 AS ok, coalesce(max(bad), 0) AS row_problems, coalesce(string_agg(p, ';' ORDER BY i) FILTER (i <= 5), '') AS reported FROM n LEFT JOIN f USING (chat) LEFT JOIN b USING (chat) GROUP BY n.chat""")
def a11_a16(spark, sf):
    """Orders as archives, one for each customer, most of them broken in one way, verified at once."""
    report, _ = V.verify_archives(*archives(spark, sf), keep=kept)
    return report.select(F.col("archive_id").alias("archive"), "ok", "row_problems", F.array_join("reported", ";").alias("reported"))


DECIDED = "CASE WHEN p_partkey % 7 = 0 AND p_partkey > 30 THEN 'branch_conflict' WHEN p_partkey % 5 = 0 THEN 'superseded' ELSE 'proceed' END"


@query("a25_o7_until_conflict", f"""WITH d AS (SELECT p_partkey AS id, p_brand AS label, CASE WHEN p_size % 9 = 0 THEN 'catalogue' ELSE 'bucket' END AS kind, p_size AS revision, {DECIDED} AS decision FROM part),
  o AS (SELECT *, row_number() OVER (ORDER BY kind <> 'catalogue', label, revision, id) AS place FROM d) SELECT id, CASE WHEN place > (SELECT min(place) FROM o WHERE decision = 'branch_conflict') THEN 'not_reached' ELSE decision END AS decision FROM o""")
def a25(spark, sf):
    t = table(spark, sf, "part")
    decision = F.expr(DECIDED)
    d = t.select(F.col("p_partkey").alias("archive_id"), F.col("p_brand").alias("label"), F.when(F.col("p_size") % 9 == 0, A.CATALOGUE).otherwise("bucket").alias("kind"), F.col("p_size").alias("revision"), decision.alias("decision"))
    return A.until_conflict(d).select(F.col("archive_id").alias("id"), "decision")


@query("a22_adopt", """WITH m AS (SELECT o_orderkey AS id, o_custkey AS source, 'c' || o_orderkey AS scope, (epoch_us(o_orderdate) // 1000) AS ms FROM orders),
  n AS (SELECT source, arg_min(scope, (ms, id)) AS scope, min(ms) AS created_at, 'import:' || arg_min(id, (ms, id)) AS origin FROM m WHERE source % 4 <> 0 GROUP BY source)
  SELECT 'scope' AS what, CAST(source AS VARCHAR) AS name, scope AS value, created_at AS "at", origin FROM n UNION ALL SELECT 'scope', CAST(c_custkey AS VARCHAR), 'mine', 0, 'local' FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT 'mapping', CAST(source AS VARCHAR), CAST(id % 3 AS VARCHAR), NULL, NULL FROM m GROUP BY source, id % 3 UNION ALL SELECT 'set', (SELECT arg_min('set' || id % 10, (ms, id)) FROM m), NULL, NULL, NULL""")
def a22(spark, sf):
    o = table(spark, sf, "orders")
    key, source = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    scope = F.struct(source.alias("source"), F.concat(F.lit("c"), key.cast("string")).alias("scope"), F.lit(None).cast("string").alias("label"))
    m = o.select(key.alias("export_id"), F.concat(F.lit("set"), (key % 10).cast("string")).alias("export_set"), S.ms_of("o_orderdate").alias("created_at"), F.array(scope).alias("account_scopes"), F.array(F.struct(source.alias("from"), (key % 3).cast("string").alias("to"))).alias("scope_mappings"))
    mine = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").cast("string").alias("source"), F.lit("mine").alias("scope"), F.lit(0).cast("long").alias("created_at"), F.lit(None).cast("string").alias("label"), F.lit("local").alias("origin"))
    known = m.select(F.explode("scope_mappings").alias("p")).select("p.from", "p.to").where("to = '1'").distinct()
    out = A.adopt(m, mine, known, m.select("export_set").limit(0))
    null = lambda t: F.lit(None).cast(t)
    scopes = out["scopes"].select(F.lit("scope").alias("what"), F.col("source").alias("name"), F.col("scope").alias("value"), F.col("created_at").alias("at"), "origin")
    return scopes.unionByName(out["mappings"].select(F.lit("mapping").alias("what"), F.col("from").alias("name"), F.col("to").alias("value"), null("long").alias("at"), null("string").alias("origin"))).unionByName(out["export_set"].select(F.lit("set").alias("what"), F.col("export_set").alias("name"), null("string").alias("value"), null("long").alias("at"), null("string").alias("origin")))
