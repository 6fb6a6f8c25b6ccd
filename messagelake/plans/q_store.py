"""Heads, revisions, journal and replay over the event log."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import feed
from ..operators import intervals as I
from ..operators import store as U
from .bindings import OBSERVATIONS_SQL, ORDERS_SQL, observations, order_messages, with_sql
from .registry import query

OLD = "urn % 4 <> 0 AND day < '2024-01-15'"
HEADS_SQL = f"h AS (SELECT urn, arg_max(digest, (observed_at, pos)) AS digest, max(observed_at) AS observed_at FROM ob WHERE {OLD} GROUP BY urn)"


def split(spark, sf):
    """(heads so far, the batch that follows) of the log."""
    o = observations(spark, sf)
    old = o.where("urn % 4 != 0 and day < '2024-01-15'")
    heads = old.groupBy("urn").agg(F.max_by("digest", F.struct("observed_at", "pos")).alias("digest"), F.max("observed_at").alias("observed_at"))
    return heads, o.where("day >= '2024-01-15'")


@query("w8_digest_changes", with_sql(OBSERVATIONS_SQL, HEADS_SQL) + """ SELECT urn, pos, digest, previous, coalesce(digest <> previous, true) AS changed FROM (SELECT ob.urn, pos, ob.digest,
  coalesce(lag(ob.digest) OVER (PARTITION BY ob.urn ORDER BY pos), h.digest) AS previous FROM ob LEFT JOIN h ON h.urn = ob.urn WHERE day >= '2024-01-15')""")
def w8(spark, sf):
    heads, batch = split(spark, sf)
    out = U.digest_changes(batch, heads.select("urn", "digest"))
    return out.select("urn", "pos", "digest", "previous", F.coalesce(F.col("digest") != F.col("previous"), F.lit(True)).alias("changed"))


@query("u2_upsert_live", with_sql(OBSERVATIONS_SQL, HEADS_SQL) + """, b AS (SELECT urn, arg_max(digest, pos) AS digest, arg_max(observed_at, pos) AS observed_at FROM ob WHERE day >= '2024-01-15' GROUP BY urn)
  SELECT coalesce(b.urn, h.urn) AS urn, coalesce(b.digest, h.digest) AS digest, coalesce(b.observed_at, h.observed_at) AS observed_at FROM h FULL JOIN b ON b.urn = h.urn""")
def u2(spark, sf):
    heads, batch = split(spark, sf)
    return U.upsert_live(batch, heads)[0]


@query("g10_tally_outcomes", with_sql(OBSERVATIONS_SQL, HEADS_SQL) + """ SELECT CASE WHEN previous IS NULL THEN 'inserted' WHEN previous = digest THEN 'unchanged' ELSE 'updated' END AS outcome, count(*) AS n FROM (SELECT ob.digest,
  coalesce(lag(ob.digest) OVER (PARTITION BY ob.urn ORDER BY pos), h.digest) AS previous FROM ob LEFT JOIN h ON h.urn = ob.urn WHERE day >= '2024-01-15') GROUP BY 1""")
def g10(spark, sf):
    heads, batch = split(spark, sf)
    return U.upsert_live(batch, heads)[1].groupBy("outcome").agg(F.count("*").alias("n"))


@query("u3_upsert_import", with_sql(OBSERVATIONS_SQL, HEADS_SQL) + f""", p AS (SELECT DISTINCT urn, digest FROM ob WHERE {OLD} AND urn % 3 <> 0), b AS (SELECT urn, arg_max(digest, pos) AS digest, arg_max(observed_at, pos) - 1000000000 * (urn % 2) AS observed_at FROM ob WHERE day >= '2024-01-15' GROUP BY urn)
  SELECT outcome, count(*) AS n, min(urn) AS first FROM (SELECT b.urn, CASE WHEN h.urn IS NULL THEN 'inserted' WHEN h.digest = b.digest THEN 'unchanged' WHEN p.urn IS NOT NULL AND b.observed_at >= h.observed_at THEN 'updated' WHEN p.urn IS NOT NULL THEN 'older' ELSE 'conflict' END AS outcome
  FROM b LEFT JOIN h ON h.urn = b.urn LEFT JOIN p ON p.urn = h.urn AND p.digest = h.digest) GROUP BY outcome""")
def u3(spark, sf):
    heads, batch = split(spark, sf)
    prior = observations(spark, sf).where("urn % 4 != 0 and day < '2024-01-15' and urn % 3 != 0").select("urn", "digest")
    last = batch.groupBy("urn").agg(F.max_by(F.struct("digest", "observed_at"), "pos").alias("x")).select("urn", "x.digest", (F.col("x.observed_at") - 1000000000 * (F.col("urn") % 2)).alias("observed_at"))
    return U.upsert_import(last, heads, prior)[1].groupBy("outcome").agg(F.count("*").alias("n"), F.min("urn").alias("first"))


@query("u4_append_revisions", with_sql(OBSERVATIONS_SQL) + " SELECT urn, digest, max(observed_at) AS observed_at FROM ob GROUP BY urn, digest")
def u4(spark, sf):
    o = observations(spark, sf)
    first = o.where("day < '2024-01-15'").groupBy("urn", "digest").agg(F.max("observed_at").alias("observed_at"))
    return U.append_revisions(first, o.where("day >= '2024-01-15'"))


@query("u1_current_heads", with_sql(ORDERS_SQL) + """ SELECT urn AS id, CASE WHEN urn % 100 < 50 THEN greatest(utc_ms, 950000000000) ELSE utc_ms END AS observed_at FROM om""")
def u1(spark, sf):
    m = order_messages(spark, sf).select("kind", F.col("urn").alias("id"), F.col("utc_ms").alias("observed_at"))
    fresh = I.islands(m.where("id % 100 < 50").select("kind", "id"), ["kind"]).withColumn("at", F.lit(950000000000))
    return U.current_heads(m, fresh).select("id", "observed_at")


@query("u8_mark_absent", with_sql(ORDERS_SQL) + " SELECT CASE WHEN kind IN ('O', 'F') AND utc_ms < 900000000000 THEN 'absent_from_source' ELSE 'present' END AS present, count(*) AS n FROM om GROUP BY 1")
def u8(spark, sf):
    m = order_messages(spark, sf).select("urn", F.col("kind").alias("native_table"), F.lit("present").alias("present"), F.col("utc_ms").alias("observed_at"))
    return U.mark_absent(m, ["O", "F"], 900000000000).groupBy("present").agg(F.count("*").alias("n"))


@query("u13_epochs", with_sql(OBSERVATIONS_SQL) + " SELECT CAST(urn % 2 AS VARCHAR) AS source, day AS scope, count(*) AS epoch FROM ob WHERE digest <> 'purchase' GROUP BY ALL")
def u13(spark, sf):
    o = observations(spark, sf)
    changes = o.select((F.col("urn") % 2).cast("string").alias("source"), F.col("day").alias("scope"), F.lit("x").alias("kind"), F.when(F.col("digest") == "purchase", "record_refresh").otherwise("record").alias("operation"))
    return U.epochs(changes)


@query("g6_count_delta", with_sql(OBSERVATIONS_SQL) + " SELECT digest, count(*) FILTER (urn % 3 <> 0) AS n FROM ob GROUP BY digest")
def g6(spark, sf):
    o = observations(spark, sf)
    counts = o.where("day < '2024-01-15'").groupBy("digest").agg(F.count("*").alias("n"))
    changes = o.where("day >= '2024-01-15'").select("digest", F.lit(1).alias("sign")).union(o.where("urn % 3 = 0").select("digest", F.lit(-1)))
    return U.count_delta(counts, changes, ["digest"])


@query("c1_seed_journal", with_sql(OBSERVATIONS_SQL) + """ SELECT row_number() OVER (ORDER BY rank, urn, data) AS seq, operation, urn, data FROM (SELECT DISTINCT 0 AS rank, 'revision' AS operation, urn, digest AS data FROM ob
  UNION ALL SELECT 1, 'record', urn, max(digest) FROM ob GROUP BY urn UNION ALL SELECT DISTINCT 2, 'observation', urn, day FROM ob)""")
def c1(spark, sf):
    o = observations(spark, sf)
    return U.seed_journal(o.select("urn", F.col("digest").alias("data")).distinct(), o.groupBy("urn").agg(F.max("digest").alias("data")), o.select("urn", F.col("day").alias("data")).distinct()).select("seq", "operation", "urn", "data")


NEW_SQL = "nw AS (SELECT urn, CASE WHEN urn % 101 = 0 THEN 'X' ELSE kind END AS kind, chat FROM om WHERE urn % 97 <> 0)"


@query("c2_j11_capture_changes", with_sql(ORDERS_SQL, NEW_SQL) + """ SELECT coalesce(om.urn, nw.urn) AS urn, CASE WHEN nw.urn IS NULL THEN 'delete' ELSE 'update' END AS operation FROM om FULL JOIN nw ON om.urn = nw.urn WHERE nw.urn IS NULL OR om.kind <> nw.kind""")
def c2(spark, sf):
    m = order_messages(spark, sf).select("urn", "kind", "chat")
    new = m.where("urn % 97 != 0").withColumn("kind", F.when(F.col("urn") % 101 == 0, "X").otherwise(F.col("kind")))
    return U.capture_changes(m, new, ["urn"], ["kind", "chat"]).select("urn", "operation")


@query("c3_refreshes", with_sql(OBSERVATIONS_SQL) + """, i AS (SELECT day, digest, min(pos) AS lo, max(pos) AS hi FROM (SELECT day, digest, pos, pos - row_number() OVER (PARTITION BY day, digest ORDER BY pos) AS g FROM ob) GROUP BY day, digest, g)
  SELECT day, digest, count(*) AS ranges, min(lo) AS lo, max(hi) AS hi, 'observation_refresh' AS operation FROM i GROUP BY day, digest""")
def c3(spark, sf):
    o = observations(spark, sf).select("day", "digest", F.col("pos").alias("id"))
    out = U.refreshes(o, ["day", "digest"], "observation_refresh")
    return out.select("day", "digest", F.size("ranges").cast("long").alias("ranges"), F.element_at("ranges", 1)["lo"].alias("lo"), F.element_at("ranges", -1)["hi"].alias("hi"), "operation")


@query("c11_next_batch", with_sql(OBSERVATIONS_SQL) + """ SELECT seq, total FROM (SELECT pos AS seq, CAST(sum(strlen(digest)) OVER (ORDER BY pos) AS BIGINT) AS total FROM (SELECT * FROM ob WHERE pos > 500 ORDER BY pos LIMIT 400)) WHERE total <= 1500""")
def c11(spark, sf):
    j = observations(spark, sf).select(F.col("pos").alias("seq"), F.col("digest").alias("data"))
    return U.next_batch(j, 500, 400, 1500).select("seq", "total")


@query("c14_apply_changes", with_sql(OBSERVATIONS_SQL) + " SELECT pos AS seq, CASE WHEN pos % 3 = 0 THEN 'known' WHEN pos % 3 = 1 OR pos % 11 = 0 THEN 'rejected' ELSE 'new' END AS status FROM ob UNION ALL SELECT pos, CASE WHEN pos % 3 = 2 AND pos % 11 = 0 THEN 'rejected' ELSE 'known' END FROM ob WHERE (pos % 7 = 0 AND pos % 3 <> 1 AND pos % 11 <> 0) OR (pos % 11 = 0 AND pos % 3 = 2)")
def c14(spark, sf):
    o = observations(spark, sf).select(F.lit("p").alias("producer"), F.col("pos").alias("seq"), F.lit("record").alias("operation"), F.col("urn").cast("string").alias("urn"), F.col("digest").alias("data"))
    done = o.where("seq % 3 != 2").select("producer", "seq", F.sha2(F.concat_ws("\n", "operation", "urn", F.when(F.col("seq") % 3 == 0, F.col("data")).otherwise("other")), 256).alias("sha256"))
    again = o.where("seq % 7 = 0 and seq % 3 != 1 and seq % 11 != 0")
    other = o.where("seq % 11 = 0 and seq % 3 = 2").withColumn("data", F.lit("something else"))
    return U.apply_changes(o.union(again).union(other), done).select("seq", "status")


def operations(spark, sf):
    """Events of all operations, one for each row of the log, some of them broken."""
    o = observations(spark, sf).where("pos > 0")
    k, n = F.col("pos") % 14, F.col("pos")
    urn = F.concat(F.lit("urn:uuid:"), F.col("urn").cast("string"))
    digest = F.concat(F.lit("sha256:"), F.sha2("digest", 256))
    name = F.element_at(F.array(*map(F.lit, U.OPERATIONS)), (k % 7 + 1).cast("int"))
    broken = k >= 7
    body = F.struct(
        F.when(~broken | ~name.isin("entity_key", "observation"), n).alias("entity_id"), urn.alias("urn"), digest.alias("revision_digest"), F.when(~broken | (name != "record_refresh"), F.col("observed_at")).alias("observed_at"),
        F.struct(F.when(broken, "dragons").otherwise("messages").alias("entity"), urn.alias("urn"), digest.alias("revision_digest")).alias("record"), F.when(~broken | (name != "revision"), urn).alias("entity_urn"), n.alias("observation_id"), F.lit("s").alias("source"), F.lit("c").alias("account_scope"), F.lit("t").alias("native_table"),
        F.array(n.cast("string")).alias("native_row_ids"), F.lit("f").alias("fingerprint"), F.lit("1").alias("adapter_version"), F.lit(False).alias("minted"), F.when(~broken, "present").otherwise("?").alias("present"), F.array(F.array(n, n + F.when(broken, -1).otherwise(3))).alias("ranges"),
        F.when(~broken, F.struct(F.lit(1).alias("s"))).alias("scopes"), F.array().cast("array<string>").alias("scope_mappings"),
    )
    return o.select(F.lit("p").alias("producer"), n.alias("seq"), name.alias("operation"), urn.alias("urn"), F.to_json(body).alias("data"))


@query("c13_validate_events", with_sql(OBSERVATIONS_SQL) + """ SELECT pos AS seq, CASE pos % 14 WHEN 7 THEN 'no stable id' WHEN 8 THEN 'record of no known kind' WHEN 9 THEN 'revision without urn, digest or record' WHEN 10 THEN 'observation present unknown' WHEN 11 THEN 'refresh without time or ranges'
  WHEN 12 THEN 'bad ranges' WHEN 13 THEN 'identity without scopes and mappings' END AS problem FROM ob WHERE pos > 0 AND pos % 14 >= 7""")
def c13(spark, sf):
    return U.validate_events(operations(spark, sf))


@query("c15_replay_operations", with_sql(OBSERVATIONS_SQL) + """, r AS (SELECT urn, pos, row_number() OVER (PARTITION BY urn ORDER BY pos) AS n FROM ob), b AS (SELECT urn, min(pos) AS stop FROM r WHERE n > 1 AND pos % 13 = 0 GROUP BY urn),
  o AS (SELECT r.*, CASE WHEN n = 1 THEN 'inserted' WHEN b.stop IS NULL OR pos < b.stop THEN 'updated' ELSE 'conflict' END AS outcome FROM r LEFT JOIN b ON b.urn = r.urn)
  SELECT CAST(urn AS VARCHAR) AS urn, 'd' || max(pos) FILTER (outcome <> 'conflict') AS digest, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'conflict') AS conflicts FROM o GROUP BY urn""")
def c15_operations(spark, sf):
    o = observations(spark, sf)
    before = F.lag("pos").over(Window.partitionBy("urn").orderBy("pos"))
    digest = lambda c: F.concat(F.lit("d"), c.cast("string"))
    carried = o.withColumn("before", before)
    body = F.struct(F.struct(F.col("urn").cast("string").alias("urn"), digest(F.col("pos")).alias("revision_digest"), F.lit("messages").alias("entity")).alias("record"), F.when(F.col("pos") % 13 == 0, "dx").otherwise(digest(F.col("before"))).alias("previous_digest"), F.col("pos").alias("observed_at"))
    events = carried.select(F.lit("p").alias("producer"), F.col("pos").alias("seq"), F.lit("record").alias("operation"), F.to_json(body).alias("data"))
    out = feed.replay(events, feed.empty_store(spark), "p")
    told = out["outcomes"].groupBy("urn").agg(F.count_if(F.col("outcome") == "updated").alias("updated"), F.count_if(F.col("outcome") == "conflict").alias("conflicts"))
    return out["heads"].join(told, "urn").select("urn", "digest", "updated", "conflicts")


@query("c15_replay_heads", with_sql(OBSERVATIONS_SQL) + " SELECT urn, arg_max(digest, (observed_at, pos)) AS data, arg_max(pos, (observed_at, pos)) AS seq FROM ob GROUP BY urn")
def c15(spark, sf):
    o = observations(spark, sf).select("urn", F.col("pos").alias("seq"), F.col("digest").alias("data"), "observed_at", F.lit("record").alias("operation"), F.lit("new").alias("status"))
    return U.replay_heads(o).select("urn", "data", "seq")


@query("c16_bind_entities", with_sql(ORDERS_SQL) + " SELECT 'p' AS producer, chat % 500 AS id, count(DISTINCT chat) AS locals FROM om GROUP BY 2 HAVING count(DISTINCT chat) > 1")
def c16(spark, sf):
    m = order_messages(spark, sf).select(F.lit("p").alias("producer"), (F.col("chat") % 500).alias("id"), F.col("chat").alias("local"))
    return U.bind_entities(m.where("local % 2 = 0"), m.where("local % 2 = 1"))


@query("c19_c20_delivery", with_sql(OBSERVATIONS_SQL) + """, e AS (SELECT DISTINCT digest AS consumer, pos // 1000 * 1000 + 1000 AS through FROM ob) SELECT consumer, max(through) AS checkpoint, count(*) FILTER (through > 4000) AS pending FROM e GROUP BY consumer""")
def c19(spark, sf):
    e = observations(spark, sf).select(F.col("digest").alias("consumer"), (F.floor(F.col("pos") / 1000) * 1000 + 1000).alias("through")).distinct().withColumn("after", F.col("through") - 1000)
    done = U.advance_delivery(e, e.select("consumer", "through"))
    receipts = e.select("consumer", F.lit("d").alias("destination"), F.lit(4000).alias("checkpoint")).distinct()
    left = U.pending(e, receipts, "d").groupBy("consumer").agg(F.count("*").alias("pending"))
    return done.join(left, "consumer", "left").select("consumer", "checkpoint", F.coalesce("pending", F.lit(0)).alias("pending"))
