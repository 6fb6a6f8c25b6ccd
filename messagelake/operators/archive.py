"""Immutable monthly buckets: planning, membership, context, digests, revisions, validation, lineage, import, comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

UNDATED, CATALOGUE = "undated", "catalogue"


def assign_bucket(df: DataFrame, ms: str = "utc_ms") -> DataFrame:
    """Adds `bucket`, the UTC month or `undated`: all buckets in one pass."""
    return df.withColumn("bucket", S.month_label(ms))


def plan_buckets(messages: DataFrame, exported: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Labels to write: all months from the first to the last message in the range, `undated` if there are any, and
    what was written before in the range. exported: (bucket)."""
    rng = messages.agg(F.min("utc_ms").alias("lo"), F.max("utc_ms").alias("hi"), F.bool_or(F.col("utc_ms").isNull()).alias("undated"))
    lo = F.greatest("lo", F.lit(since)) if since is not None else F.col("lo")
    hi = F.least("hi", F.lit(until - 1)) if until is not None else F.col("hi")
    day = lambda c: F.date_trunc("month", F.timestamp_millis(c)).cast("date")
    rng = rng.withColumns({"lo": lo, "hi": hi})
    months = rng.where("lo <= hi").select(F.explode(F.sequence(day(F.col("lo")), day(F.col("hi")), F.expr("interval 1 month"))).alias("m")).select(F.date_format("m", "yyyy-MM").alias("bucket"))
    undated = rng.where("undated").select(F.lit(UNDATED).alias("bucket"))
    before = exported.select("bucket")
    if since is not None:
        before = before.where((F.col("bucket") == UNDATED) | (F.col("bucket") >= S.month_label(F.lit(since))))
    if until is not None:
        before = before.where((F.col("bucket") == UNDATED) | (F.col("bucket") <= S.month_label(F.lit(until - 1))))
    return months.union(undated).union(before).distinct()


def orphan_events(events: DataFrame, messages: DataFrame) -> DataFrame:
    """Events whose target is null or no message: they go by their own time."""
    lost = events.where("target_urn is null")
    return lost.unionByName(events.where("target_urn is not null").join(messages.select(F.col("urn").alias("target_urn")), "target_urn", "left_anti").select(*events.columns))


def dependants(children: DataFrame, messages: DataFrame, key: str = "message_urn") -> DataFrame:
    """Children with the bucket of their message."""
    return children.join(messages.select(F.col("urn").alias(key), "bucket"), key)


def context(messages: DataFrame, members: DataFrame, aliases: DataFrame) -> DataFrame:
    """(bucket, urn): chats, senders, members of the chats and both sides of their aliases, for each bucket."""
    chats = messages.select("bucket", F.col("chat_urn").alias("urn")).distinct()
    senders = messages.select("bucket", F.col("sender_urn").alias("urn")).distinct()
    people = members.select(F.col("chat_urn").alias("urn"), "identity_urn").join(chats, "urn").select("bucket", F.col("identity_urn").alias("urn"))
    base = senders.union(people).where("urn is not null").distinct()
    one = aliases.select(F.col("old_urn").alias("urn"), F.col("new_urn").alias("to")).union(aliases.select(F.col("new_urn").alias("urn"), F.col("old_urn").alias("to")))
    return chats.where("urn is not null").union(base).union(base.join(one, "urn").select("bucket", "to")).distinct()


def stubs(references: DataFrame, carried: DataFrame, heads: DataFrame) -> DataFrame:
    """(bucket, urn, kind) of what a bucket refers to and doesn't carry; `unknown` if no head is there."""
    lost = references.select("bucket", "urn").where("urn is not null").distinct().join(carried, ["bucket", "urn"], "left_anti")
    return lost.join(heads.select("urn", "kind"), "urn", "left").select("bucket", "urn", F.coalesce("kind", F.lit("unknown")).alias("kind"))


def set_digest(records: DataFrame, by: Sequence[str], letters: int = 3) -> DataFrame:
    """(*by, records, digest) of distinct (urn, digest) pairs, in any order.

    Two levels: pairs are dealt into parts by the first letters of the urn's SHA-256, each part's sorted pairs are hashed,
    and the part hashes, sorted by part, are hashed, so no group holds a whole bucket.
    """
    pairs = records.select(*by, "urn", "digest").distinct().withColumn("_part", F.substring(F.sha2(F.col("urn").cast("string"), 256), 1, letters))
    line = F.concat(F.col("urn").cast("string"), F.lit("\0"), F.col("digest").cast("string"))
    part = pairs.groupBy(*by, "_part").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "h"))), lambda x: x["h"]), "\n")
    return part.groupBy(*by).agg(F.sum("n").alias("records"), F.sha2(whole, 256).alias("digest"))


def flat_digest(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same over one level, for buckets that a task can hold and readers that expect it."""
    line = F.concat(F.col("urn").cast("string"), F.lit("\0"), F.col("digest").cast("string"))
    return records.groupBy(*by).agg(F.count_distinct("urn", "digest").alias("records"), F.sha2(F.concat(F.array_join(F.array_sort(F.collect_set(line)), "\n"), F.lit("\n")), 256).alias("digest"))


def revise(current: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """What to do with each bucket: unchanged, skipped_empty, or the next revision with what it supersedes.
    current: (bucket, records, digest); ledger: (bucket, revision, digest, export_id)."""
    last = ledger.groupBy("bucket").agg(F.max_by(F.struct("revision", F.col("digest").alias("old"), "export_id"), "revision").alias("l")).select("bucket", "l.*")
    t = current.join(last, "bucket", "full_outer").withColumn("records", F.coalesce("records", F.lit(0)))
    action = F.when((F.col("records") == 0) & F.col("revision").isNull(), "skipped_empty").when((F.col("digest") == F.col("old")) & F.lit(not force), "unchanged").otherwise("write")
    return t.select("bucket", "records", "digest", action.alias("action"), F.when(action == "write", F.coalesce("revision", F.lit(0)) + 1).otherwise(F.col("revision")).cast("int").alias("revision"), F.when(action == "write", F.col("export_id")).alias("supersedes"))


def observation_bounds(observations: DataFrame, by: Sequence[str]) -> DataFrame:
    return observations.groupBy(*by).agg(F.min("observed_at").alias("first"), F.max("observed_at").alias("last"), F.sort_array(F.collect_set("sync_run")).alias("runs"))


def media_counts(attachments: DataFrame, by: Sequence[str]) -> DataFrame:
    return attachments.groupBy(*by).agg(*(F.count_if(F.col("availability") == s).alias(s) for s in ("available", "missing", "not_downloaded")), F.when(F.bool_or(F.col("availability") != "available"), "partial").otherwise("complete").alias("status"))


# --- validation


def problems(df: DataFrame, rules: Sequence[tuple[str, Column]], key: Sequence[str]) -> DataFrame:
    """(*key, problems) of rows that break a rule; a rule is a message and the condition that breaks it."""
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for m, c in rules)), lambda x: x.isNotNull())
    return df.select(*key, found.alias("problems")).where(F.size("problems") > 0)


def check_manifests(manifests: DataFrame) -> DataFrame:
    """Rules for many manifests at once. manifests: (archive_id, kind, label, revision, lineage, supersedes, counts, content_digest)."""
    c = F.col
    rules = [
        ("bad archive id", ~S.is_urn("archive_id")), ("unknown kind", ~c("kind").isin("bucket", "catalogue", "feed") | c("kind").isNull()), ("bad revision", c("revision").isNull() | (c("revision") < 1)),
        ("bad label", (c("kind") == "bucket") & ~c("label").rlike(r"^(\d{4}-(0[1-9]|1[0-2])|undated|\d{4}-\d\d-\d\d\.\.\d{4}-\d\d-\d\d)$")), ("bad digest", ~S.is_digest("content_digest")),
        ("lineage doesn't reach the revision", F.size("lineage") != c("revision")), ("lineage ends elsewhere", F.element_at("lineage", -1) != c("archive_id")), ("first revision supersedes one", (c("revision") == 1) & c("supersedes").isNotNull()),
        ("supersedes another than its predecessor", (c("revision") > 1) & ~c("supersedes").eqNullSafe(F.try_element_at("lineage", F.lit(-2)))), ("negative count", F.exists(F.map_values("counts"), lambda v: v < 0)),
    ]
    return problems(manifests, rules, ["archive_id"])


def check_rows(records: DataFrame, schema: dict[str, str], raw: str = "raw") -> DataFrame:
    """(raw digest, problems): JSON records against a closed schema of field names and Spark types (`?` for optional).
    Equal bodies are checked once."""
    once = records.select(F.col(raw).alias("raw")).distinct().withColumn("sha256", F.sha2("raw", 256))
    fields = ",".join(f"`{k}` {t.rstrip('?')}" for k, t in schema.items())
    t = once.withColumn("j", F.from_json("raw", fields)).withColumn("keys", F.json_object_keys("raw"))
    rules = [("not an object", F.col("keys").isNull()), ("unknown field", F.size(F.array_except("keys", F.array(*map(F.lit, schema)))) > 0)]
    rules += [(f"missing {k}", F.col("j")[k].isNull()) for k, kind in schema.items() if not kind.endswith("?")]
    return problems(t, rules, ["sha256"])


def check_digests(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(urn) of records whose stored digest isn't that of their fields."""
    return records.where(F.col("revision_digest") != S.revision_digest({f: F.col(f) for f in fields})).select("urn")


def check_counts(manifest_counts: DataFrame, members: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, expected, found) where a manifest's count differs from the rows there."""
    found = members.groupBy(*by).agg(F.count("*").alias("found"))
    t = manifest_counts.join(found, list(by), "full_outer")
    return t.select(*by, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found")).where("expected != found")


# --- import


def lineage(manifests: DataFrame, imports: DataFrame, accepted: DataFrame) -> DataFrame:
    """(archive_id, decision): already_imported, superseded (a later revision is there), branch_conflict (the last import
    isn't in its lineage), or proceed. imports: (label, archive_id, revision, lineage); accepted: (archive_id)."""
    last = imports.groupBy("label").agg(F.max_by(F.struct(F.col("archive_id").alias("i_id"), F.col("revision").alias("i_rev"), F.col("lineage").alias("i_lineage")), "revision").alias("l")).select("label", "l.*")
    done = imports.select("archive_id", F.lit(True).alias("done")).distinct()
    ok = accepted.select("archive_id", F.lit(True).alias("ok")).distinct()
    t = manifests.join(done, "archive_id", "left").join(ok, "archive_id", "left").join(last, "label", "left")
    decision = (
        F.when(F.col("done"), "already_imported").when(F.col("i_id").isNull() | F.coalesce("ok", F.lit(False)), "proceed").when(F.array_contains("i_lineage", F.col("archive_id")), "superseded")
        .when(F.array_contains("lineage", F.col("i_id")), "proceed").otherwise("branch_conflict")
    )
    return t.select("archive_id", decision.alias("decision"))


def _import_order() -> list[Column]:
    return [F.col("kind") != CATALOGUE, F.col("label"), F.col("revision"), F.col("archive_id")]


def order_archives(manifests: DataFrame) -> DataFrame:
    """The order of imports: the catalogue first, then by label, revision and id."""
    return manifests.orderBy(*_import_order())


def until_conflict(decisions: DataFrame) -> DataFrame:
    """Decisions (archive_id, kind, label, revision, decision) of an import that stops at its first branch conflict: what comes
    later in the order of imports is `not_reached`."""
    t = decisions.withColumn("_at", F.struct(*(c.alias(f"k{k}") for k, c in enumerate(_import_order()))))
    first = t.where("decision = 'branch_conflict'").agg(F.min("_at").alias("_first"))  # one row
    later = F.coalesce(F.col("_at") > F.col("_first"), F.lit(False))
    return t.crossJoin(F.broadcast(first)).withColumn("decision", F.when(later, "not_reached").otherwise(F.col("decision"))).drop("_at", "_first")


def adopt(manifests: DataFrame, scopes: DataFrame, mappings: DataFrame, export_set: DataFrame) -> dict[str, DataFrame]:
    """What a store knows of scopes, mappings and its export set after manifests. A source without a scope takes that of the
    earliest manifest that has one, a mapping is added once, and the set is taken only where there is none; so manifests
    may come again. manifests: (export_id, export_set, created_at, account_scopes of (source, scope, label), scope_mappings
    of (from, to)); scopes: (source, scope, created_at, label, origin); mappings: (from, to); export_set: at most a row."""
    m = manifests.select("export_id", "export_set", "created_at", "account_scopes", "scope_mappings")
    s = m.select("created_at", "export_id", F.posexplode("account_scopes").alias("_place", "s")).select("s.*", "created_at", "export_id", "_place")
    first = s.groupBy("source").agg(F.min_by(F.struct("scope", "created_at", "label", F.concat(F.lit("import:"), "export_id").alias("origin")), F.struct("created_at", "export_id", "_place")).alias("n"))
    new = first.select("source", "n.*").join(scopes.select("source"), "source", "left_anti")
    told = m.select(F.explode("scope_mappings").alias("p")).select("p.from", "p.to").distinct()
    one = m.where("export_set is not null").groupBy().agg(F.min_by("export_set", F.struct("created_at", "export_id")).alias("export_set")).where("export_set is not null")
    held = export_set.agg(F.max("export_set").alias("_held"))  # one row
    chosen = one.crossJoin(F.broadcast(held)).where("_held is null").select("export_set")
    return {"scopes": scopes.unionByName(new.select(*scopes.columns)), "mappings": mappings.select("from", "to").unionByName(told.join(mappings.select("from", "to"), ["from", "to"], "left_anti")), "export_set": export_set.select("export_set").unionByName(chosen)}


def retire(old: DataFrame, new: DataFrame, elsewhere: DataFrame) -> DataFrame:
    """(urn) of records that a superseded revision carried and neither the new one nor another bucket does."""
    return old.select("urn").distinct().join(new.select("urn"), "urn", "left_anti").join(elsewhere.select("urn"), "urn", "left_anti")


def blobs_to_restore(carried: DataFrame, present: DataFrame) -> DataFrame:
    return carried.dropDuplicates(["sha256"]).join(present.select("sha256"), "sha256", "left_anti")


def unresolved(references: DataFrame, heads: DataFrame) -> DataFrame:
    """(urn, uses) of what is referred to and not there."""
    return references.where("urn is not null").join(heads.select("urn"), "urn", "left_anti").groupBy("urn").agg(F.count("*").alias("uses"))


def compare_stores(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: pairs (urn, digest) in both, in one alone, and urns whose digests differ."""
    one = a.select("urn", F.col("digest").alias("a"))
    two = b.select("urn", F.col("digest").alias("b"))
    t = one.join(two, "urn", "full_outer")
    return t.agg(F.count_if(F.col("a") == F.col("b")).alias("equal"), F.count_if(F.col("a") != F.col("b")).alias("different"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


def import_summary(decisions: DataFrame) -> DataFrame:
    """(decision, n, severity), the gravest first."""
    severity = F.when(F.col("decision") == "branch_conflict", 0).when(F.col("decision") == "superseded", 1).otherwise(2)
    return decisions.groupBy("decision").agg(F.count("*").alias("n")).withColumn("severity", severity).orderBy("severity", "decision")


def bucket_members(records: DataFrame, export_id: str) -> DataFrame:
    return records.select(F.lit(export_id).alias("export_id"), "urn").distinct()


def newest_first(ledger: DataFrame) -> DataFrame:
    """The ledger with each bucket's place from its last revision."""
    return ledger.withColumn("age", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("revision"))) - 1)


# The kinds in the order in which an import applies them, those that a bucket owns, those of the catalogue.
ENTITY_ORDER = ("accounts", "identities", "aliases", "chats", "chat_memberships", "messages", "message_parts", "attachments", "events", "people", "identity_links", "sync_runs")
BUCKETED = ("messages", "message_parts", "events", "attachments")
CATALOGUED = ("accounts", "identities", "aliases", "chats", "chat_memberships", "people", "identity_links", "sync_runs")


def provenance(carried: DataFrame, revisions: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(revisions, observations, runs) of the urns that buckets carry: (bucket, ...) rows, and (bucket, sync_run) of the runs
    that either names. carried: (bucket, urn); both tables have urn and sync_run."""
    own = carried.select("bucket", "urn").distinct()
    r, o = own.join(revisions, "urn"), own.join(observations, "urn")
    runs = r.select("bucket", "sync_run").union(o.select("bucket", "sync_run")).where("sync_run is not null").distinct()
    return r, o, runs


def catalogue(records: DataFrame) -> DataFrame:
    """The records that no bucket owns, as the bucket `catalogue`. records: (urn, kind, ...)."""
    return records.where(F.col("kind").isin(*CATALOGUED)).withColumn("bucket", F.lit(CATALOGUE))


def member_digest(members: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, members, digest): SHA-256 over the lines name, zero byte, checksum of an archive's members (name, sha256) in the
    order of their names; a few names for each archive."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda m: F.concat(m["name"], F.lit("\0"), m["sha256"], F.lit("\n")))
    return members.groupBy(*by).agg(F.count("*").alias("members"), F.sha2(F.array_join(lines, ""), 256).alias("digest"))


def check_observations(observations: DataFrame, raw: str = "raw") -> DataFrame:
    """(sha256, problem) of observations in JSON that lack a field, have one of another type, or an unknown state; equal
    bodies are checked once."""
    from .schemas import let
    from .store import observation_problem

    once = observations.select(F.col(raw).alias("raw")).distinct()
    problem = let(F.try_parse_json("raw"), lambda v: F.when(v.isNull(), "no JSON").otherwise(observation_problem(v)))
    # a filter on the problem would work it out twice
    return once.select(F.sha2("raw", 256).alias("sha256"), F.explode(F.filter(F.array(problem), lambda x: x.isNotNull())).alias("problem"))


def check_types(records: DataFrame, schema: dict[str, str], enums: dict[str, Sequence[str]] | None = None, patterns: dict[str, str] | None = None, raw: str = "raw") -> DataFrame:
    """(sha256, problems): JSON records against the JSON types of their fields (`?` for optional, a field may then be null),
    the values that a field may have and the patterns that it must match. Equal bodies are checked once."""
    once = records.select(F.col(raw).alias("raw")).distinct().withColumn("sha256", F.sha2("raw", 256)).withColumn("v", F.try_parse_json("raw"))
    kind = lambda k: F.substring_index(F.schema_of_variant(F.try_variant_get(F.col("v"), f"$.{k}", "variant")), "<", 1)
    text = lambda k: F.try_variant_get(F.col("v"), f"$.{k}", "string")
    rules = [("no JSON", F.col("v").isNull())]
    for k, t in schema.items():
        there = F.coalesce(kind(k), F.lit("VOID"))
        rules.append((f"{k} is no {t.rstrip('?').lower()}", F.col("v").isNotNull() & (there != t.rstrip("?")) & (there != "VOID" if t.endswith("?") else F.lit(True))))
    rules += [(f"{k} has no such value", text(k).isNotNull() & ~text(k).isin(*values)) for k, values in (enums or {}).items()]
    rules += [(f"{k} has no such form", text(k).isNotNull() & ~text(k).rlike(p)) for k, p in (patterns or {}).items()]
    return problems(once, rules, ["sha256"])


#: What a retired record says, and the fields that belong to a sighting and not to the record.
RETIRED, SIGHTED = "retired_by_archive_revision", ("observed_at", "sync_run", "iso", "revision_digest")


def tombstoned_record(record: Column, export_id: str) -> Column:
    """A record in JSON with its tombstone, its fields in the order of their names."""
    fields = F.parse_json(record).cast("map<string,variant>")
    names = F.array_sort(F.array_union(F.array_except(F.map_keys(fields), F.array(*map(F.lit, SIGHTED))), F.array(F.lit("tombstone"))))
    tombstone = F.parse_json(F.to_json(F.struct(F.lit(export_id).alias("export_id"), F.lit(RETIRED).alias("reason"))))
    return F.to_json(F.map_from_arrays(names, F.transform(names, lambda k: F.when(k == "tombstone", tombstone).otherwise(F.try_element_at(fields, k)))))


def import_bucket(archive: dict[str, DataFrame], stored: dict[str, DataFrame], export_id: str, created_at: int, supersedes: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The tables after a bucket's import, in its order: revisions, which tell whose heads may give way; heads; observations;
    then what superseded exports carried and this one doesn't is stored with a tombstone, as a revision of its own that
    becomes the head; then the ledgers of members and of imports, in which superseded ones name what superseded them.

    archive: records (urn, kind, digest, observed_at, record in JSON), revisions (urn, digest, observed_at), observations,
    manifest (label, revision, lineage) of one row. stored: heads (urn, digest, observed_at, tombstoned, record), revisions,
    observations, members (export_id, urn), imports (export_id, label, revision, lineage, imported_at, superseded_by). Also
    gives `outcomes` and `retired`.
    """
    from . import store

    records = archive["records"].withColumn("observed_at", F.coalesce("observed_at", F.lit(created_at)))
    heads = stored["heads"]
    after, outcomes = store.upsert_import(records, heads.select("urn", "digest", "observed_at"), archive["revisions"].select("urn", "digest"))
    members = bucket_members(records.where(F.col("kind").isin(*BUCKETED)), export_id)
    old = stored["members"].where(F.col("export_id").isin(*supersedes)).select("urn").distinct() if supersedes else stored["members"].select("urn").limit(0)
    gone = old.join(members, "urn", "left_anti").select("urn", F.lit(True).alias("_gone"))
    before = heads.select("urn", F.coalesce("tombstoned", F.lit(False)).alias("_t"), F.col("record").alias("_r"))
    now = after.join(before, "urn", "left").join(outcomes, "urn", "left").join(records.select("urn", F.col("record").alias("_n")), "urn", "left").join(gone, "urn", "left")
    taken = F.coalesce(F.col("outcome").isin("inserted", "updated"), F.lit(False))
    now = now.withColumns({"record": F.when(taken, F.col("_n")).otherwise(F.col("_r")), "_t": F.coalesce("_t", F.lit(False)) & ~taken})
    dead = F.coalesce("_gone", F.lit(False)) & ~F.col("_t") & F.col("record").isNotNull()
    now = now.withColumn("_dead", dead).withColumn("record", F.when(dead, tombstoned_record(F.col("record"), export_id)).otherwise(F.col("record")))
    now = now.select("urn", F.when(F.col("_dead"), F.concat(F.lit("sha256:"), F.sha2("record", 256))).otherwise(F.col("digest")).alias("digest"), F.when(F.col("_dead"), F.lit(created_at)).otherwise(F.col("observed_at")).alias("observed_at"), (F.col("_dead") | F.col("_t")).alias("tombstoned"), "record", "_dead")
    retired = now.where("_dead").select("urn", "digest", "observed_at")
    batch = archive["revisions"].unionByName(records.select("urn", "digest", "observed_at")).unionByName(retired)
    entry = archive["manifest"].select(F.lit(export_id).alias("export_id"), "label", "revision", "lineage", F.lit(created_at).cast("long").alias("imported_at"), F.lit(None).cast("string").alias("superseded_by"))
    done = stored["imports"].withColumn("superseded_by", F.when(F.col("export_id").isin(*supersedes), F.lit(export_id)).otherwise(F.col("superseded_by")))
    return {
        "heads": now.drop("_dead"), "outcomes": outcomes, "revisions": store.append_revisions(stored["revisions"], batch), "observations": store.observe_merge(archive["observations"], stored["observations"]),
        "members": stored["members"].select("export_id", "urn").unionByName(members).distinct(), "imports": done.unionByName(entry), "retired": retired.select("urn"),
    }
