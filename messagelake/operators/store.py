"""Heads, revisions, observations: upserts with history, change capture, an ordered journal and its exact replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals
from .schemas import let

# The operations of the journal, the kinds of records, the fields of an observation with their JSON types,
# and the states in which a row can be.
OPERATIONS = ("entity_key", "record", "revision", "observation", "record_refresh", "observation_refresh", "identity_metadata")
KINDS = ("accounts", "identities", "aliases", "chats", "chat_memberships", "messages", "message_parts", "attachments", "events", "people", "identity_links", "sync_runs")
OBSERVATION = {
    "entity_urn": "STRING", "source": "STRING", "account_scope": "STRING", "native_table": "STRING", "native_row_ids": "ARRAY",
    "fingerprint": "STRING", "adapter_version": "STRING", "observed_at": "BIGINT", "minted": "BOOLEAN", "present": "STRING",
}
PRESENT = ("present", "absent_from_source", "deleted_evidence")


def hashed(df: DataFrame, *columns: str) -> DataFrame:
    """Adds `_h`, a hash of columns, to be the first key of a join or group by them: urns begin alike, so a sort by them alone
    compares whole texts at each step."""
    return df.withColumn("_h", F.xxhash64(*columns))


def digest_changes(batch: DataFrame, heads: DataFrame) -> DataFrame:
    """Adds `previous`, the digest before each row of a batch: that of the row before in the batch, else of the head.
    batch: (urn, digest, pos); heads: (urn, digest)."""
    order = Window.partitionBy("urn").orderBy("pos")
    stored = heads.select("urn", F.col("digest").alias("_head"))
    joined = batch.join(stored, "urn", "left")
    return joined.withColumn("previous", F.coalesce(F.lag("digest").over(order), F.col("_head"))).drop("_head")


def upsert_live(batch: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads after, outcomes): the last row of a batch becomes the head, whatever its time.
    batch: (urn, digest, observed_at, pos); heads: (urn, digest, observed_at)."""
    seen = digest_changes(batch, heads)
    outcome = F.when(F.col("previous").isNull(), "inserted").when(F.col("previous") == F.col("digest"), "unchanged").otherwise("updated")
    outcomes = seen.select("urn", "pos", outcome.alias("outcome"))
    last = batch.groupBy("urn").agg(F.max_by(F.struct("digest", "observed_at"), "pos").alias("n"))
    merged = heads.join(last, "urn", "full_outer")
    after = merged.select("urn", F.coalesce("n.digest", "digest").alias("digest"), F.coalesce("n.observed_at", "observed_at").alias("observed_at"))
    return after, outcomes


def upsert_import(batch: DataFrame, heads: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads after, outcomes) of imported records, one per urn: a head whose digest the lineage knows gives way to a
    record that isn't older; a record of a known digest that is older stays `older`; anything else is a `conflict`.
    prior: (urn, digest) that the lineage has carried."""
    stored = heads.select("urn", F.col("digest").alias("h_digest"), F.col("observed_at").alias("h_at"))
    known = prior.select("urn", F.col("digest").alias("h_digest"), F.lit(True).alias("known")).distinct()
    seen = batch.join(stored, "urn", "left").join(known, ["urn", "h_digest"], "left")
    outcome = (
        F.when(F.col("h_digest").isNull(), "inserted").when(F.col("h_digest") == F.col("digest"), "unchanged")
        .when(F.col("known") & (F.col("observed_at") >= F.col("h_at")), "updated").when(F.col("known"), "older").otherwise("conflict")
    )
    seen = seen.withColumn("outcome", outcome)
    taken = seen.where(F.col("outcome").isin("inserted", "updated")).select("urn", F.struct("digest", "observed_at").alias("n"))
    same = seen.where("outcome = 'unchanged'").select("urn", F.greatest("observed_at", "h_at").alias("at"))
    merged = heads.join(taken, "urn", "full_outer").join(same, "urn", "left")
    after = merged.select("urn", F.coalesce("n.digest", "digest").alias("digest"), F.coalesce("n.observed_at", "at", "observed_at").alias("observed_at"))
    return after, seen.select("urn", "outcome")


def _merged(table, batch: DataFrame, upsert, consumer: str | None, number: int | None) -> DataFrame:
    from ..plans.state import kept

    batch = kept(batch)
    stored = kept(table.read(buckets=table.touched(batch)).join(batch.select("urn").distinct(), "urn", "left_semi").select("urn", "digest", "observed_at"))
    after, outcomes = upsert(batch, stored)
    outcomes = kept(outcomes)
    moved = after.join(stored.select("urn", F.struct("digest", "observed_at").alias("_was")), "urn", "left").where(~F.struct("digest", "observed_at").eqNullSafe(F.col("_was")))
    table.merge(moved.select("urn", "digest", "observed_at"), None, consumer, number)
    return outcomes


def merge_live(table, batch: DataFrame, consumer: str | None = None, number: int | None = None) -> DataFrame:
    """upsert_live into a MergeTable of heads (urn, digest, observed_at): reads the buckets of the batch, writes the heads that
    moved. Returns the outcomes."""
    return _merged(table, batch.select("urn", "digest", "observed_at", "pos"), upsert_live, consumer, number)


def merge_import(table, batch: DataFrame, prior: DataFrame, consumer: str | None = None, number: int | None = None) -> DataFrame:
    """upsert_import into a MergeTable of heads, in the same way."""
    return _merged(table, batch.select("urn", "digest", "observed_at"), lambda b, h: upsert_import(b, h, prior), consumer, number)


def append_revisions(revisions: DataFrame, batch: DataFrame) -> DataFrame:
    """Revisions with the digests of a batch: new ones are added; one that became the head again moves to the newer
    time only if it was strictly older. (urn, digest, observed_at), one row for each urn and digest."""
    new = batch.groupBy("urn", "digest").agg(F.max("observed_at").alias("n_at"))
    merged = hashed(revisions, "urn", "digest").join(hashed(new, "urn", "digest"), ["_h", "urn", "digest"], "full_outer")
    return merged.select("urn", "digest", F.when(F.col("observed_at").isNull() | (F.col("observed_at") < F.col("n_at")), F.col("n_at")).otherwise(F.col("observed_at")).alias("observed_at"))


def set_head(heads: DataFrame, revisions: DataFrame, chosen: DataFrame, at: int) -> DataFrame:
    """Makes stored revisions (urn, digest) the heads; a digest that isn't stored changes nothing."""
    stored = chosen.join(revisions.select("urn", "digest"), ["urn", "digest"], "left_semi").select("urn", F.col("digest").alias("_d"))
    return heads.join(stored, "urn", "left").select("urn", F.coalesce("_d", "digest").alias("digest"), F.when(F.col("_d").isNotNull(), F.lit(at)).otherwise(F.col("observed_at")).alias("observed_at"))


def current_heads(heads: DataFrame, fresh: DataFrame) -> DataFrame:
    """Heads with their effective time: a later sighting of the id's interval counts. heads: (kind, id, digest, observed_at)."""
    seen = intervals.asof_interval(heads, fresh, ["kind"], "id", ["at"])
    return seen.withColumn("observed_at", F.greatest("observed_at", "at")).drop("at")


# What an observation says, and what it is about.
EVIDENCE = ("native_row_ids", "native_key", "minted", "fingerprint", "adapter_version", "present")
OBSERVED = ("urn", "source", "scope", "native_table")


def observe_live(batch: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations after, those written): evidence is written only where it differs, null-safe; times always move on."""
    s = stored.select(*OBSERVED, F.struct(*EVIDENCE).alias("s_e"), F.col("observed_at").alias("s_at"))
    b = batch.select(*OBSERVED, F.struct(*EVIDENCE).alias("b_e"), F.col("observed_at").alias("b_at"))
    both = s.join(b, list(OBSERVED), "full_outer")
    changed = F.col("b_e").isNotNull() & ~F.col("b_e").eqNullSafe(F.col("s_e"))
    after = both.select(*OBSERVED, F.coalesce("b_e", "s_e").alias("e"), F.coalesce("b_at", "s_at").alias("observed_at")).select(*OBSERVED, "e.*", "observed_at")
    return after, both.where(changed).select(*OBSERVED)


def observe_merge(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Observations after an import: of two the newer counts, the imported one if as new."""
    s = stored.select(*OBSERVED, F.struct("observed_at", F.lit(0).alias("r"), F.struct(*EVIDENCE).alias("e")).alias("x"))
    b = batch.select(*OBSERVED, F.struct("observed_at", F.lit(1).alias("r"), F.struct(*EVIDENCE).alias("e")).alias("x"))
    best = hashed(s.unionByName(b), *OBSERVED).groupBy("_h", *OBSERVED).agg(F.max_by("x", F.struct("x.observed_at", "x.r")).alias("x"))
    return best.select(*OBSERVED, "x.e.*", "x.observed_at")


def mark_absent(stored: DataFrame, scanned: Sequence[str], started: int) -> DataFrame:
    """Present observations of fully scanned tables that this run didn't see."""
    gone = F.col("native_table").isin(*scanned) & (F.col("present") == "present") & (F.col("observed_at") < started)
    return stored.withColumn("present", F.when(gone, "absent_from_source").otherwise(F.col("present")))


def open_conflicts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.col("resolved_at").isNull().alias("open")).count()


def epochs(changes: DataFrame) -> DataFrame:
    """(source, scope, epoch): how many changes of content there were; refreshes and run rows don't count."""
    semantic = ~F.col("operation").isin("record_refresh", "observation_refresh", "identity_metadata") & (F.col("kind") != "sync_runs")
    return changes.where(semantic).groupBy("source", "scope").agg(F.count("*").alias("epoch"))


def count_delta(counts: DataFrame, changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts brought up to date by old and new images: +1 for a new one, -1 for an old one. changes: (*by, sign)."""
    both = counts.select(*by, "n").unionByName(changes.select(*by, F.col("sign").cast("long").alias("n")))
    return both.groupBy(*by).agg(F.sum("n").alias("n")).where("n != 0")


# --- the journal


def sequenced(events: DataFrame, order: Sequence[str], first: int = 1) -> DataFrame:
    """Adds `seq` without gaps in an order: sorted by ranges, each range offset by the counts of those before."""
    from ..plans.state import stored

    events = stored(events)  # a sort by ranges first takes a sample, for which it would work out all rows once more
    placed = stored(events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_p", 33))
    counts = placed.groupBy("_range").agg(F.min("_p").alias("_low"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", "_low", before.alias("_before"))  # a row for each partition
    return placed.join(F.broadcast(starts), "_range").withColumn("seq", F.col("_p") - F.col("_low") + F.col("_before") + first).drop("_p", "_range", "_low", "_before")


def capture_changes(old: DataFrame, new: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(key, operation, previous, current): `record` rows where a value differs, null-safe, between two tables."""
    o = old.select(*key, F.struct(*values).alias("previous"))
    n = new.select(*key, F.struct(*values).alias("current"))
    both = o.join(n, list(key), "full_outer").where(~F.col("previous").eqNullSafe(F.col("current")))
    operation = F.when(F.col("previous").isNull(), "insert").when(F.col("current").isNull(), "delete").otherwise("update")
    return both.select(*key, operation.alias("operation"), F.to_json("previous").alias("previous"), F.to_json("current").alias("current"))


def seed_journal(revisions: DataFrame, heads: DataFrame, observations: DataFrame) -> DataFrame:
    """The first events: all revisions, then heads, then observations, each by urn. Tables: (urn, data)."""
    parts = [t.select(F.lit(k).alias("rank"), F.lit(op).alias("operation"), "urn", "data") for k, (op, t) in enumerate((("revision", revisions), ("record", heads), ("observation", observations)))]
    return sequenced(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["rank", "urn", "data"]).drop("rank")


def refreshes(sightings: DataFrame, by: Sequence[str], operation: str) -> DataFrame:
    """Sighted ids as one event for each group, with their ranges in order."""
    ranges = intervals.islands(sightings, by)
    return ranges.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges")).withColumn("operation", F.lit(operation))


def next_batch(journal: DataFrame, after: int, limit: int, max_bytes: int) -> DataFrame:
    """The first events after a cursor: at most so many, and so many bytes; a first event that is larger is an error.

    Only the bounded candidates meet in one window.
    """
    first = journal.where(F.col("seq") > after).orderBy("seq").limit(limit).withColumn("size", F.octet_length("data"))
    total = F.sum("size").over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    out = first.withColumn("total", total)
    return out.where((F.col("total") <= max_bytes) | F.when((F.col("total") == F.col("size")) & (F.col("size") > max_bytes), F.raise_error(F.lit("an event is larger than a batch")).isNull()).otherwise(False))


def _kind_of(v: Column, path: str) -> Column:
    """The JSON type at a path: BIGINT, STRING, BOOLEAN, ARRAY, OBJECT, VOID; null where there is nothing."""
    return F.substring_index(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "<", 1)


def observation_problem(v: Column, at: str = "$") -> Column:
    """What is wrong with an observation in JSON; null if nothing is."""
    get = lambda k: F.try_variant_get(v, f"{at}.{k}", "string")
    found = F.lit(None).cast("string")
    maybe = lambda k: F.coalesce(_kind_of(v, f"{at}.{k}"), F.lit("VOID")).isin("STRING", "VOID")
    rules = [(f"observation field {k} missing or no {t.lower()}", ~F.coalesce(_kind_of(v, f"{at}.{k}"), F.lit("")).eqNullSafe(t)) for k, t in OBSERVATION.items()]
    rules += [("observation present unknown", ~get("present").isin(*PRESENT)), ("observation native_key is no string", ~maybe("native_key")), ("observation sync_run is no string", ~maybe("sync_run")), ("observation entity_urn is no urn", ~get("entity_urn").startswith("urn:uuid:"))]
    for message, broken in reversed(rules):
        found = F.when(broken, message).otherwise(found)
    return found


def _plain_forms() -> dict[str, str]:
    """Patterns of events, by operation, as capture_events and feed.key_events write them, where texts are of plain ASCII, a record
    has no nested object and row ids are few (repeated groups take stack). What matches is valid by all rules, if it is JSON at all; only a record within leaves that open."""
    plain, number, positive, digest = r"[ !#-\[\]-~]*", r"(?:0|-?[1-9][0-9]{0,17})", r"[1-9][0-9]{0,17}", r'"sha256:[0-9a-f]{64}"'
    text, urn, record = rf'"{plain}"', rf'"urn:uuid:{plain}"', r"\{[ -\[\]-z|~]*\}"
    known = rf'(?=\{{[^{{}}]*?"entity":"(?:{"|".join(KINDS)})")'  # a field, as texts hold no quote
    maybe = lambda name, kind: rf'(?:,"{name}":{kind})?'
    forms = {
        "revision": rf'"entity_urn":{urn},"revision_digest":{digest},"observed_at":{number}{maybe("sync_run", text)}{maybe("supersedes", text)},"record":{record}',
        "record": rf'"entity_id":{positive},"record":{known}{record},"observed_at":{number}{maybe("sync_run", text)}{maybe("previous_digest", digest)}',
        "observation": rf'"observation_id":{positive},"entity_urn":{urn},"source":{text},"account_scope":{text},"native_table":{text},"native_row_ids":\[(?:{text}(?:,{text}){{0,50}})?\]{maybe("native_key", text)},"minted":(?:true|false),"fingerprint":{text},"adapter_version":{text},"present":"(?:{"|".join(PRESENT)})","observed_at":{number}{maybe("sync_run", text)}',
        "entity_key": rf'"entity_id":{positive},"urn":{urn},"revision_digest":{digest}{maybe("observed_at", number)}',
    }
    return {op: rf"\A\{{{form}\}}\z" for op, form in forms.items()}


def event_problem(seq: Column, op: Column, data: Column) -> Column:
    """What is wrong with an event by the rules of its operation on its JSON data, which is parsed once; null if nothing is.
    Of data in a plain form it only matters whether it is JSON, and where the form says so it isn't parsed."""
    plain = F.lit(False)
    for name, form in _plain_forms().items():
        plain = F.when(op == name, data.rlike(form)).otherwise(plain)
    plain = F.coalesce((seq >= 1) & (F.octet_length(data) < 1 << 20) & plain, F.lit(False))
    whole = ~op.isin("record", "revision")
    parsed = lambda p, v: F.when(~(p & (whole | v.isNotNull())), parsed_event_problem(seq, op, data, v))
    return let(plain, lambda p: let(F.when(~(p & whole), F.try_parse_json(data)), lambda v: parsed(p, v)))


def parsed_event_problem(seq: Column, op: Column, data: Column, v: Column) -> Column:
    """The same where the data is parsed already."""
    kind = lambda path: F.coalesce(_kind_of(v, path), F.lit("VOID"))
    text = lambda path: F.try_variant_get(v, path, "string")
    number = lambda path: F.try_variant_get(v, path, "long")
    is_op = lambda *names: F.coalesce(op.isin(*names), F.lit(False))
    positive = lambda path: (kind(path) == "BIGINT") & (number(path) >= 1)
    digest = lambda path: F.coalesce(text(path).rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))
    keyed = is_op("entity_key") | (is_op("record") & _kind_of(v, "$.entity_id").isNotNull())
    spans = F.from_json(F.get_json_object(data, "$.ranges"), "array<array<bigint>>")
    wrong = F.exists(spans, lambda x: x.isNull() | (F.size(x) != 2) | F.coalesce((x[0] < 1) | (x[0] > x[1]), F.lit(True)))
    rules = [
        ("bad sequence", seq.isNull() | (seq < 1)), ("data is no object", kind("$") != "OBJECT"), ("sync_run is no string", ~kind("$.sync_run").isin("STRING", "VOID")),
        ("unknown operation", ~is_op(*OPERATIONS)), ("no stable id", keyed & ~positive("$.entity_id")),
        ("entity key without urn or digest", is_op("entity_key") & ~(F.coalesce(text("$.urn").startswith("urn:uuid:"), F.lit(False)) & digest("$.revision_digest"))),
        ("entity key time is no number", is_op("entity_key") & _kind_of(v, "$.observed_at").isNotNull() & (kind("$.observed_at") != "BIGINT")),
        ("identity without scopes and mappings", is_op("identity_metadata") & ~((kind("$.scopes") == "OBJECT") & (kind("$.scope_mappings") == "ARRAY"))),
        ("revision without urn, digest or record", is_op("revision") & ~(F.coalesce(text("$.entity_urn").startswith("urn:uuid:"), F.lit(False)) & digest("$.revision_digest") & (kind("$.record") == "OBJECT"))),
        ("record of no known kind", is_op("record") & ~F.coalesce(text("$.record.entity").isin(*KINDS), F.lit(False))),
        ("record without time", is_op("record") & (kind("$.observed_at") != "BIGINT")),
        ("previous digest is none", is_op("record") & (kind("$.previous_digest") != "VOID") & ~digest("$.previous_digest")),
        ("observation without stable id", is_op("observation") & ~positive("$.observation_id")),
        ("refresh without time or ranges", is_op("observation_refresh", "record_refresh") & ((kind("$.observed_at") != "BIGINT") | (kind("$.ranges") != "ARRAY"))),
        ("bad ranges", is_op("observation_refresh", "record_refresh") & F.coalesce(wrong, F.lit(True))),
    ]
    problem = F.when(is_op("observation"), observation_problem(v))
    for message, broken in reversed(rules):
        problem = F.when(F.coalesce(broken, F.lit(False)), message).otherwise(problem)
    return problem


def validate_events(events: DataFrame) -> DataFrame:
    """(seq, problem) of events that no consumer may apply."""
    problem = event_problem(F.col("seq"), F.col("operation"), F.col("data"))
    # a filter on the problem would work it out twice
    return events.select("seq", F.explode(F.filter(F.array(problem), lambda x: x.isNotNull())).alias("problem"))


def apply_changes(batch: DataFrame, applied: DataFrame) -> DataFrame:
    """(producer, seq, status) of a replay: `new`, `known` for an equal event applied before or earlier in the batch,
    `rejected` where one number stands for other content. applied: (producer, seq, sha256)."""
    hashed = batch.withColumn("sha256", F.sha2(F.concat_ws("\n", "operation", "urn", "data"), 256))
    before = applied.select("producer", "seq", F.col("sha256").alias("_was"))
    same = Window.partitionBy("producer", "seq")
    many = F.min("sha256").over(same) != F.max("sha256").over(same)
    again = F.row_number().over(same.orderBy("sha256")) > 1
    status = F.when(F.col("_many") | (F.col("_was") != F.col("sha256")), "rejected").when(F.col("_was").isNotNull() | F.col("_again"), "known").otherwise("new")
    marked = hashed.withColumns({"_many": many, "_again": again})
    return marked.join(before, ["producer", "seq"], "left").withColumn("status", status).drop("_was", "_many", "_again")


def replay_heads(events: DataFrame) -> DataFrame:
    """Heads after new record events: of each urn the latest by time, then by seq. For feeds of one writer that carry no
    previous digests; replay_records() is for those that do."""
    last = events.where("operation = 'record' and status = 'new'").groupBy("urn").agg(F.max_by(F.struct("data", "seq", "observed_at"), F.struct("observed_at", "seq")).alias("x"))
    return last.select("urn", "x.data", "x.seq", "x.observed_at")


def outcome(head: str | None, head_at: int | None, digest: str, previous: str | None, at: int) -> str:
    """What becomes of a carried record: its previous digest must be the head's, else an unrelated edit stays."""
    if head is None:
        return "inserted"
    if head == digest:
        return "unchanged"
    if previous != head:
        return "conflict"
    return "updated" if at >= head_at else "older"


def replay_records(records: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads after, outcomes (urn, seq, outcome)) of record events, as replay_steps has them."""
    after, steps = replay_steps(records, heads)
    return after, steps.where("seq >= 0").select("urn", "seq", "outcome")


def replay_steps(records: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads after, steps (urn, seq, outcome, digest, observed_at): what each event made of the head) of record events
    (urn, seq, digest, previous, observed_at) in the order of seq. heads: (urn, digest, observed_at).

    An urn with one event, as nearly all have in a batch, is decided by a join and an expression. Where there are more each
    step depends on the one before: such an urn's rows stream through one task in order, and only the head is held. Steps
    of urns with events begin with the head before, if there was one, as seq -1.
    """
    from ..plans.state import kept

    new = records.select(F.col("urn").cast("string").alias("urn"), F.col("seq").cast("long").alias("seq"), "digest", "previous", F.col("observed_at").cast("long").alias("observed_at"))
    new, urn = kept(hashed(new, "urn")), ["_h", "urn"]
    old = hashed(heads.select(F.col("urn").cast("string").alias("urn"), "digest", "observed_at"), "urn")
    often = new.groupBy(*urn).agg(F.count("*").alias("n")).where("n > 1").select(*urn)
    once = new.join(often, urn, "left_anti").join(old.select(*urn, F.col("digest").alias("h"), F.col("observed_at").alias("t")), urn, "left")
    said = F.when(F.col("h").isNull(), "inserted").when(F.col("h") == F.col("digest"), "unchanged").when(~F.col("previous").eqNullSafe(F.col("h")), "conflict").when(F.col("observed_at") >= F.col("t"), "updated").otherwise("older")
    once = once.withColumn("outcome", said)
    taken = F.col("outcome").isin("inserted", "updated")
    step = once.select("urn", "seq", "outcome", F.when(taken, F.col("digest")).otherwise(F.col("h")).alias("digest"), F.when(taken, F.col("observed_at")).when(F.col("outcome") == "unchanged", F.greatest("observed_at", "t")).otherwise(F.col("t")).alias("observed_at"))
    first = once.where("h is not null").select("urn", F.lit(-1).cast("long").alias("seq"), F.lit("head").alias("outcome"), F.col("h").alias("digest"), F.col("t").alias("observed_at"))
    many = _streamed(new.join(often, urn, "left_semi"), old.join(often, urn, "left_semi"))
    steps = kept(step.unionByName(first).withColumn("_many", F.col("urn").isNull()).unionByName(many.withColumn("_many", F.lit(True))))
    after = steps.where("_many").groupBy("urn").agg(F.max_by(F.struct("digest", "observed_at"), "seq").alias("h")).select("urn", "h.*")
    after = after.unionByName(steps.where("not _many and seq >= 0").select("urn", "digest", "observed_at"))
    steps = steps.drop("_many")
    return old.join(hashed(after, "urn").select(*urn), urn, "left_anti").drop("_h").unionByName(after), steps


def _streamed(records: DataFrame, heads: DataFrame) -> DataFrame:
    """The steps of urns with several events, one after the other."""
    kind = "urn string, seq long, digest string, previous string, observed_at long"
    old = heads.select(F.col("urn").cast("string").alias("urn"), F.lit(-1).cast("long").alias("seq"), "digest", F.lit(None).cast("string").alias("previous"), "observed_at")
    new = records.select(F.col("urn").cast("string").alias("urn"), F.col("seq").cast("long").alias("seq"), "digest", "previous", "observed_at")

    def run(batches):
        import pyarrow as pa

        urn = head = at = None
        for batch in batches:
            out = []
            for u, seq, digest, previous, time in zip(*(batch[c].to_pylist() for c in ("urn", "seq", "digest", "previous", "observed_at"))):
                if u != urn:
                    urn, head, at = u, None, None
                if seq < 0:
                    head, at, said = digest, time, "head"
                else:
                    said = outcome(head, at, digest, previous, time)
                    if said in ("inserted", "updated"):
                        head, at = digest, time
                    elif said == "unchanged":
                        at = max(at, time)
                out.append((u, seq, said, head, at))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["urn", "seq", "outcome", "digest", "observed_at"])

    # by a hash of the urn: by the urn itself the shuffle is left out where joins have dealt rows so, and adaptive plans may then
    # read those joins' shuffles in place, which parts an urn's rows
    dealt = old.unionByName(new).repartition(F.xxhash64("urn")).sortWithinPartitions("urn", "seq")
    return dealt.mapInArrow(run, "urn string, seq long, outcome string, digest string, observed_at long")


def bind_entities(bound: DataFrame, batch: DataFrame) -> DataFrame:
    """(producer, id, locals): ids bound to more than one entity; must be empty."""
    both = bound.select("producer", "id", "local").unionByName(batch.select("producer", "id", "local"))
    return both.groupBy("producer", "id").agg(F.count_distinct("local").alias("locals")).where("locals > 1")


def pending(exports: DataFrame, receipts: DataFrame, destination: str) -> DataFrame:
    """Batches that a destination hasn't confirmed, in order. exports: (consumer, through, after); receipts: (consumer, destination, checkpoint)."""
    done = receipts.where(F.col("destination") == destination).groupBy("consumer").agg(F.max("checkpoint").alias("checkpoint"))
    return exports.join(done, "consumer", "left").where(F.col("through") > F.coalesce("checkpoint", F.lit(0))).orderBy("consumer", "through")


def advance_delivery(exports: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(consumer, checkpoint): the end of the confirmed batches that follow one another from the start without a gap."""
    mine = exports.join(confirmed, ["consumer", "through"], "left_semi")
    order = Window.partitionBy("consumer").orderBy("through")
    breaks = F.sum(F.when(F.col("after") == F.coalesce(F.lag("through").over(order), F.lit(0)), 0).otherwise(1)).over(order)
    return mine.withColumn("_b", breaks).where("_b = 0").groupBy("consumer").agg(F.max("through").alias("checkpoint"))


# --- small tables that jobs read and write whole: a row for each source, consumer or conflict


def put_checkpoint(stored: DataFrame, new: DataFrame, by: Sequence[str] = ("source", "scope", "key")) -> DataFrame:
    """Checkpoints with some set; a null value clears one."""
    old = stored.join(new.select(*by), list(by), "left_anti")
    return old.unionByName(new.where("value is not null"))


def advance_consumer(consumers: DataFrame, consumer: str, policy: str, through: int, last: int) -> DataFrame:
    """Consumers (consumer, policy, sequence) after a batch. A consumer keeps the policy that it began with."""
    mine = consumers.where((F.col("consumer") == consumer) & (F.col("policy") != policy))
    if not mine.isEmpty():
        raise ValueError("a consumer's policy can't change")
    row = consumers.sparkSession.createDataFrame([(consumer, policy, through)], "consumer string, policy string, sequence long")
    return consumers.where(F.col("consumer") != consumer).unionByName(row).withColumn("has_more", F.col("sequence") < last)


def check_parent(batch: DataFrame, head: DataFrame) -> DataFrame:
    """(problem) rows where a feed batch doesn't follow the last one applied: both tables have one row for each producer."""
    h = head.select("producer", F.col("sequence").alias("h_seq"), F.col("archive_id").alias("h_id"), F.col("sha256").alias("h_sha"))
    t = batch.join(h, "producer", "left")
    problem = F.when(F.col("h_seq").isNull() & (F.col("after") != 0), "no earlier batch").when(F.col("after") != F.coalesce("h_seq", F.lit(0)), "gap").when(~F.col("parent_id").eqNullSafe(F.col("h_id")), "other parent").when(~F.col("parent_sha256").eqNullSafe(F.col("h_sha")), "other content")
    return t.select("producer", problem.alias("problem")).where("problem is not null")


def resolve_conflicts(ledger: DataFrame, decided: DataFrame, at: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger, heads to set, branches to accept). decided: (conflict_id, keep): a content conflict keeps a digest, a
    branch conflict is accepted, any other is acknowledged."""
    t = ledger.join(decided, "conflict_id", "left")
    now = t.withColumn("resolved_at", F.when(F.col("resolved_at").isNull() & F.col("keep").isNotNull(), F.lit(at)).otherwise(F.col("resolved_at")))
    chosen = t.where("resolved_at is null and keep is not null")
    return now.select(*ledger.columns), chosen.where("kind = 'content'").select("urn", F.col("keep").alias("digest")), chosen.where("kind = 'branch'").select(F.col("urn").alias("archive_id"))


def identity_event(last: DataFrame, current: DataFrame) -> DataFrame:
    """The identity event, only if what it says has changed. Both: (data) of one row."""
    return current.join(last.select(F.col("data").alias("_l")), F.col("data") == F.col("_l"), "left_anti")


def revisions_of(revisions: DataFrame, urns: DataFrame) -> DataFrame:
    return revisions.join(urns.select("urn"), "urn", "left_semi").orderBy("urn", F.desc("observed_at"), "digest")


def identities_of_person(links: DataFrame, people: DataFrame, states: Sequence[str] = ("confirmed", "suggested")) -> DataFrame:
    return links.where(F.col("state").isin(*states)).join(people.select(F.col("urn").alias("person_urn")), "person_urn", "left_semi").select("person_urn", "identity_urn").distinct()


def observations_of(observations: DataFrame, urns: DataFrame) -> DataFrame:
    """The observations of some urns, whatever their state."""
    return observations.join(urns.select("urn").distinct(), "urn", "left_semi")


def alias_links(aliases: DataFrame, urns: DataFrame) -> DataFrame:
    """(urn, direction, other): what an urn became (`to`) and what became it (`from`). aliases: (old_urn, new_urn)."""
    wanted = urns.select("urn").distinct()
    became = aliases.select(F.col("old_urn").alias("urn"), F.lit("to").alias("direction"), F.col("new_urn").alias("other"))
    was = aliases.select(F.col("new_urn").alias("urn"), F.lit("from").alias("direction"), F.col("old_urn").alias("other"))
    return became.unionByName(was).join(wanted, "urn", "left_semi").distinct()


def capture_events(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """(operation, urn, data in JSON) between two states of a store, for sequenced(), in the form that validate_events accepts
    and feed.replay reads: a `record` where digest or body differs, with the previous digest where there was one; a
    `revision` that is new or whose time, predecessor or body differs; an `observation` whose evidence differs. What went is
    no event; what was only seen again is one for feed.refresh_events.

    records: (urn, id, digest, record, observed_at, sync_run); revisions: (urn, digest, record, observed_at, sync_run,
    supersedes); observations: (id, OBSERVED, EVIDENCE, observed_at, sync_run). record is the canonical record in JSON; ids
    are the store's stable ones.
    """

    def between(table: str, key: Sequence[str], watched: Sequence[str]) -> DataFrame:
        before = hashed(old[table].select(*key, F.struct(*watched).alias("_old")), *key)
        both = hashed(new[table], *key).join(before, ["_h", *key], "left")
        return both.where(F.col("_old").isNull() | ~F.struct(*watched).eqNullSafe(F.col("_old")))

    told = lambda df, operation, *fields: df.select(F.lit(operation).alias("operation"), "urn", F.to_json(F.struct(*fields)).alias("data"))
    body = F.parse_json("record").alias("record")
    r = between("records", ["urn"], ["digest", "record"])
    v = between("revisions", ["urn", "digest"], ["observed_at", "supersedes", "record"])
    o = between("observations", OBSERVED, EVIDENCE)
    about = [F.col("urn").alias("entity_urn"), "source", F.col("scope").alias("account_scope"), "native_table"]
    parts = [
        told(v, "revision", F.col("urn").alias("entity_urn"), F.col("digest").alias("revision_digest"), "observed_at", "sync_run", "supersedes", body),
        told(r, "record", F.col("id").alias("entity_id"), body, "observed_at", "sync_run", F.col("_old.digest").alias("previous_digest")),
        told(o, "observation", F.col("id").alias("observation_id"), *about, *EVIDENCE, "observed_at", "sync_run"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
