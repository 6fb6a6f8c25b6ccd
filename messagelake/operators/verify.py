"""Archives verified whole and many at once: manifests, rows of every kind, counts, members and feed sequences, as tables of problems."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import archive, schemas as J, store

#: The formats that manifests may name: of archives, and of feed batches.
FORMATS = ("messagelake-archive-v1", "messagelake-feed-v1")
# What a manifest must have, the kinds of archives, and the members whose rows a manifest doesn't count.
REQUIRED = ("archive_format", "export_id", "export_set", "created_at", "kind", "revision", "supersedes", "lineage", "counts", "payload_digest", "members")
KINDS = ("catalogue", "bucket", "undated", "range", "delta")
UNCOUNTED = ("revisions", "source_observations", "stubs")
#: How many problems a report lists; the table of problems has all.
REPORTED = 5


def _kind(v: Column, path: str) -> Column:
    """The JSON type at a path, `NONE` where there is nothing."""
    return _type(F.try_variant_get(v, path, "variant"))


def _type(x: Column) -> Column:
    """The JSON type of a value, `NONE` of nothing."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0), F.lit("NONE"))


def _text(v: Column, path: str) -> Column:
    """The string at a path, null where there is no string."""
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _whole(v: Column, path: str) -> Column:
    """The integer at a path, null where there is none."""
    return F.when(_kind(v, path) == "BIGINT", F.try_variant_get(v, path, "long"))


def _list(v: Column, path: str) -> Column:
    return F.when(_kind(v, path) == "ARRAY", F.try_variant_get(v, path, "array<variant>"))


def _root(raw: str) -> Column:
    """The type of a JSON text that is known to be one, as far as it is an object: so its values aren't looked through."""
    return F.when(F.ltrim(raw, F.lit(" \t\r\n")).startswith("{"), "OBJECT").otherwise("NONE")


def _all(values: Column, good) -> Column:
    """Whether every item of a list is good; a list that isn't there is not."""
    return F.coalesce(F.forall(values, lambda x: F.coalesce(good(x), F.lit(False))), F.lit(False))


def _once(df: DataFrame, **made: Column) -> DataFrame:
    """A table with columns that are computed once: as the item of an array, so that filters don't pull copies of them down."""
    one = F.explode(F.array(F.struct(*(c.alias(n) for n, c in made.items())))).alias("_one")
    return df.select("*", one).select(*df.columns, *(F.col(f"_one.{n}").alias(n) for n in made))


def manifest_problems(manifests: DataFrame, formats: Sequence[str] = FORMATS, sources: Sequence[str] | None = None, version: str = S.ID_VERSION, raw: str = "raw") -> DataFrame:
    """(archive_id, problem) of manifests (archive_id, raw: JSON text): a row for each rule that one breaks. A manifest that lacks
    something says only that. sources: the sources that scopes may have, all if None."""
    fields: dict[str, str] = {}

    def field(path: str) -> Column:
        return F.col(fields.setdefault(path, f"_f{len(fields)}"))

    text, whole, items, kind = (lambda p: field(p)["text"]), (lambda p: field(p)["whole"]), (lambda p: field(p)["items"]), (lambda p: field(p)["kind"])
    no = lambda c: ~F.coalesce(c, F.lit(False))
    lacking = [(f"lacks {k}", kind(f"$.{k}") == "NONE") for k in REQUIRED]
    own, kinds = text("$.export_id"), text("$.kind")
    revision, supersedes = whole("$.revision"), F.transform(items("$.supersedes"), lambda x: x.try_cast("string"))
    line = F.transform(items("$.lineage"), lambda x: x.try_cast("string"))
    ends = F.try_element_at(line, F.lit(-1)).eqNullSafe(own)
    is_feed = F.coalesce((kinds == "delta") | (text("$.archive_format") == formats[1]), F.lit(False))
    feed = is_feed & (kind("$.feed") == "OBJECT")
    after, through, parent = whole("$.feed.after"), whole("$.feed.through"), text("$.feed.parent")
    requires = F.transform(items("$.requires"), lambda x: x.try_cast("string"))
    scope_ok = lambda x: _text(x, "$.scope").isNotNull() & (_text(x, "$.source").isin(*sources) if sources else _text(x, "$.source").isNotNull())
    none = lambda p: kind(p).isin("NONE", "VOID")
    rules = [
        ("export_id is no urn", no(own.startswith("urn:uuid:"))), ("export_set is no urn", no(text("$.export_set").startswith("urn:uuid:"))),
        ("account_scopes are no sources with scopes", (kind("$.account_scopes") != "NONE") & ~_all(items("$.account_scopes"), scope_ok)),
        ("scope_mappings lack from or to", (kind("$.scope_mappings") != "NONE") & ~_all(items("$.scope_mappings"), lambda x: _text(x, "$.from").isNotNull() & _text(x, "$.to").isNotNull())),
        ("unknown archive_format", no(text("$.archive_format").isin(*formats))), ("other id_version", ~none("$.id_version") & ~F.coalesce(text("$.id_version").isin("", version), F.lit(False))),
        ("unknown kind", no(kinds.isin(*KINDS))),
        ("bucket lacks a label or a time before its end", F.coalesce(kinds.isin("bucket", "range"), F.lit(False)) & (none("$.bucket.label") | no(whole("$.bucket.start_utc_ms") < whole("$.bucket.end_utc_ms")))),
        ("revision is no positive integer", no(revision >= 1)),
        ("lineage doesn't end with this export", ~ends), ("lineage and revision differ", ends & ~F.size(line).eqNullSafe(revision.cast("int"))),
        ("supersedes what isn't in the lineage", ~_all(supersedes, lambda s: F.array_contains(line, s))), ("later revision supersedes none", (revision > 1) & no(F.size(supersedes) > 0)),
        ("counts are no numbers", ~_all(F.map_values(F.col("_counts")), lambda c: _whole(c, "$") >= 0)), ("created_at is no integer", kind("$.created_at") != "BIGINT"),
        ("unknown context", ~none("$.context") & no(text("$.context").isin("full", "minimal"))),
        ("delta and feed format go together", is_feed & no((kinds == "delta") & (text("$.archive_format") == formats[1]))), ("lacks feed", is_feed & ~feed),
        ("feed lacks stream or producer", feed & no((text("$.feed.stream") != "") & (text("$.feed.producer") != ""))), ("feed bounds are out of order", feed & no((after >= 0) & (after < through))),
        ("baseline has a parent", feed & (after == 0) & ~(none("$.feed.parent") & none("$.feed.parent_sha256"))),
        ("delta lacks its parent's id or hash", feed & ~after.eqNullSafe(F.lit(0)) & no(parent.isNotNull() & S.is_digest(text("$.feed.parent_sha256")))),
        ("requires another than its parent", feed & ~requires.eqNullSafe(F.when(F.coalesce(parent, F.lit("")) != "", F.array(parent)).otherwise(F.array().cast("array<string>")))),
        ("feed batches supersede nothing", is_feed & ~((F.coalesce(F.size(supersedes), F.lit(0)) == 0) & revision.eqNullSafe(F.lit(1)))),
    ]
    said = lambda some: F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for m, c in some)), lambda x: x.isNotNull())
    root = _root(raw)
    v = F.col("_v")
    # a value is sought once, its type told once, and it is read only as what it is
    t = _once(manifests.select("archive_id", raw), _v=F.try_parse_json(raw))
    t = _once(t, **{f"{name}_x": F.try_variant_get(v, p, "variant") for p, name in fields.items()})
    t = _once(t, **{f"{name}_k": _type(F.col(f"{name}_x")) for name in fields.values()})
    is_ = lambda name, type_, as_: F.when(F.col(f"{name}_k") == type_, F.try_variant_get(F.col(f"{name}_x"), "$", as_))
    got = {name: F.struct(F.col(f"{name}_k").alias("kind"), is_(name, "STRING", "string").alias("text"), is_(name, "BIGINT", "long").alias("whole"), is_(name, "ARRAY", "array<variant>").alias("items")) for name in fields.values()}
    t = _once(t, **got, _counts=F.try_variant_get(v, "$.counts", "map<string,variant>"))
    lacks = said(lacking)
    found = F.when(v.isNull() | (root != "OBJECT"), F.array(F.lit("no object"))).when(F.size(lacks) > 0, lacks).otherwise(said(rules))
    return t.select("archive_id", F.explode(found).alias("problem"))


def json_body(v: Column) -> Column:
    """The canonical form of a record in JSON without what belongs to a sighting; its SHA-256 is the record's digest. Numbers count in
    the form that Spark gives them, so 1.50 and 1.5 are one."""
    names = lambda fields: F.array_except(F.array_sort(F.map_keys(fields)), F.array(*map(F.lit, (*S.VOLATILE, "iso"))))
    body = lambda fields, names: F.to_json(F.map_from_arrays(names, F.transform(names, lambda k: F.try_element_at(fields, k))))
    return J.let(v.try_cast("map<string,variant>"), lambda fields: J.let(names(fields), lambda own: body(fields, own)))


def checked_rows(rows: DataFrame, by_kind: dict[str, dict] | None = None) -> DataFrame:
    """(archive_id, member, line, entity, seq, problem) of the rows of archives, blank lines left out; problem is null for a
    good row. rows: (archive_id, member, line, raw); members are named records/<entity>.jsonl. by_kind: JSON Schemas by
    entity. Nothing is shuffled."""
    v, r, entity = F.col("_v"), F.col("_r"), F.col("entity")
    t = _once(rows.where(F.length(F.btrim("raw")) > 0).withColumn("entity", F.regexp_extract("member", r"^records/(.*)\.jsonl$", 1)), _v=F.try_parse_json("raw"), _root=_root("raw"))
    t = _once(t.drop("raw"), _r=F.when(entity == "revisions", F.try_variant_get(v, "$.record", "variant")).otherwise(v), seq=F.when(entity == "changes", _whole(v, "$.seq")))
    t = _once(t, _body=F.when(~entity.isin("changes", "stubs", "source_observations"), json_body(r)), _event=F.when(entity == "changes", F.coalesce(F.try_parse_json(_text(v, "$.data")), F.when(_kind(v, "$.data") != "STRING", F.try_variant_get(v, "$.data", "variant")))))
    t = _once(t, _signed=_text(r, "$.revision_digest").eqNullSafe(F.concat(F.lit("sha256:"), F.sha2(S._lower_escapes(F.col("_body")), 256))))
    record = F.when(~F.col("_signed"), "digest isn't that of the record")
    for name, schema in (by_kind or {}).items():
        record = record.when(_text(r, "$.entity") == name, F.concat(F.lit("schema: "), F.try_element_at(J.Compiler(schema).problems(r), F.lit(1))))
    data = F.coalesce(_text(v, "$.data"), F.to_json(F.col("_event")))  # read by few rules alone
    fits = (_kind(r, "$") == "OBJECT") & _text(r, "$.urn").eqNullSafe(_text(v, "$.entity_urn")) & _text(r, "$.entity").eqNullSafe(_text(v, "$.entity_kind"))
    unlike = ~F.col("_signed") | ~_text(v, "$.revision_digest").eqNullSafe(_text(r, "$.revision_digest"))
    problem = (
        F.when(v.isNull(), "no JSON").when(F.col("_root") != "OBJECT", "row is no object")
        .when(entity == "changes", store.parsed_event_problem(F.col("seq"), _text(v, "$.operation"), data, F.col("_event")))
        .when(entity == "stubs", F.when(_text(v, "$.urn").isNull() | _text(v, "$.entity").isNull(), "stub lacks urn or entity")).when(entity == "source_observations", store.observation_problem(v))
        .when((entity == "revisions") & ~fits, "revision's record is another").when((entity == "revisions") & unlike, "revision's digest isn't that of its record")
        .when((entity == "revisions") & (_kind(v, "$.observed_at") != "BIGINT"), "revision's time is no integer")
        .when((entity != "revisions") & ~_text(v, "$.entity").eqNullSafe(entity), "row of another entity").otherwise(record)
    )
    return _once(t, problem=problem).select("archive_id", "member", "line", "entity", "seq", "problem")


def count_problems(manifests: DataFrame, checked: DataFrame, members: DataFrame) -> DataFrame:
    """(archive_id, problem) where a manifest counts other than the good rows of an entity, or other than the blobs."""
    counts = F.try_variant_get(F.try_parse_json("raw"), "$.counts", "map<string,long>")
    told = manifests.select("archive_id", F.explode(counts).alias("entity", "expected")).where(~F.col("entity").isin(*UNCOUNTED))
    found = checked.where("problem is null").groupBy("archive_id", "entity").agg(F.count("*").alias("found"))
    blobs = members.where("name like 'blobs/%'").groupBy("archive_id").agg(F.count("*").alias("found")).select("archive_id", F.lit("blob_files").alias("entity"), "found")
    t = told.join(found.where("entity != 'blob_files'").unionByName(blobs), ["archive_id", "entity"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return t.where("expected != found").select("archive_id", F.format_string("counts %d %s and holds %d", "expected", "entity", "found").alias("problem"))


def member_problems(manifests: DataFrame, members: DataFrame) -> DataFrame:
    """(archive_id, problem): blobs whose names aren't their contents' hashes, members that a manifest doesn't list or lists in
    vain, a payload digest that isn't that of the members, and changes in or missing from what they must be in.
    members: (archive_id, name, sha256 of the content in hex), without the manifest."""
    v = F.try_parse_json("raw")
    m = manifests.select("archive_id", F.when(_text(v, "$.kind") == "delta", True).otherwise(False).alias("delta"), _text(v, "$.payload_digest").alias("told"), F.transform(_list(v, "$.members"), lambda x: x.try_cast("string")).alias("listed"))
    named = F.regexp_extract("name", "^blobs/sha256/([0-9a-f]{2})/([0-9a-f]{64})$", 2)
    parted = F.regexp_extract("name", "^blobs/sha256/([0-9a-f]{2})/", 1)
    blob = F.when((named == "") | (F.substring(named, 1, 2) != parted), F.concat("name", F.lit(": no name by content"))).when(named != F.col("sha256"), F.concat("name", F.lit(": other content")))
    blobs = members.where("name like 'blobs/%'").select("archive_id", blob.alias("problem")).where("problem is not null")
    there = members.select("archive_id", "name", F.lit(True).alias("there"))
    both = m.select("archive_id", F.explode_outer(F.array_distinct("listed")).alias("name")).where("name is not null").withColumn("listed", F.lit(True)).join(there, ["archive_id", "name"], "full_outer")
    lists = both.where("there is null or listed is null").select("archive_id", F.concat("name", F.when(F.col("there").isNull(), F.lit(": listed and not there")).otherwise(F.lit(": not listed"))).alias("problem"))
    digest = archive.member_digest(members, ["archive_id"]).select("archive_id", F.concat(F.lit("sha256:"), "digest").alias("digest"))
    empty = F.concat(F.lit("sha256:"), F.sha2(F.lit(""), 256))
    payload = m.join(digest, "archive_id", "left").where(~F.coalesce("digest", empty).eqNullSafe(F.col("told"))).select("archive_id", F.lit("payload digest isn't that of the members").alias("problem"))
    changes = members.groupBy("archive_id").agg(F.bool_or(F.col("name") == "records/changes.jsonl").alias("changes"), F.bool_or(F.col("name").like("records/%") & (F.col("name") != "records/changes.jsonl")).alias("others"))
    t = m.join(changes, "archive_id", "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in ("changes", "others")})
    where = F.when(F.col("delta") & (~F.col("changes") | F.col("others")), "a feed batch holds changes and blobs alone").when(~F.col("delta") & F.col("changes"), "changes need a feed's manifest")
    return blobs.unionByName(lists).unionByName(payload).unionByName(t.select("archive_id", where.alias("problem")).where("problem is not null"))


def feed_problems(manifests: DataFrame, checked: DataFrame) -> DataFrame:
    """(archive_id, problem) of feed batches whose good events aren't the numbers after+1 to through, each once and in the order of
    their lines. Neighbours meet by a join on their numbers, so no batch is sorted in one task."""
    v = F.try_parse_json("raw")
    deltas = manifests.where(_text(v, "$.kind") == "delta").select("archive_id", _whole(v, "$.feed.after").alias("after"), _whole(v, "$.feed.through").alias("through"))
    events = checked.where("entity = 'changes' and problem is null").select("archive_id", "seq", "line")
    have = events.groupBy("archive_id", "seq").agg(F.count("*").alias("n")).groupBy("archive_id").agg(F.sum("n").alias("n"), F.count("*").alias("numbers"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    back = events.select("archive_id", (F.col("seq") - 1).alias("seq"), F.col("line").alias("_next")).join(events, ["archive_id", "seq"]).where("_next <= line").select("archive_id").distinct().withColumn("back", F.lit(True))
    t = deltas.join(have, "archive_id", "left").join(back, "archive_id", "left")
    good = F.col("lo").eqNullSafe(F.col("after") + 1) & F.col("hi").eqNullSafe(F.col("through")) & (F.col("n") == F.col("through") - F.col("after")) & (F.col("n") == F.col("numbers")) & F.col("back").isNull()
    return t.where(~F.coalesce(good, F.lit(False))).select("archive_id", F.lit("events aren't the manifest's, each once and in order").alias("problem"))


def verify_archives(manifests: DataFrame, rows: DataFrame, members: DataFrame, by_kind: dict[str, dict] | None = None, formats: Sequence[str] = FORMATS, sources: Sequence[str] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(report, problems) of many archives. problems: (archive_id, place, line, problem), place being `manifest`, `archive` or a
    member. report: (archive_id, ok, row_problems, reported), the first REPORTED problems by place, line and text.

    An archive whose manifest breaks a rule is looked at no further. manifests: (archive_id, raw), one row each; rows:
    (archive_id, member, line, raw); members: (archive_id, name, sha256). What is found of each row, without its text, is
    read three times: keep writes it, such as to a checkpoint, else rows are parsed three times.
    """
    first = manifest_problems(manifests, formats, sources).select("archive_id", F.lit("manifest").alias("place"), F.lit(None).cast("long").alias("line"), "problem")
    bad = first.select("archive_id").distinct()
    good = lambda df: df.join(bad, "archive_id", "left_anti")
    m, files, checked = good(manifests), good(members), good(keep(checked_rows(rows, by_kind)))
    broken = checked.where("problem is not null").select("archive_id", F.col("member").alias("place"), F.col("line").cast("long").alias("line"), "problem")
    whole = count_problems(m, checked, files).unionByName(member_problems(m, files)).unionByName(feed_problems(m, checked))
    problems = first.unionByName(whole.select("archive_id", F.lit("archive").alias("place"), F.lit(None).cast("long").alias("line"), "problem")).unionByName(broken)
    order = Window.partitionBy("archive_id").orderBy("place", "line", "problem")
    few = problems.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= REPORTED)
    said = F.concat_ws(":", "place", "line", "problem")
    few = few.groupBy("archive_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", said.alias("s")))), lambda x: x["s"]).alias("reported"))
    n = problems.groupBy("archive_id").agg(F.count_if(~F.col("place").isin("manifest", "archive")).alias("row_problems"))
    report = manifests.select("archive_id").join(n, "archive_id", "left").join(few, "archive_id", "left")
    return report.select("archive_id", F.col("row_problems").isNull().alias("ok"), F.coalesce("row_problems", F.lit(0)).alias("row_problems"), F.coalesce("reported", F.array().cast("array<string>")).alias("reported")), problems
