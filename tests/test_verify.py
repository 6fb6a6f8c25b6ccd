"""Archives verified whole: each rule of manifests, rows, counts, members and feeds broken once."""

import hashlib
import json

import pytest

from messagelake.operators import archive as A
from messagelake.operators import verify as V

URN = "urn:uuid:00000000-0000-5000-8000-%012d"
SHA = "sha256:" + "0" * 64


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest_of(record):
    body = {k: v for k, v in record.items() if k not in ("observed_at", "sync_run", "revision_digest", "iso")}
    return "sha256:" + sha(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def manifest(**more):
    m = {"archive_format": V.FORMATS[0], "export_id": URN % 1, "export_set": URN % 9, "created_at": 1, "kind": "bucket", "revision": 1, "supersedes": [], "lineage": [URN % 1], "counts": {}, "payload_digest": "sha256:" + sha(""), "members": [],
         "bucket": {"label": "2024-01", "start_utc_ms": 1, "end_utc_ms": 2}, "account_scopes": [{"source": "s", "scope": "c"}], "scope_mappings": [{"from": "a", "to": "b"}], "context": "full"}
    return {k: v for k, v in (m | more).items() if v is not ...}


def delta(feed=(), **more):
    return manifest(**{"archive_format": V.FORMATS[1], "kind": "delta", "requires": [URN % 5], "feed": {"stream": "x", "producer": "p", "after": 3, "through": 5, "parent": URN % 5, "parent_sha256": SHA} | dict(feed)} | more)


CASES = {
    "good": (manifest(), []), "later": (manifest(revision=2, lineage=[URN % 0, URN % 1], supersedes=[URN % 0]), []), "delta": (delta(), []), "no options": (manifest(bucket=..., kind="undated", account_scopes=..., scope_mappings=..., context=None, id_version=None), []),
    "baseline": (delta({"after": 0, "parent": None, "parent_sha256": None}, requires=[]), []),
    "lacks": (manifest(counts=..., members=..., revision=-1), ["lacks counts", "lacks members"]), "list": ([], ["no object"]), "text": ("{x", ["no object"]), "null": (None, ["no object"]),
    "ids": (manifest(export_set="x"), ["export_set is no urn"]), "id": (manifest(export_id=5, lineage=["5"]), ["export_id is no urn", "lineage doesn't end with this export"]),
    "scopes": (manifest(account_scopes=[{"source": "other", "scope": "c"}]), ["account_scopes are no sources with scopes"]), "scopes null": (manifest(account_scopes=None), ["account_scopes are no sources with scopes"]), "mappings": (manifest(scope_mappings=[{"from": "a"}]), ["scope_mappings lack from or to"]),
    "format": (manifest(archive_format="zip"), ["unknown archive_format"]), "version": (manifest(id_version="old"), ["other id_version"]), "kind": (manifest(kind="heap"), ["unknown kind"]), "bucket": (manifest(bucket={"label": "x", "start_utc_ms": 2, "end_utc_ms": 2}), ["bucket lacks a label or a time before its end"]),
    "no bucket": (manifest(kind="range", bucket=...), ["bucket lacks a label or a time before its end"]), "revision": (manifest(revision="1"), ["lineage and revision differ", "revision is no positive integer"]), "length": (manifest(revision=2, supersedes=[URN % 1]), ["lineage and revision differ"]),
    "lineage": (manifest(lineage=[]), ["lineage doesn't end with this export"]), "supersedes": (manifest(supersedes=["x"]), ["supersedes what isn't in the lineage"]), "none": (manifest(revision=2, lineage=[URN % 0, URN % 1]), ["later revision supersedes none"]),
    "counts": (manifest(counts={"a": 1, "b": -1}), ["counts are no numbers"]), "counts text": (manifest(counts={"a": "1"}), ["counts are no numbers"]), "time": (manifest(created_at=1.5), ["created_at is no integer"]), "context": (manifest(context="some"), ["unknown context"]),
    "mixed": (delta(archive_format=V.FORMATS[0]), ["delta and feed format go together"]), "no feed": ({k: v for k, v in delta().items() if k != "feed"}, ["lacks feed"]), "stream": (delta({"stream": ""}), ["feed lacks stream or producer"]), "bounds": (delta({"after": 5}), ["feed bounds are out of order"]),
    "parent": (delta({"after": 0, "parent_sha256": None}), ["baseline has a parent"]), "hash": (delta({"parent_sha256": "x"}), ["delta lacks its parent's id or hash"]), "requires": (delta(requires=[]), ["requires another than its parent"]), "again": (delta(revision=2, lineage=[URN % 0, URN % 1], supersedes=[URN % 0]), ["feed batches supersede nothing"]),
}


def test_each_rule_of_manifests(spark):
    rows = [(name, m if isinstance(m, str) or m is None else json.dumps(m)) for name, (m, _) in CASES.items()]
    got = {name: [] for name in CASES}
    for r in V.manifest_problems(spark.createDataFrame(rows, "archive_id string, raw string"), sources=["s"]).collect():
        got[r.archive_id].append(r.problem)
    assert {k: sorted(v) for k, v in got.items()} == {k: v[1] for k, v in CASES.items()}


def signed(**fields):
    r = {"entity": "messages", "urn": URN % 3, "text": "zé/\"", "n": None, "at": {"b": 1, "a": [1, "x"]}, "observed_at": 5} | fields
    return r | {"revision_digest": digest_of(r)}


def whole(archive_id, files, blobs=(), **more):
    """(manifest, rows, members) of an archive whose manifest fits its files, but for what `more` says."""
    texts = {name: "\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in rows) for name, rows in files.items()}
    members = [(archive_id, n, sha(t)) for n, t in texts.items()] + [(archive_id, n, h) for n, h in blobs]
    lines = "".join(f"{n}\0{h}\n" for _, n, h in sorted(members))
    m = dict(counts={n[8:-6]: len([x for x in rows if x != ""]) for n, rows in files.items() if n != "records/changes.jsonl"}, payload_digest="sha256:" + sha(lines), members=[n for _, n, _ in members]) | more
    base = delta(**m) if more.get("kind") == "delta" else manifest(**m)
    rows = [(archive_id, n, k + 1, line) for n, t in texts.items() for k, line in enumerate(t.split("\n"))]
    return (archive_id, json.dumps(base)), rows, members


GOOD = signed()
REV = {"entity_urn": GOOD["urn"], "entity_kind": "messages", "revision_digest": GOOD["revision_digest"], "observed_at": 5, "record": GOOD}
OBS = {"entity_urn": GOOD["urn"], "source": "s", "account_scope": "c", "native_table": "t", "native_row_ids": ["1"], "fingerprint": "f", "adapter_version": "1", "observed_at": 5, "minted": False, "present": "present"}
EVENT = {"operation": "record", "data": {"entity_id": 1, "record": GOOD, "observed_at": 5, "previous_digest": None}}
MESSAGES, BLOB = "records/messages.jsonl", "a" * 64
SCHEMAS = {"messages": {"properties": {"text": {"type": "string"}}}}
feed = lambda *seqs: {"records/changes.jsonl": [EVENT | {"seq": s} for s in seqs]}
ARCHIVES = {
    "good": (whole("good", {MESSAGES: [GOOD, "", GOOD], "records/revisions.jsonl": [REV], "records/source_observations.jsonl": [OBS], "records/stubs.jsonl": [{"urn": "u", "entity": "chats"}]}, [(f"blobs/sha256/aa/{BLOB}", BLOB)], counts={"messages": 2, "blob_files": 1, "stubs": 7}), []),
    "empty": (whole("empty", {}), []), "feed": (whole("feed", feed(4, 5), kind="delta"), []),
    "rows": (whole("rows", {MESSAGES: ["{oops", "[]", signed(entity="chats"), GOOD | {"text": "other"}, signed(text=5), GOOD]}, counts={"messages": 1}), [f"{MESSAGES}:1:no JSON", f"{MESSAGES}:2:row is no object", f"{MESSAGES}:3:row of another entity", f"{MESSAGES}:4:digest isn't that of the record", f"{MESSAGES}:5:schema: $.text: no string"]),
    "revisions": (whole("revisions", {"records/revisions.jsonl": [REV | {"entity_urn": "x"}, REV | {"revision_digest": SHA}, REV | {"observed_at": "5"}]}), ["records/revisions.jsonl:1:revision's record is another", "records/revisions.jsonl:2:revision's digest isn't that of its record", "records/revisions.jsonl:3:revision's time is no integer"]),
    "others": (whole("others", {"records/stubs.jsonl": [{"urn": "u"}], "records/source_observations.jsonl": [OBS | {"present": "perhaps"}]}), ["records/source_observations.jsonl:1:observation present unknown", "records/stubs.jsonl:1:stub lacks urn or entity"]),
    "counts": (whole("counts", {MESSAGES: [GOOD]}, counts={"messages": 2, "chats": 1, "blob_files": 0}), ["archive:counts 1 chats and holds 0", "archive:counts 2 messages and holds 1"]),
    "blobs": (whole("blobs", {}, [("blobs/sha256/ab/" + BLOB, BLOB), ("blobs/x", BLOB), (f"blobs/sha256/aa/{BLOB}", "b" * 64)]), [f"archive:blobs/sha256/aa/{BLOB}: other content", f"archive:blobs/sha256/ab/{BLOB}: no name by content", "archive:blobs/x: no name by content"]),
    "members": (whole("members", {MESSAGES: [GOOD]}, members=["gone"], payload_digest=SHA), ["archive:gone: listed and not there", "archive:payload digest isn't that of the members", f"archive:{MESSAGES}: not listed"]),
    "gap": (whole("gap", feed(4, 6), kind="delta"), ["archive:events aren't the manifest's, each once and in order"]), "back": (whole("back", feed(5, 4), kind="delta"), ["archive:events aren't the manifest's, each once and in order"]), "twice": (whole("twice", feed(4, 4), kind="delta"), ["archive:events aren't the manifest's, each once and in order"]),
    "none": (whole("none", {}, kind="delta"), ["archive:a feed batch holds changes and blobs alone", "archive:events aren't the manifest's, each once and in order"]), "astray": (whole("astray", feed(1)), ["archive:changes need a feed's manifest"]),
    "event": (whole("event", {"records/changes.jsonl": [EVENT | {"seq": 4}, EVENT | {"seq": 5, "operation": "guess"}]}, kind="delta"), ["archive:events aren't the manifest's, each once and in order", "records/changes.jsonl:2:unknown operation"]),
    "manifest": (whole("manifest", {MESSAGES: ["{"]}, revision=0), ["manifest:lineage and revision differ", "manifest:revision is no positive integer"]),
    "many": (whole("many", {MESSAGES: ["{"] * 9}, counts={}), [f"{MESSAGES}:{k}:no JSON" for k in range(1, 6)]),
}


@pytest.fixture(scope="module")
def verified(spark):
    parts = [a for a, _ in ARCHIVES.values()]
    manifests = spark.createDataFrame([m for m, _, _ in parts], "archive_id string, raw string")
    rows = spark.createDataFrame([r for _, rs, _ in parts for r in rs], "archive_id string, member string, line int, raw string")
    members = spark.createDataFrame([x for _, _, xs in parts for x in xs], "archive_id string, name string, sha256 string")
    report, problems = V.verify_archives(manifests, rows, members, SCHEMAS)
    return report.collect(), problems.collect(), (manifests, rows, members)


def test_archives_are_verified_whole(verified):
    report, problems, _ = verified
    assert {r.archive_id: r.reported for r in report} == {k: p for k, (_, p) in ARCHIVES.items()}
    assert {r.archive_id for r in report if r.ok} == {"good", "empty", "feed"}
    assert {r.archive_id: r.row_problems for r in report}["many"] == 9
    assert sum(p.archive_id == "many" for p in problems) == 9


def test_empty_tables(spark, verified):
    report, problems = V.verify_archives(*(df.limit(0) for df in verified[2]))
    assert report.count() == problems.count() == 0


def test_imports_stop_at_the_first_conflict(spark):
    rows = [("c", "catalogue", "catalogue", 1, "proceed"), ("a", "bucket", "2024-01", 1, "proceed"), ("b", "bucket", "2024-02", 1, "branch_conflict"), ("d", "bucket", "2024-02", 2, "superseded"), ("e", "bucket", "2024-03", 1, "branch_conflict")]
    df = spark.createDataFrame(rows, "archive_id string, kind string, label string, revision int, decision string")
    got = {r.archive_id: r.decision for r in A.until_conflict(df).collect()}
    assert got == {"c": "proceed", "a": "proceed", "b": "branch_conflict", "d": "not_reached", "e": "not_reached"}
    fine = A.until_conflict(df.where("decision != 'branch_conflict'"))
    assert {r.decision for r in fine.collect()} == {"proceed", "superseded"} and A.until_conflict(df.limit(0)).count() == 0


def test_scopes_are_adopted_once(spark):
    m = [("e1", "set1", 5, [("s", "c1", None), ("t", "d", "l")], [("x", "y")]), ("e2", "set2", 3, [("s", "c2", "other")], [("x", "y"), ("y", "z")]), ("e3", "set1", 9, [], [])]
    manifests = spark.createDataFrame(m, "export_id string, export_set string, created_at long, account_scopes array<struct<source string, scope string, label string>>, scope_mappings array<struct<from string, to string>>")
    scopes = spark.createDataFrame([("t", "mine", 1, None, "local")], "source string, scope string, created_at long, label string, origin string")
    mappings = spark.createDataFrame([("y", "z")], "from string, to string")
    sets = spark.createDataFrame([], "export_set string")
    after = A.adopt(manifests, scopes, mappings, sets)
    assert {tuple(r) for r in after["scopes"].collect()} == {("t", "mine", 1, None, "local"), ("s", "c2", 3, "other", "import:e2")}
    assert {tuple(r) for r in after["mappings"].collect()} == {("x", "y"), ("y", "z")}
    assert [r.export_set for r in after["export_set"].collect()] == ["set2"]
    again = A.adopt(manifests, after["scopes"], after["mappings"], after["export_set"])
    assert all(sorted(map(str, again[k].collect())) == sorted(map(str, after[k].collect())) for k in after)
