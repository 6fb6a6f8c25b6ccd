"""Edges of projections, coverage, runs and purging that the queries over the tables don't meet."""

import pytest

from messagelake.operators import archive, curation, projections, reads, routing, store
from messagelake.plans.mergeable import MergeTable
from messagelake.plans.state import VersionedTable
from messagelake.streaming import streams


def test_projection_of_broken_and_empty_records(spark):
    rows = [("a", "messages", '{"sent_at":{},"received_at":{"utc_ms":7},"text":"x","tombstone":false}'), ("b", "messages", "no json"), ("c", "messages", None), ("d", "events", '{"at":null}'), ("e", "messages", '{"sent_at":{"raw":1},"received_at":{"utc_ms":7},"tombstone":true,"text":"x"}')]
    heads = spark.createDataFrame(rows, "urn string, kind string, record string")
    got = {r.urn: (r.utc_ms, r.text, r.is_from_me) for r in projections.project_messages(heads).collect()}
    assert got == {"a": (7, "x", False), "b": (None, None, False), "c": (None, None, False), "e": (None, None, False)}
    assert [tuple(r) for r in projections.project_events(heads).collect()] == [("d", None, None, None, None)]
    assert projections.project(heads, "aliases").count() == 0


def test_retained_ranges_must_hold_what_is_withdrawn(spark):
    kind = "kind string, lo long, hi long"
    prior = spark.createDataFrame([("record", 1, 9)], kind)
    assert [(r.lo, r.hi) for r in routing.retained(prior, spark.createDataFrame([("record", 3, 4)], kind)).orderBy("lo").collect()] == [(1, 2), (5, 9)]
    for bad in ([("record", 8, 10)], [("observation", 1, 1)]):
        with pytest.raises(ValueError):
            routing.retained(prior, spark.createDataFrame(bad, kind))
    fresh = spark.createDataFrame([("record", 1, 20, 5, "old")], f"{kind}, at long, run string")
    out = routing.finish_coverage(prior, spark.createDataFrame([("record", 3, 4)], kind), spark.createDataFrame([("record", 4, 4)], kind), fresh, 6, "new")
    assert [(r.lo, r.hi) for r in out["absent"].collect()] == [(3, 3)]
    assert [(r.lo, r.hi, r.run) for r in out["fresh"].orderBy("lo").collect()] == [(1, 2, "new"), (3, 4, "old"), (5, 9, "new"), (10, 20, "old")]


def test_resight_of_nothing_changes_nothing(spark):
    fresh = spark.createDataFrame([("record", 1, 2, 5, "old")], "kind string, lo long, hi long, at long, run string")
    after, events = routing.resight(spark.createDataFrame([], "kind string, lo long, hi long"), fresh, 6, "new")
    assert [tuple(r) for r in after.collect()] == [("record", 1, 2, 5, "old")] and events.count() == 0


def test_marks_keep_nulls_and_extra_columns(spark):
    rows = [(1, "present", 3, "r", "x"), (2, None, None, None, "y"), (None, "present", 3, "r", "z")]
    o = spark.createDataFrame(rows, "id long, present string, observed_at long, sync_run string, _extra string")
    gone = spark.createDataFrame([("observation", 1, 2)], "kind string, lo long, hi long")
    got = sorted((tuple(r) for r in routing.mark_withdrawn(o, gone, 9, "n").collect()), key=lambda r: r[4])
    assert got == [(1, "absent_from_source", 9, "n", "x"), (2, None, None, None, "y"), (None, "present", 3, "r", "z")]


def test_a_failed_run_keeps_the_checkpoint(spark, tmp_path):
    runs = VersionedTable(spark, f"{tmp_path}/runs")
    assert streams.last_checkpoint(runs) is None
    assert streams.run_once(runs, "a", 1, lambda before: f"{before}!") == "None!"
    with pytest.raises(ZeroDivisionError):
        streams.run_once(runs, "b", 2, lambda before: str(1 / 0))
    assert streams.last_checkpoint(runs) == "None!"
    assert streams.run_once(runs, "c", 3, lambda before: f"{before}!") == "None!!"
    assert sorted(r.status for r in runs.appended(streams.RUNS).collect()) == ["complete", "complete", "failed", "running", "running", "running"]


def test_purged_heads_are_gone(spark, tmp_path):
    heads = MergeTable(spark, f"{tmp_path}/heads", "urn string, n int", ["urn"])
    gone = spark.createDataFrame([("u",), ("u",), (None,)], "urn string")
    streams.purge_heads(heads, gone)
    assert heads.read().count() == 0
    heads.merge(spark.createDataFrame([("u", 1), ("v", 2)], "urn string, n int"))
    streams.purge_heads(heads, gone)
    assert [tuple(r) for r in heads.read().collect()] == [("v", 2)]


def test_purge_of_a_source_spares_unknown_ones(spark):
    records = spark.createDataFrame([("a", 1, "s", "x"), ("b", 2, None, "x"), ("c", 3, "s", "y")], "urn string, id long, source string, scope string")
    fresh = spark.createDataFrame([("record", 1, 3, 5, "r")], "kind string, lo long, hi long, at long, run string")
    marks = spark.createDataFrame([("s", "x", 1), ("t", "x", 2)], "source string, scope string, v int")
    out = curation.purge_source({"parts": spark.createDataFrame([("a",), ("b",)], "urn string")}, records, fresh, marks, "s")
    assert sorted(r.urn for r in out["records"].collect()) == ["b"] and [r.urn for r in out["parts"].collect()] == ["b"]
    assert [(r.lo, r.hi) for r in out["fresh"].collect()] == [(2, 2)] and [r.source for r in out["checkpoints"].collect()] == ["t"]


def test_chats_page_past_a_cursor_without_time(spark):
    chats = spark.createDataFrame([(1, "a", "One"), (2, "a", "Two"), (3, "a", None)], "urn long, source string, label string")
    m = spark.createDataFrame([(1, "message", 5), (2, "system", 9)], "chat_urn long, kind string, utc_ms long")
    members = spark.createDataFrame([(3, "p", "Tw"), (3, "p", "tw"), (2, "q", None)], "chat_urn long, identity_urn string, label string")
    assert [(r.urn, r.n) for r in reads.list_chats(chats, m, members).collect()] == [(1, 1), (2, 0), (3, 0)]
    assert [r.urn for r in reads.list_chats(chats, m, members, after=(None, 2)).collect()] == [3]
    assert [r.urn for r in reads.list_chats(chats, m, members, label="tw").collect()] == [2, 3]
    assert reads.list_chats(chats, m, members, participants=[]).count() == 0


def test_member_digest_is_over_lines_in_name_order(spark):
    import hashlib

    members = spark.createDataFrame([("x", "b", "2"), ("x", "a", "1")], "archive string, name string, sha256 string")
    row = archive.member_digest(members, ["archive"]).first()
    assert row["digest"] == hashlib.sha256(b"a\x001\nb\x002\n").hexdigest() and row["members"] == 2


def test_events_of_equal_stores_are_none(spark):
    kind = "urn string, id long, digest string, record string, observed_at long, sync_run string, supersedes string"
    t = spark.createDataFrame([("a", 1, "d", None, 1, None, None)], kind)
    o = spark.createDataFrame([], "id long, urn string, source string, scope string, native_table string, native_row_ids array<string>, native_key string, minted boolean, fingerprint string, adapter_version string, present string, observed_at long, sync_run string")
    same = {"records": t, "revisions": t, "observations": o}
    assert store.capture_events(same, same).count() == 0
    assert sorted(r.operation for r in store.capture_events(same | {"records": t.limit(0)}, same).collect()) == ["record"]
