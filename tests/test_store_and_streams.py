"""Merge rules, journal, sources and streams on small tables."""

import os
import unicodedata
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from messagelake.functions import scalars
from messagelake.operators import reads, store
from messagelake.plans.mergeable import MergeTable
from messagelake.plans.state import VersionedTable
from messagelake.sources import native, records
from messagelake.streaming import streams


def test_live_upsert_follows_a_b_a(spark):
    heads = spark.createDataFrame([("u", "A", 1), ("v", "A", 5)], "urn string, digest string, observed_at long")
    batch = spark.createDataFrame([("u", "B", 2, 0), ("u", "A", 3, 1), ("u", "A", 4, 2), ("w", "C", 1, 3)], "urn string, digest string, observed_at long, pos long")
    after, outcomes = store.upsert_live(batch, heads)
    assert sorted(tuple(r) for r in after.collect()) == [("u", "A", 4), ("v", "A", 5), ("w", "C", 1)]
    assert [r.outcome for r in outcomes.orderBy("pos").collect()] == ["updated", "updated", "unchanged", "inserted"]


def test_import_keeps_unknown_heads(spark):
    heads = spark.createDataFrame([(k, "A", 5) for k in "abcd"], "urn string, digest string, observed_at long")
    batch = spark.createDataFrame([("a", "B", 6), ("b", "B", 4), ("c", "B", 9), ("d", "A", 9), ("e", "A", 1)], "urn string, digest string, observed_at long")
    prior = spark.createDataFrame([("a", "A"), ("b", "A")], "urn string, digest string")
    after, outcomes = store.upsert_import(batch, heads, prior)
    assert dict(tuple(r) for r in outcomes.collect()) == {"a": "updated", "b": "older", "c": "conflict", "d": "unchanged", "e": "inserted"}
    assert {r.urn: (r.digest, r.observed_at) for r in after.collect()} == {"a": ("B", 6), "b": ("A", 5), "c": ("A", 5), "d": ("A", 9), "e": ("A", 1)}


def test_observations(spark):
    kind = "urn string, source string, scope string, native_table string, native_row_ids array<string>, native_key string, minted boolean, fingerprint string, adapter_version string, present string, observed_at long"
    row = lambda u, f, at: (u, "s", "c", "t", ["1"], None, False, f, "1", "present", at)
    stored = spark.createDataFrame([row("a", "x", 1), row("b", "x", 1)], kind)
    batch = spark.createDataFrame([row("a", "x", 2), row("b", "y", 0), row("c", "z", 2)], kind)
    after, written = store.observe_live(batch, stored)
    assert sorted(r.urn for r in written.collect()) == ["b", "c"]
    assert {r.urn: (r.fingerprint, r.observed_at) for r in after.collect()} == {"a": ("x", 2), "b": ("y", 0), "c": ("z", 2)}
    assert {r.urn: r.fingerprint for r in store.observe_merge(batch, stored).collect()} == {"a": "x", "b": "x", "c": "z"}


def test_sequence_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = [(r.x, r.seq) for r in store.sequenced(df, ["x"]).collect()]
    assert sorted(s for _, s in got) == list(range(1, 1001))
    assert [x for x, _ in sorted(got, key=lambda p: p[1])] == sorted(x for x, _ in got)


def test_batch_with_an_oversized_event(spark):
    j = spark.createDataFrame([(1, "x" * 10), (2, "x" * 100)], "seq long, data string")
    assert [r.seq for r in store.next_batch(j, 0, 10, 50).where("seq < 2").collect()] == [1]
    with pytest.raises(Exception, match="larger"):
        store.next_batch(j, 1, 10, 50).collect()


def test_cursor_and_page(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 7)], "urn long, utc_ms long")
    order = [("utc_ms", False), ("urn", False)]
    assert reads.decode_cursor(reads.encode_cursor(5, 2)) == (5, 2)
    assert [r.urn for r in reads.page(df, order, 2).collect()] == [1, 2, 3]
    assert [r.urn for r in reads.page(df, order, 2, (5, 2)).collect()] == [3, 4]
    assert [r.urn for r in reads.page(df, order, 2, (None, 1)).collect()] == [2, 3, 4]
    with pytest.raises(ValueError):
        reads.decode_cursor("!")


def test_literal_search_folds_case_and_accents(spark):
    df = spark.createDataFrame([(1, "Über-den Fluß!"), (2, "uber den"), (3, None)], "id long, text string")
    ids = lambda q: sorted(r.id for r in df.where(reads.literal("text", q)).collect())
    assert ids("über") == ids("U\u0308BER") == ids("uber") == [1, 2] and ids("über-den") == [1, 2] and ids("fluß") == [1] and ids("  ") == [] and ids("!") == []


def test_keys_are_composed_and_nested_keys_in_order(spark):
    texts = ["cafe\u0301", "café", "e\u0302\u0301x", "plain", "漢字", "a\u0323\u0302"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: (r.u, r.c) for r in scalars.in_nfc(df).select("id", scalars.urn("s", "c", "message", F.col("text")).alias("u"), F.col("text").alias("c")).collect()}
    assert got[0][0] == got[1][0] and all(got[k][1] == unicodedata.normalize("NFC", t) for k, t in enumerate(texts))
    nested = spark.sql("SELECT named_struct('b', named_struct('z', 1, 'a', array(named_struct('y', 2, 'c', null))), 'a', 3) AS s").select("s.*")
    assert nested.select(scalars.canonical_json({c: F.col(c) for c in nested.columns}, nested.schema).alias("j")).first().j == '{"a":3,"b":{"a":[{"c":null,"y":2}],"z":1}}'
    raw = spark.createDataFrame([(b"x",)], "b binary").select(scalars.fingerprint("b", binary=(0,)).alias("f"), scalars.fingerprint("b").alias("g")).first()
    assert raw.f != raw.g


def test_resolve_decides_by_digest_first(spark):
    heads = spark.createDataFrame([("a", "d2", True, False), ("s", "d1", False, True), ("h", "d1", False, False)], "urn string, digest string, tombstoned boolean, stub boolean")
    revisions = spark.createDataFrame([("a", "d1"), ("a", "d2")], "urn string, digest string")
    aliases = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(30)] + [("c30", "h"), ("x", "y"), ("y", "x"), ("m", "a"), ("m", "h"), ("h", "a")], "old_urn string, new_urn string")
    asked = [("a", None), ("a", "d2"), ("a", "d1"), ("a", "d9"), ("s", None), ("h", "d1"), ("c0", "d1"), ("c7", "d3"), ("x", None), ("m", None), ("?", None)]
    got = {(r.urn, r.digest): (r.status, r.resolved_urn) for r in reads.resolve(spark.createDataFrame(asked, "urn string, digest string"), heads, revisions, aliases).collect()}
    want = ["tombstoned", "tombstoned", "revision_superseded", "unknown_revision", "unavailable", "current", "current", "unknown_revision", "unknown", "ambiguous", "unknown"]
    assert [got[k][0] for k in asked] == want and got["c0", "d1"][1] == "h"


def test_replay_follows_previous_digests(spark):
    heads = spark.createDataFrame([("u", "A", 5), ("v", "A", 5)], "urn string, digest string, observed_at long")
    records = spark.createDataFrame([("u", 1, "B", "A", 6), ("u", 2, "C", "A", 7), ("u", 3, "B", None, 9), ("u", 4, "D", "B", 8), ("v", 5, "B", "A", 4), ("w", 6, "A", None, 1)], "urn string, seq long, digest string, previous string, observed_at long")
    after, told = store.replay_records(records, heads)
    assert [r.outcome for r in told.orderBy("seq").collect()] == ["updated", "conflict", "unchanged", "older", "older", "inserted"]
    assert {r.urn: (r.digest, r.observed_at) for r in after.collect()} == {"u": ("B", 9), "v": ("A", 5), "w": ("A", 1)}


def test_context_around_one_message(spark):
    df = spark.createDataFrame([("c", f"m{k}", None if k < 2 else k) for k in range(9)] + [("d", "x", 3)], "chat_urn string, urn string, utc_ms long")
    got = {(r.urn, r.offset) for r in reads.around(df, "m4", 2, 3).collect()}
    assert got == {("m2", -2), ("m3", -1), ("m4", 0), ("m5", 1), ("m6", 2), ("m7", 3)}
    many = {(r.urn, r.offset) for r in reads.neighbours(df, spark.createDataFrame([("m4",), ("x",)], "anchor string"), 2, 3).collect()}
    assert many == got | {("x", 0)} and reads.around(df, "none", 1, 1).count() == 0


def test_required_columns_and_framing(spark):
    with pytest.raises(native.MissingColumns, match="messages.ZTEXT"):
        native.check_required({k: spark.createDataFrame([], ", ".join(f"{c} string" for c in v if c != "ZTEXT")) for k, v in native.REQUIRED_A.items()}, native.REQUIRED_A)
    rows = lambda said: spark.createDataFrame([("header", None, None, "p"), ("message", 1, None, None), ("message", 2, None, None), ("footer", None, said, None)], "type string, rowid long, rows long, policy string")
    assert native.check_framing(rows(2)).count() == 2
    assert native.merge_decoded([rows(2), rows(2)], 4).count() == 4
    for bad in (lambda: native.check_framing(rows(3)), lambda: native.check_framing(rows(2), spark.createDataFrame([(9,)], "rowid long")), lambda: native.merge_decoded([rows(2)], 3)):
        with pytest.raises(ValueError):
            bad()


def test_records_round_trip_and_bad_lines(spark, tmp_path):
    df = spark.createDataFrame([("b", "2", None), ("a", "1", 5)], "urn string, revision_digest string, n long")
    records.write_records(df, f"{tmp_path}/r")
    with open(f"{tmp_path}/r/part-bad.txt", "w") as f:
        f.write("{broken\n")
    good, bad = records.read_records(spark, f"{tmp_path}/r", "n long, revision_digest string, urn string")
    assert sorted((r.urn, r.n) for r in good.collect()) == [("a", 5), ("b", None)]
    assert [r.value for r in bad.collect()] == ["{broken"]
    with pytest.raises(Exception):
        records.write_records(df, f"{tmp_path}/r")


def test_media_and_alias_sources(spark, tmp_path):
    os.makedirs(f"{tmp_path}/m/x")
    with open(f"{tmp_path}/m/x/a.bin", "wb") as f:
        f.write(b"abc")
    got = native.probe_media(spark, f"{tmp_path}/m", spark.createDataFrame([("x/a.bin",), ("x/b.bin",)], "path string"))
    assert {r.path: r["size"] for r in got.collect()} == {"x/a.bin": 3, "x/b.bin": None}
    spark.createDataFrame([("l", "p"), ("l", None)], "ZLID string, ZP string").write.parquet(f"{tmp_path}/al")
    pairs, absent = native.read_alias_sources(spark, {"one": (f"{tmp_path}/al", "ZLID", "ZP"), "two": (f"{tmp_path}/none", "ZLID", "ZP")})
    assert [tuple(r) for r in pairs.collect()] == [("l", "p", "one")] and absent == ["two"]


def test_feed_batches_survive_a_crash_and_replay_once(spark, tmp_path):
    journal = spark.createDataFrame([(n, "p", "record", f"u{n % 3}", n, f"d{n}") for n in range(1, 8)], "seq long, producer string, operation string, urn string, observed_at long, data string")
    first = records.write_feed_batch(journal, f"{tmp_path}/feed", "s", 0, 4, 1000)
    assert first == records.write_feed_batch(journal, f"{tmp_path}/feed", "s", 0, 4, 1000)
    second = records.write_feed_batch(journal, f"{tmp_path}/feed", "s", first[0], 4, 1000)
    assert records.write_feed_batch(journal, f"{tmp_path}/feed", "s", second[0], 4, 1000) is None
    schema = "seq long, producer string, operation string, urn string, observed_at long, data string"
    again = records.read_feed(spark, [first[1], second[1], first[1]])
    assert sorted(r.seq for r in again.collect()) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 7]
    feed = again.dropDuplicates(["seq"]).select(*(c.split()[0] for c in schema.split(", ")))
    own = Window.partitionBy("urn").orderBy("seq")
    feed.withColumn("digest", F.col("data")).withColumn("previous", F.lag("data").over(own)).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    heads, applied = MergeTable(spark, f"{tmp_path}/heads", streams.HEADS, ["urn"]), VersionedTable(spark, f"{tmp_path}/applied")
    for run in range(2):  # two consumers of one ledger: the second finds all events applied
        streams.stream_replay(streams.file_stream(spark, f"{tmp_path}/in/*", schema + ", digest string, previous string"), applied, heads, f"{tmp_path}/c{run}", f"consumer{run}")
        assert {r.urn: (r.data, r.seq) for r in heads.read().collect()} == {"u0": ("d6", 6), "u1": ("d7", 7), "u2": ("d5", 5)}
        assert applied.appended(streams.LEDGER).count() == 7


KIND = "producer string, seq long, operation string, urn string, observed_at long, data string, digest string, previous string"


def fed(spark, path, rows):
    spark.createDataFrame([("p", n, "record", u, at, d, d, p) for n, u, at, d, p in rows], KIND).coalesce(1).write.mode("append").parquet(path)


def test_unrelated_edits_stay_and_old_events_move_nothing(spark, tmp_path):
    heads, applied = MergeTable(spark, f"{tmp_path}/heads", streams.HEADS, ["urn"], buckets=4), VersionedTable(spark, f"{tmp_path}/applied")
    run = lambda: streams.stream_replay(streams.file_stream(spark, f"{tmp_path}/feed", KIND), applied, heads, f"{tmp_path}/c", outcomes=lambda df, i: told.update({r.seq: r.outcome for r in df.collect()}))
    told, now = {}, lambda: {r.urn: r.data for r in heads.read().collect()}
    fed(spark, f"{tmp_path}/feed", [(1, "u", 100, "A", None), (2, "v", 5, "first", None)])
    run()
    store.merge_live(MergeTable(spark, f"{tmp_path}/heads2", "urn string, digest string, observed_at long", ["urn"]), spark.createDataFrame([("u", "x", 1, 1)], "urn string, digest string, observed_at long, pos long"))
    fed(spark, f"{tmp_path}/feed", [(3, "u", 5, "late", "A"), (4, "v", 6, "second", "first"), (4, "v", 6, "second", "first"), (5, "v", 7, "stray", "first"), (6, "v", 8, "first", "second")])
    run()
    assert now() == {"u": "A", "v": "first"} and told == {1: "inserted", 2: "inserted", 3: "older", 4: "updated", 5: "conflict", 6: "updated"}
    assert applied.appended(streams.LEDGER).count() == 6
    before = heads.versions()[-1]
    fed(spark, f"{tmp_path}/feed", [(7, "v", 9, "third", "first")])
    run()
    assert now() == {"u": "A", "v": "third"} and {b for b, f in heads.manifest()["files"].items() if f != heads.manifest(before)["files"].get(b)} == {str(heads.touched(spark.createDataFrame([("v",)], "urn string"))[0])}
    fed(spark, f"{tmp_path}/feed", [(2, "v", 5, "other", None)])
    with pytest.raises(Exception, match="other content"):
        run()


def test_a_batch_that_failed_before_the_ledger_comes_again(spark, tmp_path, monkeypatch):
    heads, applied = MergeTable(spark, f"{tmp_path}/heads", streams.HEADS, ["urn"]), VersionedTable(spark, f"{tmp_path}/applied")
    run = lambda: streams.stream_replay(streams.file_stream(spark, f"{tmp_path}/feed", KIND), applied, heads, f"{tmp_path}/c")
    fed(spark, f"{tmp_path}/feed", [(1, "u", 1, "A", None), (2, "u", 2, "B", "A"), (3, "u", 3, "A", "B")])
    monkeypatch.setattr(applied, "append", lambda df: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.undo()
    versions = heads.versions()
    run()
    assert heads.versions() == versions and applied.appended(streams.LEDGER).count() == 3
    assert [(r.data, r.seq) for r in heads.read().collect()] == [("A", 3)]


def test_kept_heads_of_a_stream(spark, tmp_path):
    for k, v in streams.STATE_STORE.items():
        spark.conf.set(k, v)
    rows = [("a", "A", None, 1, 0, False), ("a", "B", "A", 2, 1, False), ("a", "C", "A", 3, 2, False), ("a", "C", "B", 1, 3, False), ("a", "D", None, 0, 4, True)]
    schema = "urn string, digest string, previous string, observed_at long, pos long, live boolean"
    spark.createDataFrame([(1, *r[1:]) for r in rows], "urn long, " + schema.split(", ", 1)[1]).coalesce(1).write.parquet(f"{tmp_path}/h")
    stream = streams.stream_heads(streams.file_stream(spark, f"{tmp_path}/h", "urn long, " + schema.split(", ", 1)[1]))
    streams.run_available(stream, lambda df, i: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{i}"), f"{tmp_path}/hc", "update")
    assert [r.outcome for r in spark.read.parquet(f"{tmp_path}/out/*").orderBy("pos").collect()] == ["inserted", "updated", "conflict", "older", "updated"]


def test_stream_of_table_versions(spark, tmp_path):
    for v, rows in enumerate([[(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")]]):
        spark.createDataFrame([(v, *r) for r in rows], "version int, k int, x string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/v")
    seen = []
    state = MergeTable(spark, f"{tmp_path}/state-{uuid.uuid4().hex}", "k int, x string", ["k"])
    streams.stream_changes(streams.file_stream(spark, f"{tmp_path}/v", "version int, k int, x string"), state, lambda df, i: seen.extend((r.version, r.k) for r in df.collect()), "k", ["x"], f"{tmp_path}/c")
    assert sorted(seen) == [(0, 1), (0, 2), (1, 2), (1, 3)]
