"""Line numbers of broken records, senders of a person, hydrated chats, rendered messages, scopes that are one account."""

import pytest
from pyspark.sql import functions as F

from messagelake.operators import curation as K
from messagelake.operators import reads as R
from messagelake.sources import records


def test_broken_lines_have_numbers_in_any_block(spark, tmp_path):
    want = set()
    for name, n in (("a", 300), ("b", 3), ("c", 0)):
        lines = []
        for k in range(1, n + 1):
            bad = k % 7 == 2
            lines.append("" if k % 11 == 0 else f"{{broken {name} {k}" if bad else f'{{"n":{k}}}')
            want |= {(name, k)} if bad and k % 11 else set()
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        good, bad = records.read_records(spark, str(tmp_path), "n long")
        assert good.rdd.getNumPartitions() > 3
        assert {(r.file[-7], r.line) for r in bad.collect()} == want and all(str(r.line) in r.value for r in bad.collect())
        assert good.count() == sum(1 for k in range(1, 301) if k % 11 and k % 7 != 2) + 2
        every = records.numbered(records.text_lines(spark, str(tmp_path / "a.jsonl")))
        assert sorted(r.line for r in every.collect()) == list(range(1, 301))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_person_without_identities_is_an_error(spark):
    links = spark.createDataFrame([("p", "a", "confirmed"), ("p", "b", "rejected"), ("q", "b", "suggested")], "person_urn string, identity_urn string, state string")
    assert {r.sender for r in R.senders(links, "p", ["a", "x"]).collect()} == {"a", "x"}
    assert {r.sender for r in R.senders(links, "q", ["x"]).collect()} == {"x"} and R.senders(links).count() == 0
    with pytest.raises(LookupError):
        R.senders(links, "q")


def test_chats_are_hydrated(spark):
    chats = spark.createDataFrame([("c1", "group", "s", None, "x", "y"), ("c2", None, None, None, None, None)], "urn string, kind string, service string, assignment string, source string, account_scope string")
    messages = spark.createDataFrame([("c1", 5), ("c1", None), ("gone", 9), (None, 1)], "chat_urn string, utc_ms long")
    members = spark.createDataFrame([("c1", f"i{k % 7}") for k in range(20)] + [("c1", None), ("gone", "i1"), (None, "i2")], "chat_urn string, identity_urn string")
    labels = spark.createDataFrame([("c1", "Team"), ("i1", "Ann")], "urn string, label string")
    got = {r.urn: r for r in R.hydrate_chats(chats, messages, members, labels, 3).collect()}
    assert [tuple(p) for p in got["c1"].participants] == [("i0", None), ("i1", "Ann"), ("i2", None)]
    assert (got["c1"].label, got["c1"].message_count, got["c1"].last_message_utc_ms, tuple(got["c1"].provenance)) == ("Team", 2, 5, ("x", "y"))
    assert (got["c2"].label, got["c2"].message_count, got["c2"].participants) == (None, 0, []) and len(got) == 2


def test_messages_are_rendered(spark):
    schema = "urn string, ms long, sender string, mine boolean, text string, kind string, files array<struct<kind string, filename string, availability string>>, events array<struct<kind string, emoji string>>, cut boolean"
    rows = [("u1", 0, "Ann", False, "hi", "message", [("image", None, "missing")], [("reaction", "+"), ("edit", None), ("reaction_removed", None)], True), ("u2", None, None, None, None, None, None, None, None), ("u3", 60000, "Bob", True, "x", "call", [], [], False)]
    df = spark.createDataFrame(rows, schema)
    line = R.render_message(*(F.col(c) for c in ("urn", "ms", "sender", "mine", "text", "kind", "files", "events", "cut")))
    assert [r.line for r in df.select(line.alias("line")).collect()] == ["1970-01-01 00:00  Ann: hi  [attachment image  missing] [reaction +] [reaction_removed ] …[truncated]\n    u1", "?  ?: \n    u2", "1970-01-01 00:01  me: x  [call]\n    u3"]


def test_scopes_of_other_sources_are_not_one(spark):
    heads = spark.createDataFrame([("u1", "messages", "s", "a"), ("u2", "messages", "t", "b"), ("u3", "notes", "s", "a")], "urn string, kind string, source string, scope string")
    seen = spark.createDataFrame([("u1", "s", "a", "k", False), ("u1", "s", "a", "k", False), ("u3", "s", "a", "k", False), ("u1", "s", "a", None, False)], "urn string, source string, scope string, native_key string, minted boolean")
    none, known = spark.createDataFrame([], "source string, scope string"), spark.createDataFrame([], "old_urn string, new_urn string")
    for old, new in (("a", "a"), ("gone", "a"), ("a", "b")):
        with pytest.raises(ValueError):
            K.declare_same_scope(seen, heads, none, known, old, new)
    aliases, skipped = K.declare_same_scope(seen, heads, none, known, "a", "c")
    rows = aliases.collect()
    assert [(r.old_urn, r.scope, r.reason) for r in rows] == [("u1", "a", "scope_map")] and [tuple(r) for r in skipped.collect()] == [("notes", 1)]
    assert K.declare_same_scope(seen, heads, none, aliases, "a", "c")[0].count() == 0
