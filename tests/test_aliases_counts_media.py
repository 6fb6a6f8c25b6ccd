"""Alias groups against a plain union, counts of a stream with deletes and a restart, media that is large or known."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from messagelake.operators import aliases
from messagelake.operators.extract_a import owner_closure
from messagelake.plans.mergeable import MergeTable
from messagelake.sources import native
from messagelake.streaming import streams


def plain_groups(pairs):
    at = {}

    def find(x):
        while at.setdefault(x, x) != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            lo, hi = sorted((find(a), find(b)))
            at[hi] = lo
    return {x: find(x) for x in list(at)}


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "lid string, phone string")


def test_chain_circle_hub_and_singles(spark):
    r = random.Random(2)
    names = [f"c{n:05}" for n in r.sample(range(10000), 300)]
    rows = list(zip(names, names[1:], strict=False))
    rows += [(f"r{n}", f"r{(n + 1) % 9}") for n in range(9)] + [("zhub", f"h{n}") for n in range(500)]
    rows += [("self", "self"), ("self", "self"), (None, "x"), ("y", None), ("r1", "r1")]
    r.shuffle(rows)
    got = {t.member: t.root for t in aliases.groups(pairs_of(spark, rows), "lid", "phone").collect()}
    assert got == plain_groups(rows)


def test_no_pairs(spark):
    assert aliases.groups(pairs_of(spark, []), "lid", "phone").count() == 0


def test_increments_equal_the_whole(spark, tmp_path):
    r = random.Random(4)
    t, seen = MergeTable(spark, f"{tmp_path}/m", aliases.MEMBERS, ["member"], 4), []
    for n in range(2):
        rows = [(f"a{r.randrange(60):02}", f"a{r.randrange(60):02}") for _ in range(15)] + [(None, "q")]
        seen += rows
        aliases.add_aliases(t, pairs_of(spark, rows), "lid", "phone", number=n)
        version = t.versions()[-1]
        assert aliases.add_aliases(t, pairs_of(spark, [("a00", "other")]), "lid", "phone", number=n) == version  # it comes again
        assert {x.member: x.root for x in t.read().collect()} == plain_groups(seen)


def test_owners_over_chains(spark):
    messages = spark.createDataFrame([(0, "a@s.whatsapp.net"), (1, "b@s.whatsapp.net"), (0, None)], "ZISFROMME int, ZTOJID string")
    pairs = pairs_of(spark, [("a@s.whatsapp.net", "c@lid"), ("c@lid", "d@s.whatsapp.net"), ("x@lid", "b@s.whatsapp.net")])
    want = {"a@s.whatsapp.net", "c@lid", "d@s.whatsapp.net"}
    assert {r.jid for r in owner_closure(messages, pairs).collect()} == want
    assert {r.jid for r in owner_closure(messages, pairs, aliases.groups(pairs, "lid", "phone")).collect()} == want


def test_counts_with_edits_moves_deletes_and_a_restart(spark, tmp_path):
    for k, v in streams.STATE_STORE.items():
        spark.conf.set(k, v)
    schema, r, now = "urn long, before string, after string", random.Random(8), {}
    counts = MergeTable(spark, f"{tmp_path}/counts", streams.COUNTS, ["scope", "share"], 2)
    for n in range(3):  # each round is a start of its own from the same checkpoint
        rows = []
        for urn in range(60):
            was = now.get(urn)
            will = r.choice([None, "a", "a", "b", "c"]) if n < 2 else r.choice([None, "a", None])
            rows.append((urn, was, will))
            now[urn] = will
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")
        feed = streams.file_stream(spark, f"{tmp_path}/changes", schema, 1)
        streams.stream_signed_counts(feed, counts, f"{tmp_path}/checkpoint", shares=3)
        live = [s for s in now.values() if s is not None]
        assert {x.scope: x.n for x in streams.live_counts(counts).collect()} == {s: live.count(s) for s in set(live)}
    assert {x.scope for x in counts.read().collect()} == {"a"}  # scopes at zero leave the table


def test_media_that_is_large_unwanted_or_known(spark, tmp_path):
    root = f"{tmp_path}/m (1)+x"
    os.makedirs(f"{root}/x")
    for name, data in (("a.bin", b"abc"), ("ä %41.bin", b"odd"), ("empty", b""), ("no.bin", b"unwanted")):
        with open(f"{root}/x/{name}", "wb") as f:
            f.write(data)
    with open(f"{root}/big", "wb") as f:
        f.truncate(3 << 30)  # sparse, above what one row of bytes can hold
    os.chmod(f"{root}/x/no.bin", 0)
    names = ["x/a.bin", "x/ä %41.bin", "x/empty", "big", "gone", "x/a.bin"]
    refs = spark.createDataFrame([(n, k) for k, n in enumerate(names)] + [(None, 9)], "path string, k int")
    got = native.probe_media(spark, root, refs).cache()
    h = hashlib.sha256()
    for _ in range(3 << 10):
        h.update(bytes(1 << 20))
    sha = {n: hashlib.sha256(d).hexdigest() for n, d in (("x/a.bin", b"abc"), ("x/ä %41.bin", b"odd"), ("x/empty", b""))} | {"big": h.hexdigest()}
    assert sorted((r.k, r.sha256) for r in got.collect()) == sorted([(k, sha.get(n)) for k, n in enumerate(names)] + [(9, None)], key=lambda t: t[0])
    known = got.select("path", "size", "modified", F.lit("kept").alias("sha256")).where("size is not null")
    with open(f"{root}/x/a.bin", "wb") as f:
        f.write(b"changed")
    again = {r.path: r.sha256 for r in native.probe_media(spark, root, refs, known).collect()}
    assert again["big"] == again["x/ä %41.bin"] == "kept" and again["x/empty"] == sha["x/empty"] and again["gone"] is None and again["x/a.bin"] == hashlib.sha256(b"changed").hexdigest()


def test_listing_of_an_empty_reference_table(spark, tmp_path):
    with open(f"{tmp_path}/a", "wb") as f:
        f.write(b"1")
    assert native.probe_media(spark, str(tmp_path), spark.createDataFrame([], "path string")).count() == 0
    assert [(r.path, r["size"]) for r in native.list_media(spark, f"file://{tmp_path}").collect()] == [("a", 1)]
    with pytest.raises(Exception):
        native.list_media(spark, f"{tmp_path}/none").count()
