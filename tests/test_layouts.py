"""Trees of digests and clustered pages against plain scans, and what they read."""

import random

import pytest
from pyspark.sql import functions as F

from messagelake.operators import reads, routing
from messagelake.plans.clustered import ClusteredTable
from messagelake.plans.hashtree import TreedTable, differing, tree_compare, tree_diff

SCHEMA = "k long, v string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def same_rows(a, b):
    key = lambda r: str(r)
    return sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def test_tree_diff_equals_the_full_diff_and_reads_what_changed(spark, tmp_path):
    r = random.Random(3)
    t = TreedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], buckets=4, depth=2)
    first = t.merge(frame(spark, [(k, f"v{k % 5}" if k % 7 else None) for k in range(400)]))
    versions = [first]
    for n in range(2):
        new = [(k, f"n{n}" if k % 2 else None) for k in {r.randrange(450) for _ in range(15)}]
        gone = [(k,) for k in {r.randrange(400) for _ in range(5)} - {k for k, _ in new}]
        versions.append(t.merge(frame(spark, new), frame(spark, gone, "k long")))
    for a, b in ((0, 2), (2, 1)):
        got = tree_diff(t, t, ["v"], versions[a], versions[b])
        want = routing.diff(t.table.read(versions[a]), t.table.read(versions[b]), "k", ["v"])
        assert same_rows(got, want)
    last = t.merge(frame(spark, [(7, "single")]))
    parts, leaves = differing(t, t, versions[-1], last)
    assert len(parts) == 1 and leaves.count() == 1
    read = t.rows(versions[-1], parts, leaves)
    assert read.count() < 20 and all(f"bucket={parts[0]}/" in f for f in read.inputFiles())
    t.table.compact()
    t.update()
    assert differing(t, t, last)[0] == [] and tree_diff(t, t, ["v"], last).count() == 0


def test_tree_of_a_merge_that_crashed_catches_up(spark, tmp_path, monkeypatch):
    t = TreedTable(spark, f"{tmp_path}/t", SCHEMA, ["k"], buckets=4)
    t.merge(frame(spark, [(1, "a"), (2, "b")]))
    monkeypatch.setattr(TreedTable, "update", lambda self: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.merge(frame(spark, [(2, "c"), (3, "d")]))
    monkeypatch.undo()
    with pytest.raises(ValueError, match="no tree"):
        t.tree()
    t.update()
    assert [(r.k, r.before.v, r.after.v) for r in tree_diff(t, t, ["v"], 1, 2).where("before is not null").collect()] == [(2, "b", "c")]


def test_tree_compare_of_stores(spark, tmp_path):
    a, b, other = (TreedTable(spark, f"{tmp_path}/{n}", "urn string, digest string", ["urn"], buckets=4, depth=d) for n, d in (("a", 2), ("b", 2), ("o", 1)))
    a.merge(frame(spark, [("x", "1"), ("y", "1"), (None, "1"), ("z", "1")], "urn string, digest string"))
    b.merge(frame(spark, [("x", "1"), ("y", "2"), (None, "1"), ("w", "1")], "urn string, digest string"))
    assert tree_compare(a, b).first().asDict() == {"equal": 2, "different": 1, "only_a": 1, "only_b": 1}
    assert tree_compare(a, a).first().asDict() == {"equal": 4, "different": 0, "only_a": 0, "only_b": 0}
    with pytest.raises(ValueError, match="can't be compared"):
        differing(a, other)


ROWS = "chat string, ms long, urn long, flag boolean"


def table_of(spark, path, seed, n=300, per_file=20):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", "b", "b", None]), r.choice([None, *range(12)]), u, r.random() < 0.1) for u in range(n)]
    t = ClusteredTable(spark, path, ROWS, ("chat", "ms", "urn"), per_file)
    for k in range(3):
        t.append(frame(spark, rows[k::3], ROWS))
    return t, rows


def ordered(rows, descending):
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r[1:3])
    return sorted(rows, key=key, reverse=descending)


@pytest.mark.parametrize("descending", [False, True])
def test_pages_of_a_chat_follow_each_other(spark, tmp_path, descending):
    t, rows = table_of(spark, f"{tmp_path}/t", 5)
    for chat in ("b", None):
        got, after = [], None
        while True:
            page = ordered([tuple(r) for r in t.page(80, after, descending, (chat,)).collect()], descending)
            got += page[:80]
            if len(page) <= 80:
                break
            after = page[79][1:3]
        assert got == ordered([r for r in rows if r[0] == chat], descending)
    assert t.page(5, None, descending, ("none",)).count() == 0


def test_pages_with_a_condition_and_what_they_read(spark, tmp_path):
    t, rows = table_of(spark, f"{tmp_path}/t", 6, 600, 10)
    want = ordered([r for r in rows if r[0] == "b" and r[3]], False)[:6]
    assert ordered([tuple(r) for r in t.page(5, None, False, ("b",), F.col("flag")).collect()], False) == want
    t.rewrite()
    files = t.bounds.read().count()
    page = t.page(5, (3, 0), False, ("b",))
    assert files > 30 and len(page.inputFiles()) <= 4
    plain = reads.page(frame(spark, rows, ROWS).where("chat = 'b'"), [("ms", False), ("urn", False)], 5, (3, 0))
    assert same_rows(page, plain)
    assert ClusteredTable(spark, f"{tmp_path}/none", ROWS, ("chat", "ms", "urn")).page().count() == 0


def test_a_run_without_bounds_is_not_there(spark, tmp_path, monkeypatch):
    t, rows = table_of(spark, f"{tmp_path}/t", 7, 60)
    monkeypatch.setattr(type(t.bounds), "write", lambda self, df: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.append(frame(spark, [("b", 1, 999, True)], ROWS))
    assert t.read().count() == 60
