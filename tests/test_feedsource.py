"""The feed as a stream source and the bucket as a sink: order, consumers, gaps, forks, changed files, failed tasks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from messagelake.plans.mergeable import MergeTable
from messagelake.sources import feedsource as S


def journal(spark, n):
    return spark.range(1, n + 1).select(F.col("id").alias("seq"), F.lit("p").alias("producer"), F.lit("record").alias("operation"), F.concat(F.lit("u"), F.col("id") % 3).alias("urn"), F.col("id").alias("observed_at"), F.concat(F.lit('{"é":'), F.col("id"), F.lit("}")).alias("data"))


def test_consumers_stand_at_their_own_places(spark, tmp_path):
    feed, table = f"{tmp_path}/feed", MergeTable(spark, f"{tmp_path}/consumers", S.CONSUMERS, ["consumer"])
    seen = {"a": [], "b": []}
    run = lambda who, **more: S.consume(spark, feed, "p", table, who, "text", f"{tmp_path}/c", lambda df, n: seen[who].append(sorted(r.seq for r in df.collect())), **more)
    places = lambda: {r.consumer: r.sequence for r in table.read().collect()}
    assert S.publish(journal(spark, 25), feed, "p", limit=10) == 25
    assert S.publish(journal(spark, 25), feed, "p", limit=10) is None
    run("a")
    assert sum(seen["a"], []) == list(range(1, 26)) and places() == {"a": 25}
    assert S.publish(journal(spark, 32), feed, "p", limit=10) == 32
    run("a")
    run("b", after="25")
    assert sum(seen["a"], []) == list(range(1, 33)) and sum(seen["b"], []) == list(range(26, 33)) and places() == {"a": 32, "b": 32}
    with pytest.raises(ValueError, match="policy"):
        S.consume(spark, feed, "p", table, "a", "media", f"{tmp_path}/c", lambda df, n: None)
    with pytest.raises(ValueError, match="after 32"):
        S.publish(journal(spark, 40).where("seq != 36"), feed, "p", limit=10)
    with pytest.raises(Exception, match="smaller limit"):
        S.publish(journal(spark, 40), feed, "p", limit=10, max_bytes=50)


@pytest.mark.parametrize("fault,said", [("gap", "gap"), ("fork", "fork"), ("content", "head names"), ("parent", "follows another")])
def test_broken_feeds_are_errors(spark, tmp_path, fault, said):
    feed = f"{tmp_path}/feed"
    S.publish(journal(spark, 30), feed, "p", limit=10)
    names = sorted(n for n in os.listdir(feed) if n.endswith(".json"))
    if fault == "gap":
        os.remove(f"{feed}/{names[1]}")
    elif fault == "fork":
        head = json.load(open(f"{feed}/{names[1]}"))
        json.dump(head | {"through": 19}, open(f"{feed}/p-{10:020d}-{19:020d}.json", "w"))
    elif fault == "content":
        with open(f"{feed}/{names[1]}l", "a") as f:
            f.write("{}\n")
    else:
        head = json.load(open(f"{feed}/{names[2]}"))
        json.dump(head | {"parent_sha256": "0"}, open(f"{feed}/{names[2]}", "w"))
    table = MergeTable(spark, f"{tmp_path}/consumers", S.CONSUMERS, ["consumer"])
    with pytest.raises(Exception, match=said):
        S.consume(spark, feed, "p", table, "a", "text", f"{tmp_path}/c", lambda df, n: df.count())


def test_admission_by_batches_and_bytes(tmp_path, spark):
    feed = f"{tmp_path}/feed"
    S.publish(journal(spark, 50), feed, "p", limit=10)
    size = json.load(open(f"{feed}/{sorted(n for n in os.listdir(feed) if n.endswith('.json'))[0]}"))["bytes"]
    for more, want in (({"maxBatches": "2"}, [20, 40, 50]), ({"maxBytes": str(int(size * 1.5))}, [10, 20, 30, 40, 50]), ({"maxBytes": "1"}, [10, 20, 30, 40, 50])):
        reader = S.FeedReader({"path": feed, "producer": "p"} | more)
        at, ends = reader.initialOffset(), []
        reader.partitions(at, at)
        while (end := reader.latestOffset()) != at:
            assert [b.through for b in reader.partitions(at, end)][-1] == end["seq"]
            at = end
            ends.append(end["seq"])
        assert ends == want


def test_many_small_batches_share_tasks_and_one_publication(spark, tmp_path, monkeypatch):
    """Each batch was read by a task of its own, and each round of a publication read all heads and the whole journal anew."""
    feed, heads, chain = f"{tmp_path}/feed", [], S.chain
    monkeypatch.setattr(S, "chain", lambda *a: heads.append(1) or chain(*a))
    assert S.publish(journal(spark, 995), feed, "p", 10, None) == 995 and len(heads) == 1
    assert S.publish(journal(spark, 995), feed, "p", 10, None) is None
    by_rounds = f"{tmp_path}/rounds"
    while S.publish(journal(spark, 995), by_rounds, "p", 10, 40) is not None:
        pass
    assert [open(f"{feed}/{n}").read() for n in sorted(os.listdir(feed))] == [open(f"{by_rounds}/{n}").read() for n in sorted(os.listdir(by_rounds))]
    reader = S.FeedReader({"path": feed, "producer": "p"})
    parts = reader.partitions({"seq": 0}, {"seq": 995})
    assert len(parts) == 1 and [b.through for b in parts[0].files] == [*range(10, 1000, 10), 995]
    monkeypatch.setattr(S, "TASK_BYTES", 2500)
    cut = reader.partitions({"seq": 0}, {"seq": 995})
    size = lambda p: sum(os.path.getsize(f.path) for f in p.files)
    assert [f for p in cut for f in p.files] == parts[0].files and len(cut) > 20 and max(map(size, cut)) <= 2500
    assert [s for p in cut for b in reader.read(p) for s in b["seq"].to_pylist()] == list(range(1, 996))
    table, seen = MergeTable(spark, f"{tmp_path}/consumers", S.CONSUMERS, ["consumer"]), []
    S.consume(spark, feed, "p", table, "a", "text", f"{tmp_path}/c", lambda df, n: seen.append((df.rdd.getNumPartitions(), sorted(r.seq for r in df.collect()))))
    assert sum((s for _, s in seen), []) == list(range(1, 996)) and max(n for n, _ in seen) <= 2


def members(spark, n):
    t = spark.range(n).select(F.concat(F.lit("u"), F.col("id")).alias("urn"), F.lit("d").alias("revision_digest"), F.when(F.col("id") % 3 == 0, "é").alias("text"))
    return {"messages": t, "events": t.where("text is null").drop("text")}


def test_a_bucket_is_written_once_and_verified(spark, tmp_path):
    where = S.write_bucket(members(spark, 90), str(tmp_path), "2024-01", 1, {"kind": "bucket"})
    manifest, sums = S.read_manifest(where)
    assert manifest["counts"] == {"messages": 90, "events": 60} and manifest["kind"] == "bucket" and manifest["members"] == sorted(sums)
    assert S.verify_bucket(spark, where).count() == 0
    assert sorted(r.urn for r in S.read_member(spark, where, "messages", "urn string, text string").where("text = 'é'").collect()) == sorted(f"u{k}" for k in range(0, 90, 3))
    with pytest.raises(Exception, match="already"):
        S.write_bucket(members(spark, 5), str(tmp_path), "2024-01", 1, {})
    first, second = manifest["members"][:2]
    with open(f"{where}/{first}", "a") as f:
        f.write("{}\n")
    os.remove(f"{where}/{second}")
    got = {(r.name, r.problem) for r in S.verify_bucket(spark, where).collect()}
    assert {(first, "other content"), (second, "missing")} <= got and any(p == "other count" for _, p in got)


def test_tasks_of_a_bucket_follow_its_rows(spark, tmp_path, monkeypatch):
    """Partitions were merged by their bytes in the shuffle, so here one task sorted and wrote all rows."""
    monkeypatch.setattr(S, "TASK_ROWS", 10)
    where = S.write_bucket(members(spark, 90), str(tmp_path), "2024-01", 1, {})
    manifest, _ = S.read_manifest(where)
    assert manifest["counts"] == {"messages": 90, "events": 60} and 12 <= len(manifest["members"]) <= 17
    assert max(sum(1 for _ in open(f"{where}/{n}")) for n in manifest["members"]) <= 20 and S.verify_bucket(spark, where).count() == 0


def test_a_failed_task_leaves_no_revision(spark, tmp_path):
    broken = members(spark, 50)
    broken["messages"] = broken["messages"].withColumn("text", F.when(F.col("urn") == "u33", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        S.write_bucket(broken, str(tmp_path), "2024-01", 1, {})
    where = f"{tmp_path}/bucket=2024-01/rev=1"
    assert not os.path.exists(f"{where}/manifest.json") and not [f for _, _, names in os.walk(where) for f in names if f.endswith(".jsonl")]
    S.write_bucket(members(spark, 50), str(tmp_path), "2024-01", 1, {})
    assert S.verify_bucket(spark, where).count() == 0
