"""Spark data sources of the archive: a stream of feed batches in order, and a sink that commits one bucket revision."""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

EVENTS = "seq bigint, producer string, operation string, urn string, observed_at bigint, data string"
CHUNK = 1 << 20
#: Rows of a bucket that a task sorts and writes, about.
TASK_ROWS = 500_000
#: Bytes of batches that one task reads, unless its first is larger: small files share tasks, as a task has a cost of its own.
TASK_BYTES = 4 << 20


class BadFeed(ValueError):
    """Batches that don't follow one another."""


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _hashed(fs: pafs.FileSystem, path: str) -> tuple[int, str]:
    """(bytes, SHA-256) of a file, read in chunks."""
    h, size = hashlib.sha256(), 0
    with fs.open_input_stream(path) as f:
        while chunk := f.read(CHUNK):
            h.update(chunk)
            size += len(chunk)
    return size, h.hexdigest()


# --- the feed


def publish(journal: DataFrame, path: str, producer: str, limit: int = 5000, batches: int | None = 100, max_bytes: int = 64 << 20) -> int | None:
    """Writes the next batches of a producer's journal (EVENTS, numbered without gaps) after those there, a file of `limit`
    numbers each, `batches` files at most; the last number, or None if there is nothing new. Each call reads the heads that are
    there and the journal once, so who has many batches to write takes batches=None: all that is new in one call.

    Tasks write the files under hidden names; the driver, which sees a row for each, moves them to the names that say their
    bounds and then writes each one's head: the batch before and its SHA-256. A batch without a head isn't there yet.
    """
    fs, top = _files(path)
    fs.create_dir(top)
    known = chain(fs, top, producer)
    last = known[-1] if known else {"through": 0, "name": None, "sha256": None}
    after, columns = last["through"], [c.split()[0] for c in EVENTS.split(", ")]
    new = F.col("seq") > after if batches is None else F.col("seq").between(after + 1, after + limit * batches)
    rows = journal.where(new).withColumn("batch", F.floor((F.col("seq") - after - 1) / limit))
    for c in columns:
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    line = F.to_json(F.struct(*columns))

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _files(path)
        done, now = [], None
        for part in parts:
            for k, seq, text in zip(*(part[c].to_pylist() for c in ("batch", "seq", "line")), strict=True):
                if now is None or now["batch"] != k:
                    if now is not None:
                        now["file"].close()
                    now = {"batch": k, "through": seq, "rows": 0, "bytes": 0, "sha": hashlib.sha256(), "hidden": f".{uuid.uuid4().hex}"}
                    now["file"] = fs.open_output_stream(f"{top}/{now['hidden']}")
                    done.append(now)
                data = (text + "\n").encode()
                now["file"].write(data)
                now["sha"].update(data)
                now |= {"through": seq, "rows": now["rows"] + 1, "bytes": now["bytes"] + len(data)}
                if now["bytes"] > max_bytes:
                    raise ValueError(f"the batch up to {seq} is larger than {max_bytes} bytes; take a smaller limit")
        if now is not None:
            now["file"].close()
        out = [[d[c] for d in done] for c in ("batch", "through", "rows", "bytes", "hidden")] + [[d["sha"].hexdigest() for d in done]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["batch", "through", "rows", "bytes", "hidden", "sha256"])

    dealt = rows.select("batch", "seq", line.alias("line")).repartition(F.xxhash64("batch")).sortWithinPartitions("batch", "seq")
    written = sorted(dealt.mapInArrow(write, "batch long, through long, rows long, bytes long, hidden string, sha256 string").collect(), key=lambda r: r["batch"])
    for r in written:
        if r["rows"] != r["through"] - last["through"]:
            raise BadFeed(f"the journal has gaps after {last['through']}")
        name = f"{producer}-{last['through']:020d}-{r['through']:020d}"
        head = {"name": name, "producer": producer, "after": last["through"], "through": r["through"], "bytes": r["bytes"], "sha256": r["sha256"], "parent": last["name"], "parent_sha256": last["sha256"]}
        fs.move(f"{top}/{r['hidden']}", f"{top}/{name}.jsonl")
        with fs.open_output_stream(f"{top}/{r['hidden']}.head") as f:
            f.write(json.dumps(head, sort_keys=True).encode())
        fs.move(f"{top}/{r['hidden']}.head", f"{top}/{name}.json")
        last = head
    return last["through"] if written else None


def chain(fs: pafs.FileSystem, top: str, producer: str) -> list[dict]:
    """The heads of a producer's batches by their bounds; two after the same number are a fork, and a head that names another
    parent, or other content of it, than the one before is an error."""
    out = []
    for info in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)):
        parts = info.base_name.removesuffix(".json").rsplit("-", 2)
        if info.base_name.endswith(".json") and len(parts) == 3 and parts[0] == producer:
            with fs.open_input_stream(info.path) as f:
                out.append(json.loads(f.read()))
    out.sort(key=lambda b: (b["after"], b["through"]))
    for a, b in zip(out, out[1:]):
        if a["after"] == b["after"]:
            raise BadFeed(f"fork: two batches after {a['after']}")
        if a["through"] == b["after"] and (b["parent"] != a["name"] or b["parent_sha256"] != a["sha256"]):
            raise BadFeed(f"{b['name']} follows another batch than {a['name']}")
    return out


@dataclass
class FeedBatch(InputPartition):
    path: str
    after: int
    through: int
    sha256: str


@dataclass
class FeedBatches(InputPartition):
    files: list[FeedBatch]

    @property
    def through(self) -> int:
        return self.files[-1].through


class FeedReader(DataSourceStreamReader):
    """Offsets are sequence numbers; a step admits so many batches and bytes, a partition is the files of batches that follow one another, up to TASK_BYTES. A gap, a fork, a batch
    that follows another parent than is there, or one that doesn't hold what its head names, is an error of the query."""

    def __init__(self, options: dict):
        self.path, self.producer = options["path"], options["producer"]
        self.most, self.most_bytes = int(options.get("maxBatches", 100)), int(options.get("maxBytes", 1 << 30))
        self.start, self.at = int(options.get("after", 0)), None

    def initialOffset(self) -> dict:
        return {"seq": self.start}

    def _following(self, seq: int) -> list[dict]:
        fs, top = _files(self.path)
        out = [b for b in chain(fs, top, self.producer) if b["through"] > seq]
        for b in out:
            if b["after"] != seq:
                raise BadFeed(f"gap: no batch after {seq}, the next is after {b['after']}")
            seq = b["through"]
        return out

    def latestOffset(self) -> dict:
        if self.at is None:
            fs, top = _files(self.path)
            return {"seq": max((b["through"] for b in chain(fs, top, self.producer)), default=self.start)}
        size, begin = 0, self.at
        for b in self._following(begin)[: self.most]:
            size += b["bytes"]
            if size > self.most_bytes and b["after"] != begin:  # one batch goes through whatever its size
                break
            self.at = b["through"]
        return {"seq": self.at}

    def partitions(self, start: dict, end: dict) -> list[FeedBatches]:
        self.at = end["seq"]
        _, top = _files(self.path)
        out, size = [], 0
        for b in self._following(start["seq"]):
            if b["through"] > end["seq"]:
                break
            if not out or size + b["bytes"] > TASK_BYTES:
                out.append(FeedBatches([]))
                size = 0
            size += b["bytes"]
            out[-1].files.append(FeedBatch(f"{top}/{b['name']}.jsonl", b["after"], b["through"], b["sha256"]))
        return out

    def read(self, partition: FeedBatches) -> Iterator[pa.RecordBatch]:
        fs, _ = _files(self.path)
        kinds = {"bigint": pa.int64(), "string": pa.string()}
        columns = [c.split() for c in EVENTS.split(", ")]
        for batch in partition.files:
            with fs.open_input_stream(batch.path) as f:
                body = f.read()  # a batch has a bound of bytes
            rows = [json.loads(x) for x in body.splitlines()]
            if hashlib.sha256(body).hexdigest() != batch.sha256 or [r["seq"] for r in rows] != list(range(batch.after + 1, batch.through + 1)):
                raise BadFeed(f"{batch.path} doesn't hold what its head names")
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in columns], [n for n, _ in columns])

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """spark.readStream.format("message_feed").options(path=..., producer=..., after=..., maxBatches=..., maxBytes=...)"""

    @classmethod
    def name(cls) -> str:
        return "message_feed"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))


CONSUMERS = "consumer string, policy string, sequence long"


def consume(spark: SparkSession, path: str, producer: str, consumers, consumer: str, policy: str, checkpoint: str, work: Callable[[DataFrame, int], None], **options: str) -> StreamingQuery:
    """Gives a named consumer the batches that it hasn't seen, to the end, and notes its place in a MergeTable of CONSUMERS. A
    consumer keeps the policy that it began with; each has a checkpoint of its own, so consumers stand at different places."""
    from ..streaming.streams import run_available

    mine = consumers.read(buckets=consumers.touched(spark.createDataFrame([(consumer, policy, 0)], CONSUMERS))).where(F.col("consumer") == consumer).first()
    if mine is not None and mine["policy"] != policy:
        raise ValueError("a consumer's policy can't change")
    if mine is None:
        consumers.merge(spark.createDataFrame([(consumer, policy, int(options.get("after", 0)))], CONSUMERS))

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        work(df, number)
        through = df.agg(F.max("seq")).first()[0]
        df.unpersist()
        if through is not None:
            consumers.merge(spark.createDataFrame([(consumer, policy, through)], CONSUMERS), None, consumer, number)

    spark.dataSource.register(FeedSource)
    feed = spark.readStream.format("message_feed").options(path=path, producer=producer, **options).load()
    return run_available(feed, batch, f"{checkpoint.rstrip('/')}/{consumer}")


# --- the bucket


@dataclass
class Written(WriterCommitMessage):
    parts: list


class BucketWriter(DataSourceWriter):
    """Tasks write members (member, line) as files of their own, and say what they wrote; the commit writes the checksums and,
    last, the manifest, which alone makes the revision one. Never over an existing revision."""

    def __init__(self, options: dict):
        self.where, self.manifest, self.run = f"{options['path'].rstrip('/')}/bucket={options['bucket']}/rev={options['revision']}", json.loads(options.get("manifest", "{}")), uuid.uuid4().hex
        fs, top = _files(self.where)
        if fs.get_file_info(f"{top}/manifest.json").type != pafs.FileType.NotFound:
            raise FileExistsError(f"{self.where} is there already")

    def write(self, rows: Iterator) -> Written:
        fs, top = _files(self.where)
        parts, task = {}, uuid.uuid4().hex
        try:
            for r in rows:
                if r["member"] not in parts:
                    fs.create_dir(f"{top}/records/{r['member']}")
                    name = f"records/{r['member']}/{self.run}-{task}.jsonl"
                    parts[r["member"]] = {"name": name, "file": fs.open_output_stream(f"{top}/{name}"), "rows": 0, "sha": hashlib.sha256(), "member": r["member"]}
                p, line = parts[r["member"]], (r["line"] + "\n").encode()
                p["file"].write(line)
                p["sha"].update(line)
                p["rows"] += 1
        finally:
            for p in parts.values():
                p["file"].close()
        return Written([{"name": p["name"], "member": p["member"], "rows": p["rows"], "sha256": p["sha"].hexdigest()} for p in parts.values()])

    def _names(self, fs: pafs.FileSystem, top: str) -> list[str]:
        found = fs.get_file_info(pafs.FileSelector(f"{top}/records", recursive=True, allow_not_found=True))
        return [f.path for f in found if f.type == pafs.FileType.File and f.base_name.startswith(self.run)]

    def commit(self, messages: list[Written]) -> None:
        fs, top = _files(self.where)
        parts = [p for m in messages if m is not None for p in m.parts]
        sums, counts = {p["name"]: p["sha256"] for p in parts}, {}
        for p in parts:
            counts[p["member"]] = counts.get(p["member"], 0) + p["rows"]
        for path in self._names(fs, top):  # of tasks that failed or ran twice
            if posixpath.relpath(path, top) not in sums:
                fs.delete_file(path)
        fs.create_dir(top)
        payload = hashlib.sha256("".join(f"{n}\0{sums[n]}\n" for n in sorted(sums)).encode()).hexdigest()
        told = self.manifest | {"counts": counts, "members": sorted(sums), "payload_digest": f"sha256:{payload}"}
        for name, body in (("checksums.json", sums), ("manifest.json", told)):
            with fs.open_output_stream(f"{top}/.{self.run}") as f:
                f.write(json.dumps(body, sort_keys=True).encode())
            if name == "manifest.json" and fs.get_file_info(f"{top}/{name}").type != pafs.FileType.NotFound:
                raise FileExistsError(f"{self.where} is there already")
            fs.move(f"{top}/.{self.run}", f"{top}/{name}")

    def abort(self, messages: list[Written]) -> None:
        fs, top = _files(self.where)
        for path in self._names(fs, top):
            fs.delete_file(path)


class BucketSink(DataSource):
    """df of (member, line).write.format("message_bucket").mode("append").options(path=..., bucket=..., revision=..., manifest=...)"""

    @classmethod
    def name(cls) -> str:
        return "message_bucket"

    def writer(self, schema, overwrite: bool) -> BucketWriter:
        return BucketWriter(dict(self.options))


def write_bucket(members: dict[str, DataFrame], path: str, bucket: str, revision: int, manifest: dict, order: tuple[str, ...] = ("urn", "revision_digest")) -> str:
    """Members of a bucket revision as JSON lines, in one order over a member's files, with checksums and manifest."""
    spark = next(iter(members.values())).sparkSession
    rows = None
    for name, df in members.items():
        line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        own = df.select(F.lit(name).alias("member"), line.alias("line"), *(F.col(c).cast("string").alias(f"_{k}") for k, c in enumerate(order)))
        rows = own if rows is None else rows.unionByName(own)
    keys = ["member", *(f"_{k}" for k in range(len(order)))]
    spark.dataSource.register(BucketSink)
    # a number that is named isn't merged: lines shrink much in a shuffle, so partitions merged by that hold too many rows
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("member", "line")
    dealt.write.format("message_bucket").mode("append").options(path=path, bucket=bucket, revision=str(revision), manifest=json.dumps(manifest)).save()
    return f"{path.rstrip('/')}/bucket={bucket}/rev={revision}"


def read_manifest(where: str) -> tuple[dict, dict]:
    """(manifest, checksums) of a committed revision."""
    fs, top = _files(where)
    load = lambda name: json.loads(fs.open_input_stream(f"{top}/{name}").read())
    return load("manifest.json"), load("checksums.json")


def read_member(spark: SparkSession, where: str, member: str, schema: str) -> DataFrame:
    """The rows of a member, from the files that the manifest names alone."""
    manifest, _ = read_manifest(where)
    names = [f"{where}/{n}" for n in manifest["members"] if n.split("/")[1] == member]
    return spark.read.schema(schema).json(names) if names else spark.createDataFrame([], schema)


def verify_bucket(spark: SparkSession, where: str) -> DataFrame:
    """(name, problem): members that are missing or changed, counts that differ, a payload digest that isn't the checksums'. Files
    are hashed by tasks, in chunks."""
    manifest, sums = read_manifest(where)
    fs, top = _files(where)
    payload = hashlib.sha256("".join(f"{n}\0{sums[n]}\n" for n in sorted(sums)).encode()).hexdigest()
    own = [] if manifest["payload_digest"] == f"sha256:{payload}" and manifest["members"] == sorted(sums) else [("manifest.json", "payload digest or members aren't the checksums'")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _files(where)
        for b in batches:
            out = []
            for name in b["name"].to_pylist():
                there = fs.get_file_info(f"{top}/{name}").type == pafs.FileType.File
                lines = sum(chunk.count(b"\n") for chunk in iter(lambda f=fs.open_input_stream(f"{top}/{name}"): f.read(CHUNK), b"")) if there else 0
                out.append((name, _hashed(fs, f"{top}/{name}")[1] if there else None, lines))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["name", "found", "lines"])

    listed = spark.createDataFrame([(n, s) for n, s in sums.items()], "name string, sha256 string").repartition(max(1, min(len(sums), 200)))
    met = listed.select("name").mapInArrow(look, "name string, found string, lines long").join(listed, "name")
    met = met.persist()
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "other content")
    bad = met.select("name", problem.alias("problem")).where("problem is not null")
    expected = spark.createDataFrame(list(manifest["counts"].items()), "member string, expected long")
    rows = met.groupBy(F.split("name", "/")[1].alias("member")).agg(F.sum("lines").alias("rows"))
    counts = expected.join(rows, "member", "full_outer").where("not (expected <=> rows)").select(F.concat(F.lit("records/"), "member").alias("name"), F.lit("other count").alias("problem"))
    return bad.unionByName(counts).unionByName(spark.createDataFrame(own, "name string, problem string"))
