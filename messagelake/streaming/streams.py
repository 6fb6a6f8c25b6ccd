"""Streams: changes of table versions, heads kept by urn, exactly-once replay of a feed, counts, polls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import store
from ..plans.mergeable import MergeTable
from ..plans.state import VersionedTable, kept

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Heads(StatefulProcessor):
    """The head digest of each urn across batches: live rows always become the head, imported ones only if they follow it
    (their previous digest is its) and it isn't newer; one that doesn't follow is a conflict. A row without a digest purges
    the urn: nothing of it stays. Rows of a batch are taken in the order of pos."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "digest string, observed_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("pos")
        digest, at = self.head.get() if self.head.exists() else (None, None)
        out = []
        for r in batch.itertuples():
            if r.digest is None or r.digest != r.digest:
                digest, at = None, None
                out.append((key[0], int(r.pos), "purged"))
                continue
            outcome = store.outcome(digest, at, r.digest, digest if r.live else r.previous, at if r.live and at is not None else int(r.observed_at))
            if outcome in ("inserted", "updated"):
                digest, at = r.digest, int(r.observed_at)
            elif outcome == "unchanged":
                at = max(at, int(r.observed_at))
            out.append((key[0], int(r.pos), outcome))
        if digest is None:
            self.head.clear()
        else:
            self.head.update((digest, at))
        yield pd.DataFrame(out, columns=["urn", "pos", "outcome"])

    def close(self) -> None:
        pass


def stream_heads(records: DataFrame) -> DataFrame:
    """(urn, pos, outcome) of a stream of records (urn, digest, previous, observed_at, pos, live)."""
    return records.groupBy("urn").transformWithStateInPandas(Heads(), "urn long, pos long, outcome string", "update", "none")


def stream_counts(messages: DataFrame, by: str = "scope") -> DataFrame:
    """Live counts for each scope, in update mode."""
    return messages.groupBy(by).agg(F.count("*").alias("n"))


class Counts(StatefulProcessor):
    """The live rows of a scope's share, kept as one number; at zero nothing is kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.n.get()[0] if self.n.exists() else 0
        now = before + sum(int(part["sign"].sum()) for part in rows)
        if now == 0:
            self.n.clear()
        else:
            self.n.update((now,))
        if now != before:
            yield pd.DataFrame([(key[0], int(key[1]), now)], columns=["scope", "share", "n"])

    def close(self) -> None:
        pass


COUNTS = "scope string, share int, n long"


def signed(changes: DataFrame, key: str, shares: int = 8) -> DataFrame:
    """(scope, share, sign) of changes with scopes before and after, null where the row wasn't or isn't there: an edit inside a
    scope gives nothing. A row always falls into the same share of its scope, so a scope with most rows is in many tasks."""
    moved = changes.where(~F.col("before").eqNullSafe(F.col("after")))
    images = F.array(F.struct(F.col("before").alias("scope"), F.lit(-1).alias("sign")), F.struct(F.col("after").alias("scope"), F.lit(1).alias("sign")))
    one = moved.select(F.pmod(F.xxhash64(key), F.lit(shares)).cast("int").alias("share"), F.explode(images).alias("i"))
    return one.select("i.scope", "share", "i.sign").where("scope is not null")


def stream_signed_counts(changes: DataFrame, counts: MergeTable, checkpoint: str, key: str = "urn", shares: int = 8, consumer: str = "counts") -> StreamingQuery:
    """Live counts of a stream of inserts, edits, moves and deletes (key, before, after), in a table of COUNTS keyed by scope
    and share; scopes at zero leave it. A batch that comes again after a restart is not counted again: state and offsets
    are one, and the table holds the batch's number. live_counts() sums the shares."""
    told = signed(changes, key, shares).groupBy("scope", "share").transformWithStateInPandas(Counts(), COUNTS, "update", "none")

    def batch(df: DataFrame, batch_id: int) -> None:
        df = kept(df)
        counts.merge(df.where("n != 0"), df.where("n = 0").select("scope", "share"), consumer, batch_id)

    return run_available(told, batch, checkpoint, "update")


def live_counts(counts: MergeTable) -> DataFrame:
    """(scope, n)"""
    return counts.read().groupBy("scope").agg(F.sum("n").alias("n")).where("n != 0")


def run_available(df: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Takes what is there, batch by batch, and stops; a consumer's offsets are in its own checkpoint folder."""
    q = df.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


LEDGER = "producer string, seq long, sha256 string"
HEADS = "urn string, digest string, observed_at long, seq long, data string"


def stream_replay(feed: DataFrame, applied: VersionedTable, heads: MergeTable, checkpoint: str, consumer: str = "replay", outcomes: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Applies an ordered feed (producer, seq, operation, urn, digest, previous, observed_at, data) once.

    A record counts if its previous digest is the head's, as store.replay_records has it: an unrelated edit is a conflict and
    stays. A batch reads the buckets of its own urns and writes the heads that it moved as deltas, so its bytes follow the
    batch and not the table; the table notes the batch's number with them, and a batch that comes again finds its events in
    the ledger. The ledger grows by the new events of each batch, written last, and is read only between the batch's
    numbers. outcomes gets (urn, seq, outcome). Each consumer has a checkpoint of its own under its name.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        df = kept(df)
        bounds = df.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
        if bounds["lo"] is None:
            return
        done = applied.appended(LEDGER).where(F.col("seq").between(bounds["lo"], bounds["hi"]))
        status = kept(store.apply_changes(df, done))
        if not status.where("status = 'rejected'").isEmpty():
            raise ValueError("an event came again with other content")
        new = status.where("status = 'new' and operation = 'record'")
        if (heads.done(consumer) if heads.done(consumer) is not None else -1) < batch_id:
            stored = kept(heads.read(buckets=heads.touched(new)).join(new.select("urn").distinct(), "urn", "left_semi"))
            after, told = store.replay_records(new, stored)
            if outcomes is not None:
                outcomes(told, batch_id)
            won = told.where("outcome in ('inserted', 'updated')").join(new.select("urn", "seq", "data"), ["urn", "seq"])
            won = won.groupBy("urn").agg(F.max_by(F.struct("seq", "data"), "seq").alias("w"))
            now = after.join(won, "urn", "left").join(stored.select("urn", F.struct("digest", "observed_at", "seq", "data").alias("s")), "urn", "left")
            now = now.where(~F.struct("digest", "observed_at").eqNullSafe(F.struct("s.digest", "s.observed_at")))
            heads.merge(now.select("urn", "digest", "observed_at", F.coalesce("w.seq", "s.seq").alias("seq"), F.coalesce("w.data", "s.data").alias("data")), None, consumer, batch_id)
        applied.append(status.where("status = 'new'").select("producer", "seq", "sha256"))

    return run_available(feed, batch, f"{checkpoint.rstrip('/')}/{consumer}")


def stream_changes(versions: DataFrame, state: MergeTable, out: Callable[[DataFrame, int], None], key: str, values: list[str], checkpoint: str) -> StreamingQuery:
    """Each version of a native table (rows with their version's number) against the one before, as ordered changes. The state
    takes in only the rows that changed; a version that it has seen gives nothing again."""
    from ..operators.routing import diff

    def batch(df: DataFrame, batch_id: int) -> None:
        df = kept(df)
        for (version,) in df.select("version").distinct().orderBy("version").collect():  # a few numbers
            if version <= (-1 if state.done("changes") is None else state.done("changes")):
                continue
            now = df.where(F.col("version") == version).select(key, *values)
            named = F.when(F.col("before").isNull(), "inserted").when(F.col("after").isNull(), "deleted").otherwise("updated")
            changes = kept(diff(state.read(), now, key, values).withColumn("change", named))
            out(changes.withColumn("version", F.lit(version)), batch_id)
            gone = changes.where("change = 'deleted'").select(key)
            state.merge(now.join(changes.where("change != 'deleted'").select(key), key, "left_semi"), gone, "changes", int(version))

    return run_available(versions, batch, checkpoint)


def stream_polls(source: DataFrame, poll: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 30) -> StreamingQuery:
    """Polls a source at an interval; each poll's result is what the function makes of the batch."""
    return source.writeStream.foreachBatch(poll).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def file_stream(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def purge_heads(heads: MergeTable, gone: DataFrame) -> None:
    """Removes purged urns as a new version; the ledger of applied events stays, so none comes back by a replay. Files of
    older versions hold them until compact() and vacuum()."""
    heads.merge(heads.read().limit(0), gone.select("urn").distinct())
    heads.compact()


RUNS = "run string, status string, at long, checkpoint string"


def run_once(runs: VersionedTable, run: str, at: int, work: Callable[[str | None], str]) -> str:
    """One run: a running row first, then the work, which gets the last complete run's checkpoint and gives the next one,
    then the row that commits it. If the work fails the run is failed and the old checkpoint stays."""
    say = lambda status, mark: runs.append(runs.spark.createDataFrame([(run, status, at, mark)], RUNS))
    before = last_checkpoint(runs)
    say("running", None)
    try:
        mark = work(before)
    except Exception:
        say("failed", None)
        raise
    say("complete", mark)
    return mark


def last_checkpoint(runs: VersionedTable) -> str | None:
    """The checkpoint of the latest complete run."""
    done = runs.appended(RUNS).where("status = 'complete'").agg(F.max_by("checkpoint", F.struct("at", "run")).alias("c"))
    return done.first()["c"]
