"""Incremental recompute: changed rows of native tables to the units that they affect, memos, withdrawal of ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import intervals as I


def diff(old: DataFrame, new: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """(key, before, after) of rows that appeared, vanished or changed, null-safe."""
    o = old.select(key, F.struct(*values).alias("before"))
    n = new.select(key, F.struct(*values).alias("after"))
    return o.join(n, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def _images(change: DataFrame, *fields: str) -> DataFrame:
    """Both images of changed rows as rows of their own."""
    pick = lambda side: change.where(f"{side} is not null").select(*(F.col(f"{side}.{f}").alias(f) for f in fields))
    return pick("before").unionByName(pick("after")).distinct()


def route_a(changes: dict[str, DataFrame], messages: DataFrame, media: DataFrame) -> DataFrame:
    """(chat, stanza) units of family A that changed rows affect: their own groups before and after, groups of rows that
    answer them, groups of both owners of changed media, all groups of sessions whose address changed."""
    key = messages.select("Z_PK", "ZCHATSESSION", "ZSTANZAID", "ZPARENTMESSAGE")
    units = None
    add = lambda df: df if units is None else units.unionByName(df)
    if "messages" in changes:
        own = _images(changes["messages"], "ZCHATSESSION", "ZSTANZAID")
        units = add(own)
        rows = changes["messages"].select(F.col("Z_PK").alias("ZPARENTMESSAGE"))
        units = add(key.join(rows, "ZPARENTMESSAGE", "left_semi").select("ZCHATSESSION", "ZSTANZAID"))
    if "media" in changes:
        owners = _images(changes["media"], "ZMESSAGE").select(F.col("ZMESSAGE").alias("Z_PK"))
        users = messages.join(changes["media"].select(F.col("Z_PK").alias("ZMEDIAITEM")), "ZMEDIAITEM", "left_semi").select("ZCHATSESSION", "ZSTANZAID")
        units = add(key.join(owners, "Z_PK", "left_semi").select("ZCHATSESSION", "ZSTANZAID"))
        units = add(users)
    if "sessions" in changes:
        moved = changes["sessions"].where(~F.col("before.ZCONTACTJID").eqNullSafe(F.col("after.ZCONTACTJID"))).select(F.col("Z_PK").alias("ZCHATSESSION"))
        units = add(key.join(moved, "ZCHATSESSION", "left_semi").select("ZCHATSESSION", "ZSTANZAID"))
        answers = key.alias("k").join(key.join(moved, "ZCHATSESSION", "left_semi").select(F.col("Z_PK").alias("p")), F.col("k.ZPARENTMESSAGE") == F.col("p"), "left_semi").select("ZCHATSESSION", "ZSTANZAID")
        units = add(answers)
    return units.where(F.coalesce("ZSTANZAID", F.lit("")) != "").distinct().select(F.col("ZCHATSESSION").alias("chat"), F.col("ZSTANZAID").alias("stanza"))


def route_b(changes: dict[str, DataFrame], message: DataFrame, chat_joins: DataFrame, attachment_joins: DataFrame) -> DataFrame:
    """(message_id) of family B that changed rows affect, one union of a semi join for each kind of dependency: the
    message itself, those in a changed thread or reacting to it, users of changed handles, members of changed chats
    and chat joins, owners of changed attachments, and messages placed by a chat's identifier."""
    ids = lambda df, c="ROWID": df.select(F.col(c).alias("message_id"))
    found = []
    if "message" in changes:
        found.append(ids(changes["message"]))
        guid = _images(changes["message"], "guid")
        found.append(ids(message.join(guid.select(F.col("guid").alias("thread_originator_guid")), "thread_originator_guid", "left_semi")))
        found.append(ids(message.join(guid.select(F.col("guid").alias("associated_message_guid")), "associated_message_guid", "left_semi")))
    if "handle" in changes:
        h = changes["handle"].select(F.col("ROWID").alias("handle_id"))
        found.append(ids(message.join(h, "handle_id", "left_semi")))
        found.append(ids(message.join(h.select(F.col("handle_id").alias("other_handle")), "other_handle", "left_semi")))
    if "chat" in changes:
        found.append(chat_joins.join(changes["chat"].select(F.col("ROWID").alias("chat_id")), "chat_id", "left_semi").select("message_id"))
        tails = _images(changes["chat"], "chat_identifier").select(F.col("chat_identifier").alias("_tail"))
        lost = message.join(chat_joins.select(F.col("message_id").alias("ROWID")), "ROWID", "left_anti").withColumn("_tail", S.ck_identifier("ck_chat_id"))
        found.append(ids(lost.join(tails, "_tail", "left_semi")))
    if "chat_joins" in changes:
        found.append(_images(changes["chat_joins"], "message_id"))
    if "attachment" in changes:
        found.append(attachment_joins.join(changes["attachment"].select(F.col("ROWID").alias("attachment_id")), "attachment_id", "left_semi").select("message_id"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("message_id is not null").distinct()


def changed_header_keys(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(key, change) of header keys that appeared, vanished or changed; rows of one key count together, in any order: by
    their number and two sums of hashes, so a key with very many rows is summed where they are. Tables: (key, fingerprint)."""
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "fingerprint").cast("decimal(38,0)"))
    rows = lambda df, name: df.groupBy("key").agg(F.struct(F.count("*"), part(1), part(2)).alias(name))
    t = rows(previous, "old").join(rows(current, "new"), "key", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return t.select("key", F.when(F.col("old").isNull(), "appeared").when(F.col("new").isNull(), "vanished").otherwise("changed").alias("change"))


def observed_keys(bases: DataFrame, observed: DataFrame) -> DataFrame:
    """Base keys and the extended ones that were observed: an equi join on the first four elements of a key."""
    stem = lambda c: F.concat_ws(",", F.slice(F.split(F.regexp_replace(c, r"\]$", ""), ",(?=\")"), 1, 4))
    b = bases.select(stem(F.col("key")).alias("_s")).distinct()
    return observed.select("key").distinct().withColumn("_s", stem(F.col("key"))).join(b, "_s", "left_semi").select("key")


def reuse_units(units: DataFrame, memo: DataFrame) -> DataFrame:
    """Units with `reused`: a valid memo of the same signature and fingerprint serves. units: (unit, signature, fingerprint)."""
    m = memo.where("valid").select("unit", "signature", "fingerprint", F.lit(True).alias("_m")).distinct()
    return units.join(m, ["unit", "signature", "fingerprint"], "left").withColumn("reused", F.coalesce("_m", F.lit(False))).drop("_m")


def save_units(members: DataFrame, heads: DataFrame) -> DataFrame:
    """(unit) whose members' digests are all those of the heads. members: (unit, urn, digest)."""
    t = members.join(heads.select("urn", F.col("digest").alias("_h")), "urn", "left")
    return t.groupBy("unit").agg(F.bool_and(F.coalesce(F.col("digest") == F.col("_h"), F.lit(False))).alias("valid")).where("valid").select("unit")


def invalidate_units(memo: DataFrame, members: DataFrame, changed: DataFrame) -> DataFrame:
    bad = members.join(changed.select("urn"), "urn", "left_semi").select("unit", F.lit(True).alias("_bad")).distinct()
    return memo.join(bad, "unit", "left").withColumn("valid", F.col("valid") & F.col("_bad").isNull()).drop("_bad")


def sharing_units(members: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, other): units that hold a record of one of the given units and aren't given themselves."""
    mine = members.join(units.select("unit"), "unit", "left_semi")
    other = members.join(units.select("unit"), "unit", "left_anti").select(F.col("unit").alias("other"), "urn")
    return mine.join(other, "urn").select("unit", "other").distinct()


def withdraw(units: DataFrame, memo: DataFrame, members: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans to withdraw, units that can't be): missing or invalid ones, and those that share a record with a valid
    other one. ranges: (unit, kind, lo, hi)."""
    valid = memo.where("valid").select("unit")
    missing = units.select("unit").join(valid, "unit", "left_anti").select("unit", F.lit("missing").alias("reason"))
    shared = sharing_units(members, units).join(valid.select(F.col("unit").alias("other")), "other", "left_semi").select("unit", F.lit("shared").alias("reason")).distinct()
    refused = missing.union(shared)
    good = ranges.join(units.select("unit"), "unit", "left_semi").join(refused.select("unit"), "unit", "left_anti")
    return I.merge_spans(good, ["kind"]), refused


def changed_event_keys(owned: DataFrame, current: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys touched, rows of those keys, ownership after) of changed native rows: a key is touched that a changed row had
    before or has now, and all rows that have it now are selected again. Tables: (row_id, event_key); changed: (row_id)."""
    rows = changed.select("row_id").distinct()
    now = current.select("row_id", "event_key").join(rows, "row_id", "left_semi")
    before = owned.select("row_id", "event_key")
    touched = before.join(rows, "row_id", "left_semi").select("event_key").union(now.select("event_key")).distinct()
    after = before.join(rows, "row_id", "left_anti").unionByName(now)
    return touched, after.join(touched, "event_key", "left_semi").select("row_id", "event_key"), after


def withdraw_headers(observations: DataFrame, entities: DataFrame, complete: Sequence[str], keyed: DataFrame) -> DataFrame:
    """(kind, lo, hi) of records and observations that headers give up: present ones of whole tables, and those of the
    given keys. observations: (id, urn, native_table, native_key, present); entities: (urn, id); keyed: (native_table, native_key)."""
    there = observations.where("present = 'present'").select("id", "urn", "native_table", "native_key")
    whole = F.col("native_table").isin(*complete) if complete else F.lit(False)
    chosen = there.where(whole).unionByName(there.where(~whole).join(keyed.select("native_table", "native_key").distinct(), ["native_table", "native_key"], "left_semi"))
    met = chosen.join(entities.select("urn", F.col("id").alias("_entity")), "urn")
    ids = met.select(F.explode(F.array(F.struct(F.lit("observation").alias("kind"), "id"), F.struct(F.lit("record").alias("kind"), F.col("_entity").alias("id")))).alias("x"))
    return I.islands(ids.select("x.*"), ["kind"])


def outside(prior: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """What is withdrawn and wasn't covered before; it must be empty, see retained()."""
    return I.subtract_spans(withdrawn, prior, ["kind"])


def retained(prior: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Prior coverage without what is withdrawn, which must lie inside it."""
    rest, beyond = I.parted_spans(prior, withdrawn, ["kind"])
    if not beyond.isEmpty():
        raise ValueError("withdrawn ranges lie outside the prior coverage")
    return rest


def finish_coverage(prior: DataFrame, withdrawn: DataFrame, staged: DataFrame, fresh: DataFrame | None = None, at: int | None = None, run: str | None = None, absent: bool = True) -> dict[str, DataFrame]:
    """absent (if asked for): what was withdrawn and not seen again; retained: what wasn't withdrawn; coverage: retained and staged. With
    `fresh` (kind, lo, hi, at, run) also fresh: what is retained counts as seen by this run, at its time."""
    kept = I.subtract_spans(prior, withdrawn, ["kind"])
    covered = I.merge_spans(kept.unionByName(staged), ["kind"])
    out = {"retained": kept, "coverage": covered} | ({"absent": I.subtract_spans(withdrawn, covered, ["kind"])} if absent else {})
    return out if fresh is None else out | {"fresh": resight(kept, fresh, at, run)[0]}


def resight(prior: DataFrame, fresh: DataFrame, at: int, run: str) -> tuple[DataFrame, DataFrame]:
    """(fresh after, refresh events) where nothing changed: prior ranges count as seen again, without an extraction. An event
    (kind, operation, ranges, ids) for each kind, with how many ids it covers."""
    stamps = prior.select("kind", "lo", "hi", F.lit(at).cast("long").alias("at"), F.lit(run).alias("run"), F.lit(0).cast("long").alias("arrival"))
    merged = I.merge_spans(prior.select("kind", "lo", "hi"), ["kind"])
    events = merged.groupBy("kind").agg(F.count("*").alias("ranges"), F.sum(F.col("hi") - F.col("lo") + 1).alias("ids"))
    return I.stamp(fresh, stamps, ["kind"]), events.select("kind", F.concat("kind", F.lit("_refresh")).alias("operation"), "ranges", "ids")


def mark_withdrawn(observations: DataFrame, absent: DataFrame, at: int, run: str) -> DataFrame:
    """Observations (id, present, observed_at, sync_run, ...) with present ones in the absent ranges (lo, hi) marked."""
    spans = absent.select(F.lit(0).alias("_k"), "lo", "hi", F.lit(True).alias("_gone"))
    met = I.asof_interval(observations.withColumn("_k", F.lit(0)), spans, ["_k"], "id", ["_gone"])
    gone = F.coalesce("_gone", F.lit(False)) & F.coalesce(F.col("present") == "present", F.lit(False))
    new = {"present": F.lit("absent_from_source"), "observed_at": F.lit(at).cast("long"), "sync_run": F.lit(run)}
    return met.withColumns({c: F.when(gone, v).otherwise(F.col(c)) for c, v in new.items()}).select(*observations.columns)


def dirty_media(previous: DataFrame, current: DataFrame, racy_ms: int, now_ms: int) -> DataFrame:
    """(row, reason) of files to look at again: new, another path, size or time, or written too shortly before to tell.
    Tables: (row, path, size, modified_ms)."""
    p = previous.select("row", F.struct("path", "size", "modified_ms").alias("_p"))
    t = current.join(p, "row", "left")
    now = F.struct("path", "size", "modified_ms")
    reason = F.when(F.col("_p").isNull(), "new").when(~F.col("_p.path").eqNullSafe(F.col("path")), "moved").when(~F.col("_p").eqNullSafe(now), "changed").when(F.col("modified_ms") > now_ms - racy_ms, "racy")
    return t.select("row", reason.alias("reason")).where("reason is not null")


def reset_detected(current: DataFrame, checkpoint: DataFrame, key: str = "Z_PK") -> DataFrame:
    """(table, reset): whether a table's largest row went backwards. checkpoint: (table, max_id)."""
    now = current.groupBy("table").agg(F.max(key).alias("_now"))
    return checkpoint.join(now, "table", "left").select("table", (F.coalesce("_now", F.lit(0)) < F.col("max_id")).alias("reset"))


def run_ranges(written: DataFrame, sighted: DataFrame, run: str) -> DataFrame:
    """(kind, lo, hi) of ids written or sighted in a run."""
    own = I.islands(written.where(F.col("run") == run), ["kind"])
    return I.merge_spans(own.unionByName(sighted.where(F.col("run") == run).select("kind", "lo", "hi")), ["kind"])
