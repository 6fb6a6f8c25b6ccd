"""Searching, reading, listing and summarising messages, chats, people and media."""

from __future__ import annotations

import base64
import json
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.state import kept
from .store import sequenced

MAX_PAGE, DEFAULT_PAGE = 500, 50  # fixed values
HARMLESS = "ambiguous_lid_phone_pair"  # fixed value: the error that leaves a run complete


def message_filters(df: DataFrame, since: int | None = None, until: int | None = None, source: str | None = None, scope: str | None = None, chat: str | None = None, senders: Sequence[str] | None = None, transport: str | None = None, kinds: Sequence[str] | None = ("message",), has_attachment: bool | None = None) -> DataFrame:
    """All given conditions at once; until is exclusive; kinds None or 'all' admits every kind."""
    tests: list[Column] = []
    if since is not None:
        tests.append(F.col("utc_ms") >= since)
    if until is not None:
        tests.append(F.col("utc_ms") < until)
    for name, value in (("source", source), ("account_scope", scope), ("chat_urn", chat), ("transport", transport)):
        if value:
            tests.append(F.col(name) == value)
    if senders:
        tests.append(F.col("sender").isin(*senders))
    if kinds and "all" not in kinds:
        tests.append(F.col("kind").isin(*kinds))
    if has_attachment is not None:
        tests.append(F.col("has_attachments") == has_attachment)
    for t in tests:
        df = df.where(t)
    return df


def sender_set(messages: DataFrame, links: DataFrame, person: str) -> DataFrame:
    """Messages of a person's confirmed identities. links: (person_urn, identity_urn, state)."""
    own = links.where((F.col("person_urn") == person) & (F.col("state") == "confirmed")).select(F.col("identity_urn").alias("sender"))
    return messages.join(own.distinct(), "sender", "left_semi")


def senders(links: DataFrame, person: str | None = None, explicit: Sequence[str] = ()) -> DataFrame:
    """(sender): the explicit ones and a person's confirmed identities. It is an error if there are none: a filter without
    senders would find nothing without saying why."""
    named = links.sparkSession.createDataFrame([(s,) for s in explicit], "sender string")
    own = links.where((F.col("person_urn") == person) & (F.col("state") == "confirmed")).select(F.col("identity_urn").cast("string").alias("sender"))
    out = named.union(own).distinct()
    if person is not None and out.isEmpty():
        raise LookupError(f"person {person} has no linked identities")
    return out


def allowlisted(values: Column, names: Sequence[str]) -> Column:
    """Of a map the named entries that aren't null."""
    return F.map_filter(values, lambda k, v: k.isin(*names) & v.isNotNull())


def page(df: DataFrame, order: Sequence[tuple[str, bool]], limit: int = DEFAULT_PAGE, after: tuple | None = None) -> DataFrame:
    """The next rows after a cursor in a total order, one more than asked for to tell that there are more.
    order: (column, descending); nulls come first ascending and last descending."""
    if after is not None:
        test, equal = F.lit(False), F.lit(True)
        for (name, descending), value in zip(order, after, strict=True):
            c = F.col(name)
            if value is None:
                beyond = F.lit(False) if descending else c.isNotNull()
            else:
                beyond = (c < value) | c.isNull() if descending else c > value
            test = test | (equal & beyond)
            equal = equal & c.eqNullSafe(F.lit(value))
        df = df.where(test)
    return df.orderBy(*(F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_first() for n, d in order)).limit(min(max(limit, 1), MAX_PAGE) + 1)


def encode_cursor(*values) -> str:
    return base64.urlsafe_b64encode(json.dumps(values).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple:
    try:
        return tuple(json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))))
    except ValueError as e:
        raise ValueError("invalid cursor") from e


# --- text search


def query_phrases(query: str) -> list[list[str]]:
    """The tokens of each white-space separated part of a query, case and accents apart; parts without tokens don't count."""
    keep = lambda part: "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) in ("Co", "So", "Sk", "Mn") else " " for c in part)
    return [words for p in S.phrases(query) if (words := keep(S.fold_text(p)).split())]


def literal(text: Column | str, query: str) -> Column:
    """Every white-space separated part of a query occurs as a phrase, case and accents apart; a query without tokens
    matches nothing."""
    wanted = [" ".join(words) for words in query_phrases(query)]
    line = S.token_line(text)
    test = F.lit(bool(wanted))
    for w in wanted:
        test = test & line.contains(f" {w} ")
    return test


def search_terms(text: Column | str, all_of: Sequence[str] = (), any_of: Sequence[str] = (), none_of: Sequence[str] = (), phrase: str | None = None, prefix: str | None = None) -> Column:
    """A Boolean combination of tokens, a phrase and a token's beginning."""
    have = S.tokens(text)
    test = F.lit(True)
    for w in all_of:
        test = test & F.array_contains(have, S.fold_text(w))
    if any_of:
        test = test & F.arrays_overlap(have, F.array(*(F.lit(S.fold_text(w)) for w in any_of)))
    for w in none_of:
        test = test & ~F.array_contains(have, S.fold_text(w))
    if phrase:
        test = test & S.token_line(text).contains(f" {' '.join(S.fold_text(phrase).split())} ")
    if prefix:
        test = test & F.exists(have, lambda t: t.startswith(S.fold_text(prefix)))
    return test


def snippet(text: Column | str, terms: Sequence[str], size: int = 12) -> Column:
    """Tokens around the first hit, hits in brackets; it starts up to a third of its size before the hit."""
    have = S.tokens(text)
    wanted = F.array(*(F.lit(S.fold_text(t)) for t in terms))
    first = F.array_min(F.filter(F.transform(wanted, lambda w: F.array_position(have, w)), lambda p: p > 0))
    start = F.greatest(F.coalesce(first, F.lit(1)) - size // 3, F.lit(1))
    marked = F.transform(F.slice(have, start.cast("int"), size), lambda t: F.when(F.array_contains(wanted, t), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t))
    return F.array_join(marked, " ")


def token_index(messages: DataFrame, key: str = "urn", text: str = "text") -> DataFrame:
    """(token, key, positions): the inverted table that serves searches over large corpora; write it bucketed by token."""
    spread = messages.select(key, F.posexplode(S.tokens(text)).alias("pos", "token"))
    return spread.groupBy("token", key).agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def _shifted(positions: str, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def indexed_phrase(index: DataFrame, words: Sequence[str], key: str = "urn") -> DataFrame:
    """Keys whose texts hold the words one after the other, from the inverted table alone."""
    found = None
    for k, w in enumerate(words):
        at = index.where(F.col("token") == S.fold_text(w)).select(key, _shifted("positions", k).alias(f"p{k}"))
        found = at.withColumnRenamed("p0", "at") if found is None else found.join(at, key).withColumn("at", F.array_intersect("at", f"p{k}")).drop(f"p{k}")
        found = found.where(F.size("at") > 0)
    return found.select(key)


# --- budgets and context


def budget(df: DataFrame, chars: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Cuts texts where the characters before and in them exceed the budget. Meant for a page: one window over its rows."""
    before = F.coalesce(F.sum(F.char_length(F.coalesce("text", F.lit("")))).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumn("_before", before).withColumn("truncated", F.col("_before") + F.char_length(F.coalesce("text", F.lit(""))) > chars)
    return out.withColumn("text", F.when(F.col("truncated"), S.clip("text", (F.lit(chars) - F.col("_before")))).otherwise(F.col("text"))).drop("_before")


def neighbours(messages: DataFrame, anchors: DataFrame, before: int, after: int, chat: str = "chat_urn") -> DataFrame:
    """Of many anchors (urn as anchor) the messages up to so many places before and after in their chats, with offset.

    Only the anchors' chats are numbered, by one sort in ranges, so a chat with very many messages is no task's alone.
    """
    chats = messages.join(anchors.select(F.col("anchor").alias("urn")), "urn", "left_semi").select(chat).distinct()
    ranked = sequenced(messages.join(chats, chat, "left_semi"), [chat, "utc_ms", "urn"]).withColumnRenamed("seq", "_n")
    at = ranked.join(anchors.select(F.col("anchor").alias("urn")), "urn").select(F.col("urn").alias("anchor"), F.col(chat).alias("_chat"), F.explode(F.sequence(F.col("_n") - before, F.col("_n") + after)).alias("_at"), F.col("_n").alias("_own"))
    met = ranked.join(at, F.col(chat).eqNullSafe(F.col("_chat")) & (F.col("_n") == F.col("_at")))
    return met.withColumn("offset", F.col("_n") - F.col("_own")).drop("_n", "_chat", "_at", "_own")


def around(messages: DataFrame, anchor: str | int, before: int, after: int, chat: str = "chat_urn") -> DataFrame:
    """The messages up to so many places before and after one anchor, with offset: two filtered top lists, no ranking."""
    own = messages.where(F.col("urn") == anchor).select(F.col(chat).alias("_chat"), F.col("utc_ms").alias("_ms")).first()
    if own is None:
        return messages.limit(0).withColumn("offset", F.lit(0))
    ms = F.coalesce("utc_ms", F.lit(-(1 << 62)))  # undated messages come first
    here = messages.where(F.col(chat).eqNullSafe(F.lit(own["_chat"]))).withColumn("_ms", ms)
    place = F.struct("_ms", "urn")
    at = F.struct(F.lit(-(1 << 62) if own["_ms"] is None else own["_ms"]).cast("long").alias("_ms"), F.lit(anchor).alias("urn"))
    back = here.where(place < at).orderBy(F.desc("_ms"), F.desc("urn")).limit(before).withColumn("offset", -F.row_number().over(Window.orderBy(F.desc("_ms"), F.desc("urn"))))
    on = here.where(place >= at).orderBy("_ms", "urn").limit(after + 1).withColumn("offset", F.row_number().over(Window.orderBy("_ms", "urn")) - 1)
    return back.unionByName(on).drop("_ms")  # both windows hold a page at most


# --- chats, people, media


def chat_activity(chats: DataFrame, messages: DataFrame, since: int | None = None, chat: str = "chat") -> DataFrame:
    """Chats with the number and the latest time of their messages; those without messages stay unless `since` asks."""
    seen = messages.groupBy(chat).agg(F.count("*").alias("n"), F.max("utc_ms").alias("last_ms"))
    out = chats.join(seen, chat, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.where(F.col("last_ms") >= since) if since is not None else out


def by_label(chats: DataFrame, needle: str) -> DataFrame:
    """Chats whose label, or a participant's, holds a text, case apart. participants: array<string>."""
    n = needle.lower()
    return chats.where(F.lower("label").contains(n) | F.exists("participants", lambda p: F.lower(p).contains(n)))


def list_chats(
    chats: DataFrame, messages: DataFrame, members: DataFrame, since: int | None = None, source: str | None = None, label: str | None = None,
    participants: Sequence[str] | None = None, limit: int = DEFAULT_PAGE, after: tuple | None = None,
) -> DataFrame:
    """A page of chats, the latest activity first and chats without any last, one row more than asked for if others follow.

    chats: (urn, source, label); messages: (chat_urn, kind, utc_ms); members: (chat_urn, identity_urn, label). A label is
    looked for in that of the chat and of its participants; participants keeps chats of any of these identities.
    """
    t = chats.where(F.col("source") == source) if source else chats
    if participants is not None:
        t = t.join(members.where(F.col("identity_urn").isin(*participants)).select(F.col("chat_urn").alias("urn")), "urn", "left_semi")
    seen = messages.where("kind = 'message'").groupBy(F.col("chat_urn").alias("urn")).agg(F.count("*").alias("n"), F.max("utc_ms").alias("last_ms"))
    t = t.join(seen, "urn", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if since is not None:
        t = t.where(F.col("last_ms") >= since)
    if label:
        n = label.lower()
        hit = members.where(F.lower("label").contains(n)).select(F.col("chat_urn").alias("urn"), F.lit(True).alias("_hit")).distinct()
        t = t.join(hit, "urn", "left").where(F.coalesce(F.lower("label").contains(n), F.lit(False)) | F.col("_hit")).drop("_hit")
    return page(t, [("last_ms", True), ("urn", False)], limit, after)


def cap_children(df: DataFrame, by: Sequence[str], child: str, n: int = 50) -> DataFrame:
    """The first n children of a parent by name, and how many there are; ranks first, so no parent is collected whole."""
    order = Window.partitionBy(*by).orderBy(child)
    few = df.select(*by, child).distinct().withColumn("_r", F.row_number().over(order))
    return few.groupBy(*by).agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(F.col("_r") <= n, F.col(child)))).alias("children"))


def hydrate_chats(chats: DataFrame, messages: DataFrame, members: DataFrame, labels: DataFrame, n: int = 50) -> DataFrame:
    """Chats as listings show them: (urn, chat_kind, label, service, assignment, message_count, last_message_utc_ms, participants
    of (urn, label), provenance of (source, account_scope)). A chat has its first n participants by urn; ranks come before
    labels, so of a large chat only those are joined and collected.

    chats: (urn, kind, service, assignment, source, account_scope); messages: (chat_urn, utc_ms); members: (chat_urn,
    identity_urn); labels: (urn, label)."""
    wanted = chats.select(F.col("urn").alias("chat_urn"))
    active = messages.join(wanted, "chat_urn", "left_semi").groupBy("chat_urn").agg(F.count("*").alias("message_count"), F.max("utc_ms").alias("last_message_utc_ms"))
    order = Window.partitionBy("chat_urn").orderBy("identity_urn")
    few = members.select("chat_urn", "identity_urn").where("identity_urn is not null").join(wanted, "chat_urn", "left_semi").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    called = labels.select("urn", "label")
    named = few.join(called.withColumnRenamed("urn", "identity_urn"), "identity_urn", "left")
    people = named.groupBy("chat_urn").agg(F.array_sort(F.collect_list(F.struct(F.col("identity_urn").alias("urn"), "label"))).alias("participants"))
    t = chats.join(called, "urn", "left").withColumnRenamed("urn", "chat_urn").join(active, "chat_urn", "left").join(people, "chat_urn", "left")
    none = F.array().cast("array<struct<urn:string,label:string>>")
    return t.select(
        F.col("chat_urn").alias("urn"), F.col("kind").alias("chat_kind"), "label", "service", "assignment", F.coalesce("message_count", F.lit(0)).alias("message_count"), "last_message_utc_ms",
        F.coalesce(F.col("participants").cast("array<struct<urn:string,label:string>>"), none).alias("participants"), F.struct("source", "account_scope").alias("provenance"),
    )


def attach_children(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Parents with arrays of children; each child table is grouped by the key before it is joined. children: (key, order, row)."""
    for name, df in children.items():
        grouped = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "row"))), lambda x: x["row"]).alias(name))
        parents = parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.expr(f"cast(array() as {grouped.schema[name].dataType.simpleString()})")))
    return parents


def counterpart_labels(members: DataFrame) -> DataFrame:
    """(chat, label) of chats with exactly one member other than me. members: (chat, identity, is_me, label)."""
    out = members.groupBy("chat").agg(F.count_if(~F.coalesce("is_me", F.lit(False))).alias("n"), F.max(F.when(~F.coalesce("is_me", F.lit(False)), F.col("label"))).alias("label"))
    return out.where((F.col("n") == 1) & (F.col("label") != "")).select("chat", "label")


def expand_participant(base: DataFrame, aliases: DataFrame) -> DataFrame:
    """Identities and what one alias step, either way, adds. base: (urn); aliases: (old_urn, new_urn)."""
    one = aliases.select(F.col("old_urn").alias("urn"), F.col("new_urn").alias("to"))
    two = aliases.select(F.col("new_urn").alias("urn"), F.col("old_urn").alias("to"))
    return base.select("urn").union(one.union(two).join(base, "urn").select("to")).distinct()


def availability_summary(attachments: DataFrame, by: Sequence[str]) -> DataFrame:
    return attachments.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def media_summary(attachments: DataFrame) -> DataFrame:
    """(source, availability, local_state): number, declared bytes and how many have a hash."""
    measures = [F.count("*").alias("n"), F.coalesce(F.sum("declared_size"), F.lit(0)).alias("declared_bytes"), F.count("blob_sha256").alias("hashed")]
    return attachments.groupBy("source", "availability", "local_state").agg(*measures)


def unavailable_by_chat(attachments: DataFrame, messages: DataFrame, n: int) -> DataFrame:
    """The chats with most attachments that aren't at hand; ties by chat. The source is that of the latest one."""
    met = attachments.join(messages, attachments["message"] == messages["urn"]).select("chat", "availability", "bytes", attachments["source"], "utc_ms", attachments["urn"])
    out = met.groupBy("chat").agg(
        F.count_if(F.col("availability") == "missing").alias("missing"), F.count_if(F.col("availability") == "not_downloaded").alias("not_downloaded"),
        F.sum(F.when(F.col("availability") != "available", F.col("bytes")).otherwise(0)).alias("bytes"), F.max("utc_ms").alias("last_ms"),
        F.max_by("source", F.struct("utc_ms", "urn")).alias("source"),
    )
    return out.withColumn("unavailable", F.col("missing") + F.col("not_downloaded")).where("unavailable > 0").orderBy(F.desc("unavailable"), "chat").limit(n)


def coverage(messages: DataFrame, by: Sequence[str]) -> DataFrame:
    return messages.groupBy(*by).agg(F.count("*").alias("n"), F.min("utc_ms").alias("first_ms"), F.max("utc_ms").alias("last_ms"))


def latest_runs(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The latest run of each key by time, then by urn."""
    return runs.groupBy(*by).agg(F.max_by(F.struct("urn", "status"), F.struct("observed_at", "urn")).alias("r")).select(*by, "r.*")


def tally_errors(rejects: DataFrame) -> DataFrame:
    """(code, count, sample): the sample is the first by order. rejects: (code, sample, order)."""
    return rejects.groupBy("code").agg(F.count("*").alias("count"), F.min_by("sample", "order").alias("sample"))


def run_status(errors: DataFrame, harmless: str = HARMLESS) -> DataFrame:
    """`partial` if any error counts, else `complete`; one row."""
    return errors.agg(F.when(F.coalesce(F.bool_or(F.col("code") != harmless), F.lit(False)), "partial").otherwise("complete").alias("status"), F.coalesce(F.sum("count"), F.lit(0)).alias("errors"))


def tally(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of what an adapter met and doesn't know; rows without a key don't count."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def run_rows(runs: DataFrame, outcomes: DataFrame, unsupported: DataFrame, seen: DataFrame, errors: DataFrame, by: Sequence[str] = ("run",), harmless: str = HARMLESS) -> DataFrame:
    """The rows of finished runs: status, counts of outcomes and of unsupported kinds as maps, coverage, errors.

    outcomes and unsupported: (*by, name, n); seen: (*by, n, first_ms, last_ms); errors: (*by, code, count, sample).
    """
    keys = list(by)
    as_map = lambda df, name: df.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias(name))
    told = errors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("code", "count", "sample"))).alias("errors"))
    t = runs.join(as_map(outcomes, "written"), keys, "left").join(as_map(unsupported, "unsupported"), keys, "left").join(told, keys, "left")
    t = t.join(seen.select(*keys, F.struct("n", "first_ms", "last_ms").alias("coverage")), keys, "left")
    bad = F.exists("errors", lambda e: e["code"] != harmless)
    return t.withColumn("status", F.when(F.coalesce(bad, F.lit(False)), "partial").otherwise("complete"))


def followed(aliases: DataFrame, heads: DataFrame) -> DataFrame:
    """(urn, to): where chains of single aliases (old_urn, new_urn) lead from urns without a head, however long. `to` is
    null for a chain that runs in a circle."""
    lost = aliases.join(heads.select(F.col("urn").alias("old_urn")), "old_urn", "left_anti")
    single = lost.groupBy(F.col("old_urn").alias("urn")).agg(F.count_distinct("new_urn").alias("n"), F.min("new_urn").alias("to")).where("n = 1")
    now = kept(single.select("urn", "to"))
    for _ in range(now.count().bit_length() + 1):  # each round doubles the stretch that a row covers
        ahead = now.select(F.col("urn").alias("to"), F.col("to").alias("far"), F.lit(True).alias("on"))
        now = kept(now.join(ahead, "to", "left").select("urn", F.when(F.col("on"), F.col("far")).otherwise(F.col("to")).alias("to"), F.coalesce("on", F.lit(False)).alias("on")))
        if now.where("on").isEmpty():
            return now.select("urn", "to")
        now = now.drop("on")
    ends = now.join(now.select(F.col("urn").alias("to"), F.lit(True).alias("on")), "to", "left")
    return ends.select("urn", F.when(F.col("on").isNull(), F.col("to")).alias("to"))


def resolve(citations: DataFrame, heads: DataFrame, revisions: DataFrame, aliases: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """The status of citations (urn, digest or null). A urn without a head is followed over single aliases to the end;
    several aliases are ambiguous, and without any, or in a circle, it is unknown. A cited digest that isn't the head's
    decides: revision_superseded if it is stored, else unknown_revision. Else the head is tombstoned, unavailable (a stub)
    or current. heads: (urn, digest, tombstoned, and stub if there are any). ends: what followed() gives, where it is kept
    between calls."""
    ends = (followed(aliases, heads) if ends is None else ends).select("urn", F.col("to").alias("_to"), F.lit(True).alias("_via"))
    many = aliases.groupBy(F.col("old_urn").alias("_at")).agg((F.count_distinct("new_urn") > 1).alias("_many"))
    now = citations.select("urn", "digest").join(ends, "urn", "left").withColumn("_at", F.when(F.col("_via"), F.col("_to")).otherwise(F.col("urn")))
    stub = F.coalesce("stub", F.lit(False)) if "stub" in heads.columns else F.lit(False)
    h = heads.select(F.col("urn").alias("_at"), F.col("digest").alias("_d"), F.coalesce("tombstoned", F.lit(False)).alias("_t"), stub.alias("_s"), F.lit(True).alias("_head"))
    r = revisions.select(F.col("urn").alias("_at"), "digest", F.lit(True).alias("_known")).distinct()
    met = now.join(h, "_at", "left").join(r, ["_at", "digest"], "left").join(many, "_at", "left")
    status = (
        F.when(F.col("_head").isNull() & F.col("_many"), "ambiguous").when(F.col("_head").isNull(), "unknown")
        .when((F.col("digest") != F.col("_d")) & F.col("_known"), "revision_superseded").when(F.col("digest") != F.col("_d"), "unknown_revision")
        .when(F.col("_t"), "tombstoned").when(F.col("_s"), "unavailable").otherwise("current")
    )
    return met.select("urn", "digest", F.col("_at").alias("resolved_urn"), status.alias("status"))


def local_state(attachments: DataFrame, blobs: DataFrame, files: DataFrame) -> DataFrame:
    """restored if its bytes are stored, else source_file if the source has the file, else absent."""
    b = blobs.select(F.col("sha256").alias("blob_sha256"), F.lit(True).alias("_b")).distinct()
    f = files.select(F.col("path").alias("source_path_hint"), F.lit(True).alias("_f")).distinct()
    met = attachments.join(b, "blob_sha256", "left").join(f, "source_path_hint", "left")
    return met.withColumn("local_state", F.when(F.col("_b"), "restored").when(F.col("_f"), "source_file").otherwise("absent")).drop("_b", "_f")


def render(sender: Column, ms: Column, text: Column, zone: str = "UTC") -> Column:
    """A message as a line: [time] sender: text."""
    at = F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone), "yyyy-MM-dd HH:mm")
    return F.concat(F.lit("["), F.coalesce(at, F.lit("?")), F.lit("] "), F.coalesce(sender, F.lit("?")), F.lit(": "), F.coalesce(text, F.lit("")))


def render_message(urn: Column, ms: Column, sender: Column, mine: Column, text: Column, kind: Column, attachments: Column, events: Column, truncated: Column, zone: str = "UTC") -> Column:
    """A message as a reader sees it: time, who, text, then its attachments and reactions, its kind unless it is a plain message,
    and its urn on a line of its own. attachments: array of (kind, filename, availability); events: array of (kind, emoji), of
    which reactions are shown; both may be null."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    at = F.coalesce(F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone), "yyyy-MM-dd HH:mm"), F.lit("?"))
    who = F.when(F.coalesce(mine, F.lit(False)), "me").otherwise(F.coalesce(F.when(sender != "", sender), F.lit("?")))
    none = F.array().cast("array<string>")
    files = F.coalesce(F.transform(attachments, lambda a: F.concat(F.lit("[attachment "), blank(a["kind"]), F.lit(" "), blank(a["filename"]), F.lit(" "), blank(a["availability"]), F.lit("]"))), none)
    shown = F.filter(events, lambda e: F.coalesce(e["kind"].startswith("reaction"), F.lit(False)))
    reactions = F.coalesce(F.transform(shown, lambda e: F.concat(F.lit("["), e["kind"], F.lit(" "), blank(e["emoji"]), F.lit("]"))), none)
    own = F.when(kind != "message", F.array(F.concat(F.lit("["), kind, F.lit("]")))).otherwise(none)
    extras = F.concat(files, reactions, own)
    return F.concat(at, F.lit("  "), who, F.lit(": "), blank(text), F.when(F.size(extras) > 0, F.concat(F.lit("  "), F.array_join(extras, " "))).otherwise(""), F.when(F.coalesce(truncated, F.lit(False)), " …[truncated]").otherwise(""), F.lit("\n    "), urn)


# --- history, people, status


def search_history(revisions: DataFrame, messages: DataFrame, query: str) -> DataFrame:
    """Every retained revision that says it, with whether it is the current one. revisions: (urn, digest, text);
    messages: (urn, digest as the head's, ...)."""
    heads = messages.withColumnRenamed("digest", "head_digest").drop("text")
    hits = revisions.where(literal("text", query)).select("urn", "digest", "text").join(heads, "urn")
    return hits.withColumn("revision_status", F.when(F.col("digest") == F.col("head_digest"), "current").otherwise("revision_superseded"))


def labels(wanted: DataFrame, identities: DataFrame, chats: DataFrame, people: DataFrame, counterparts: DataFrame) -> DataFrame:
    """(urn, label) of identities, chats and people. An unnamed chat is called after its only counterpart, then after its
    handle. identities: (urn, label); chats: (urn, observed_name, native_key); people: (urn, label); counterparts: (chat, label)."""
    named = chats.join(counterparts.select(F.col("chat").alias("urn"), F.col("label").alias("_c")), "urn", "left")
    named = named.select("urn", F.coalesce(F.when(F.col("observed_name") != "", F.col("observed_name")), "_c", S.handle_of("native_key")).alias("label"))
    known = identities.select("urn", "label").unionByName(named).unionByName(people.select("urn", "label"))
    return wanted.select("urn").distinct().join(known, "urn", "left").select("urn", "label")


def list_people(people: DataFrame, links: DataFrame, identities: DataFrame) -> DataFrame:
    """People with their links: state, urn and label of each identity, in order."""
    i = identities.select(F.col("urn").alias("identity_urn"), F.col("label").alias("identity_label"))
    own = links.join(i, "identity_urn", "left").groupBy(F.col("person_urn").alias("urn")).agg(F.array_sort(F.collect_list(F.struct("identity_urn", "state", "identity_label"))).alias("identities"))
    return people.join(own, "urn", "left")


def freshness(scopes: DataFrame, runs: DataFrame) -> DataFrame:
    """Scopes with their latest run; scopes without one have nulls."""
    return scopes.join(latest_runs(runs, ["source", "scope"]), ["source", "scope"], "left")


def status(scopes: DataFrame, runs: DataFrame, heads: DataFrame, messages: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(part, name, value): records by kind, messages by source, open conflicts and latest runs as one table."""
    line = lambda df, part, name, value: df.select(F.lit(part).alias("part"), name.cast("string").alias("name"), value.cast("string").alias("value"))
    kinds = heads.groupBy("kind").agg(F.count("*").alias("n"))
    seen = coverage(messages, ["source"])
    unsettled = conflicts.agg(F.count_if(F.col("resolved_at").isNull()).alias("n"))
    fresh = freshness(scopes, runs)
    return line(kinds, "records", F.col("kind"), F.col("n")).unionByName(line(seen, "messages", F.col("source"), F.col("n"))).unionByName(line(unsettled, "conflicts", F.lit("open"), F.col("n"))).unionByName(line(fresh, "run", F.concat_ws("/", "source", "scope"), F.coalesce("status", F.lit("never"))))


def add_iso(df: DataFrame) -> DataFrame:
    """Adds an ISO text for every timestamp struct at the top level."""
    stamps = [f.name for f in df.schema.fields if getattr(f.dataType, "names", None) == ["raw", "unit", "epoch", "utc_ms"]]
    return df.withColumns({f"{c}_iso": S.iso_utc(f"{c}.utc_ms") for c in stamps}) if stamps else df


def budget_remaining(df: DataFrame, chars: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Cuts texts to what is left of a budget, which a cut text uses up."""
    before = F.coalesce(F.sum(F.char_length(F.coalesce("text", F.lit("")))).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(chars) - F.col("_before"), F.lit(0))
    out = df.withColumn("_before", before).withColumn("truncated", F.char_length(F.coalesce("text", F.lit(""))) > left)
    return out.withColumn("text", F.when(F.col("truncated"), S.clip("text", left)).otherwise(F.col("text"))).drop("_before")
