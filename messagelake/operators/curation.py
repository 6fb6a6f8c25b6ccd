"""People and their identities, links across sources, scopes and their mapping, and purging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import intervals


def link(pairs: DataFrame, people: DataFrame, identities: DataFrame) -> DataFrame:
    """Confirmed links of existing people with existing identities; the link's urn follows from both."""
    good = pairs.join(people.select(F.col("urn").alias("person_urn")), "person_urn", "left_semi").join(identities.select(F.col("urn").alias("identity_urn")), "identity_urn", "left_semi")
    return good.distinct().select(S.link_urn("person_urn", "identity_urn").alias("urn"), "person_urn", "identity_urn", F.lit("confirmed").alias("state"))


def unlink(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links with some rejected; they stay as evidence."""
    gone = pairs.select("person_urn", "identity_urn", F.lit(True).alias("_g")).distinct()
    return links.join(gone, ["person_urn", "identity_urn"], "left").withColumn("state", F.when(F.col("_g"), "rejected").otherwise(F.col("state"))).drop("_g")


def suggest(identities: DataFrame, links: DataFrame, address: Column | None = None) -> DataFrame:
    """(address, identities, sources): groups of one address with two or more identities of two or more sources, not all
    linked yet and none rejected. identities: (urn, source, address)."""
    key = S.column("address") if address is None else address
    state = links.groupBy(F.col("identity_urn").alias("urn")).agg(F.bool_or(F.col("state") == "confirmed").alias("linked"), F.bool_or(F.col("state") == "rejected").alias("rejected"))
    t = identities.select("urn", "source", key.alias("address")).where("address is not null").join(state, "urn", "left")
    g = t.groupBy("address").agg(F.count("*").alias("identities"), F.count_distinct("source").alias("sources"), F.bool_and(F.coalesce("linked", F.lit(False))).alias("all"), F.bool_or(F.coalesce("rejected", F.lit(False))).alias("any"))
    return g.where("identities >= 2 and sources >= 2 and not all and not any").select("address", "identities", "sources")


def map_scope(observations: DataFrame, heads: DataFrame, source: Column | str, target: str, entity: str = "message") -> DataFrame:
    """(old_urn, new_urn) aliases of every record with a native key, in a target scope; what exists already is left out."""
    t = observations.where("not minted and native_key is not null").select(F.col("urn").alias("old_urn"), S.urn(source, target, entity, F.col("native_key")).alias("new_urn")).distinct()
    return t.join(heads.select(F.col("urn").alias("old_urn")), "old_urn", "left_semi").join(heads.select(F.col("urn").alias("new_urn")), "new_urn", "left_anti").where("old_urn != new_urn")


#: The type by which the urns of a kind of records are made.
ENTITY_TYPE = {"identities": "identity", "accounts": "identity", "chats": "chat", "messages": "message", "attachments": "attachment", "message_parts": "event", "events": "event", "chat_memberships": "event", "aliases": "event"}


def declare_same_scope(observations: DataFrame, heads: DataFrame, configured: DataFrame, known: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """(aliases, skipped): that an account scope is the same account as another. Every record that was seen in the old scope under
    a native key, and wasn't minted, gets an alias to the urn that it would have in the new one; nothing is rewritten, and an
    alias that is known isn't made again. skipped: (kind, n) of records whose kind has no urn of its own.

    It is an error if the scopes are one, if the old one has no records, or if records of it have a source that the new
    one doesn't have. observations: (urn, source, scope, native_key, minted); heads: (urn, kind, source, scope);
    configured: (source, scope); known: (old_urn, new_urn)."""
    if old == new:
        raise ValueError("both scopes are one")
    of = lambda df, scope: {r.source for r in df.where(F.col("scope") == scope).select("source").distinct().collect()}  # noqa: E731  # few sources
    have, target = of(heads, old), of(heads, new) | of(configured, new)
    if not have:
        raise ValueError(f"no records in scope {old}")
    if target and not have <= target:
        raise ValueError(f"scopes of different sources: {sorted(have)} and {sorted(target)}")
    seen = observations.where((F.col("scope") == old) & ~F.col("minted") & F.col("native_key").isNotNull()).select("urn", "source", "native_key").distinct().join(heads.select("urn", "kind"), "urn")
    typed = F.create_map(*(F.lit(x) for pair in ENTITY_TYPE.items() for x in pair))
    t = seen.withColumn("entity", F.try_element_at(typed, F.col("kind"))).withColumn("new_urn", S.urn(F.col("source"), new, F.col("entity"), F.col("native_key")))
    key = S.composite_key(F.lit("scope_map"), F.col("old_urn"), F.lit(new))
    pairs = t.where("new_urn is not null and new_urn != urn").select("source", F.col("urn").alias("old_urn"), "new_urn").distinct().join(known.select("old_urn", "new_urn"), ["old_urn", "new_urn"], "left_anti")
    aliases = pairs.select(S.urn(F.col("source"), old, "event", key).alias("urn"), "source", F.lit(old).alias("scope"), "old_urn", "new_urn", F.lit("scope_map").alias("reason"))
    return aliases, t.where(~F.col("kind").isin(*ENTITY_TYPE)).groupBy("kind").agg(F.count("*").alias("n"))


def scopes(heads: DataFrame, configured: DataFrame, mappings: DataFrame) -> DataFrame:
    """(scope, source, records, origin, mapped_to): scopes with records and scopes that are only configured."""
    n = heads.groupBy("scope", "source").agg(F.count("*").alias("records"))
    t = n.join(configured.select("scope", "source", F.lit("configured").alias("origin")), ["scope", "source"], "full_outer").join(mappings.select(F.col("from_scope").alias("scope"), F.col("to_scope").alias("mapped_to")), "scope", "left")
    return t.select("scope", "source", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("origin", F.lit("imported")).alias("origin"), "mapped_to")


def children(chosen: DataFrame, messages: DataFrame, dependants: Sequence[DataFrame], members: DataFrame) -> DataFrame:
    """(urn) of what goes with chosen records: messages of chats and what hangs on messages, and memberships of chats.
    messages: (urn, chat_urn); dependants: (urn, message_urn); members: (urn, chat_urn)."""
    chats = chosen.select(F.col("urn").alias("chat_urn"))
    own = chosen.select("urn").union(messages.join(chats, "chat_urn", "left_semi").select("urn")).union(members.join(chats, "chat_urn", "left_semi").select("urn")).distinct()
    keys = own.select(F.col("urn").alias("message_urn"))
    for d in dependants:
        own = own.union(d.join(keys, "message_urn", "left_semi").select("urn"))
    return own.distinct()


def purge(tables: dict[str, DataFrame], gone: DataFrame, key: str = "urn") -> dict[str, DataFrame]:
    """Every table without the records that go."""
    return {name: df.join(gone.select(F.col("urn").alias(key)), key, "left_anti") for name, df in tables.items()}


def purge_source(tables: dict[str, DataFrame], records: DataFrame, fresh: DataFrame, checkpoints: DataFrame, source: str, scope: str | None = None) -> dict[str, DataFrame]:
    """All tables without the records of a source, or of a scope of it; their freshness is forgotten and the source's
    checkpoints go. records: (urn, id, source, scope); fresh: (kind, lo, hi, at, run); checkpoints: (source, scope, ...)."""
    mine = F.coalesce(F.col("source") == source, F.lit(False))
    mine = mine & F.coalesce(F.col("scope") == scope, F.lit(False)) if scope else mine
    gone = records.where(mine)
    ids = gone.select(F.lit("record").alias("kind"), "id")
    left = intervals.forget(fresh, ids, ["kind"], ["at", "run"])
    return purge(tables | {"records": records}, gone.select("urn")) | {"fresh": left.select("kind", "lo", "hi", "at", "run"), "checkpoints": checkpoints.where(~mine)}
