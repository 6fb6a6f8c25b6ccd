"""Typed tables of stored heads (urn, kind, record in JSON), and states of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields of a record that each kind's table holds, and states of evidence.
FIELDS = {
    "attachments": "message_urn string, availability string, blob_sha256 string",
    "message_parts": "message_urn string, index bigint",
    "chat_memberships": "chat_urn string, identity_urn string",
    "identity_links": "person_urn string, identity_urn string, state string",
    "aliases": "old_urn string, new_urn string",
}
EVENT = "target_urn string, kind string, at struct<utc_ms:bigint>, actor_urn string"
MESSAGE = (
    "chat_urn string, sender_urn string, sent_at struct<utc_ms:bigint>, received_at struct<utc_ms:bigint>, kind string, transport string,"
    " source string, account_scope string, has_attachments boolean, is_from_me boolean, text string"
)
PRESENT, ABSENT, DELETED = "present", "absent_from_source", "deleted_evidence"


def _parsed(heads: DataFrame, kind: str, fields: str) -> DataFrame:
    return heads.where(F.col("kind") == kind).select("urn", "record", F.from_json("record", fields).alias("r"))


def project_messages(heads: DataFrame) -> DataFrame:
    """Messages: their time is that of sent_at if there is one, else of received_at; an empty object is none. A tombstoned
    message has no text; absent flags are false."""
    r = _parsed(heads, "messages", MESSAGE)
    sent = F.when(F.coalesce(F.get_json_object("record", "$.sent_at"), F.lit("{}")) != "{}", F.col("r.sent_at"))
    dead = ~F.coalesce(F.get_json_object("record", "$.tombstone"), F.lit("false")).isin("false", "{}", "")
    flag = lambda name: F.coalesce(F.col(f"r.{name}"), F.lit(False)).alias(name)
    return r.select(
        "urn", "r.chat_urn", "r.sender_urn", F.coalesce(sent, "r.received_at")["utc_ms"].alias("utc_ms"), "r.kind", "r.transport", "r.source", "r.account_scope",
        flag("has_attachments"), flag("is_from_me"), F.when(~dead, F.col("r.text")).alias("text"),
    )


def project_events(heads: DataFrame) -> DataFrame:
    return _parsed(heads, "events", EVENT).select("urn", "r.target_urn", "r.kind", F.col("r.at.utc_ms").alias("at_ms"), "r.actor_urn")


def project(heads: DataFrame, kind: str) -> DataFrame:
    """Heads of another kind with its fields as columns; a field that a record lacks is null."""
    return _parsed(heads, kind, FIELDS[kind]).select("urn", "r.*")


def in_state(observations: DataFrame, *states: str) -> DataFrame:
    """Observations of some states, by default those that are present; a null state is none."""
    return observations.where(F.col("present").isin(*(states or (PRESENT,))))
