"""From native tables and the decoded feed of source family B to canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

SOURCE = "messages"

# Services, reactions, and what group actions are called.
TRANSPORTS = {"iMessage": "imessage", "SMS": "sms", "RCS": "rcs", "rcs": "rcs", "iMessageLite": "imessage"}
TAPBACKS = {"loved": "❤️", "liked": "👍", "disliked": "👎", "laughed": "😂", "emphasized": "‼️", "questioned": "❓"}
ACTIONS = {"participant_added": "membership_add", "participant_removed": "membership_remove", "participant_left": "membership_remove", "name_change": "subject_change", "icon_changed": "icon_change", "icon_removed": "icon_change"}
STYLES = {43: "group", 45: "direct"}
QUIET = ("audio_message_kept",)


def _named(c: Column, names: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), c)


def transport(service: Column | str) -> Column:
    return F.coalesce(_named(S.column(service), TRANSPORTS), F.lit("unknown"))


def identities(handles: DataFrame, scope: str) -> DataFrame:
    """One record for each (service, id): its rows, and the other spellings of the id."""
    key = S.handle_key("service", "id")
    t = handles.where("id is not null").groupBy(key.alias("native_key")).agg(F.min(F.when(F.col("id").contains("@"), F.lower("id")).otherwise(F.col("id"))).alias("address"), F.first("service").alias("service"), F.sort_array(F.collect_list("ROWID")).alias("row_ids"), F.sort_array(F.collect_set("uncanonicalized_id")).alias("spellings"))
    kind = F.when(F.col("address").contains("@"), "email").when(F.col("address").rlike(r"^\+?[0-9][0-9 ()-]+$"), "phone").otherwise("unknown")
    names = F.transform(F.filter("spellings", lambda n: (n != "") & (n != F.col("address"))), lambda n: F.struct(n.alias("name"), F.lit("uncanonicalized_id").alias("origin")))
    return t.select(S.urn(SOURCE, scope, "identity", F.col("native_key")).alias("urn"), "native_key", kind.alias("kind"), "address", "service", F.lit(False).alias("is_me"), names.alias("observed_names"), "row_ids")


def person_groups(handles: DataFrame) -> DataFrame:
    """How many person ids stand for more than one handle."""
    return handles.where("person_centric_id is not null").groupBy("person_centric_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("groups"))


def chats(chat: DataFrame, scope: str) -> DataFrame:
    key = S.chat_key("guid")
    return chat.select(F.col("ROWID").alias("chat_id"), S.urn(SOURCE, scope, "chat", key).alias("urn"), key.alias("native_key"), F.coalesce(_named(F.col("style"), STYLES), F.concat(F.lit("unknown:"), F.coalesce(F.col("style").cast("string"), F.lit("None")))).alias("kind"), F.when(F.col("display_name") != "", F.col("display_name")).alias("observed_name"), F.col("service_name").alias("service"), F.col("is_archived").cast("boolean").alias("is_archived"), "chat_identifier")


def memberships(joins: DataFrame, chat_table: DataFrame, handle_urns: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """(memberships, rejects): rows whose chat or handle is gone are rejected. handle_urns: (handle_id, identity_urn, identity_key)."""
    t = joins.join(chat_table.select("chat_id", F.col("urn").alias("chat_urn"), F.col("native_key").alias("chat_key")), "chat_id", "left").join(handle_urns, "handle_id", "left")
    good = F.col("chat_urn").isNotNull() & F.col("identity_urn").isNotNull()
    out = t.where(good).select(S.urn(SOURCE, scope, "event", S.composite_key(F.lit("membership"), "chat_key", "identity_key")).alias("urn"), "chat_urn", "identity_urn", F.lit("member").alias("role"), F.lit("active").alias("state")).distinct()
    bad = t.where(~good).select(F.lit("dangling_membership").alias("code"), F.concat_ws("/", "chat_id", "handle_id").alias("sample"), F.col("chat_id").alias("order"))
    return out, bad


def infer_chat(message: DataFrame, joins: DataFrame, chat: DataFrame) -> DataFrame:
    """(message_id, chat_id) of messages without a join row: the chat whose identifier is the tail of ck_chat_id, of
    the same service first, then the lowest row."""
    lost = message.join(joins.select(F.col("message_id").alias("ROWID")).distinct(), "ROWID", "left_anti").where("ck_chat_id is not null")
    left = lost.select(F.col("ROWID").alias("message_id"), "service", S.ck_identifier("ck_chat_id").alias("tail"))
    # a row for each identifier and service, then for each identifier: a message meets one of each, however many chats share it
    own = chat.groupBy(F.col("chat_identifier").alias("tail"), F.col("service_name").alias("_service")).agg(F.min("ROWID").alias("_own"))
    lowest = own.groupBy("tail").agg(F.min("_own").alias("_any"))
    own = own.withColumnRenamed("tail", "_tail")
    met = left.join(lowest, "tail").join(own, (F.col("tail") == F.col("_tail")) & F.col("service").eqNullSafe(F.col("_service")), "left")
    return met.groupBy("message_id").agg(F.min("_own").alias("_own"), F.min("_any").alias("_any")).select("message_id", F.coalesce("_own", "_any").alias("chat_id"))


def stub_chats(message: DataFrame, joins: DataFrame, inferred: DataFrame, scope: str) -> DataFrame:
    """(ck_chat_id, urn): chats for messages that neither a join row nor an identifier places."""
    lost = message.join(joins.select(F.col("message_id").alias("ROWID")).distinct(), "ROWID", "left_anti").join(inferred.select(F.col("message_id").alias("ROWID")), "ROWID", "left_anti")
    key = S.inferred_chat_key("ck_chat_id")
    return lost.where("ck_chat_id is not null").select("ck_chat_id").distinct().select("ck_chat_id", S.urn(SOURCE, scope, "chat", key).alias("urn"), key.alias("native_key"))


def attachment_owner(joins: DataFrame) -> DataFrame:
    """(attachment_id, owner): the lowest message that uses it."""
    return joins.groupBy("attachment_id").agg(F.min("message_id").alias("owner"))


FEED = (
    "type string, rowid long, guid string, chat_id long, handle_id long, other_handle long, service string, date long, date_read long, date_delivered long, date_edited long, is_from_me boolean, is_read boolean, "
    "item_type int, group_action_type int, group_action struct<kind:string,handle_id:long,name:string>, announcement string, variant string, balloon_bundle_id string, thread_originator_guid string, "
    "associated_message_guid string, associated_message_type int, associated_message_emoji string, tapback struct<part_index:int,action:string,kind:string,target_guid:string>, subject string, text string, parser_status string, "
    "parts array<struct<index:int,kind:string,text:string,attachment_guid:string,attachment_name:string,inline:boolean,links:array<string>,mentions:array<string>,edit_status:string,edit_history:array<struct<date:long,text:string>>>>, "
    "attachments array<struct<rowid:long,guid:string,filename:string,transfer_name:string,uti:string,mime_type:string,total_bytes:long,is_sticker:boolean,hide_attachment:boolean>>, deleted_from long, is_fully_unsent boolean"
)

_EVENT = "struct<kind:string,target_urn:string,target_native:string,date:bigint,payload:string>"


def messages(feed: DataFrame, chat_table: DataFrame, handle_urns: DataFrame, scope: str, inferred: DataFrame | None = None, stubs: DataFrame | None = None, owners: DataFrame | None = None, files: DataFrame | None = None, root: str = "~") -> dict[str, DataFrame]:
    """messages, parts, attachments, events and rejects of decoded messages (FEED). inferred: (message_id, chat_id);
    stubs: (rowid, stub_urn)."""
    c = chat_table.select("chat_id", F.col("urn").alias("join_urn"))
    t = feed.where("type = 'message'").join(c, "chat_id", "left")
    if inferred is not None:
        i = inferred.join(chat_table.select("chat_id", F.col("urn").alias("inferred_urn")), "chat_id").select(F.col("message_id").alias("rowid"), "inferred_urn")
        t = t.join(i, "rowid", "left")
    else:
        t = t.withColumn("inferred_urn", F.lit(None).cast("string"))
    t = t.join(stubs.select("rowid", "stub_urn"), "rowid", "left") if stubs is not None else t.withColumn("stub_urn", F.lit(None).cast("string"))
    t = t.join(handle_urns.select("handle_id", "identity_urn"), "handle_id", "left")
    me = F.coalesce("is_from_me", F.lit(False))
    t = t.withColumns({
        "urn": S.urn(SOURCE, scope, "message", F.col("guid")), "chat_urn": F.coalesce("join_urn", "inferred_urn", "stub_urn"),
        "chat_assignment": F.when(F.col("join_urn").isNotNull(), "join_table").when(F.coalesce("inferred_urn", "stub_urn").isNotNull(), "inferred").otherwise("none"),
        "sender_urn": F.when(me, S.urn(SOURCE, scope, "identity", S.me_key())).otherwise(F.col("identity_urn")), "me": me,
    })
    t = t.withColumns({"kind": _kind(), "parts_": _parts(scope)})
    t = t.withColumn("kind", F.when((F.size("parts_") == 0) & (F.col("parser_status") == "empty") & (F.col("variant") == "normal") & (F.col("kind") == "message"), "placeholder").otherwise(F.col("kind")))
    t = t.withColumn("events_", _events(scope))
    said = F.filter(F.concat(F.array("subject"), F.transform(F.filter("parts", lambda p: p["kind"] == "text"), lambda p: p["text"])), lambda x: F.coalesce(x, F.lit("")) != "")
    stamp = lambda c: S.ts_struct(F.when(F.col(c) != 0, F.col(c)), "ns")
    records = t.select(
        "urn", F.col("guid").alias("native_key"), "chat_urn", "chat_assignment", "sender_urn", F.col("me").alias("is_from_me"), transport("service").alias("transport"), "kind", S.ts_struct("date", "ns").alias("sent_at"),
        stamp("date_delivered").alias("received_at"), stamp("date_edited").alias("edited_at"), F.when(F.coalesce("is_fully_unsent", F.lit(False)), stamp("date_edited")).alias("retracted_at"),
        F.when(~F.col("me"), "unknown").when(F.coalesce("date_read", F.lit(0)) != 0, "read").when(F.coalesce("date_delivered", F.lit(0)) != 0, "delivered").otherwise("sent").alias("state"),
        S.urn(SOURCE, scope, "message", F.col("thread_originator_guid")).alias("reply_to_urn"), F.col("thread_originator_guid").alias("reply_to_native"),
        F.when((F.col("kind") != "reaction") & (F.size(said) > 0), F.array_join(said, "\n")).alias("text"), F.exists("parts_", lambda p: p["type"] == "attachment").alias("has_attachments"), F.size("parts_").alias("part_count"),
        F.when(F.col("deleted_from").isNotNull(), "deleted_from_chat").alias("tombstone_reason"),
    )
    parts = t.select(F.col("urn").alias("message_urn"), "guid", F.posexplode("parts_").alias("index", "p")).select("message_urn", S.urn(SOURCE, scope, "event", S.composite_key(F.lit("part"), "guid", F.col("index").cast("string"))).alias("urn"), "index", "p.type", "p.text", "p.attachment_urn", "p.payload")
    key = F.when(F.col("n") == 0, F.col("guid")).otherwise(S.composite_key("guid", F.lit("event"), F.col("n").cast("string")))
    events = t.select("guid", "date", F.col("urn").alias("carrier_message_urn"), F.col("sender_urn").alias("actor_urn"), F.posexplode("events_").alias("n", "e")).select(S.urn(SOURCE, scope, "event", key).alias("urn"), "e.kind", "e.target_urn", "e.target_native", "actor_urn", S.ts_struct(F.coalesce("e.date", "date"), "ns").alias("at"), "e.payload", "carrier_message_urn")
    bad = t.where(~F.col("me") & F.col("identity_urn").isNull() & (F.coalesce("handle_id", F.lit(0)) != 0)).select(F.lit("unknown_handle_id").alias("code"), F.concat(F.lit("ROWID="), F.col("rowid").cast("string")).alias("sample"), F.col("rowid").alias("order"))
    return {"messages": records, "parts": parts, "events": events, "attachments": _attachments(t, scope, owners, files, root), "rejects": bad}


def _kind() -> Column:
    loud = F.col("announcement").isNotNull() & ~F.col("announcement").isin(*QUIET)
    return (
        F.when((F.col("variant") == "tapback") & F.col("tapback").isNotNull(), "reaction").when(F.col("announcement") == "fully_unsent", "retraction").when(loud, "system")
        .when(~F.col("item_type").between(0, 6) & (F.col("variant") == "normal"), F.concat(F.lit("unknown:item_type_"), F.col("item_type").cast("string"))).otherwise("message")
    )


def _attachment_key(guid: Column, rowid: Column) -> Column:
    return F.coalesce(F.when(guid != "", guid), S.composite_key(F.lit("attachment_rowid"), rowid.cast("string")))


def _parts(scope: str) -> Column:
    """Subject, then the decoded parts, then attachments that no part names."""
    make = lambda kind, text, att, payload: F.struct(kind.alias("type"), text.cast("string").alias("text"), att.cast("string").alias("attachment_urn"), payload.cast("string").alias("payload"))
    none = F.lit(None)
    known = lambda guid: F.exists("attachments", lambda a: a["guid"] == guid)

    def one(p: Column) -> Column:
        key = F.when(known(p["attachment_guid"]), p["attachment_guid"]).otherwise(S.composite_key(F.lit("purged"), F.nullif(p["attachment_guid"], F.lit(""))))
        text = F.to_json(F.struct(p["links"].alias("links"), p["mentions"].alias("mentions"), F.when(p["edit_status"] != "original", p["edit_status"]).alias("edit_status"), p["edit_history"].alias("edit_history")))
        return (
            F.when(p["kind"] == "text", make(F.lit("text"), p["text"], none, text))
            .when(p["kind"] == "attachment", make(F.lit("attachment"), p["text"], S.urn(SOURCE, scope, "attachment", key), F.when(p["inline"], F.lit('{"inline":true}'))))
            .when(p["kind"] == "app", make(F.lit("app"), none, none, F.to_json(F.struct("balloon_bundle_id", "variant"))))
            .when(p["kind"] == "retracted", make(F.lit("opaque"), none, none, F.lit('{"retracted":true}')))
        )

    named = F.transform(F.filter("parts", lambda p: p["kind"] == "attachment"), lambda p: p["attachment_guid"])
    rest = F.filter("attachments", lambda a: a["guid"].isNull() | ~F.coalesce(F.array_contains(named, a["guid"]), F.lit(False)))
    trailing = F.transform(rest, lambda a: make(F.lit("attachment"), none, S.urn(SOURCE, scope, "attachment", _attachment_key(a["guid"], a["rowid"])), none))
    subject = F.array(F.when(F.col("subject") != "", make(F.lit("text"), F.col("subject"), none, F.lit('{"subject":true}'))))
    return F.filter(F.concat(subject, F.transform("parts", one), trailing), lambda p: p.isNotNull())


def _events(scope: str) -> Column:
    make = lambda kind, target, native, date, payload: F.struct(kind.cast("string").alias("kind"), target.cast("string").alias("target_urn"), native.cast("string").alias("target_native"), date.cast("long").alias("date"), payload.cast("string").alias("payload"))
    none = F.lit(None)
    tap = F.col("tapback")
    emoji = F.coalesce("associated_message_emoji", _named(tap["kind"], TAPBACKS))
    reaction = make(F.when(tap["action"] == "added", "reaction").otherwise("reaction_removed"), S.urn(SOURCE, scope, "message", tap["target_guid"]), tap["target_guid"], none, F.to_json(F.struct(tap["kind"].alias("tapback"), emoji.alias("emoji"), tap["part_index"].alias("part_index"))))
    action = make(F.coalesce(_named(F.col("group_action.kind"), ACTIONS), F.concat(F.lit("unknown:"), F.col("group_action.kind"))), F.col("chat_urn"), none, none, F.to_json(F.struct(F.col("group_action.kind").alias("action"), F.col("group_action.name").alias("name"))))
    first = F.array(
        F.when(F.col("kind") == "reaction", reaction).when(F.col("kind") == "retraction", make(F.lit("retraction"), F.col("urn"), none, none, F.lit("{}")))
        .when((F.col("announcement") == "group_action") & F.col("group_action").isNotNull(), action)
    )
    texts = F.filter("parts", lambda p: (p["kind"] == "text") & (F.size(p["edit_history"]) > 1))
    edits = F.flatten(F.transform(texts, lambda p: F.transform(F.slice(p["edit_history"], F.lit(2), F.size(p["edit_history"])), lambda h: make(F.lit("edit"), F.col("urn"), none, h["date"], F.to_json(F.struct(p["index"].alias("part_index")))))))
    return F.filter(F.concat(first, F.coalesce(edits, F.expr(f"cast(array() as array<{_EVENT}>)"))), lambda e: e.isNotNull())


def _attachments(t: DataFrame, scope: str, owners: DataFrame | None, files: DataFrame | None, root: str) -> DataFrame:
    """Attachment records: of several messages that share one only the owner gives it; purged ones have placeholders.

    files: (path, sha256, size) of the regular files that there are. One without a name isn't downloaded, one whose name
    is neither absolute nor under ~ is unknown, one whose file is there is available with its hash and size.
    """
    fields = ("guid", "filename", "transfer_name", "uti", "mime_type", "total_bytes", "is_sticker")
    places = F.filter("parts", lambda p: p["kind"] == "attachment")
    a = t.select(F.col("rowid").alias("message_id"), F.col("urn").alias("message_urn"), places.alias("places"), F.explode("attachments").alias("a"))
    first = F.try_element_at(F.filter("places", lambda p: p["attachment_guid"] == F.col("a.guid")), F.lit(1))["index"]
    a = a.select("message_id", "message_urn", F.col("a.rowid").alias("attachment_id"), first.alias("part_index"), *(f"a.{c}" for c in fields))
    if owners is not None:
        a = a.join(owners, "attachment_id", "left").where(F.coalesce("owner", "message_id") == F.col("message_id")).drop("owner")
    none = F.lit(None).cast("string")
    named = F.coalesce("filename", F.lit("")) != ""
    if files is None:
        a = a.withColumns({"blob_sha256": none, "size": F.lit(None).cast("long")})
    else:
        there = files.where("sha256 is not null").groupBy(F.col("path").alias("filename")).agg(F.min("sha256").alias("blob_sha256"), F.min("size").alias("size"))
        a = a.join(there, "filename", "left")
    safe = F.col("filename").startswith("~") | F.col("filename").startswith("/")
    found = safe & F.col("blob_sha256").isNotNull()
    availability = F.when(~named, "not_downloaded").when(~safe, "unknown").when(found, "available").otherwise("missing")
    top = root.rstrip("/") + "/"
    hint = F.when(named, F.when(F.col("filename").startswith(top), F.substring("filename", F.lit(len(top) + 1), F.length("filename"))).otherwise(S.basename("filename")))
    key = _attachment_key(F.col("guid"), F.col("attachment_id"))
    name = F.nullif(S.basename(F.coalesce("transfer_name", "filename")), F.lit(""))
    out = a.select(
        S.urn(SOURCE, scope, "attachment", key).alias("urn"), key.alias("native_key"), "message_urn", "part_index", name.alias("filename"), "mime_type", "uti", F.when(found, F.col("size")).otherwise(F.col("total_bytes")).alias("declared_size"),
        availability.alias("availability"), F.when(found, F.col("blob_sha256")).alias("blob_sha256"), hint.alias("source_path_hint"), F.coalesce("is_sticker", F.lit(False)).alias("is_sticker"), S.attachment_kind("mime_type", "uti").alias("kind"),
    )
    p = t.select(F.col("urn").alias("message_urn"), F.explode(F.filter("parts", lambda p: (p["kind"] == "attachment") & (p["attachment_guid"] != ""))).alias("p"), F.transform("attachments", lambda x: x["guid"]).alias("known"))
    key = S.composite_key(F.lit("purged"), "p.attachment_guid")
    none = F.lit(None).cast("string")
    gone = p.where(~F.coalesce(F.array_contains("known", F.col("p.attachment_guid")), F.lit(False))).select(S.urn(SOURCE, scope, "attachment", key).alias("urn"), key.alias("native_key"), "message_urn", F.col("p.index").alias("part_index"), F.col("p.attachment_name").alias("filename"), none.alias("mime_type"), none.alias("uti"), F.lit(None).cast("long").alias("declared_size"), F.lit("missing").alias("availability"), none.alias("blob_sha256"), none.alias("source_path_hint"), F.lit(False).alias("is_sticker"), F.lit("other").alias("kind"))
    return out.unionByName(gone)
