"""From native tables of source family A to canonical tables. Native tables are a dict of DataFrames by name:
sessions, members, groups, push_names, messages, media, items, changes, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.state import kept
from . import aliases

SOURCE = "whatsapp"

# What message types hold, which of them are attachments, and what addresses and states are called.
SYSTEM_TYPE = 6
CONTENT = {0: "text", 1: "image", 2: "video", 3: "audio", 4: "contact", 5: "location", 7: "url", 8: "document", 11: "gif", 15: "sticker"}
ATTACHED = {"image": "image", "video": "video", "audio": "audio", "document": "document", "gif": "video", "sticker": "image", "contact": "contact", "location": "location"}
JID_KINDS = {"s.whatsapp.net": "jid_phone", "lid": "jid_lid", "g.us": "jid_group", "broadcast": "jid_broadcast", "status": "jid_status", "lid.status": "jid_status", "bot": "jid_bot"}
CHAT_KINDS = {"jid_group": "group", "jid_phone": "direct", "jid_lid": "direct", "jid_broadcast": "broadcast", "jid_status": "status"}
STATES = {1: "sent", 5: "delivered", 6: "sent", 8: "read"}


def _named(c: Column, names: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), c)


def jid_kind(c: Column | str) -> Column:
    c = S.column(c)
    return F.when(c.contains("@"), F.coalesce(_named(F.lower(S.jid_suffix(c)), JID_KINDS), F.lit("unknown"))).otherwise("unknown")


def chat_kind(c: Column | str, session_type: Column | str) -> Column:
    return F.coalesce(_named(jid_kind(c), CHAT_KINDS), F.concat(F.lit("unknown:"), F.coalesce(S.column(session_type).cast("string"), F.lit("None"))))


# --- message groups


def collapse_messages(messages: DataFrame) -> DataFrame:
    """Rows of one (chat, stanza) as one group: rep (the row of largest sort, then key), row ids, rows, largest sort.
    Rows without a stanza are left out; a null chat is a chat of its own."""
    rows = messages.where(F.coalesce("ZSTANZAID", F.lit("")) != "")
    order = F.struct(F.coalesce("ZSORT", F.lit(-(1 << 62))), "Z_PK")
    return rows.groupBy(F.col("ZCHATSESSION").alias("chat"), F.col("ZSTANZAID").alias("stanza")).agg(
        F.max_by(F.struct(*rows.columns), order).alias("rep"), F.sort_array(F.collect_list("Z_PK")).alias("row_ids"), F.count("*").alias("rows"), F.max("ZSORT").alias("max_sort"), F.max_by("ZMEDIAITEM", F.when(F.col("ZMEDIAITEM").isNotNull(), -F.col("Z_PK"))).alias("any_media")
    )


def pick_media(groups: DataFrame, media: DataFrame) -> DataFrame:
    """Adds `media`: the row that belongs to the representative, else to the group's first row that has one."""
    owners = media.where("ZMESSAGE is not null").select(F.col("ZMESSAGE").alias("_pk"), F.struct(*media.columns).alias("_m"))
    spread = groups.select("chat", "stanza", F.col("rep.Z_PK").alias("_rep"), F.explode("row_ids").alias("_pk"))
    best = spread.join(owners, "_pk").groupBy(F.col("chat").alias("_c"), F.col("stanza").alias("_s")).agg(F.min_by("_m", F.struct(F.col("_pk") != F.col("_rep"), "_pk", F.col("_m.Z_PK"))).alias("media"))
    return groups.join(best, F.col("chat").eqNullSafe(F.col("_c")) & (F.col("stanza") == F.col("_s")), "left").drop("_c", "_s")


def data_items(groups: DataFrame, items: DataFrame) -> DataFrame:
    """Adds `items`: title, summary and address of the representative's links, in order."""
    own = items.groupBy(F.col("ZMESSAGE").alias("_m")).agg(F.array_sort(F.collect_list(F.struct("ZINDEX", F.col("Z_PK").alias("pk"), F.col("ZTITLE").alias("title"), F.col("ZSUMMARY").alias("summary"), F.col("ZMATCHEDTEXT").alias("url")))).alias("items"))
    return groups.join(own, F.col("rep.Z_PK") == F.col("_m"), "left").drop("_m")


def chats(sessions: DataFrame, groups: DataFrame, scope: str) -> DataFrame:
    """Chat records; a group's creation time comes from its own table."""
    info = groups.where("ZCHATSESSION is not null").groupBy(F.col("ZCHATSESSION").alias("Z_PK")).agg(F.max("ZCREATIONDATE").alias("created"))
    t = sessions.join(info, "Z_PK", "left").withColumn("jid", S.jid("ZCONTACTJID"))
    return t.select(
        F.col("Z_PK").alias("chat_pk"), "jid", S.urn(SOURCE, scope, "chat", F.col("jid")).alias("urn"), chat_kind("jid", "ZSESSIONTYPE").alias("kind"), F.col("ZPARTNERNAME").alias("observed_name"),
        F.col("ZARCHIVED").cast("boolean").alias("is_archived"), S.ts_struct("created", "s").alias("created_at"),
    )


def with_parent(groups: DataFrame, messages: DataFrame) -> DataFrame:
    """Adds `parent`: the row that the representative answers."""
    rows = messages.select(F.col("Z_PK").alias("_p"), F.struct(F.col("ZCHATSESSION").alias("chat"), F.col("ZSTANZAID").alias("stanza"), F.col("ZFROMJID").alias("sender"), F.col("ZISFROMME").alias("from_me")).alias("parent"))
    return groups.join(rows, F.col("rep.ZPARENTMESSAGE") == F.col("_p"), "left").drop("_p")


def rejects(groups: DataFrame, chat_table: DataFrame) -> DataFrame:
    """Groups with `reject`: no chat session, an incoming message without sender, or null; and the chat's jid and urn."""
    c = chat_table.select(F.col("chat_pk").alias("_c"), F.col("jid").alias("chat_jid"), F.col("urn").alias("chat_urn"))
    t = groups.join(c, F.col("chat") == F.col("_c"), "left").drop("_c")
    incoming = ~F.coalesce(F.col("rep.ZISFROMME") != 0, F.lit(False)) & (F.coalesce(F.col("rep.ZFROMJID"), F.lit("")) == "")
    reason = F.when(F.col("chat_jid").isNull(), "message_without_chat_session").when(incoming, "incoming_without_sender")
    return t.withColumn("reject", reason)


def messages(native: dict[str, DataFrame], scope: str, files: DataFrame | None = None) -> dict[str, DataFrame]:
    """messages, parts, attachments, blobs, events and rejects. files: (path, sha256, size) of the media folder."""
    chat_table = chats(native["sessions"], native["groups"], scope)
    groups = data_items(pick_media(with_parent(collapse_messages(native["messages"]), native["messages"]), native["media"]), native["items"])
    checked = rejects(groups, chat_table)
    parents = chat_table.select(F.col("chat_pk").alias("_pc"), F.col("jid").alias("parent_jid"))
    t = checked.where("reject is null").join(parents, F.col("parent.chat") == F.col("_pc"), "left").drop("_pc")
    me = F.col("rep.ZISFROMME") == 1
    key = S.message_key("chat_jid", "rep.ZFROMJID", me, "stanza")
    parent_key = F.when(F.coalesce("parent.stanza", F.lit("")) != "", S.message_key("parent_jid", "parent.sender", F.coalesce(F.col("parent.from_me") == 1, F.lit(False)), "parent.stanza"))
    kind = F.col("rep.ZMESSAGETYPE")
    content = _named(kind, CONTENT)
    has_media = F.col("media").isNotNull() & (_named(content, ATTACHED).isNotNull() | F.col("media.ZMEDIALOCALPATH").isNotNull())
    t = t.withColumns({"native_key": key, "from_me": me, "reply_to_native": parent_key, "content": content, "has_media": F.coalesce(has_media, F.lit(False)), "text": F.when(F.col("rep.ZTEXT") != "", F.col("rep.ZTEXT"))})
    t = t.withColumns({"urn": S.urn(SOURCE, scope, "message", F.col("native_key")), "attachment_urn": S.urn(SOURCE, scope, "attachment", F.when(F.col("has_media"), S.attachment_key("native_key")))})
    t = t.withColumn("sender_urn", S.urn(SOURCE, scope, "identity", F.when(F.col("from_me"), S.me_key()).otherwise(S.jid("rep.ZFROMJID"))))
    t = t.withColumn("kind", F.when(kind == SYSTEM_TYPE, "system").when(F.col("content").isNotNull(), "message").otherwise(F.concat(F.lit("unknown:"), kind.cast("string"))))
    t = t.withColumn("parts", _parts())
    records = t.select(
        "urn", "native_key", "chat_urn", "sender_urn", F.col("from_me").alias("is_from_me"), "kind", S.ts_struct("rep.ZMESSAGEDATE", "s").alias("sent_at"), S.ts_struct("rep.ZSENTDATE", "s").alias("received_at"),
        F.when(F.col("from_me"), F.coalesce(_named(F.col("rep.ZMESSAGESTATUS"), STATES), F.lit("unknown"))).otherwise("unknown").alias("state"),
        S.urn(SOURCE, scope, "message", F.col("reply_to_native")).alias("reply_to_urn"), "reply_to_native", "text", F.col("has_media").alias("has_attachments"), F.size("parts").alias("part_count"),
        (F.coalesce("max_sort", F.lit(0)) < 0).alias("zsort_negative_only"), F.col("rows").alias("duplicate_rows"), "row_ids",
    )
    parts = t.select(F.col("urn").alias("message_urn"), "native_key", F.posexplode("parts").alias("index", "p")).select("message_urn", S.urn(SOURCE, scope, "event", S.composite_key(F.lit("part"), "native_key", F.col("index").cast("string"))).alias("urn"), "index", "p.*")
    attached = _attachments(t.where("has_media"), files)
    blobs = attached.where("availability = 'available'").select(F.col("blob_sha256").alias("sha256"), F.col("declared_size").alias("size")).dropDuplicates(["sha256"])
    events = t.where("kind = 'system'").select(
        S.urn(SOURCE, scope, "event", S.composite_key(F.lit("sysevent"), "native_key")).alias("urn"), F.concat(F.lit("unknown:"), F.coalesce(F.col("rep.ZGROUPEVENTTYPE").cast("string"), F.lit("None"))).alias("kind"),
        F.col("chat_urn").alias("target_urn"), F.col("chat_jid").alias("target_native"), F.col("sender_urn").alias("actor_urn"), S.ts_struct("rep.ZMESSAGEDATE", "s").alias("at"), F.col("urn").alias("carrier_message_urn"),
    )
    bad = checked.where("reject is not null").select(F.col("reject").alias("code"), F.concat(F.lit("Z_PK="), F.col("rep.Z_PK").cast("string")).alias("sample"), F.col("rep.Z_PK").alias("order"))
    return {"chats": chat_table, "messages": records, "parts": parts, "attachments": attached, "blobs": blobs, "events": events, "rejects": bad}


def _parts() -> Column:
    """Ordered parts: text, media (or contact, or place), its opaque metadata, links."""
    text = lambda c: c.cast("string")
    part = lambda kind, said, status, payload, att=None: F.struct(kind.alias("type"), text(said).alias("text"), F.lit(status).alias("parser_status"), text(payload).alias("payload"), text(att if att is not None else F.lit(None)).alias("attachment_urn"))
    content, media = F.col("content"), F.col("media")
    kind = F.when(content.isin("contact", "location"), content).otherwise("attachment")
    title = F.when(media["ZTITLE"] != "", media["ZTITLE"])
    payload = F.when(content == "location", F.to_json(F.struct(media["ZLATITUDE"].alias("latitude"), media["ZLONGITUDE"].alias("longitude"), title.alias("title")))).when(content == "contact", F.to_json(F.struct(media["ZVCARDNAME"].alias("vcard_name"), title.alias("title")))).otherwise(F.to_json(F.struct(title.alias("title"))))
    opaque = F.to_json(F.struct(F.lit("metadata").alias("source_field"), F.sha2(media["ZMETADATA"], 256).alias("sha256"), F.length(media["ZMETADATA"]).alias("size")))
    first = F.array(
        F.when(F.col("text").isNotNull(), part(F.lit("text"), F.col("text"), "decoded", F.lit(None))),
        F.when(F.col("has_media"), part(kind, F.when(content.isin("document", "contact"), title), "decoded", payload, F.when(kind == "attachment", F.col("attachment_urn")))),
        F.when(F.col("has_media") & media["ZMETADATA"].isNotNull(), part(F.lit("opaque"), F.lit(None), "unsupported", opaque)),
    )
    links = F.transform(F.coalesce("items", F.expr("cast(array() as array<struct<ZINDEX:int,pk:bigint,title:string,summary:string,url:string>>)")), lambda d: part(F.lit("link"), F.lit(None), "partial", F.to_json(F.struct(F.nullif(d["title"], F.lit("")).alias("title"), F.nullif(d["summary"], F.lit("")).alias("summary"), F.nullif(d["url"], F.lit("")).alias("url")))))
    return F.filter(F.concat(first, links), lambda p: p.isNotNull())


def _attachments(t: DataFrame, files: DataFrame | None) -> DataFrame:
    path = F.col("media.ZMEDIALOCALPATH")
    t = t.withColumn("path", path)
    if files is not None:
        t = t.join(files.select(F.col("path").alias("_f"), "sha256", "size"), F.col("path") == F.col("_f"), "left")
    else:
        t = t.withColumns({"sha256": F.lit(None).cast("string"), "size": F.lit(None).cast("long")})
    state = F.when(S.unsafe_path("path"), "unknown").when(F.col("path").isNull(), "not_downloaded").when(F.col("sha256").isNotNull(), "available").otherwise("missing")
    unsafe = state == "unknown"
    return t.select(
        F.col("attachment_urn").alias("urn"), S.attachment_key("native_key").alias("native_key"), F.col("urn").alias("message_urn"), F.when(F.col("text").isNull(), 0).otherwise(1).alias("part_index"), S.basename("path").alias("filename"),
        F.when(~F.coalesce(unsafe, F.lit(False)), F.coalesce("size", "media.ZFILESIZE")).alias("declared_size"), state.alias("availability"), F.when(~F.coalesce(unsafe, F.lit(False)), F.col("sha256")).alias("blob_sha256"),
        F.col("path").alias("source_path_hint"), F.coalesce(F.col("content") == "sticker", F.lit(False)).alias("is_sticker"), F.coalesce(_named(F.col("content"), ATTACHED), F.lit("other")).alias("kind"),
    )


# --- headers


def group_change_events(changes: DataFrame) -> DataFrame:
    """(key, row_ids, members): per (group, date, type) the lowest key's member list has the base key, every other
    distinct list an extended one, and equal lists are one event."""
    t = changes.select("Z_PK", S.group_event_key("ZGROUPJID", F.col("ZCHANGEDATE").cast("string"), F.col("ZCHANGETYPE").cast("string")).alias("base"), S.member_list("ZMEMBERJIDS").alias("members"))
    lists = t.groupBy("base", "members").agg(F.min("Z_PK").alias("first"), F.sort_array(F.collect_list("Z_PK")).alias("row_ids"))
    holder = F.first("members").over(Window.partitionBy("base").orderBy(F.col("first").asc_nulls_last(), "members"))
    return lists.withColumn("holder", holder).select(F.when(F.col("members") == F.col("holder"), F.col("base")).otherwise(S.extended_key(F.col("base"), F.col("members"))).alias("key"), "row_ids", "members")


def direct_memberships(chat_table: DataFrame, scope: str) -> DataFrame:
    """For chats that aren't groups: the counterpart and me."""
    who = F.explode(F.array(F.struct(F.col("jid").alias("member"), F.lit("chat_session_jid").alias("evidence")), F.struct(S.me_key().alias("member"), F.lit("chat_session_me").alias("evidence"))))
    t = chat_table.where("kind != 'group'").select(F.col("urn").alias("chat_urn"), "jid", who.alias("w"))
    return t.select(S.urn(SOURCE, scope, "event", S.composite_key(F.lit("membership"), "jid", "w.member")).alias("urn"), "chat_urn", S.urn(SOURCE, scope, "identity", F.col("w.member")).alias("identity_urn"), F.lit("member").alias("role"), F.lit("active").alias("state"), F.col("w.evidence").alias("evidence"))


def group_memberships(members: DataFrame, chat_table: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """(memberships, rejects) of the members table; rows of unknown chats are rejected."""
    rows = members.where("ZMEMBERJID is not null")
    c = chat_table.select(F.col("chat_pk").alias("ZCHATSESSION"), "jid", F.col("urn").alias("chat_urn"))
    t = rows.join(c, "ZCHATSESSION").withColumn("member", S.jid("ZMEMBERJID"))
    out = t.select(
        S.urn(SOURCE, scope, "event", S.composite_key(F.lit("membership"), "jid", "member")).alias("urn"), "chat_urn", S.urn(SOURCE, scope, "identity", F.col("member")).alias("identity_urn"),
        F.when(F.coalesce(F.col("ZISADMIN") != 0, F.lit(False)), "admin").otherwise("member").alias("role"), F.when(F.coalesce(F.col("ZISACTIVE") != 0, F.lit(False)), "active").otherwise("left").alias("state"), F.lit("group_member_table").alias("evidence"),
    )
    bad = rows.join(c, "ZCHATSESSION", "left_anti").select(F.lit("membership_without_chat").alias("code"), F.concat(F.lit("Z_PK="), F.col("Z_PK").cast("string")).alias("sample"), F.col("Z_PK").alias("order"))
    return out, bad


def observed_names(push: DataFrame, members: DataFrame, chat_table: DataFrame) -> DataFrame:
    """(jid, observed_names): push name, contact card, direct partner's name in that order, each name once."""
    part = lambda df, jid, name, rank, origin: df.select(S.jid(jid).alias("jid"), F.col(name).alias("name"), F.lit(rank).alias("rank"), F.lit(origin).alias("origin"))
    union = part(push, "ZJID", "ZPUSHNAME", 0, "push_name").unionByName(part(members, "ZMEMBERJID", "ZCONTACTNAME", 1, "contact_card")).unionByName(part(chat_table.where("kind = 'direct'"), "jid", "observed_name", 2, "chat_partner_name"))
    once = union.where(F.col("jid").isNotNull() & (F.coalesce("name", F.lit("")) != "")).groupBy("jid", "name").agg(F.min(F.struct("rank", "origin")).alias("o"))
    names = F.array_sort(F.collect_list(F.struct(F.col("o.rank").alias("rank"), "name", F.col("o.origin").alias("origin"))))
    return once.groupBy("jid").agg(F.transform(names, lambda x: F.struct(x["name"].alias("name"), x["origin"].alias("origin"))).alias("observed_names"))


def alias_pairs(sources: DataFrame) -> DataFrame:
    """(lid, phone, evidence) of pairs from several sources; phone numbers by their digits. sources: (lid, phone, source)."""
    phone = F.when(F.col("phone").contains("@"), S.jid("phone")).otherwise(F.concat(F.regexp_replace("phone", r"\D+", ""), F.lit("@s.whatsapp.net")))
    t = sources.where("lid is not null and phone is not null").select(S.jid("lid").alias("lid"), phone.alias("phone"), "source")
    return t.groupBy("lid", "phone").agg(F.sort_array(F.collect_set("source")).alias("evidence"))


def unambiguous_aliases(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, rejects): a lid with more than one phone gives no alias and an error for each pair."""
    t = pairs.withColumn("_n", F.count("*").over(Window.partitionBy("lid")))
    bad = t.where("_n > 1").select(F.lit("ambiguous_alias").alias("code"), F.lit("one lid maps to several phones").alias("sample"), F.col("lid").alias("order"))
    return t.where("_n = 1").drop("_n"), bad


def owner_closure(messages: DataFrame, pairs: DataFrame, grouped: DataFrame | None = None) -> DataFrame:
    """The owner's addresses: recipients of incoming rows, and all that alias pairs join with them. grouped: (member, root)
    of the pairs where a table of them is kept (aliases.add_aliases)."""
    seeds = messages.where("ZISFROMME = 0 and ZTOJID is not null").select(S.jid("ZTOJID").alias("jid")).distinct()
    return kept(aliases.closure(seeds, aliases.groups(pairs, "lid", "phone") if grouped is None else grouped))


def identities(native: dict[str, DataFrame], chat_table: DataFrame, pairs: DataFrame, scope: str) -> DataFrame:
    """One record for each address seen anywhere, and one for me."""
    one = lambda df, c: df.where(F.col(c).isNotNull()).select(S.jid(c).alias("jid"))
    names = observed_names(native["push_names"], native["members"], chat_table)
    owners = owner_closure(native["messages"], pairs)
    seen = names.select("jid")
    for df, c in ((native["members"], "ZMEMBERJID"), (chat_table, "jid"), (pairs, "lid"), (pairs, "phone"), (native["messages"], "ZFROMJID"), (native["messages"], "ZTOJID"), (owners, "jid")):
        seen = seen.union(one(df, c))
    t = seen.distinct().join(names, "jid", "left").join(owners.withColumn("is_me", F.lit(True)), "jid", "left")
    t = t.select(S.urn(SOURCE, scope, "identity", F.col("jid")).alias("urn"), F.col("jid").alias("native_key"), jid_kind("jid").alias("kind"), F.col("jid").alias("address"), F.coalesce("is_me", F.lit(False)).alias("is_me"), F.coalesce("observed_names", F.expr("cast(array() as array<struct<name:string,origin:string>>)")).alias("observed_names"))
    me = native["messages"].sparkSession.range(1).select(S.urn(SOURCE, scope, "identity", S.me_key()).alias("urn"), S.me_key().alias("native_key"), F.lit("me").alias("kind"), F.lit(None).cast("string").alias("address"), F.lit(True).alias("is_me"), F.expr("cast(array() as array<struct<name:string,origin:string>>)").alias("observed_names"))
    return t.unionByName(me)
