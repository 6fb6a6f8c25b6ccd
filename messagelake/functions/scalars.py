"""Column expressions: times, canonical JSON, identifiers, digests, keys, addresses, labels, months, text."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Sequence
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Identifiers equal those of existing data only with this name space and that data's identifier version.
NAMESPACE = "3f14f01c-5cc4-4325-950f-a56812da489b"
ID_VERSION = "message-id-v1"

# 2001-01-01T00:00:00Z in milliseconds, and the units in which sources write times.
EPOCH_2001_MS = 978_307_200_000
UNITS = {"s": 1_000, "ms": 1, "us": 1_000, "ns": 1_000_000}

# Fields that don't count for a record's digest.
VOLATILE = ("observed_at", "sync_run", "revision_digest")

TS = "struct<raw:string,unit:string,epoch:string,utc_ms:bigint>"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- times


def utc_ms(raw: Column | str, unit: str, epoch: str = "2001") -> Column:
    """A source's number as UTC milliseconds, cut toward zero; null stays null."""
    value = column(raw).cast("decimal(38,6)")
    ms = value * F.lit(UNITS["s"]) if unit == "s" else value if unit == "ms" else value / F.lit(UNITS[unit])
    cut = F.when(ms >= 0, F.floor(ms)).otherwise(F.ceil(ms)).cast("long")
    return cut + F.lit(EPOCH_2001_MS if epoch == "2001" else 0)


def ts_struct(raw: Column | str, unit: str, epoch: str = "2001") -> Column:
    """{raw, unit, epoch, utc_ms}; null for a null number."""
    made = F.struct(column(raw).cast("string").alias("raw"), F.lit(unit).alias("unit"), F.lit(epoch).alias("epoch"), utc_ms(raw, unit, epoch).alias("utc_ms"))
    return F.when(column(raw).isNotNull(), made)


def iso_utc(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(column(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def ms_of(ts: Column | str) -> Column:
    """A time-zone-free timestamp as UTC milliseconds, in a session whose zone is UTC."""
    return F.unix_millis(column(ts).cast("timestamp"))


def month_label(ms: Column | str) -> Column:
    """YYYY-MM in UTC; `undated` for null."""
    return F.coalesce(F.date_format(F.timestamp_millis(column(ms)), "yyyy-MM"), F.lit("undated"))


def month_start(ms: Column | str) -> Column:
    return F.unix_millis(F.date_trunc("month", F.timestamp_millis(column(ms))))


def next_month(ms: Column | str) -> Column:
    return F.unix_millis(F.add_months(F.date_trunc("month", F.timestamp_millis(column(ms))).cast("date"), 1).cast("timestamp"))


def range_label(since_ms: int, until_ms: int) -> str:
    day = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%d")
    return f"{day(since_ms)}..{day(until_ms)}"


def parse_date(text: str, zone: str = "UTC") -> int:
    """A day (its local midnight) or an RFC 3339 time as UTC milliseconds."""
    moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if moment.tzinfo is None:
        if len(text) != 10:
            raise ValueError("a time needs an offset")
        moment = moment.replace(tzinfo=ZoneInfo(zone))
    return int(moment.timestamp() * 1000)


# --- JSON, identifiers, digests


def _lower_escapes(json: Column) -> Column:
    """Spark writes \\u001F, canonical JSON \\u001f: only where there are such escapes."""
    letters = [(f"\\u00{a}{b}", f"\\u00{a}{b.lower()}") for a in "01" for b in "ABCDEF"]
    out = json
    for upper, lower in letters:
        out = F.replace(out, F.lit(upper), F.lit(lower))
    return F.when(json.contains("\\u00"), out).otherwise(json)


def _key(parts: list[Column]) -> Column:
    missing = F.lit(False)
    for p in parts:
        missing = missing | p.isNull()
    return F.when(~missing, _lower_escapes(F.to_json(F.array(*parts))))


def composite_key(*parts: Column | str) -> Column:
    """A compact JSON array of strings; null if a part is null. Readers have put texts in NFC (in_nfc)."""
    return _key([column(p).cast("string") for p in parts])


def in_order(value: Column, kind: T.DataType) -> Column:
    """A value with the fields of its structs in the order of their names, at any depth."""
    if isinstance(kind, T.StructType):
        made = F.struct(*(in_order(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
        return F.when(value.isNotNull(), made)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(value, lambda x: in_order(x, kind.elementType))
    return value


def canonical_json(fields: dict[str, Column], kinds: T.StructType | None = None) -> Column:
    """Compact JSON with keys in order and nulls written; with the fields' types nested keys are in order too."""
    known = {f.name: f.dataType for f in kinds.fields} if kinds else {}
    made = F.struct(*((in_order(fields[k], known[k]) if k in known else fields[k]).alias(k) for k in sorted(fields)))
    return _lower_escapes(F.to_json(made, {"ignoreNullFields": "false"}))


@functools.cache
def _accents() -> tuple[str, str]:
    """Letters that are a letter with marks, and those letters without them."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, range(0xC0, 0x3100))]
    pairs = [(c, apart[0]) for c, apart in pairs if len(apart) > 1 and all(unicodedata.category(x) == "Mn" for x in apart[1:])]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


@F.pandas_udf(T.StringType())
def _nfc(texts):
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column | str) -> Column:
    """NFC. Python, for which Spark has no function of its own; it is sent only texts that aren't ASCII."""
    text = column(text)
    wide = F.octet_length(text) != F.char_length(text)
    return F.when(wide, _nfc(F.when(wide, text))).otherwise(text)


def in_nfc(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """A table with its text columns, or those named, in NFC: for readers, so that keys made of them are too."""
    own = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (names is None or f.name in names)]
    return df.withColumns({c: nfc(F.col(f"`{c}`")) for c in own}) if own else df


def fold(text: Column | str) -> Column:
    """Lower case without accents, as search compares it."""
    text = F.lower(column(text))
    plain = F.regexp_replace(F.translate(text, *_accents()), r"\p{Mn}+", "")
    return F.when(F.octet_length(text) != F.char_length(text), plain).otherwise(text)


def fold_text(text: str) -> str:
    """fold() of a query."""
    apart = "".join(unicodedata.normalize("NFD", c) if unicodedata.category(c)[0] != "L" or ord(c) < 0x3100 else c for c in text.lower())
    return "".join(c for c in apart if unicodedata.category(c) != "Mn")


def _uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)) + 8), 1, 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(F.lower(variant), F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def urn(source: Column | str, scope: Column | str, entity: Column | str, native_key: Column, version: str = ID_VERSION) -> Column:
    """urn:uuid of a record: UUIDv5 over version, source, scope, entity type and native key."""
    text = lambda c: c if isinstance(c, Column) else F.lit(c)
    name = _key([F.lit(version), text(source), text(scope), text(entity), native_key])
    return F.when(native_key.isNotNull() & text(entity).isNotNull(), F.concat(F.lit("urn:uuid:"), _uuid5(name)))


def link_urn(person: Column | str, identity: Column | str, version: str = ID_VERSION) -> Column:
    """The identifier of a person's link with an identity, a function of both."""
    return F.concat(F.lit("urn:uuid:"), _uuid5(_key([F.lit(version), F.lit("link"), column(person), column(identity)])))


def revision_digest(fields: dict[str, Column], kinds: T.StructType | None = None) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json({k: v for k, v in fields.items() if k not in VOLATILE}, kinds), 256))


def fingerprint(*values: Column | str, binary: tuple[int, ...] = ()) -> Column:
    """A digest of native values; those whose places are named as binary count by their hash and size."""
    parts = [F.when(column(v).isNotNull(), F.to_json(F.struct(F.sha2(column(v), 256).alias("sha256"), F.length(column(v)).alias("size")))) if k in binary else column(v).cast("string") for k, v in enumerate(values)]
    return F.sha2(_lower_escapes(F.to_json(F.struct(*(p.alias(f"v{k:03d}") for k, p in enumerate(parts))), {"ignoreNullFields": "false"})), 256)


def is_urn(c: Column | str) -> Column:
    return F.coalesce(column(c).rlike("^urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def is_digest(c: Column | str) -> Column:
    return F.coalesce(column(c).rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))


def json_get(c: Column | str, path: str) -> Column:
    return F.get_json_object(column(c), path)


# --- native keys and addresses


def jid(c: Column | str) -> Column:
    """An address in lower case; NFC comes with the key that it becomes part of."""
    return F.lower(column(c))


def jid_suffix(c: Column | str) -> Column:
    return F.substring_index(column(c), "@", -1)


def handle_key(service: Column | str, handle: Column | str) -> Column:
    handle = column(handle)
    return composite_key(F.lit("handle"), service, F.when(handle.contains("@"), F.lower(handle)).otherwise(handle))


def me_key(login: Column | None = None) -> Column:
    return composite_key(F.lit("me")) if login is None else F.coalesce(composite_key(F.lit("me"), F.when(login != "", login)), composite_key(F.lit("me")))


def chat_key(guid: Column | str) -> Column:
    return composite_key(F.lit("guid"), guid)


def inferred_chat_key(ck: Column | str) -> Column:
    return composite_key(F.lit("ck_chat_id"), ck)


def message_key(chat: Column | str, sender: Column | str, from_me: Column | str, stanza: Column | str) -> Column:
    """[chat, me or sender, stanza]; null for an incoming message without sender."""
    sender = F.when(column(from_me).cast("boolean"), F.lit("me")).otherwise(F.when(column(sender) != "", jid(sender)))
    return composite_key(jid(chat), sender, stanza)


def attachment_key(message: Column | str, index: int = 0) -> Column:
    return composite_key(message, F.lit("media"), F.lit(str(index)))


def member_list(c: Column | str) -> Column:
    """Members split at commas and semicolons, lower-cased, without empty ones, in native order."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(column(c), F.lit(""))), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def group_event_key(group: Column | str, date: Column | str, kind: Column | str) -> Column:
    return composite_key(F.lit("groupchange"), jid(group), date, kind)


def extended_key(base: Column, members: Column) -> Column:
    """A base key with one further element: its members."""
    return F.concat(F.substring(base, F.lit(1), F.char_length(base) - 1), F.lit(","), F.to_json(F.array(F.array_join(members, ","))).substr(F.lit(2), F.char_length(F.to_json(F.array(F.array_join(members, ",")))) - 2), F.lit("]"))


def normalise_address(kind: Column | str, address: Column | str) -> Column:
    """`email:` with the address lower-cased, or `phone:` with the last ten digits of eight or more; else null."""
    address = F.trim(column(address))
    digits = F.regexp_replace(address, r"\D+", "")
    phone = (column(kind) == "phone") & (F.char_length(digits) >= 8)
    return F.when((column(kind) == "email") | address.contains("@"), F.concat(F.lit("email:"), F.lower(address))).when(phone, F.concat(F.lit("phone:"), F.right(digits, F.lit(10))))


def handle_of(key: Column | str) -> Column:
    """The bare handle of a composite chat key of two strings; any other key as it is."""
    key = column(key)
    parts = F.from_json(key, "array<string>")
    last = F.element_at(F.split(F.element_at(parts, 2), ";"), -1)
    return F.when(key.startswith("[") & (F.size(parts) == 2) & (last != ""), last).otherwise(key)


def identity_label(is_me: Column | str, names: Column | str, address: Column | str) -> Column:
    """me, the first observed name, or the address. names: array<struct<name,origin>>."""
    names = column(names)
    return F.when(F.coalesce(column(is_me), F.lit(False)), F.lit("me")).otherwise(F.coalesce(F.when(F.size(names) > 0, F.element_at(names, 1)["name"]), column(address)))


def chat_label(name: Column | str, key: Column | str) -> Column:
    return F.coalesce(F.when(column(name) != "", column(name)), handle_of(key))


# The kind of an attachment by how its MIME type begins and what its uniform type identifier holds. The
# first kind that either names counts; any other type is a document, and none is other.
MIME_KINDS = (("image/", "image"), ("video/", "video"), ("audio/", "audio"), ("text/vcard", "contact"))
UTI_KINDS = (("image", "image"), ("movie", "video"), ("video", "video"), ("audio", "audio"), ("vcard", "contact"))


def attachment_kind(mime: Column | str, uti: Column | str) -> Column:
    mime, uti = F.lower(F.coalesce(column(mime), F.lit(""))), F.lower(F.coalesce(column(uti), F.lit("")))
    named = F.when((mime != "") | (uti != ""), "document").otherwise("other")
    for kind in ("contact", "audio", "video", "image"):
        test = F.lit(False)
        for text, own in MIME_KINDS:
            test = test | ((mime == text if kind == "contact" else mime.startswith(text)) if own == kind else F.lit(False))
        for text, own in UTI_KINDS:
            test = test | (uti.contains(text) if own == kind else F.lit(False))
        named = F.when(test, kind).otherwise(named)
    return named


# --- text


def phrases(query: str) -> list[str]:
    return query.split()


#: Fixed value: what a search token is made of.
TOKEN = r"[\p{L}\p{N}\p{Co}\p{So}\p{Sk}\p{Mn}]+"


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(column(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_line(text: Column | str) -> Column:
    """Tokens between single spaces, with one at either end, so that a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def clip(text: Column | str, n: Column | int) -> Column:
    return F.substring(column(text), F.lit(1), F.greatest(F.lit(n) if isinstance(n, int) else n, F.lit(0)).cast("int"))


def basename(path: Column | str) -> Column:
    return F.substring_index(column(path), "/", -1)


def unsafe_path(path: Column | str) -> Column:
    path = column(path)
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def ck_identifier(c: Column | str) -> Column:
    """What follows the second semicolon."""
    return F.element_at(F.split(column(c), ";", 3), -1)
