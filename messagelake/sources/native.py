"""Native tables with their required columns, the decoded feed with its framing, alias sources, media listings."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import in_nfc
from ..operators.extract_b import FEED
from ..plans.state import kept

# The columns without which a source can't be read.
REQUIRED_A = {
    "sessions": ("Z_PK", "ZCONTACTJID", "ZSESSIONTYPE", "ZPARTNERNAME", "ZARCHIVED"), "members": ("Z_PK", "ZCHATSESSION", "ZMEMBERJID", "ZISACTIVE", "ZISADMIN"), "groups": ("ZCHATSESSION", "ZCREATIONDATE"), "push_names": ("ZJID", "ZPUSHNAME"),
    "messages": ("Z_PK", "ZISFROMME", "ZMESSAGETYPE", "ZSORT", "ZCHATSESSION", "ZMEDIAITEM", "ZPARENTMESSAGE", "ZMESSAGEDATE", "ZFROMJID", "ZSTANZAID", "ZTEXT", "ZTOJID"), "media": ("Z_PK", "ZMESSAGE", "ZMEDIALOCALPATH", "ZTITLE", "ZMETADATA"), "items": ("Z_PK", "ZINDEX", "ZMESSAGE", "ZTITLE", "ZSUMMARY", "ZMATCHEDTEXT"),
}
REQUIRED_B = {
    "handle": ("ROWID", "id", "service", "uncanonicalized_id"), "chat": ("ROWID", "guid", "style", "chat_identifier", "service_name", "display_name"), "chat_handles": ("chat_id", "handle_id"), "chat_messages": ("chat_id", "message_id"),
    "message": ("ROWID", "guid", "service", "ck_chat_id"), "attachment": ("ROWID", "guid", "filename"), "message_attachments": ("message_id", "attachment_id"),
}


class MissingColumns(ValueError):
    pass


def check_required(tables: Mapping[str, DataFrame], required: Mapping[str, Sequence[str]]) -> None:
    """Raises with all missing tables and columns; further ones are welcome."""
    lacks = [f"{t}" if t not in tables else f"{t}.{c}" for t, columns in required.items() for c in (columns if t in tables else [""]) if t not in tables or c not in tables[t].columns]
    if lacks:
        raise MissingColumns("missing: " + ", ".join(sorted(set(lacks))))


def read_native(spark: SparkSession, path: str, required: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """One DataFrame for each native table, from parquet of its name, texts in NFC."""
    tables = {name: spark.read.parquet(f"{path}/{name}.parquet") for name in required}
    check_required(tables, required)
    return {name: in_nfc(df) for name, df in tables.items()}


def read_decoded(spark: SparkSession, path: str, requested: DataFrame | None = None) -> DataFrame:
    """Messages of a decoded feed: one header, one footer with the count of messages, and all the requested rows."""
    rows = spark.read.schema(FEED + ", rows long, policy string").json(path)
    return check_framing(rows, requested)


def check_framing(rows: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    n = rows.agg(F.count_if(F.col("type") == "header").alias("h"), F.count_if(F.col("type") == "footer").alias("f"), F.count_if(F.col("type") == "message").alias("m"), F.count("*").alias("all"), F.max(F.when(F.col("type") == "footer", F.col("rows"))).alias("said")).first()
    if n["h"] != 1 or n["f"] != 1 or n["h"] + n["f"] + n["m"] != n["all"] or n["said"] != n["m"]:
        raise ValueError(f"bad framing: {n['h']} headers, {n['f']} footers, {n['m']} messages of {n['all']} rows, {n['said']} said")
    messages = rows.where("type = 'message'").drop("rows", "policy")
    if requested is not None and not requested.select("rowid").join(messages, "rowid", "left_anti").isEmpty():
        raise ValueError("requested rows are missing")
    return messages


def merge_decoded(batches: Sequence[DataFrame], requested: int) -> DataFrame:
    """Several batches as one: all headers have one policy and the footers' counts add up to what was asked for."""
    rows = batches[0]
    for b in batches[1:]:
        rows = rows.unionByName(b)
    n = rows.agg(F.count_distinct(F.when(F.col("type") == "header", F.coalesce("policy", F.lit("")))).alias("policies"), F.sum(F.when(F.col("type") == "footer", F.col("rows"))).alias("said"), F.count_if(F.col("type") == "message").alias("m")).first()
    if n["policies"] != 1 or n["said"] != requested or n["m"] != requested:
        raise ValueError(f"batches don't fit: {n['policies']} policies, {n['said']} said, {n['m']} of {requested} messages")
    return rows.where("type = 'message'").drop("rows", "policy")


def read_alias_sources(spark: SparkSession, paths: Mapping[str, tuple[str, str, str]]) -> tuple[DataFrame, list[str]]:
    """(pairs, absent sources). paths: source to (path, lid column, phone column). A source that isn't there is told
    apart from an empty one."""
    pairs, absent = spark.createDataFrame([], "lid string, phone string, source string"), []
    jvm = spark.sparkContext._jvm
    for source, (path, lid, phone) in paths.items():
        where = jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            absent.append(source)
            continue
        t = spark.read.parquet(path).select(F.col(lid).alias("lid"), F.col(phone).alias("phone"), F.lit(source).alias("source"))
        pairs = pairs.unionByName(t.dropna(subset=["lid", "phone"]))
    return pairs, absent


CHUNK = 4 << 20
HASHED = "file string, size long, modified timestamp, path string, sha256 string"


def _hash_files(batches):
    """Adds the SHA-256 of each file, read in chunks, so that a file of any size takes a few megabytes; null if it went. A file
    without a size wasn't listed, as empty ones aren't, and is looked at itself."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            fs, at = pafs.FileSystem.from_uri(r.file) if "://" in r.file else (pafs.LocalFileSystem(), r.file)
            size, modified, h = r.size, r.modified, hashlib.sha256()
            if size != size or size is None:
                info = fs.get_file_info(at)
                if info.type != pafs.FileType.File:
                    continue
                size, modified = info.size, pd.Timestamp(info.mtime).tz_convert(None).floor("ms")
            try:
                with fs.open_input_stream(at) as f:
                    while chunk := f.read(CHUNK):
                        h.update(chunk)
                out.append((r.file, int(size), modified, r.path, h.hexdigest()))
            except FileNotFoundError:
                out.append((r.file, int(size), modified, r.path, None))
        yield pd.DataFrame(out, columns=["file", "size", "modified", "path", "sha256"])


def list_media(spark: SparkSession, root: str) -> DataFrame:
    """(file, path, size, modified) of all files with content below a folder, path relative to it; none is read."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", "^file:/+", "/")
    base = root.rstrip("/") + "/"
    return files.select(plain.alias("file"), F.element_at(F.split(plain, F.concat(F.lit("\\Q"), F.lit(base), F.lit("\\E")), 2), -1).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def probe_media(spark: SparkSession, root: str, references: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """References (path) with sha256, size and time of the files of a folder; null where there is none.

    Files that nobody refers to are listed and not read. known: (path, size, modified, sha256) of an earlier probe; a file
    of the same path, size and time keeps its digest unread. The others are read in chunks, a few files a task.
    """
    wanted = kept(list_media(spark, root).join(references.select("path").distinct(), "path", "left_semi"))
    same = ["path", "size", "modified"]
    old = wanted.limit(0).select(*same, F.lit(None).cast("string").alias("sha256")) if known is None else known.where("sha256 is not null").select(*same, "sha256").dropDuplicates(same)
    todo = wanted.join(old, same, "left_anti").select("file", "size", "modified", "path")
    base = F.lit(("/" + root[5:].lstrip("/") if root.startswith("file:") else root).rstrip("/") + "/")
    unlisted = references.select("path").where("path != '' and not path rlike '(^|/)[.][.](/|$)'").distinct().join(wanted.select("path"), "path", "left_anti")
    none = lambda t: F.lit(None).cast(t)
    todo = kept(todo.unionByName(unlisted.select(F.concat(base, "path").alias("file"), none("long").alias("size"), none("timestamp").alias("modified"), "path")))
    tasks = max(spark.sparkContext.defaultParallelism, -(-todo.count() // 64))
    dealt = todo.repartition(tasks, F.xxhash64("file"))
    digests = wanted.join(old, same).select(*same, "sha256").unionByName(kept(dealt.mapInPandas(_hash_files, HASHED)).select(*same, "sha256"))
    return references.join(digests.select("path", "sha256", "size", "modified"), "path", "left")
