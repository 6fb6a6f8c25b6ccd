"""Line dedup: exploded normalised lines, hashed, counted over documents, dropped above a threshold, put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, kept, spread_join

SPACE = " \t\n\x0b\f\r"


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drops lines found in many documents, except from the largest id that holds them.

    Returns (id_col, lines array, dropped array of positions, kept string, columns to carry), one row for each input row, with
    DataFrame functions alone. A key is the line without white space at its ends, A-Z lower-cased; two 64-bit
    hashes of it stand for it, written once to the shared folder. Only hashes are shuffled for the count, which is taken
    by key and document first, so a line that a third of the documents hold is summed before it meets in one task. Keys
    that more than 1 in 50,000 of the common lines have, which are fewer than 50,000, are broadcast to their lines; the
    others meet by a shuffle.

    Null or empty texts are one empty line. Rows that repeat an id count as one document, and each is treated by
    its own text. A row without an id counts as one document and never loses a line. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("rest")).withColumn("th", F.xxhash64("text"))
    lines = rows.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("id", "th", "pos", F.btrim("line", F.lit(SPACE)).alias("key")).where(F.char_length("key") >= min_chars)
    keys = keys.withColumn("key", ascii_lower(F.col("key")))
    keys = kept(keys.select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")))
    common = keys.groupBy("h1", "h2", "id").agg(F.count("*").alias("lines"))
    common = common.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.sum("lines").alias("lines"), F.max("id").alias("keeper"))
    common = kept(common.where(F.col("docs") >= min_docs).drop("docs"))
    total = common.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    drops = spread_join(keys, common, ["h1", "h2"], "lines", total).where(F.col("id") < F.col("keeper")).groupBy("id", "th").agg(F.collect_set("pos").alias("dropped"))
    drops = drops.select(F.col("id").alias("drop_id"), F.col("th").alias("drop_th"), "dropped")
    out = rows.join(drops, (F.col("id") == F.col("drop_id")) & (F.col("th") == F.col("drop_th")), "left")
    out = out.withColumn("lines", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    text = F.array_join(F.transform(left, lambda i: F.element_at("lines", i + 1)), "\n")
    return out.select(
        F.col("id").alias(id_col),
        "lines",
        F.coalesce(F.array_sort("dropped"), F.array().cast("array<int>")).alias("dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(text).alias("kept"),
        *(F.col("rest")[c].alias(c) for c in carry),
    )
