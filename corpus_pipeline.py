"""From raw documents to tokens: quality, repeated lines, near duplicates, benchmark passages, BPE.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from messagelake.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from messagelake.llm.common import scratch
from messagelake.llm.queries import fold, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = ("lang", "source", "n_chars")


def _as_documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, unchanged. A null text is scored as an empty one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(5) != 0)
    model = quality.train_quality(docs, labels)
    return quality.score_quality(docs.select(*COLUMNS), model).where("score >= 0.3").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share, except in the last that holds them."""
    out = line_dedup.line_dedup(docs, carry=OTHERS)
    return _as_documents(out.select("doc_id", F.col("kept").alias("text"), *OTHERS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by shared shingles of five words; texts unchanged. Of
    rows that share an id each stays or goes by its own text."""
    groups = near_dedup.near_duplicates(docs, shingle_words=5, percent=80)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash"))
    return docs.join(gone, same, "left_anti").select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; one that held nothing else goes, clean ones are unchanged."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=OTHERS)
    left = found.where(~F.col("contaminated") | (F.col("n_hit") < F.col("n_words")))
    return _as_documents(left.withColumn("text", F.coalesce("cleaned", "text")))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every document."""
    encoded = bpe.bpe_encode(docs, vocabulary(), carry=("lang", "source"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_good),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("tokens", to_tokens),
]

#: Learned scores, similarity components and token ids are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, with each result in the folder that the cluster shares."""
    folder = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
