"""The corpus pipeline: quality filter, line dedup, near-duplicate removal, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and
reads it back as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import byte_bpe, line_dedup, mixing, quality, simhash
from pagemill.llm.shared import table_path

RANKS = "byte_bpe_multi_50k.tiktoken"


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score at least 0.3)."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep_one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix draws, a document as often as it is drawn, shuffled inside each output shard."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the token ids of each row's whole text (32-bit little-endian), their number and decoded_sha256.

    Every row's ids are decoded again; ids that don't give the text's bytes end the run with an error.
    """
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    hashed = docs.withColumn("_sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return checked(byte_bpe.encode_decode(hashed, path, pattern, keep=("doc_id", "source", "_sha256")))


def checked(coded: DataFrame) -> DataFrame:
    """doc_id, source, ids, n_tokens and decoded_sha256 of coded(_sha256, decoded_sha256); an error where the two differ."""
    same = F.when(F.col("decoded_sha256") == F.col("_sha256"), F.col("decoded_sha256")).otherwise(F.raise_error(F.lit("token ids don't decode to their text")).cast("string"))
    return coded.select("doc_id", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), same.alias("decoded_sha256"))


STAGES = [
    ("quality classifier", filter_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding", encode),
]

#: SQL can express neither the classifier nor the fingerprints' trees; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = table_path(spark, name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
