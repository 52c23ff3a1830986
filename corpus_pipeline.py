"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it as
Parquet and rereads it as the next stage's ``docs``. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.llm import bpe
from braid.llm.mixing import mixed_documents
from braid.llm.near_dedup import near_dedup
from braid.llm.quality import quality_rules
from braid.llm.substring_dedup import substring_dedup
from braid.llm.tables import finished

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_WORDS = 35
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; cutoffs come from the labels of documents of this input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs.select(*COLUMNS), labels).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least doc_id."""
    return near_dedup(docs.select(*COLUMNS)).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages. One whose words all go stays, with an empty text."""
    cut = substring_dedup(docs.select(*COLUMNS), min_words=MIN_WORDS, changed_only=True)
    return cut.withColumn("text", F.coalesce("kept", "text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, a row for each document and pass; documents without words have no words to mix."""
    return mixed_documents(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row (packed as 4-byte integers), with the check that decoding gives the text's bytes."""
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    done = bpe.round_trip(docs.select("doc_id", "source", "text"), path)
    same = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    return done.select("doc_id", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [("quality rules", quality), ("near-dedup", near_duplicates), ("substring dedup", repeats), ("mixing", mix), ("byte-level BPE", tokens)]

#: The quality stage's binomial bounds and the mix's draws are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; the tables that a stage needed go when it has ended."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = finished(spark, lambda own=docs, stage=stage: stage(spark, own, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
