"""The registered queries of this subpackage: each applies its operator to a whole table and derives digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat
from .knn import top_products
from .mixing import plan_mix, taken
from .near_dedup import near_duplicates
from .quality import quality_rules
from .sharding import hilbert_shards
from .substring_dedup import substring_dedup
from .url_filter import host_and_path, url_filter
from .warc import read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=35, keep_text=False)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = plan_mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return taken(mixed).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 100 = 0")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The listed rules of the contract.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled URLs: a page's URL ends in the doc_id of its document; bad is low quality or toxic."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    doc = F.expr(r"try_cast(regexp_extract(path, '/([0-9]+)[^/]*/?$', 1) AS long)")
    labels = _table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    known = pages.withColumn("path", host_and_path(F.col("url"))[1]).withColumn("doc_id", doc).join(labels, "doc_id").select("url", "bad")
    return url_filter(pages, known, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", F.round("bad_part", 6).alias("bad_part"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(vocabulary)
    done = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = hilbert_shards(_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), shards=8)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    out = chat.render(chat.fold(chat.events_of(rows.union(own))))
    turns = out.select(F.col("conv").alias("conv_id"), "formatted", "segments", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    done = quality_rules(docs, _table(spark, sf_dir, "labels"), keep_text=False)
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from . import sql

    return sql.ORACLES
