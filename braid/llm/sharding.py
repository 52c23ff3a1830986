"""Sharding along a Hilbert curve.

Rows are points in a grid of quantised metadata (source, language, size). They are
ordered by their place on the grid's Hilbert curve, so a run of rows covers a compact
region and files that hold runs can be pruned by each dimension. Runs are cut to near
equal bytes, and never inside a group of equal texts.

What is ordered is a row for each different text. Cumulative bytes and counts come from
a range partitioning that is written once: the driver adds up one sum for each
partition, the rest are running sums inside partitions. Rows of a group get their
places from buckets of it, dealt by a digest of the id, so no group is one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordered import ranked
from ..tables import fresh_names, written

BITS = 6
BUCKETS = 1024  # of the rows of one text


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of ``cells`` (coordinates below 2**bits), by Skilling's transposed form."""
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for own in x:
            is_set = (own >> level) & 1 == 1
            swap = np.where(is_set, 0, (x[0] ^ own) & low)
            x[0] ^= np.where(is_set, low, swap)
            if own is not x[0] and not np.shares_memory(own, x[0]):
                own ^= swap
    for a, b in zip(x, x[1:], strict=False):
        b ^= a
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for row in x:
            index = (index << 1) | ((row >> level) & 1)
    return index


def _hilbert(bits: int, *dimensions: Column) -> Column:
    @F.pandas_udf("long")
    def place(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack(cells), bits))

    return place(*dimensions)


def _coded(df: DataFrame, name: str, bits: int) -> DataFrame:
    """``df`` with ``name`` replaced by its cell: the rank of its value among the different ones (null first), cut evenly."""
    values = df.select(F.col(name).alias("value")).distinct()
    placed = written(ranked(values, [F.col("value")], "rank"), "values")
    cells = placed.select("value", F.floor(F.col("rank") * F.lit(float(1 << bits)) / F.lit(float(max(placed.count(), 1 << bits)))).cast("long").alias("cell"))
    return df.join(cells, F.col(name).eqNullSafe(F.col("value"))).drop("value", name).withColumnRenamed("cell", name)


def hilbert_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", dimensions: tuple[str, str] = ("source", "lang"), bits: int = BITS) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes and 1), ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    Each shard is a run of the curve whose bytes are near the mean; equal texts share a
    shard, so a shard is off the mean by half a group on either side at most. A null
    text counts as empty; null dimensions come first; a group takes its least dimensions.
    Ties on the curve go by a digest of the text, inside a group by a digest of the id in BUCKETS steps
    and then by id (null first); equal rows get slots in any order. Fewer texts than shards leave
    shards empty, an empty table gives no rows. Names that are taken get a leading underscore.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = fresh_names(docs, "size", "text_crc32", "shard", "slot", "b_key", "b_bucket", "b_inner", "b_start")
    size, crc, shard, slot, key, bucket, inner, start = names
    rows = docs.withColumns({size: (F.octet_length(text) + 1).cast("long"), crc: F.crc32(F.encode(text, "utf-8")), key: F.unhex(F.md5(text))})
    groups = rows.groupBy(F.col(key).alias("key")).agg(
        F.min(dimensions[0]).alias("d0"), F.min(dimensions[1]).alias("d1"), F.max(size).alias("each"), F.sum(size).alias("bytes"), F.count("*").alias("members")
    )
    groups = written(groups, "shard-groups")
    # two steps for each doubling of the size: its highest bit and the one after it
    digits = F.bin("each")
    step = 2 * (F.length(digits) - 1) + (F.substring(digits, 2, 1) == "1").cast("int")
    cells = _coded(_coded(groups, "d0", bits), "d1", bits).withColumn("d2", F.least(step, F.lit((1 << bits) - 1)).cast("long"))
    ordered = cells.withColumn("place", _hilbert(bits, F.col("d0"), F.col("d1"), F.col("d2"))).select("key", "place", "bytes", "members")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = written(ordered.repartitionByRange(n, "place", "key").withColumn("part", F.spark_partition_id()), "curve")

    sums = sorted(ordered.groupBy("part").agg(F.sum("bytes"), F.sum("members")).collect())  # one row for each partition
    heads, b, m = [], 0, 0
    for part, part_bytes, part_members in sums:
        heads.append((part, b, m))
        b, m = b + part_bytes, m + part_members
    heads = spark.createDataFrame(heads, "part int, head_bytes long, head_rows long")
    run = Window.partitionBy("part").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(run), F.lit(0))
    placed = ordered.withColumns({"in_bytes": so_far("bytes"), "in_rows": so_far("members")}).join(heads, "part")
    middle = (2 * (F.col("head_bytes") + F.col("in_bytes")) + F.col("bytes")) * shards
    placed = placed.select("key", "members", (F.col("head_rows") + F.col("in_rows")).alias("at"), F.least(F.floor(middle / F.lit(2.0 * max(b, 1))), F.lit(shards - 1)).cast("int").alias("shard"))
    placed = written(placed, "placed")
    starts = placed.groupBy("shard").agg(F.min("at").alias("start"))
    placed = placed.join(F.broadcast(starts), "shard").select(F.col("key").alias(key), F.col("shard").alias(shard), (F.col("at") - F.col("start")).alias(start))

    # rows meet their places by bucket, so that a text with many rows is many tasks
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    dealt = rows.withColumn(bucket, (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % BUCKETS).cast("int"))
    counts = dealt.groupBy(key, bucket).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of BUCKETS rows at most
    heads = counts.withColumn("before", before).join(placed, key).select(key, bucket, shard, (F.col(start) + F.col("before")).alias(start))
    numbered = dealt.withColumn(inner, F.row_number().over(Window.partitionBy(key, bucket).orderBy(F.col(id_col).asc_nulls_first())) - 1)
    return numbered.join(heads, [key, bucket]).withColumn(slot, (F.col(start) + F.col(inner)).cast("long")).select(*docs.columns, size, crc, shard, slot)


def write_shards(sharded: DataFrame, folder: str, files_each: int = 1) -> None:
    """Write the rows of :func:`hilbert_shards` under ``folder``, a folder for each shard, its files runs of slots.

    The last two columns are the shard and the slot, whatever their names. An empty table gives an empty folder.
    """
    shard, slot = sharded.columns[-2:]
    sharded = written(sharded, "sharded")
    shards = sharded.agg(F.count_distinct(shard)).first()[0]
    sharded.repartitionByRange(max(1, shards * files_each), shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(folder)
