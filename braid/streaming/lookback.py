"""Causal windows over events, as batch and as a stream; and incremental histories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.relational import history


def lookback(df: DataFrame, entity: str, order: list[str], value: str, length: int, out: str = "series") -> DataFrame:
    """``df`` with the entity's last ``length`` values up to each row, and how many there were."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(-(length - 1), Window.currentRow)
    return df.withColumn(out, F.collect_list(value).over(w)).withColumn("lookback_observed", F.size(out).cast("double"))


def windowed(events: DataFrame, time: str, entity: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Count, mean and spread of values by entity and time window; in a stream, rows later than ``late`` are dropped by the watermark."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    span = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.groupBy(span, entity).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.select(F.col("window.start").alias("start"), entity, "n", "mean", "std")


def stream_of(spark: SparkSession, path: str, schema, files_each: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def keep_history(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Fold a stream of (name, step, importance, alignment, score, selected) into a history, a version for each batch.

    A batch that is run again writes its own version again, so restarts count nothing twice.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{folder}/version={number - 1}") if number else None
        history(before, batch).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_batches(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
