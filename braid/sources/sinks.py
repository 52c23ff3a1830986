"""What a run writes beside its results: splits, logs, curated tables, and files for other programs."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ranked

PARTS = ("train", "validation", "test")


def write_splits(split: DataFrame, path: str, key: str = "row_id", **metadata) -> None:
    """A split manifest: the rows (key, split) as Parquet in a folder for each part, and what else is known as JSON. Parts of any size."""
    split.select(F.col(key), F.col("split")).write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    split.sparkSession.createDataFrame([(key, json.dumps(metadata, sort_keys=True))], "key string, metadata string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_splits(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(key, split) and the metadata of a manifest. Raises if a key is in two parts or a part is unknown."""
    about = spark.read.schema("key string, metadata string").json(f"{path}/manifest").first()
    rows = spark.read.parquet(f"{path}/rows").select(about.key, F.col("split").cast("string").alias("split"))
    if not rows.where(~F.col("split").isin(*PARTS)).isEmpty():
        raise ValueError(f"the parts of a split are {PARTS}")
    if not rows.groupBy(about.key).agg(F.count("*").alias("__n")).where("__n > 1").isEmpty():
        raise ValueError("a row is in two parts, or twice in one")
    return rows, json.loads(about.metadata)


def append_events(events: DataFrame, path: str) -> None:
    """Append rows to a log of JSON lines; a batch is there whole or not at all."""
    events.write.mode("append").json(path)


def event_count(spark: SparkSession, path: str) -> int:
    """The lines of a log that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").count()


def last_event(spark: SparkSession, path: str, order: str, schema: str) -> dict | None:
    """The last line that parses, by its field ``order``; lines that do not parse or have no such field do not count."""
    rows = spark.read.schema(schema).json(path).where(F.col(order).isNotNull())
    found = rows.agg(F.max_by(F.struct(*rows.columns), order).alias("last")).first().last
    return None if found is None else found.asDict(recursive=True)


def curate(spark: SparkSession, files: dict[str, str], separator: str = " ") -> tuple[DataFrame, DataFrame]:
    """Text tables of numbers, one for each part, whose last column is the target: (row_id, x0, ..., y) and (row_id, split).

    Rows are numbered part after part, in the order of each part's lines.
    """
    parts = []
    for place, name in enumerate(PARTS):
        lines = spark.read.text(files[name]).where(F.trim("value") != "").withColumns({"at": F.monotonically_increasing_id(), "v": F.split(F.trim("value"), f"[{separator}]+").cast("array<double>")})
        parts.append(lines.select(F.lit(place).alias("part"), "at", "v"))
    rows = reduce(DataFrame.unionByName, parts)
    widths = [r[0] for r in rows.select(F.size("v")).distinct().limit(2).collect()]
    if len(widths) != 1:
        raise ValueError("the parts' rows are not of one width")
    numbered = ranked(rows, [F.col("part"), F.col("at")], "row_id")
    names = F.array(*map(F.lit, PARTS))
    table = numbered.select("row_id", *(F.col("v")[i].alias(f"x{i}") for i in range(widths[0] - 1)), F.col("v")[widths[0] - 1].alias("y"))
    return table, numbered.select("row_id", names[F.col("part")].alias("split"))


def write_exchange(train: DataFrame, test: DataFrame, folder: str) -> None:
    """Training and test rows as CSV with headers, for a program that is run elsewhere."""
    train.write.mode("overwrite").csv(f"{folder}/train", header=True)
    test.write.mode("overwrite").csv(f"{folder}/test", header=True)


def read_predictions(spark: SparkSession, path: str, key: str, expected: DataFrame) -> DataFrame:
    """(key, prediction) that a program left; raises unless each expected row has one finite prediction."""
    found = spark.read.csv(path, header=True, schema=f"{key} {dict(expected.dtypes)[key]}, prediction double")
    bad = found.where(F.col("prediction").isNull() | F.isnan("prediction") | (F.abs("prediction") == float("inf")))
    if not bad.isEmpty() or not expected.select(key).exceptAll(found.select(key)).isEmpty() or not found.select(key).exceptAll(expected.select(key)).isEmpty():
        raise ValueError("there is not one finite prediction for each row")
    return found
