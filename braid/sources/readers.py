"""Sources: a registry of loaders, array files, manifests, generators and event logs."""

from __future__ import annotations

import hashlib
import importlib
import json
import math
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ranked

Loader = Callable[[SparkSession, dict], DataFrame]
_LOADERS: dict[str, Loader] = {}


def register(name: str, loader: Loader) -> None:
    _LOADERS[name] = loader


def names() -> list[str]:
    return sorted(_LOADERS)


def load(spark: SparkSession, config: dict) -> DataFrame:
    """The dataset that ``config["adapter"]`` names."""
    adapter = config.get("adapter")
    if adapter not in _LOADERS:
        raise ValueError(f"unknown adapter {adapter!r}; known: {names()}")
    return _LOADERS[adapter](spark, config)


def load_parquet(spark: SparkSession, config: dict) -> DataFrame:
    """The target and inputs of a Parquet table; only they are read."""
    df = spark.read.parquet(config["path"])
    keys = config.get("input_keys") or [c for c in df.columns if c != config.get("target_key", "y")]
    return df.select(F.col(config.get("target_key", "y")).cast("double").alias("y"), *keys)


def load_npz(spark: SparkSession, config: dict) -> DataFrame:
    """Arrays of a file as a table with ``row_id``: matrices as array columns. The file fits the driver; data of any size is Parquet."""
    import numpy as np

    path = os.path.join(config.get("base_dir", ""), config.get("path") or config["npz_path"])
    with np.load(path, allow_pickle=False) as arrays:
        target = config.get("target_key", "y")
        keys = config.get("input_keys") or [k for k in arrays.files if k != target]
        missing = [k for k in (target, *keys) if k not in arrays.files]
        if missing:
            raise KeyError(f"{path} has no {missing}")
        y = np.asarray(arrays[target], dtype=np.float64).reshape(-1)
        columns = {"row_id": range(len(y)), "y": y.tolist()} | {k: arrays[k].tolist() for k in keys if arrays[k].ndim and len(arrays[k]) == len(y)}
    return spark.createDataFrame([dict(zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=True)])


def load_manifest(spark: SparkSession, config: dict) -> DataFrame:
    """A JSON manifest merged under ``config``; its paths are relative to it."""
    at = Path(config["manifest_path"])
    merged = json.loads(at.read_text()) | {k: v for k, v in config.items() if k not in ("manifest_path", "adapter", "name")}
    return load(spark, {"base_dir": str(at.parent)} | merged)


def load_module(spark: SparkSession, config: dict) -> DataFrame:
    """``module:function`` called with the session and its keyword arguments."""
    module, _, function = config["loader"].partition(":")
    return getattr(importlib.import_module(module), function)(spark, **config.get("kwargs", {}))


def synthetic_tabular(spark: SparkSession, config: dict) -> DataFrame:
    """Standard normal x0.. and a target of known form, standardized; the same for a seed at any partitioning of equal size."""
    n, p, seed = int(config.get("n_samples", 100)), int(config.get("n_features", 8)), int(config.get("seed", 0))
    df = spark.range(n).withColumnRenamed("id", "row_id").withColumns({f"x{i}": normal(F.col("row_id"), seed, i) for i in range(p)})
    x = lambda i: F.col(f"x{min(i, p - 1)}")
    raw = 1.2 * x(0) - 0.7 * x(1) + 0.5 * x(2) * x(2) - 0.4 * F.abs(x(3)) + 0.35 * x(0) * x(4) + 0.2 * normal(F.col("row_id"), seed, p)
    df = df.withColumn("raw", raw)
    one = df.agg(F.avg("raw").alias("m"), F.stddev_pop("raw").alias("s"))
    return df.crossJoin(F.broadcast(one)).withColumn("y", (F.col("raw") - F.col("m")) / F.greatest("s", F.lit(1e-8))).drop("raw", "m", "s")


def uniform(key: Column, seed: int, stream: int) -> Column:
    """A number in (0, 1) that depends on the key, the seed and the stream only."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(stream), key), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def normal(key: Column, seed: int, stream: int) -> Column:
    return F.sqrt(-2 * F.log(uniform(key, seed, 2 * stream))) * F.cos(2 * math.pi * uniform(key, seed, 2 * stream + 1))


def synthetic_structural_break(spark: SparkSession, config: dict) -> DataFrame:
    """Series of noise and drift; those labelled 1 break at the boundary by a level, a spread, a ramp or a wave."""
    n, length, seed = int(config.get("n_samples", 100)), int(config.get("length", 96)), int(config.get("seed", 0))
    b = int(config.get("boundary") or length // 2)
    row = F.col("row_id")
    rows = spark.range(n).withColumnRenamed("id", "row_id")
    # half of the rows break: those first in a shuffled order
    df = ranked(rows, [uniform(row, seed, -1), row], "__order").withColumn("y", (F.col("__order") < n // 2).cast("double"))
    df = df.withColumns({"drift": 0.05 * normal(row, seed, 0), "level": 0.7 + 0.08 * normal(row, seed, 1), "spread": 1.8 + 0.5 * uniform(row, seed, 4), "ramp": 0.8 + 0.4 * uniform(row, seed, 5), "t": F.sequence(F.lit(0), F.lit(length - 1))})

    def value(t: Column) -> Column:
        key = row * F.lit(length) + t
        noise = 0.35 * normal(key, seed, 10) + F.col("drift") * (2 * t / F.lit(float(length - 1)) - 1)
        late, place = (t >= b) & (F.col("y") == 1), (t - b) / F.lit(float(max(length - b - 1, 1)))
        kind = row % 4
        return F.when(~late, noise).when(kind == 0, noise + F.col("level")).when(kind == 1, noise * F.col("spread")).when(kind == 2, noise + F.col("ramp") * place).otherwise(noise + 0.45 * F.sin(7 * place))

    return df.withColumn("series", F.transform("t", value)).select("row_id", "y", "series", F.lit(b).alias("boundary"))


def inject_outliers(df: DataFrame, column: str = "series", key: str = "row_id", seed: int = 0, part: float = 0.2) -> DataFrame:
    """A spike of 5 to 8 at one place of each chosen row: that part of the rows, one at least, those first in a shuffled order."""
    k = F.col(key)
    df = ranked(df, [uniform(k, seed, 21), k], "__order")
    hit = F.col("__order") < max(1, int(df.count() * part + 1e-9))
    at = F.floor(uniform(k, seed, 22) * F.size(column)).cast("int")
    spike = (5 + 3 * uniform(k, seed, 23)) * F.when(uniform(k, seed, 24) < 0.5, -1.0).otherwise(1.0)
    wide = df.withColumns({"__hit": hit, "__at": at, "__spike": spike})
    return wide.withColumn(column, F.transform(column, lambda v, i: F.when(F.col("__hit") & (i == F.col("__at")), v + F.col("__spike")).otherwise(v))).drop("__hit", "__at", "__spike", "__order")


def frozen_dataset(spark: SparkSession, manifest: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A hashed Parquet or CSV dataset with explicit train, validation and test rows.

    Raises if the data's hash, the splits' names, overlaps, ranges or values are not sound.
    """
    at = Path(manifest).resolve()
    m = json.loads(at.read_text())
    path = (at.parent / m["data"]).resolve()
    if "://" in m["data"] or not path.is_relative_to(at.parent):
        raise ValueError("the data is not beside its manifest")
    with open(path, "rb") as data:
        if hashlib.file_digest(data, "sha256").hexdigest() != m["sha256"]:
            raise ValueError("the data is not what was frozen")
    df = spark.read.parquet(str(path)) if path.suffix == ".parquet" else spark.read.csv(str(path), header=True, inferSchema=True)
    numeric = [c for c, t in df.dtypes if t in ("double", "float")]
    finite = lambda c: F.count(F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 1))
    if numeric and any(df.agg(*map(finite, numeric)).first()):
        raise ValueError("the data holds values that are not finite")
    splits = m["splits"] if "splits" in m else json.loads((at.parent / m["split_file"]).read_text())["splits"]
    if sorted(splits) != ["test", "train", "validation"]:
        raise ValueError("three splits are needed")
    ids = [i for part in splits.values() for i in part]
    if any(type(i) is not int for i in ids) or len(set(ids)) != len(ids) or min(ids) < 0 or max(ids) >= df.count():
        raise ValueError("splits repeat rows or leave the data")
    return df, {name: spark.createDataFrame([(i,) for i in part], "row_id long") for name, part in splits.items()}


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an append-only JSON-lines log; a torn last line is a row of nulls and is left out."""
    schema = "step long, mode string, accepted boolean, score double, best_score double"
    return spark.read.schema(schema).json(path).where("step IS NOT NULL")


def task_table(spark: SparkSession, config: dict) -> DataFrame:
    """Rows of a task with a known graph; see :mod:`braid.sources.tasks`."""
    from .tasks import generate

    return generate(spark, config["task"], config.get("split", "train"), int(config.get("n_samples", 512)), int(config.get("seed", 0)))


for _name, _loader in (("ground-truth-task", task_table), ("parquet", load_parquet), ("external-npz", load_npz), ("external-manifest", load_manifest), ("python-module", load_module), ("synthetic-tabular", synthetic_tabular), ("synthetic-structural-break", synthetic_structural_break)):
    register(_name, _loader)
