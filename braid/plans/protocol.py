"""Protocols of experiments: sealed test rows, budgets, baselines, refinement and model selection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import nz
from ..operators.ordered import quantiles
from .linalg import EPS, Ridge, ridge, ridge_of
from .rank import GRID, fit as rank_fit


class SealedProtocol:
    """Train and validation rows at will; test rows once, after the method is final."""

    def __init__(self, parts: dict[str, DataFrame], key: str):
        if sorted(parts) != ["test", "train", "validation"]:
            raise ValueError("three parts are needed: train, validation, test")
        if len({tuple(d.columns) for d in parts.values()}) != 1:
            raise ValueError("the parts' columns differ")
        names = sorted(parts)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                if not parts[a].select(key).intersect(parts[b].select(key)).isEmpty():
                    raise ValueError(f"{a} and {b} share rows")
        self._parts, self._final, self._used = parts, False, False

    def part(self, name: str) -> DataFrame:
        if name == "test":
            raise PermissionError("the test rows are sealed")
        return self._parts[name]

    def finalize(self) -> None:
        if self._final:
            raise RuntimeError("final already")
        self._final = True

    def evaluate(self, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What ``predict`` makes of the test rows; they count as used before it runs."""
        if not self._final or self._used:
            raise PermissionError("the test rows are for one evaluation of a final method")
        self._used = True
        return predict(self._parts["test"])


@dataclass
class Budget:
    """Limits on named kinds of use; a use that would pass any limit changes nothing."""

    limits: dict[str, float]
    used: dict[str, float] = field(default_factory=dict)

    def spend(self, **amounts: float) -> None:
        for kind, amount in amounts.items():
            if kind not in self.limits or amount < 0:
                raise ValueError(f"{kind}={amount} is no use of this budget")
            if self.used.get(kind, 0) + amount > self.limits[kind]:
                raise RuntimeError(f"the budget of {kind} is used up")
        for kind, amount in amounts.items():
            self.used[kind] = self.used.get(kind, 0) + amount


RESULT_SCHEMA = "task string, method string, seed long, split string, status string, metrics map<string,double>, usage map<string,double>"


def result_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Results of experiments as a table (RESULT_SCHEMA). Each (task, method, seed, split) stands once; what succeeded has finite metrics."""
    seen = set()
    for r in rows:
        key = (r["task"], r["method"], r["seed"], r["split"])
        if key in seen:
            raise ValueError(f"{key} has a result already")
        seen.add(key)
        if r["status"] not in ("ok", "failed"):
            raise ValueError(f"unknown status {r['status']!r}")
        if r["status"] == "ok" and not (r.get("metrics") and all(np.isfinite(v) for v in r["metrics"].values())):
            raise ValueError(f"{key} has no finite metrics")
    names = [c.split()[0] for c in RESULT_SCHEMA.split(", ")]
    typed = [tuple({k: float(v) for k, v in (r.get(n) or {}).items()} if n in ("metrics", "usage") else r[n] for n in names) for r in rows]
    return spark.createDataFrame(typed, RESULT_SCHEMA)


@dataclass
class RawRidge:
    """Ridge over raw columns; what is not finite becomes the training median (0 where nothing is finite)."""

    features: list[str]
    medians: list[float]
    model: Ridge

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], y: str) -> RawRidge:
        finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c).cast("double"))
        found = [(quantiles(df, finite(f), [0.5]) or [0.0])[0] for f in features]
        out = cls(features, found, Ridge(np.zeros(0), 0.0, 0.0))
        out.model = ridge(out.imputed(df), [f"__i{i}" for i in range(len(features))], y)
        return out

    def imputed(self, df: DataFrame) -> DataFrame:
        ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
        return df.withColumns({f"__i{i}": F.when(ok(f), F.col(f).cast("double")).otherwise(F.lit(m)) for i, (f, m) in enumerate(zip(self.features, self.medians, strict=True))})

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        total = F.lit(self.model.intercept)
        for i, b in enumerate(self.model.coef):
            total = total + F.lit(float(b)) * F.col(f"__i{i}")
        return self.imputed(df).withColumn(out, total).drop(*(f"__i{i}" for i in range(len(self.features))))


def random_features(df: DataFrame, features: list[str], size: int = 64, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """``df`` with sines (even places) and hyperbolic tangents (odd ones) of random projections of z-scores."""
    rng = np.random.default_rng(seed)
    w, bias = rng.normal(0, 1 / np.sqrt(len(features)), (len(features), size)), rng.uniform(-np.pi, np.pi, size)
    stats = df.agg(*(F.avg(nz(F.col(f))) for f in features), *(F.stddev_pop(nz(F.col(f))) for f in features)).first()
    p = len(features)
    z = [(nz(F.col(f)) - stats[i]) / (stats[p + i] if stats[p + i] >= 1e-8 else 1.0) for i, f in enumerate(features)]
    df = df.withColumns({f"__z{i}": c for i, c in enumerate(z)})
    new = {}
    for j in range(size):
        dot = F.lit(float(bias[j]))
        for i in range(p):
            dot = dot + F.lit(float(w[i, j])) * F.col(f"__z{i}")
        new[f"rf{j}"] = F.sin(dot) if j % 2 == 0 else F.tanh(dot)
    return df.withColumns(new).drop(*(f"__z{i}" for i in range(p))), list(new)


@dataclass
class RandomFeatureRidge:
    """Ridge over z-scores and random sines and hyperbolic tangents of them; what is not finite becomes the training median."""

    raw: RawRidge
    centre: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    bias: np.ndarray
    model: Ridge

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], y: str, size: int = 256, seed: int = 0) -> RandomFeatureRidge:
        if size <= 0:
            raise ValueError("size is positive")
        raw, p = RawRidge.fit(df, features, y), len(features)
        columns = [f"__i{i}" for i in range(p)]
        stats = raw.imputed(df).agg(*(F.avg(c) for c in columns), *(F.stddev_pop(c) for c in columns)).first()
        scale = np.array([s if s is not None and s >= EPS else 1.0 for s in stats[p:]])
        rng = np.random.default_rng(seed)
        projection, bias = rng.normal(0, 1 / np.sqrt(p), (p, size)), rng.uniform(-np.pi, np.pi, size)
        out = cls(raw, np.array([m or 0.0 for m in stats[:p]]), scale, projection, bias, Ridge(np.zeros(0), 0.0, 0.0))
        kernel = lambda rows: np.column_stack((out.expand(rows[:, :p]), rows[:, p]))
        out.model = ridge_of(raw.imputed(df), [*columns, y], kernel, p + size)
        return out

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        latent = z @ self.projection + self.bias
        latent[:, 0::2], latent[:, 1::2] = np.sin(latent[:, 0::2]), np.tanh(latent[:, 1::2])
        return np.column_stack((z, latent))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the prediction, by batches: hundreds of random features are no expression to compile."""
        columns = [f"__i{i}" for i in range(len(self.raw.features))]

        @F.pandas_udf("double")
        def predicted(*x: pd.Series) -> pd.Series:
            return pd.Series(self.model.predict(self.expand(np.column_stack(x))))

        return self.raw.imputed(df).withColumn(out, predicted(*columns)).drop(*columns)


def select_rank(df: DataFrame, features: list[str], y: str, fold: str, score: Callable[[DataFrame, str, str], float], grid=GRID):
    """(score, size, power) of the rank ensemble with the best pooled out-of-fold score; the first of equals."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    best = None
    for size, power in grid:
        pooled = None
        for k in folds:
            part = rank_fit(df.where(F.col(fold) != k), features, y, size, power).predict(df.where(F.col(fold) == k), "rank_score").select(y, "rank_score")
            pooled = part if pooled is None else pooled.unionByName(part)
        s = score(pooled, y, "rank_score")
        if best is None or s > best[0]:
            best = (s, size, power)
    return best


def refine(values: dict[str, list[float]], loss: Callable[[dict[str, list[float]]], float], steps: int = 10, first: float = 0.1) -> tuple[dict[str, list[float]], float]:
    """Coordinate search: each step tries one value a little up and down, and keeps what lowers the loss by 1e-12."""
    values = {k: list(v) for k, v in values.items()}
    places = [(k, i) for k, v in sorted(values.items()) for i in range(len(v))]
    best = loss(values)
    for step in range(steps if places else 0):
        k, i = places[step % len(places)]
        size = first / (1 + step / len(places))
        for sign in (1, -1):
            trial = {n: list(v) for n, v in values.items()}
            trial[k][i] += sign * size
            now = loss(trial)
            if now + 1e-12 < best:
                values, best = trial, now
                break
    return values, best
