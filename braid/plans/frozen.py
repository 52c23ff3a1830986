"""A readout that is fitted once and predicts rows that it has not seen."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import nz
from ..operators import scoring
from .evaluate import ALL, IRLS_STEPS, Superset, _reweighted, _select
from .graph import Graph
from .linalg import EPS, Moments, Ridge, Solver, moments
from .planner import Config


@dataclass(frozen=True)
class FrozenRegressor:
    """A graph under one configuration, and its readout. Statistics of the readout are those of the training rows;
    features that need the whole batch take it from the rows that are scored."""

    graph: Graph
    config: Config
    features: tuple[str, ...]
    centre: np.ndarray
    scale: np.ndarray
    readout: Ridge
    boundary: int | Column | None = None
    length: int | None = None

    def _features(self, df: DataFrame, inputs: dict[str, object]) -> tuple[DataFrame, list[str]]:
        s = Superset(self.graph, df, inputs, self.boundary, self.length)
        own = s.features(self.config)
        if tuple(s.labels(self.config)) != self.features:
            raise ValueError("these inputs do not give the features that were fitted")
        return s.frame([F.col(c) for c in df.columns]), own

    def predict(self, df: DataFrame, inputs: dict[str, object], out: str = "prediction") -> DataFrame:
        """``df`` with the prediction: a projection, unless a feature needs the batch."""
        frame, own = self._features(df, inputs)
        return frame.withColumn(out, self.readout.column(own)).select(*df.columns, out)

    def contributions(self, df: DataFrame, inputs: dict[str, object]) -> DataFrame:
        """``df`` with ``contributions``: for each feature its z-score times its coefficient. With ``base`` they add up to the prediction."""
        frame, own = self._features(df, inputs)
        parts = [F.lit(float(b)) * (F.col(c) - F.lit(float(m))) for b, c, m in zip(self.readout.coef, own, self.centre, strict=True)]
        base = float(self.readout.intercept + self.centre @ self.readout.coef)
        return frame.select(*df.columns, F.array(*parts).cast("array<double>").alias("contributions"), F.lit(base).alias("base"))

    def score(self, df: DataFrame, inputs: dict[str, object], y: str, metric: str = "rmse") -> float:
        """The metric itself, not turned."""
        fn, _ = scoring.scorer(metric)
        done = self.predict(df, inputs, "__p")
        return done.agg(fn(F.col(y), F.col("__p"))).first()[0]


def contribution_summary(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, mean_abs, std) of :meth:`FrozenRegressor.contributions`, each feature's part of all, and the reconstruction error."""
    rows = df.select(F.posexplode("contributions").alias("place", "v"))
    sums = rows.groupBy("place").agg(F.avg("v").alias("mean"), F.avg(F.abs("v")).alias("mean_abs"), F.stddev_pop("v").alias("std"))
    names = df.sparkSession.createDataFrame(list(enumerate(features)), "place int, feature string")  # a row for each feature
    return sums.join(F.broadcast(names), "place").drop("place")


def fit_frozen(g: Graph, config: Config, df: DataFrame, inputs: dict[str, object], y: str, boundary: int | Column | None = None, length: int | None = None, irls_steps: int = IRLS_STEPS) -> FrozenRegressor:
    """Fit the readout of one configuration on all rows of ``df``; weights and reweighting are those of the configuration."""
    g = g.clone()
    config = g.default_config() | config
    s = Superset(g, df, inputs, boundary, length)
    own, w = s.features(config), s.weight(config)
    s.columns["__w0"], s.level["__w0"] = F.lit(1.0) if w is None else F.greatest(nz(w.cast("double")), F.lit(0.0)), 0
    frame = s.frame([F.col(y).cast("double").alias("__y")]).withColumns({"__one": F.lit(1.0), "__n": F.lit(1.0), "__fold": F.lit(0)}).persist()
    try:
        columns = [*dict.fromkeys(own), "__y"]
        first = frame.agg(*(F.coalesce(F.avg(c), F.lit(0.0)) for c in [*columns, "__w0"])).first()
        shift, w_mean = np.array(first[:-1]), {"": first[-1]}
        sums = moments(frame, columns, "__fold", 1, ["__one", "__w0"], shift)
        plain, weighted = (Moments.of(n, raw, shift) for n, raw in (sums[0, 0], sums[0, 1]))
        if not own:
            return FrozenRegressor(g, config, (), np.zeros(0), np.zeros(0), Ridge(np.zeros(0), float(weighted.mean[0]), 1.0), boundary, length)
        place = {c: i for i, c in enumerate(columns)}
        at = [place[c] for c in own] + [place["__y"]]
        key, per, names, weights = (0, ALL), [own], [""], {"": "__w0"}
        fits = _select(frame, columns, weights, [key], per, names, {key: Solver.of(weighted.take(at), plain.take(at))}, None, place)
        rule = s.rule(config)
        for _ in range(0 if rule is None else irls_steps):
            again = _reweighted(frame, columns, weights, [key], per, names, w_mean, fits, {0: rule}, {}, shift, place)
            solver = Solver.of(again[key][0], plain.take(at))
            fits = _select(frame, columns, weights, [key], per, names, {key: solver}, (fits, {0: rule}, {key: again[key][1]}, w_mean), place)
    finally:
        frame.unpersist()
    scale = plain.take(at[:-1]).std
    return FrozenRegressor(g, config, tuple(s.labels(config)), plain.take(at[:-1]).mean, np.where(scale < EPS, 1.0, scale), fits[key], boundary, length)
