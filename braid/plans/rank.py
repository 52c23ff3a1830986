"""Rank ensembles: a weighted mean of mid-ranks of the features that align with the target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, nz
from ..operators.ordered import mid_ranks
from ..operators.scoring import alignment

GRID = [(m, p) for m in (8, 16, 32, 64, 128) for p in (1.0, 1.5, 2.0)]


def expand(df: DataFrame, features: list[str], y: str, top: int = 12) -> tuple[DataFrame, list[str]]:
    """z-scores clipped to 8, with magnitudes and pair products of the ``top`` best aligned (ties to the later feature)."""
    stats = df.agg(*(F.avg(nz(F.col(f))).alias(f"m{i}") for i, f in enumerate(features)), *(F.stddev_pop(nz(F.col(f))).alias(f"s{i}") for i, f in enumerate(features))).first()
    p = len(features)
    z = {f: clip((nz(F.col(f)) - F.lit(stats[i])) / F.lit(stats[p + i] if stats[p + i] >= 1e-8 else 1.0), -8, 8) for i, f in enumerate(features)}
    out = df.withColumns({f"z_{f}": c for f, c in z.items()})
    names = [f"z_{f}" for f in features]
    corr = {r.feature: abs(r["corr"]) for r in alignment(out, names, y).collect()}
    best = sorted(range(p), key=lambda i: (corr[names[i]], i), reverse=True)[:top]
    more = {f"abs_{names[i]}": F.abs(F.col(names[i])) for i in best}
    more |= {f"{names[a]}_x_{names[b]}": F.col(names[a]) * F.col(names[b]) for i, a in enumerate(best) for b in best[i + 1 :]}
    return out.withColumns(more), [*names, *more]


@dataclass
class RankEnsemble:
    features: list[str]
    directions: list[int]
    weights: list[float]

    def predict(self, df: DataFrame, out: str = "rank_score") -> DataFrame:
        """``df`` with the score; ranks are taken within the batch."""
        total = F.lit(0.0)
        for i, (f, d, w) in enumerate(zip(self.features, self.directions, self.weights, strict=True)):
            df = mid_ranks(df, f, f"__r{i}")
            rank = F.col(f"__r{i}")
            total = total + float(w) * (rank if d >= 0 else 1 - rank)
        return df.withColumn(out, total).drop(*(f"__r{i}" for i in range(len(self.features))))


def fit(df: DataFrame, features: list[str], y: str, most: int = 16, power: float = 1.0) -> RankEnsemble:
    """The ``most`` features of greatest correlation (ties to the later one), weighted by its power."""
    corr = {r.feature: r["corr"] for r in alignment(df, features, y).collect()}
    best = sorted(range(len(features)), key=lambda i: (abs(corr[features[i]]), i), reverse=True)[: max(1, most)]
    raw = [max(abs(corr[features[i]]), 1e-8) ** power for i in best]
    return RankEnsemble([features[i] for i in best], [-1 if corr[features[i]] < 0 else 1 for i in best], [w / sum(raw) for w in raw])
