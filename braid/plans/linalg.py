"""Ridge readouts from distributed sums.

Rows are only ever summed: ``summed`` folds batches of each partition to vectors on the
executors and adds those up by group, so what reaches the driver is a fixed number of
values that depends on the number of columns, not of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHAS = np.logspace(-4, 4, 17)
EPS = 1e-8


#: Values (rows times columns) up to which a table that is passed over again and again is held on the driver.
HELD_VALUES = 1 << 21


class Held:
    """A small table on the driver, in place of a DataFrame that many passes read. The sums are the same ones."""

    def __init__(self, df: DataFrame):
        self.columns, self.rows = df.columns, df.toPandas().to_numpy(dtype=np.float64)

    def take(self, columns: list[str]) -> np.ndarray:
        return self.rows[:, [self.columns.index(c) for c in columns]]


def summed(df: DataFrame | Held, columns: list[str], kernel: Callable[[np.ndarray], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The sums over all rows of what ``kernel`` gives for batches (rows, columns): a vector for each group."""
    if isinstance(df, Held):
        return kernel(df.take(columns)) if len(df.rows) else {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            # columns lie side by side, so that a kernel's choice of columns copies those only; nulls become NaN
            rows = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], dtype=np.float64).T
            for group, vector in kernel(rows).items():
                held[group] = held[group] + vector if group in held else vector
        for group, vector in held.items():
            yield pa.RecordBatch.from_pydict({"g": np.full(len(vector), group, dtype=np.int64), "i": np.arange(len(vector)), "v": np.asarray(vector, dtype=np.float64)})

    parts = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).mapInArrow(work, "g long, i long, v double")
    total = parts.groupBy("g", "i").agg(F.sum("v").alias("v")).toPandas().sort_values(["g", "i"])
    return {int(g): rows["v"].to_numpy() for g, rows in total.groupby("g")}


@dataclass
class Moments:
    """Weighted sums of the columns (1, features, target): count, weight, means and centred cross products."""

    n: float
    w: float
    mean: np.ndarray
    cross: np.ndarray  # sum of w (v - mean)(v - mean)'

    @classmethod
    def of(cls, n: float, raw: np.ndarray, shift: np.ndarray) -> Moments:
        """From sum of w u u' for u = (1, v - shift)."""
        w, s = raw[0, 0], raw[0, 1:]
        if w <= 0:
            return cls(n, 0.0, shift.copy(), np.zeros((len(shift), len(shift))))
        return cls(n, w, shift + s / w, raw[1:, 1:] - np.outer(s, s) / w)

    def take(self, places: list[int]) -> Moments:
        return Moments(self.n, self.w, self.mean[places], self.cross[np.ix_(places, places)])

    @property
    def std(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cross), 0) / max(self.w, EPS))


def chosen(rows: np.ndarray, at: list[int], here: np.ndarray | None = None) -> np.ndarray:
    """Columns ``at`` of the rows ``here`` (places; None: all), without a copy of the others."""
    return rows.T[at].T if here is None else rows.T[np.ix_(at, here)].T


def moments(df: DataFrame | Held, columns: list[str], fold: str, folds: int, weights: list[str], shift: np.ndarray, times: str | None = None) -> dict[tuple[int, int], tuple[float, np.ndarray]]:
    """(fold, place of the weight) to (rows, sum of w u u' for u = (1, v - shift)); a row counts ``times`` times."""
    p, m = len(columns) + 1, len(weights)

    def kernel(rows: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        u = np.column_stack((np.ones(len(rows)), rows[:, : p - 1] - shift))
        n = rows[:, -2] if times else np.ones(len(rows))
        for f in np.unique(rows[:, -1]).astype(int):
            here = np.flatnonzero(rows[:, -1] == f)
            own = u[here]
            for j in range(m):
                w = rows[here, p - 1 + j] * n[here]
                out[f * m + j] = np.append(n[here].sum(), ((own * w[:, None]).T @ own).ravel())
        return out

    sums = summed(df, [*columns, *weights, *([times] if times else []), fold], kernel)
    empty = np.zeros(1 + p * p)
    return {(f, j): ((v := sums.get(f * m + j, empty))[0], v[1:].reshape(p, p)) for f in range(folds) for j in range(m)}


@dataclass
class Ridge:
    """Coefficients in the units of the features, and the penalty that gave them."""

    coef: np.ndarray
    intercept: float
    alpha: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coef + self.intercept

    def column(self, features: list[str]) -> Column:
        """The prediction as an expression of the features' columns."""
        return sum((F.lit(float(b)) * F.col(c) for b, c in zip(self.coef, features, strict=True)), F.lit(float(self.intercept)))


@dataclass
class Solver:
    """Ridge fits for all penalties from one weighted Gram matrix of standardized features.

    Feature means and spreads for standardizing are unweighted; the fit centres by the
    weighted means and does not penalize the intercept.
    """

    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray  # weighted, standardized
    y_mean: float
    values: np.ndarray
    vectors: np.ndarray
    rhs: np.ndarray
    unit: float  # weights times this have mean 1

    @classmethod
    def of(cls, weighted: Moments, plain: Moments) -> Solver:
        """Of moments whose last column is the target. Weights that are 0 nearly everywhere count as ones."""
        if weighted.w < EPS * plain.n:
            weighted = plain
        unit = plain.n / weighted.w if weighted.w else 1.0
        p = len(plain.mean) - 1
        scale = plain.std[:p].copy()
        scale[scale < EPS] = 1.0
        gram = unit * weighted.cross[:p, :p] / np.outer(scale, scale)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2) if p else (np.zeros(0), np.zeros((0, 0)))
        values = np.where(values > max(values.max(initial=0), 0) * 1e-13, values, 0.0)
        rhs = vectors.T @ (unit * weighted.cross[:p, p] / scale)
        rhs = np.where(values > 0, rhs, 0.0)
        return cls(plain.mean[:p], scale, (weighted.mean[:p] - plain.mean[:p]) / scale, weighted.mean[p], values, vectors, rhs, unit)

    def fit(self, alpha: float) -> Ridge:
        beta = self.vectors @ (self.rhs / (self.values + alpha)) / self.scale
        return Ridge(beta, float(self.y_mean - (self.centre + self.mean * self.scale) @ beta), float(alpha))

    def held_out(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
        """For each penalty the weighted sum of squared leave-one-out errors of a batch of its own rows, each counted ``times`` times."""
        w = w * self.unit
        z = (x - (self.centre + self.mean * self.scale)) @ (self.vectors / self.scale[:, None])
        shrunk = 1 / (self.values[:, None] + ALPHAS)
        loo = (y - self.y_mean)[:, None] - z @ (self.rhs[:, None] * shrunk)
        rest = (z * z) @ shrunk
        rest *= -w[:, None]
        rest += 1
        loo /= np.maximum(rest, EPS, out=rest)
        loo *= loo
        return (w if times is None else w * times) @ loo

    def merged(self, columns: list[int]) -> Solver:
        """The same readout for ``held_out`` over different columns: ``columns`` tells which of them each feature is."""
        different, first, back = np.unique(columns, return_index=True, return_inverse=True)
        turn = np.zeros((len(different), len(self.values)))
        np.add.at(turn, back, self.vectors / self.scale[:, None])
        seen = self.values > 0  # along other directions all rows are alike
        ones = np.ones(len(different))
        return Solver((self.centre + self.mean * self.scale)[first], ones, 0 * ones, self.y_mean, self.values[seen], turn[:, seen], self.rhs[seen], self.unit)


def first_least(losses: np.ndarray) -> int:
    """The first place of the least finite loss (0 if there is none)."""
    losses = np.where(np.isfinite(losses), losses, np.inf)
    return int(np.argmin(losses))


def ridge(df: DataFrame, features: list[str], y: str, weight: str | None = None, alpha: float | None = None) -> Ridge:
    """One ridge readout over all rows; without ``alpha`` the penalty of the least leave-one-out error.

    Two passes with a given penalty, three without. No features: the weighted mean.
    """
    columns = [*features, y]
    work = df.withColumns({"__fold": F.lit(0), "__one": F.lit(1.0), "__w": F.col(weight).cast("double") if weight else F.lit(1.0)})
    shift = np.array(work.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(columns))).first(), dtype=np.float64)
    sums = moments(work, columns, "__fold", 1, ["__one", "__w"], shift)
    plain, weighted = (Moments.of(n, raw, shift) for n, raw in (sums[0, 0], sums[0, 1]))
    if not features:
        return Ridge(np.zeros(0), float(weighted.mean[0]), float(ALPHAS[0]))
    solver = Solver.of(weighted, plain)
    if alpha is None:
        losses = summed(work, [*columns, "__w"], lambda r: {0: solver.held_out(r[:, :-2], r[:, -2], r[:, -1])})
        alpha = ALPHAS[first_least(losses.get(0, np.zeros(len(ALPHAS))))]
    return solver.fit(float(alpha))


def ridge_of(df: DataFrame, columns: list[str], expand: Callable[[np.ndarray], np.ndarray], width: int) -> Ridge:
    """A ridge readout over what ``expand`` makes of batches of rows (``width`` features, then the target), in two passes."""

    def sums(rows: np.ndarray) -> dict[int, np.ndarray]:
        u = np.column_stack((np.ones(len(rows)), expand(rows)))
        return {0: np.append(len(rows), (u.T @ u).ravel())}

    found = summed(df, columns, sums).get(0, np.zeros(1 + (width + 2) ** 2))
    m = Moments.of(found[0], found[1:].reshape(width + 2, width + 2), np.zeros(width + 1))
    solver = Solver.of(m, m)

    def held_out(rows: np.ndarray) -> dict[int, np.ndarray]:
        wide = expand(rows)
        return {0: solver.held_out(wide[:, :-1], wide[:, -1], np.ones(len(rows)))}

    return solver.fit(float(ALPHAS[first_least(summed(df, columns, held_out).get(0, np.zeros(len(ALPHAS))))]))


def effective_rank(m: Moments) -> float:
    """exp of the entropy of the normalized singular values of the z-scored columns that vary."""
    ok = m.std >= 1e-12
    if not ok.any():
        return 0.0
    s = m.std[ok]
    corr = m.cross[np.ix_(ok, ok)] / np.outer(s, s) / max(m.w, EPS)
    sv = np.sqrt(np.maximum(np.linalg.eigvalsh(corr), 0) * m.w)
    share = sv / sv.sum() if sv.sum() else sv
    share = share[share > 0]
    return float(np.exp(-(share * np.log(share)).sum()))


def correlations(m: Moments) -> np.ndarray:
    """Magnitudes of correlations, 0 on the diagonal and for columns that do not vary."""
    ok = m.std >= 1e-12
    scale = np.where(ok, m.std, 1.0)
    out = np.abs(m.cross / np.outer(scale, scale) / max(m.w, EPS))
    out[~ok, :] = out[:, ~ok] = 0
    np.fill_diagonal(out, 0)
    return out


def target_correlations(df: DataFrame | Held, features: list[str], y: str, times: str, fold: str, whole: Moments, models: list[Ridge], train: list[Moments]) -> dict:
    """In one pass over rows that count ``times`` times: each feature's correlations with target and residual (out of fold), its square's too, and its mean
    distances from its means (over all rows, and over each fold's rows from the training rows' mean)."""
    p, different = len(features), list(dict.fromkeys(features))
    at = [different.index(c) for c in features]
    shift = np.append(whole.mean, whole.std**2 + whole.mean**2)

    def kernel(rows: np.ndarray) -> dict[int, np.ndarray]:
        x, target, times_, own = rows[:, at], rows[:, -3], rows[:, -2], rows[:, -1].astype(int)
        predicted, apart = np.empty(len(rows)), np.zeros(p)
        for f in np.unique(own):
            here = own == f
            predicted[here] = models[f].predict(x[here])
            apart += times_[here] @ (np.abs(x[here] - train[f].mean) * np.abs(models[f].coef))
        residual = target - predicted
        v = np.column_stack((x, x * x)) - shift
        one = [np.array([times_ @ c for c in (np.ones(len(rows)), target, target**2, residual, residual**2, predicted, predicted**2)])]
        sums = [times_ @ v, times_ @ (v * v), (times_ * target) @ v, (times_ * residual) @ v, times_ @ np.abs(x - whole.mean), apart]
        return {0: np.concatenate([*one, *sums])}

    found = summed(df, [*different, y, times, fold], kernel).get(0, np.zeros(7 + 10 * p))
    n = max(found[0], 1.0)
    mean = found[:7] / n
    spread = lambda k: float(np.sqrt(max(mean[k + 1] - mean[k] ** 2, 0.0)))
    s1, s2, sy, sr = (found[7 + 2 * p * i : 7 + 2 * p * (i + 1)] / n for i in range(4))
    sd = np.sqrt(np.maximum(s2 - s1**2, 0.0))

    def corr(cross: np.ndarray, k: int) -> np.ndarray:
        ok = (sd > 1e-12) & (spread(k) > 1e-12)
        return np.where(ok, (cross - s1 * mean[k]) / np.where(ok, sd * spread(k), 1.0), 0.0)

    target, residual = corr(sy, 1), corr(sr, 3)
    away = found[7 + 8 * p :] / n
    return {
        "target": target[:p], "target_squared": target[p:], "residual": residual[:p], "residual_squared": residual[p:],
        "distance": away[:p], "held_out_distance": away[p:], "residual_std": spread(3), "prediction_std": spread(5),
    }
