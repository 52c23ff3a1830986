"""Scores, correlations and objective breakdowns as aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import nz
from .ordered import quantiles

TINY = 1e-12


def variance_explained(y: Column, p: Column) -> Column:
    y, p = nz(y), nz(p)
    mse, var = F.avg((y - p) * (y - p)), F.var_pop(y)
    return F.when(var < TINY, F.when(mse < TINY, F.lit(1.0)).otherwise(-mse)).otherwise(1 - mse / F.when(var != 0, var))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((nz(y) - nz(p)) * (nz(y) - nz(p))))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(nz(y) - nz(p)))


Scorer = tuple[Callable[[Column, Column], Column], bool]
_SCORERS: dict[str, Scorer] = {"variance_explained": (variance_explained, True), "rmse": (rmse, False), "mae": (mae, False)}
_ALIASES = {"r2": "variance_explained", "root_mean_squared_error": "rmse", "mean_absolute_error": "mae"}


def register_scorer(name: str, fn: Callable[[Column, Column], Column], higher_is_better: bool = True) -> None:
    _SCORERS[name] = (fn, higher_is_better)


def scorer(what: str | Callable[[Column, Column], Column]) -> Scorer:
    """(aggregate, whether higher is better) of a name, an alias or a function."""
    if callable(what):
        return what, True
    name = _ALIASES.get(what, what)
    if name not in _SCORERS:
        raise ValueError(f"unknown scorer {what!r}; known: {sorted(_SCORERS)}")
    return _SCORERS[name]


def oriented(what, y: Column, p: Column) -> Column:
    """The score that is better when it is higher."""
    fn, up = scorer(what)
    return fn(y, p) if up else -fn(y, p)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; 0 where either side does not vary."""
    x, y = nz(x), nz(y)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx < TINY) | (sy < TINY) | (sx * sy < TINY), F.lit(0.0)).otherwise(F.covar_pop(x, y) / F.when(sx * sy != 0, sx * sy))


def alignment(df: DataFrame, features: list[str], y: str, squared: bool = False) -> DataFrame:
    """(feature, corr): the correlation of each feature (or its square) with ``y``, all in one aggregate."""
    x = lambda f: nz(F.col(f)) * nz(F.col(f)) if squared else F.col(f)
    one = df.agg(*(safe_corr(x(f), F.col(y)).alias(f"c{i}") for i, f in enumerate(features)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"c{i}").alias("corr")) for i, f in enumerate(features)))))


def nrmse(y: Column, p: Column) -> Column:
    """RMSE over the target's spread; raises if the target does not vary."""
    spread = F.stddev_pop(y)
    return F.sqrt(F.avg((y - p) * (y - p))) / F.when(spread > 0, spread).otherwise(F.raise_error(F.lit("the target does not vary")).cast("double"))


def breakdown(y: Column, p: Column, metric: str = "rmse") -> list[Column]:
    fn, up = scorer(metric)
    residual = nz(y) - nz(p)
    raw = fn(y, p)
    return [F.count("*").alias("n"), (raw if up else -raw).alias("score"), raw.alias("raw"), F.avg(residual).alias("residual_mean"), F.avg(F.abs(residual)).alias("abs_residual_mean")]


def by_group(df: DataFrame, group: str, y: str, p: str, metric: str = "rmse", groups: int = 20) -> DataFrame:
    """The breakdown of the first ``groups`` groups in order, worst first."""
    first = df.select(group).distinct().orderBy(group).limit(groups)
    out = df.join(F.broadcast(first), group).groupBy(group).agg(*breakdown(F.col(y), F.col(p), metric))
    up = scorer(metric)[1]
    return out.orderBy(F.asc("raw") if up else F.desc("raw"), group)


def quantile_bins(df: DataFrame, value: str, bins: int = 5, out: str = "bin") -> DataFrame:
    """``df`` with the place of ``value`` among the inner edges of its exact quantile bins (an edge belongs to the bin above)."""
    v = nz(F.col(value).cast("double"))
    edges = sorted(set(quantiles(df, v, [k / bins for k in range(bins + 1)]) or []))
    return df.withColumn("__v", v).withColumn(out, sum((F.when(F.col("__v") >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))).drop("__v")


def by_target_bin(df: DataFrame, y: str, p: str, metric: str = "rmse", bins: int = 5) -> DataFrame:
    out = quantile_bins(df, y, bins).groupBy("bin").agg(*breakdown(F.col(y), F.col(p), metric), F.min(y).alias("low"), F.max(y).alias("high"))
    return out.orderBy("bin")


def by_time_bin(df: DataFrame, time: str, y: str, p: str, metric: str = "rmse", bins: int = 5) -> DataFrame:
    out = quantile_bins(df, time, bins).groupBy("bin").agg(*breakdown(F.col(y), F.col(p), metric), F.avg(p).alias("prediction_mean"), F.min(time).alias("low"), F.max(time).alias("high"))
    return out.orderBy("bin")


REPORT = ("part", "role", "key", "n", "score", "raw", "residual_mean", "abs_residual_mean")


def objective(df: DataFrame, y: str, p: str, metric: str = "rmse", group: str | None = None, time: str | None = None, roles: dict[str, str] | None = None, bins: int = 5) -> DataFrame:
    """Where predictions are good and where not, as one table (REPORT): overall, by bin of the target, by group, by bin of time, and by each role's groups."""
    measures = breakdown(F.col(y), F.col(p), metric)
    named = lambda part, role, key, rows: rows.select(F.lit(part).alias("part"), F.lit(role).alias("role"), key.cast("string").alias("key"), *REPORT[3:])
    tables = [named("overall", "", F.lit(""), df.agg(*measures)), named("target_bin", y, F.col("bin"), quantile_bins(df, y, bins).groupBy("bin").agg(*measures))]
    if group:
        tables.append(named("group", group, F.col(group), by_group(df, group, y, p, metric)))
    if time:
        tables.append(named("time_bin", time, F.col("bin"), quantile_bins(df, time, bins).groupBy("bin").agg(*measures)))
    tables += [named("role", role, F.col(key), by_group(df, key, y, p, metric)) for role, key in (roles or {}).items() if key != group]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
