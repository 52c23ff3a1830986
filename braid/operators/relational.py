"""Joins, set operations and lookups that row-aligned evaluation implies, as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_groups(df: DataFrame, groups: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """Rows whose key is (not) among the groups."""
    return df.join(groups.select(key).distinct(), key, "left_semi" if inside else "left_anti")


def subset(df: DataFrame, split: DataFrame, key: str, part: str) -> DataFrame:
    """Rows of one part of a split table (key, split)."""
    return df.join(split.where(F.col("split") == part).select(key), key, "left_semi")


def bin_of(value: Column, edges: list[float]) -> Column:
    """How many sorted edges are at most the value."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))


def longest_prefix(df: DataFrame, name: str, prefixes: list[str], out: str = "prefix") -> DataFrame:
    """The longest of a list of prefixes that the name starts with; null if none."""
    found = F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):
        found = F.when(F.col(name).startswith(p), p).otherwise(found)
    return df.withColumn(out, found)


def pair_products(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A column for the product of every two different columns."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.select(*keys, *((F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in pairs))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def uncovered(expected: DataFrame, *parts: DataFrame, key: str) -> DataFrame:
    """Keys that no part has."""
    have = parts[0].select(key)
    for p in parts[1:]:
        have = have.unionByName(p.select(key))
    return expected.select(key).subtract(have)


def rollup(df: DataFrame, explode: str, value: str) -> DataFrame:
    """Per dependency of exploded lists: count, total, mean and greatest of a value."""
    rows = df.withColumn("dep", F.explode(explode))
    return rows.groupBy("dep").agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("most"))


#: What a roll-up of features holds: its column, the feature's column, and the aggregate.
ROLLED = {
    "importance": ("importance", F.sum),
    "shap_importance": ("shap_importance", F.sum),
    "max_target_alignment": ("target_alignment", lambda c: F.greatest(F.max(c), F.lit(0.0))),
    "mean_abs_shap": ("shap_mean_abs", F.avg),
    "mean_abs_residual_corr": ("residual_corr", lambda c: F.avg(F.abs(c))),
    "mean_redundancy": ("redundancy", F.avg),
    "mean_weight_stability": ("weight_stability", F.avg),
}


def subnodes(features: DataFrame) -> DataFrame:
    """Per alternative that features depend on (``dependencies``, a list): how many, and their fields taken together."""
    rows = features.withColumn("__dep", F.explode("dependencies"))
    return rows.groupBy(F.col("__dep").alias("name")).agg(F.count("*").alias("feature_count"), *(how(F.col(c)).alias(out) for out, (c, how) in ROLLED.items()))


def alternatives(features: DataFrame, chosen: DataFrame) -> DataFrame:
    """:func:`subnodes` with ``selected``; ``chosen`` (name) that no feature depends on have zeros."""
    both = subnodes(features).join(chosen.select("name").distinct().withColumn("selected", F.lit(True)), "name", "full")
    numbers = [c for c in both.columns if c not in ("name", "selected")]
    node = F.substring_index("name", ".", 1)
    return both.select("name", node.alias("node"), F.substring_index("name", ".", -1).alias("alternative"), *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), F.coalesce("selected", F.lit(False)).alias("selected"))


def search_summary(configs: DataFrame, by: list[str]) -> DataFrame:
    """Per search (``by``): configurations, the range, mean and population spread of their scores, and their features in all and in the best."""
    best = F.max_by("n_features", F.struct(F.col("score"), -F.col("planner_index")))
    return configs.groupBy(*by).agg(
        F.count("*").alias("evaluated"), F.min("score").alias("least"), F.max("score").alias("best_config_score"), F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"),
        F.sum("n_features").alias("n_features_global"), best.alias("n_features_best_config"),
    )


def risky(features: DataFrame, copy: float = 0.98, unstable: float = 0.25) -> DataFrame:
    """Features that are likely copies of another or whose weights change from fold to fold."""
    return features.where((F.col("redundancy") > copy) | (F.col("weight_stability") < unstable))


def last_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The last ``n`` rows in the order; ``n`` is what a reader asks to see."""
    return df.orderBy(*(c.desc() for c in order)).limit(n)


def first_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def best_row(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The least row of each key in the order, by one aggregate."""
    return df.groupBy(*by).agg(F.min_by(F.struct(*(c for c in df.columns if c not in by)), F.struct(*order)).alias("__r")).select(*by, "__r.*")


def every(df: DataFrame, step: str, k: int) -> DataFrame:
    """Rows of every ``k``-th step of a run, the first at ``k``."""
    return df.where((F.col(step) > 0) & (F.col(step) % k == 0))


def spread_of(df: DataFrame, by: list[str], value: str, failed: Column) -> DataFrame:
    """Per key: median and range of a value over rows that did not fail, and the part that did. A key's rows are experiments, few for each."""
    v = F.when(~failed, F.col(value))
    return df.groupBy(*by).agg(F.percentile(v, F.lit(0.5)).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(failed.cast("double")).alias("failure_rate"))


def history(state: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Alternative history after a batch of rows (name, step, importance, alignment, score, selected): counts, last values, running means and best values.

    ``state`` is an earlier result, or None. Best scores and alignments begin at 0. The state
    is additive, so batches may come in any grouping, in order of ``step``.
    """
    new = rows.groupBy("name").agg(
        F.count("*").alias("participation_count"),
        F.count(F.when(F.col("selected"), 1)).alias("selected_count"),
        F.max_by("importance", "step").alias("last_importance"),
        F.max("step").alias("last_step"),
        F.sum("importance").alias("sum_importance"),
        F.greatest(F.max("alignment"), F.lit(0.0)).alias("max_target_alignment"),
        F.greatest(F.max("score"), F.lit(0.0)).alias("best_config_score"),
    )
    if state is None:
        out = new
    else:
        both = state.drop("mean_importance").unionByName(new)
        out = both.groupBy("name").agg(
            F.sum("participation_count").alias("participation_count"),
            F.sum("selected_count").alias("selected_count"),
            F.max_by("last_importance", "last_step").alias("last_importance"),
            F.max("last_step").alias("last_step"),
            F.sum("sum_importance").alias("sum_importance"),
            F.max("max_target_alignment").alias("max_target_alignment"),
            F.max("best_config_score").alias("best_config_score"),
        )
    return out.withColumn("mean_importance", F.col("sum_importance") / F.col("participation_count"))


def standardized(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """z-scores by batch mean and population spread; a spread below 1e-8 counts as 1."""
    one = df.agg(*(F.avg(c).alias(f"__m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"__s{i}") for i, c in enumerate(columns)))
    wide = df.crossJoin(F.broadcast(one))
    z = [((F.col(c) - F.col(f"__m{i}")) / F.when(F.col(f"__s{i}") < 1e-8, F.lit(1.0)).otherwise(F.col(f"__s{i}"))).alias(f"z_{c}") for i, c in enumerate(columns)]
    return wide.select(*keys, *z)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, finite part, mean, std, min, max) over the finite values of each column."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    ok = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf"))
    v = F.when(ok, F.col("v"))
    return rows.groupBy("column").agg(F.count("*").alias("n"), F.avg(ok.cast("double")).alias("finite"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
