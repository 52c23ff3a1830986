"""Strategies that give every row a fold, and what they report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered
from ..tables import written

Strategy = Callable[[DataFrame, str, str, int, int], DataFrame]
NAMES = ("random", "group_random", "leave_group_out", "stratified", "time_blocked")


@dataclass(frozen=True)
class FoldStrategy:
    """``name`` is one of NAMES, or a function (df, key, y, k, seed) to ``df`` with a column ``fold``."""

    name: str | Strategy = "random"
    group_key: str | None = None
    time_key: str | None = None
    stratify_bins: int = 5

    def split(self, df: DataFrame, key: str, y: str, k: int, seed: int | None = 0) -> tuple[DataFrame, dict]:
        """``df`` with ``fold`` (in place of a column of that name), and how it was made. Without the column that a strategy needs rows go at random, or in order, and the reason is told."""
        df = df.drop("fold")
        about = {"method": self.name if isinstance(self.name, str) else getattr(self.name, "__name__", "custom"), "group_key": self.group_key, "time_key": self.time_key}
        if callable(self.name):
            out = self.name(df, key, y, k, seed)
            if "fold" not in out.columns:
                raise ValueError("a fold strategy gives a column named fold")
            return out, about
        match self.name:
            case "random":
                return ordered.random_folds(df, key, k, seed or 0), about
            case "stratified":
                return stratified(df, key, y, k, seed, self.stratify_bins), about | {"stratify_bins": self.stratify_bins}
            case "time_blocked":
                known = self.time_key in df.columns
                out = written(ordered.time_folds(df, self.time_key if known else key, key, k), "folds")
                sizes = [r["count"] for r in out.groupBy("fold").count().orderBy("fold").collect()]  # a row for each fold
                return out, about | {"blocked": True, "validation_block_sizes": sizes} | ({} if known else {"reason": "time key was not supplied; used sample order"})
            case "group_random" | "leave_group_out":
                if self.group_key not in df.columns:
                    return ordered.random_folds(df, key, k, seed or 0), about | {"method": "random", "grouped": False, "reason": "group key was not supplied"}
                alone = self.name == "leave_group_out"
                out = written(ordered.leave_group_out(df, self.group_key) if alone else ordered.group_folds(df, self.group_key, k, seed, key), "folds")
                return out, about | {"grouped": True, "requested_folds": k} | group_diagnostics(out, self.group_key)
        raise ValueError(f"unknown fold strategy {self.name!r}; known: {NAMES}")


def stratified(df: DataFrame, key: str, y: str, k: int, seed: int | None = 0, bins: int = 5) -> DataFrame:
    """Folds with even parts of each value of ``y``, or of its quantile bins where it has more than ``bins`` values."""
    values = df.select(y).distinct().limit(bins + 1).count()
    if values <= bins:
        return ordered.stratified_folds(df, y, [key], k, seed)
    return ordered.stratified_folds(ordered.quantile_labels(df, y, bins, "__stratum"), "__stratum", [key], k, seed).drop("__stratum")


def group_diagnostics(folded: DataFrame, group: str) -> dict:
    """How many groups there are, how many each fold holds, and how many (fold, group) pairs have the group on both sides."""
    pairs = folded.groupBy(group, "fold").agg(F.count("*").alias("n"))
    spread = pairs.groupBy(group).agg(F.count("*").alias("folds"))
    groups, over = spread.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("folds") > 1, F.col("folds"))), F.lit(0))).first()
    counts = [r.n for r in pairs.groupBy("fold").agg(F.count("*").alias("n")).orderBy("fold").collect()]  # a row for each fold
    return {"n_groups": groups, "actual_folds": len(counts), "validation_group_counts": counts, "fold_group_overlap_count": over}


def fold_strategy(what: FoldStrategy | str | Strategy | None = None, group_key: str | None = None, time_key: str | None = None, stratify_bins: int = 5) -> FoldStrategy:
    """A strategy from a name, a function, or nothing: by groups where there is a group key, else random."""
    if isinstance(what, FoldStrategy):
        return what
    return FoldStrategy(what or ("group_random" if group_key else "random"), group_key, time_key, stratify_bins)
