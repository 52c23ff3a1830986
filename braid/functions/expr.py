"""Scalar column helpers and feature blocks.

A block is an ordered list of (name, Column). ``select_block`` is the block boundary:
every value is made finite there, so later operators never see NaN or infinities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8
Block = list[tuple[str, Column]]


def nz(c: Column) -> Column:
    """``c`` where it is finite, else 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0, which ``nz`` makes 0."""
    return F.when(b != 0, a / b)


def log_ratio(a: Column, b: Column) -> Column:
    return F.log(ratio(a, b))


def floor_at(c: Column, least: float = EPS) -> Column:
    return F.greatest(c, F.lit(float(least)))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def sign_abs(name: str, c: Column) -> Block:
    """A value and its magnitude."""
    return [(name, c), (f"{name}_abs", F.abs(c))]


def select_block(df: DataFrame, keys: list[str], block: Block) -> DataFrame:
    """``keys`` and the block's finite values; names must differ."""
    names = [n for n, _ in block]
    if len(set(names)) != len(names):
        raise ValueError(f"a block names {sorted(n for n in set(names) if names.count(n) > 1)} twice")
    own = [f"__b{i}" for i in range(len(block))]  # a column each, since nz reads its argument several times
    made = df.select(*keys, *(c.cast("double").alias(o) for o, (_, c) in zip(own, block, strict=True)))
    return made.select(*keys, *(nz(F.col(o)).alias(n) for o, (n, _) in zip(own, block, strict=True)))


class Steps:
    """Named intermediate columns over a DataFrame, each computed once.

    Lambdas over arrays are evaluated for each element, so what they refer to should be a
    column, not an expression. A step has a level above those of the steps that it
    refers to; ``build`` adds one projection for each level.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self._levels: dict[int, dict[str, Column]] = {}
        self._known: dict[str, Column] = {}

    def let(self, key: str, c: Column, level: int) -> Column:
        if key not in self._known:
            name = f"__s{len(self._known)}"
            self._levels.setdefault(level, {})[name] = c
            self._known[key] = F.col(name)
        return self._known[key]

    def build(self) -> DataFrame:
        df = self.df
        for level in sorted(self._levels):
            df = df.withColumns(self._levels[level])
        return df
