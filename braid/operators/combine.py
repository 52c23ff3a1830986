"""Combining blocks, callables over columns, projections and weights."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import EPS, Block, clip, nz


@dataclass(frozen=True)
class Family:
    """A named function of columns that flows along a graph's edges."""

    name: str
    fn: Callable[[Column], Column]


def identity() -> Family:
    return Family("identity", lambda c: c)


def sigmoid_gate(scale: float = 1.0) -> Family:
    return Family("sigmoid_gate", lambda c: 1 / (1 + F.exp(-scale * c)))


def clipped_linear(scale: float = 1.0) -> Family:
    return Family("clipped_linear", lambda c: clip(0.5 + scale * c, 0, 1))


def source_callable(op: str, scale: float = 1.0, low: float = -1.0, high: float = 1.0) -> Family:
    """The callables that a graph document may spell out; their clipped line differs from ``clipped_linear``."""
    made = {"identity": lambda c: c, "sigmoid": lambda c: 1 / (1 + F.exp(-scale * c)), "tanh": lambda c: F.tanh(scale * c), "clipped_linear": lambda c: clip(scale * c, low, high)}
    if op not in made:
        raise ValueError(f"unknown callable {op!r}; known: {sorted(made)}")
    return Family(op, made[op])


def combine(*blocks: Block) -> Block:
    """Blocks side by side, names unchanged; repeated names get their position, so a plan's aliases differ."""
    out, seen = [], set()
    for i, (name, c) in enumerate(x for b in blocks for x in b):
        out.append((name if name not in seen else f"{name}__{i}", c))
        seen.add(name)
    return out


def activated(family: Family, *blocks: Block) -> Block:
    if not isinstance(family, Family):
        raise TypeError("the last parent of an activated output is a callable")
    return [(f"{family.name}_{n}", family.fn(nz(c))) for n, c in combine(*blocks)]


def projection(vector: list[float], *blocks: Block) -> Block:
    """The dot product of the first 16 columns with ``vector``."""
    terms = [nz(c) * float(w) for (_, c), w in zip(combine(*blocks)[:16], vector, strict=False)]
    return [("global_projection", sum(terms[1:], terms[0]) if terms else F.lit(0.0))]


#: Residual rules: a column of residuals to a column of weights.
def identity_rule(_: float = 1.0) -> Callable[[Column], Column]:
    return lambda r: F.lit(1.0)


def huber_rule(scale: float = 1.0) -> Callable[[Column], Column]:
    s = max(float(scale), 1e-6)
    return lambda r: F.when(F.abs(r) <= s, F.lit(1.0)).otherwise(s / F.greatest(F.abs(r), F.lit(1e-6)))


def source_rule(op: str, scale: float = 1.0) -> Callable[[Column], Column]:
    s = max(float(scale), EPS)
    made = {"identity": lambda r: F.lit(1.0), "huber": lambda r: F.least(F.lit(1.0), s / F.greatest(F.abs(r), F.lit(EPS))), "soft_l1": lambda r: 1 / F.sqrt(1 + (r / s) * (r / s))}
    if op not in made:
        raise ValueError(f"unknown residual rule {op!r}; known: {sorted(made)}")
    return made[op]


def normalized_weight(df: DataFrame, weight: Column | None, out: str) -> DataFrame:
    """``df`` with ``out``: the weight, finite and not negative, over its batch mean; 1 if the mean is below 1e-8."""
    if weight is None:
        return df.withColumn(out, F.lit(1.0))
    w = F.greatest(nz(weight.cast("double")), F.lit(0.0))
    one = df.agg(F.avg(w).alias("__w_mean"))
    return df.crossJoin(F.broadcast(one)).withColumn(out, F.when(F.col("__w_mean") < EPS, F.lit(1.0)).otherwise(w / F.col("__w_mean"))).drop("__w_mean")


def combined_weight(df: DataFrame, weights: list[Column | None], out: str) -> DataFrame:
    """The product of weights that are each normalized, normalized again. No weights: ones."""
    given = [w for w in weights if w is not None]
    names = [f"__cw{i}" for i in range(len(given))]
    for name, w in zip(names, given, strict=True):
        df = normalized_weight(df, w, name)
    if not names:
        return df.withColumn(out, F.lit(1.0))
    product = F.col(names[0])
    for name in names[1:]:
        product = product * F.col(name)
    return normalized_weight(df, product, out).drop(*names)
