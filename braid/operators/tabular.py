"""Features of a row's numeric columns: plain expressions, so they stay in generated code.

Operators that need statistics of the whole batch (means, spreads, a median) take them
from one aggregate of one row, broadcast to all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import EPS, Block, clip, floor_at, nz, select_block
from .ordered import quantiles


@dataclass
class Table:
    """A batch: its DataFrame, and its feature columns made finite. ``batch`` adds one-row statistics."""

    df: DataFrame
    columns: list[str]

    def x(self, i: int) -> Column:
        return nz(F.col(self.columns[i]).cast("double"))

    @property
    def width(self) -> int:
        return len(self.columns)

    def batch(self, **stats: Column) -> Table:
        new = {n: c for n, c in stats.items() if n not in self.df.columns}
        if not new:
            return self
        one = self.df.agg(*(c.alias(n) for n, c in new.items()))
        return Table(self.df.crossJoin(F.broadcast(one)), self.columns)

    def means(self) -> Table:
        return self.batch(**{f"__mean{i}": F.avg(self.x(i)) for i in range(self.width)})

    def centred(self, i: int) -> Column:
        return self.x(i) - F.col(f"__mean{i}")


def _each(name: str, f: Callable[[Column], Column]) -> Callable[[Table], tuple[Table, Block]]:
    return lambda t: (t, [(f"{name}_{i}", f(t.x(i))) for i in range(t.width)])


def raw(t: Table) -> tuple[Table, Block]:
    return _each("raw", lambda c: c)(t)


def centered(t: Table) -> tuple[Table, Block]:
    t = t.means()
    return t, [(f"centered_{i}", t.centred(i)) for i in range(t.width)]


def _row_stats(t: Table) -> tuple[Column, Column]:
    xs = [t.x(i) for i in range(t.width)]
    mean = sum(xs[1:], xs[0]) / t.width
    squares = [(x - mean) * (x - mean) for x in xs]
    return mean, F.sqrt(sum(squares[1:], squares[0]) / t.width)


def summary(t: Table) -> tuple[Table, Block]:
    mean, std = _row_stats(t)
    xs = [t.x(i) for i in range(t.width)]
    low, high = (F.least(*xs), F.greatest(*xs)) if len(xs) > 1 else (xs[0], xs[0])
    return t, [("row_mean", mean), ("row_std", std), ("row_min", low), ("row_max", high)]


def low_rank_interactions(t: Table) -> tuple[Table, Block]:
    """Products of neighbours among the first four centred columns."""
    if not t.width:
        return t, [("empty_interaction", F.lit(0.0))]
    t = t.means()
    if t.width == 1:
        return t, [("interaction_0_0", t.centred(0) * t.centred(0))]
    return t, [(f"interaction_{i}_{i + 1}", t.centred(i) * t.centred(i + 1)) for i in range(min(4, t.width) - 1)]


def sine_interactions(t: Table) -> tuple[Table, Block]:
    k = min(4, t.width)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)] or [(0, 0)]
    return t, [(f"sin_interaction_{i}_{j}", F.sin(t.x(i) * t.x(j))) for i, j in pairs]


def gated_log(t: Table) -> tuple[Table, Block]:
    k = min(4, t.width)
    return t, [(f"positive_gate_log_{i}_{(i + 1) % k}", F.when(t.x(i) > 0, F.log1p(F.abs(t.x((i + 1) % k)))).otherwise(0.0)) for i in range(k)]


def quantile_summary(t: Table) -> tuple[Table, Block]:
    from ..functions.arrays import quantile_sorted

    t = Table(t.df.withColumn("__sorted", F.sort_array(F.array(*(t.x(i) for i in range(t.width))))), t.columns)
    return t, [(f"row_q{round(100 * q)}", quantile_sorted(F.col("__sorted"), q)) for q in (0.1, 0.25, 0.5, 0.75, 0.9)]


def row_norm_weight(t: Table) -> tuple[Table, Column]:
    """1 / (1 + norm / the batch's median norm), the norm as root mean square."""
    squares = [t.x(i) * t.x(i) for i in range(t.width)]
    norm = F.sqrt(sum(squares[1:], squares[0]) / t.width)
    median = quantiles(t.df, norm, [0.5])
    return t, 1 / (1 + norm / floor_at(F.lit(median[0] if median else None).cast("double")))


TABULAR_BLOCKS: dict[str, Callable[[Table], tuple[Table, Block]]] = {
    "tabular_raw": raw,
    "tabular_centered": centered,
    "tabular_abs": _each("abs", F.abs),
    "tabular_square": _each("square", lambda c: c * c),
    "tabular_summary": summary,
    "tabular_low_rank_interactions": low_rank_interactions,
    "tabular_signed_log": _each("signed_log", lambda c: F.signum(c) * F.log1p(F.abs(c))),
    "tabular_sine": _each("sin", F.sin),
    "tabular_tanh": _each("tanh", F.tanh),
    "tabular_sine_interactions": sine_interactions,
    "tabular_gated_log": gated_log,
    "tabular_quantile_summary": quantile_summary,
}


def tabular_features(df: DataFrame, keys: list[str], columns: list[str], blocks: list[str]) -> DataFrame:
    t, out = Table(df, columns), []
    for b in blocks:
        t, block = TABULAR_BLOCKS[b](t)
        out += block
    return select_block(t.df, keys, out)


def interaction_outputs(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Row measures and neighbour products of batch z-scores (clipped to 5) of the first six columns."""
    columns = columns[:6]
    if not columns:
        return df.select(*keys)
    t = Table(df, columns).means()
    t = t.batch(**{f"__std{i}": F.stddev_pop(t.x(i)) for i in range(t.width)})
    z = [clip(t.centred(i) / floor_at(F.col(f"__std{i}"), EPS), -5, 5) for i in range(t.width)]
    mean_of = lambda xs: sum(xs[1:], xs[0]) / len(xs)
    ends = (F.greatest(*z), F.least(*z)) if len(z) > 1 else (z[0], z[0])
    block = [("z_mean", mean_of(z)), ("z_max", ends[0]), ("z_min", ends[1]), ("z_abs_mean", mean_of([F.abs(c) for c in z]))]
    block += [(f"z_interaction_{i}_{i + 1}", z[i] * z[i + 1]) for i in range(len(z) - 1)]
    return select_block(t.df, keys, block)
