"""Regression tasks with a known graph of operations behind the target."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.source import ground_truth
from .readers import normal, uniform

Step = tuple[str, str, tuple[str, ...], dict]


@dataclass(frozen=True)
class Task:
    """``steps`` are (name, operation, inputs, parameters); the last is the target without noise."""

    width: int
    active: tuple[int, ...]
    steps: tuple[Step, ...]
    noise: float = 0.05
    copies: dict[int, tuple[int, float]] = field(default_factory=dict)  # column: (column that it follows, correlation)
    noisier_by: tuple[str, float] | None = None  # noise grows with the magnitude of a step
    missing: float = 0.0


#: The tasks.
TASKS: dict[str, Task] = {
    "shared_wave_gate": Task(
        8,
        (0, 1, 2, 3, 4),
        (
            ("interaction", "multiply", ("x0", "x1"), {}),
            ("shared_wave", "sin", ("interaction",), {"scale": 1.7}),
            ("log_magnitude", "log1p_abs", ("x2",), {}),
            ("positive_gate", "indicator_gt", ("x3",), {"threshold": 0.0}),
            ("gated_log", "multiply", ("positive_gate", "log_magnitude"), {}),
            ("wave_modulation", "multiply", ("shared_wave", "x4"), {}),
            ("target", "weighted_sum", ("shared_wave", "gated_log", "wave_modulation"), {"weights": (1.0, 1.0, 0.2)}),
        ),
        copies={5: (0, 0.9), 6: (2, 0.75)},
    ),
    "piecewise_rational": Task(
        7,
        (0, 1, 2, 3),
        (
            ("ratio", "safe_ratio", ("x0", "x1"), {"offset": 1.0}),
            ("branch", "indicator_gt", ("x2",), {"threshold": -0.15}),
            ("curvature", "square", ("x3",), {}),
            ("selected_curve", "multiply", ("branch", "curvature"), {}),
            ("target", "weighted_sum", ("ratio", "selected_curve", "branch"), {"weights": (1.0, 0.7, -0.25)}),
        ),
        noise=0.08,
        copies={4: (1, 0.85)},
    ),
    "heteroscedastic_reuse": Task(
        9,
        (0, 1, 2, 3),
        (
            ("radial", "sum_squares", ("x0", "x1"), {}),
            ("compressed", "log1p_abs", ("radial",), {}),
            ("oscillation", "sin", ("x2",), {"scale": 2.2}),
            ("coupling", "multiply", ("compressed", "oscillation"), {}),
            ("target", "weighted_sum", ("compressed", "coupling", "x3"), {"weights": (0.8, 1.0, 0.3)}),
        ),
        noise=0.04,
        copies={4: (0, 0.95), 5: (2, 0.8)},
        noisier_by=("compressed", 0.8),
    ),
    "missing_sensor_composition": Task(
        8,
        (0, 1, 2, 3),
        (
            ("contrast", "difference", ("x0", "x1"), {}),
            ("smooth_contrast", "tanh", ("contrast",), {"scale": 1.4}),
            ("amplitude", "log1p_abs", ("x2",), {}),
            ("modulated", "multiply", ("smooth_contrast", "amplitude"), {}),
            ("target", "weighted_sum", ("smooth_contrast", "modulated", "x3"), {"weights": (0.6, 1.0, 0.2)}),
        ),
        noise=0.06,
        copies={4: (0, 0.8)},
        missing=0.12,
    ),
}
SPLITS = ("train", "validation", "interpolation", "extrapolation")


def with_steps(df: DataFrame, task: Task) -> DataFrame:
    """``df`` (x0, x1, ...) with a column for each step of the task."""
    for name, op, inputs, how in task.steps:
        df = df.withColumn(name, ground_truth(op, [F.col(c) for c in inputs], **how))
    return df


def generate(spark: SparkSession, name: str, split: str = "train", n: int = 512, seed: int = 0, steps: bool = False) -> DataFrame:
    """(row_id, x0, ..., y, y_clean): rows of a task, the same for a seed at any partitioning; with ``steps`` their columns too.

    Splits are independent draws. Inputs are uniform in -1..1; in ``extrapolation`` the active ones have magnitudes of
    1.25 to 2.25. Columns that follow another are made of it and normal noise. Missing values are NaN, put in after the target.
    """
    task, stream = TASKS[name], SPLITS.index(split)
    base = (seed * len(SPLITS) + stream) * 1_000_003 + sum(ord(c) << (8 * (i % 4)) for i, c in enumerate(name)) % 1_000_003
    row = F.col("row_id")
    df = spark.range(n).withColumnRenamed("id", "row_id").withColumns({f"x{i}": 2 * uniform(row, base, 100 + i) - 1 for i in range(task.width)})
    if split == "extrapolation":
        far = lambda i: (1.25 + uniform(row, base, 200 + i)) * F.when(uniform(row, base, 300 + i) < 0.5, -1.0).otherwise(1.0)
        df = df.withColumns({f"x{i}": far(i) for i in task.active})
    spreads = df.agg(*(F.stddev_pop(f"x{s}") for s, _ in task.copies.values())).first() if task.copies else ()
    for (column, (source, r)), spread in zip(task.copies.items(), spreads, strict=True):
        noise = F.lit(max(float(spread or 0.0), 1e-12)) * normal(row, base, 200 + column)
        df = df.withColumn(f"x{column}", r * F.col(f"x{source}") + math.sqrt(1 - r * r) * noise)
    df = with_steps(df, task)
    scale = F.lit(task.noise)
    if task.noisier_by:
        scale = scale * (1 + task.noisier_by[1] * F.abs(task.noisier_by[0]))
    df = df.withColumn("y_clean", F.col(task.steps[-1][0])).withColumn("y", F.col("y_clean") + scale * normal(row, base, 400))
    if task.missing:
        df = df.withColumns({f"x{i}": F.when(uniform(row, base, 900 + i) < task.missing, float("nan")).otherwise(F.col(f"x{i}")) for i in range(task.width)})
    more = [s[0] for s in task.steps] if steps else []
    return df.select("row_id", *(f"x{i}" for i in range(task.width)), "y", "y_clean", *more)
