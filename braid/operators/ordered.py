"""Ordered analytics: running values, ranks, folds, splits and top-k, as window functions.

A window over a whole table is one task, so ranks and running sums of whole tables go through
a range partitioning that is written once: sums of its partitions, and running values inside them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import written


def running(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Running sum, maximum, minimum, mean, and the difference from the value before, by key."""
    w = Window.partitionBy(*by).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = F.col(value)
    return df.withColumns(
        {"running_sum": F.sum(v).over(so_far), "running_max": F.max(v).over(so_far), "running_min": F.min(v).over(so_far), "running_mean": F.avg(v).over(so_far), "step": v - F.lag(v).over(w)}
    )


def _cut(df: DataFrame, order: list[Column], parts: int | None) -> tuple[DataFrame, list[str]]:
    """``df`` in sorted range partitions, written, with each row's partition and place in it; and the names of the order's columns."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"__o{i}" for i in range(len(order))]
    cut = df.withColumns(dict(zip(names, order, strict=True))).repartitionByRange(n, *names).sortWithinPartitions(*names)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return written(cut.withColumns({"__part": F.spark_partition_id(), "__in": place}), "ranges"), names


def _heads(cut: DataFrame, amount: Column) -> DataFrame:
    """(__part, __head): what the partitions before hold. The driver adds up one row for each partition."""
    heads, at = [], 0
    for part, size in sorted(cut.groupBy("__part").agg(amount).collect()):
        heads.append((part, at))
        at += size
    return F.broadcast(cut.sparkSession.createDataFrame(heads, "__part int, __head long"))


def ranked(df: DataFrame, order: list[Column], out: str = "rn", parts: int | None = None) -> DataFrame:
    """``df`` with 0-based row numbers in the order, for tables of any size; the order should be total."""
    cut, names = _cut(df, order, parts)
    return cut.join(_heads(cut, F.count("*")), "__part").withColumn(out, F.col("__head") + F.col("__in")).drop("__part", "__in", "__head", *names)


def counted_before(df: DataFrame, order: list[Column], amount: str, out: str, parts: int | None = None) -> DataFrame:
    """``df`` with the sum of ``amount`` (long) over the rows before, for tables of any size; the order should be total."""
    cut, names = _cut(df, order, parts)
    w = Window.partitionBy("__part").orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn(out, F.coalesce(F.sum(amount).over(w), F.lit(0)))
    return inside.join(_heads(cut, F.sum(amount)), "__part").withColumn(out, F.col("__head") + F.col(out)).drop("__part", "__in", "__head", *names)


def _value_places(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, __v, __c, __b): the different values, how often each stands, and how many rows come before it in the order of keys and values."""
    counts = df.groupBy(*keys, value.alias("__v")).agg(F.count("*").alias("__c"))
    return counted_before(counts, [*(F.col(k) for k in keys), F.col("__v")], "__c", "__b")


def mid_ranks(df: DataFrame, value: str, out: str = "mid_rank", by: list[str] | None = None) -> DataFrame:
    """Ranks in 0..1, ties at their mean. Equal values are counted first, so the order is over different values only."""
    keys = by or []
    placed = written(_value_places(df, keys, F.col(value)), "value-places")
    if keys:
        whole = placed.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.sum("__c").alias("__n"), F.min("__b").alias("__head"))
        placed = placed.join(whole, _all([F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]))
    else:
        placed = placed.withColumns({"__n": F.lit(placed.agg(F.coalesce(F.sum("__c"), F.lit(0))).first()[0]), "__head": F.lit(0)})
    rank = F.when(F.col("__n") <= 1, F.lit(0.5)).otherwise((F.col("__b") - F.col("__head") + (F.col("__c") - 1) / F.lit(2.0)) / (F.col("__n") - 1))
    placed = placed.select(*keys, "__v", rank.cast("double").alias(out))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return df.alias("l").join(placed.alias("r"), _all([*same, F.col(f"l.{value}").eqNullSafe(F.col("r.__v"))])).select("l.*", f"r.{out}")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def quantiles(df: DataFrame, value: Column, parts: list[float]) -> list[float] | None:
    """Exact quantiles with linear interpolation, for tables of any size; nulls do not count. None without values.

    Values are counted, and only those at the ranks that are needed come to the driver.
    """
    placed = written(_value_places(df.where(value.isNotNull()), [], value.cast("double")), "value-places")
    n = placed.agg(F.sum("__c")).first()[0]
    if not n:
        return None
    places = [p * (n - 1) for p in parts]
    ranks = sorted({r for x in places for r in (math.floor(x), math.ceil(x))})
    hit = placed.withColumn("__r", F.explode(F.filter(F.array(*(F.lit(r).cast("long") for r in ranks)), lambda r: (r >= F.col("__b")) & (r < F.col("__b") + F.col("__c")))))
    at = {r["__r"]: r["__v"] for r in hit.select("__r", "__v").collect()}  # a row for each rank
    low = lambda x: at[math.floor(x)]
    return [low(x) + (at[math.ceil(x)] - low(x)) * (x - math.floor(x)) if math.floor(x) != math.ceil(x) else low(x) for x in places]


def blocks(df: DataFrame, order: list[Column], k: int, out: str = "fold", parts: int | None = None) -> DataFrame:
    """``k`` contiguous runs of rows in order, the first ones a row longer."""
    numbered = ranked(df, order, "__rn", parts)
    n = numbered.count()
    size, more = divmod(n, k)
    edge = more * (size + 1)
    rn = F.col("__rn")
    fold = F.when(rn < edge, F.floor(rn / F.lit(float(size + 1)))).otherwise(more + F.floor((rn - edge) / F.lit(float(max(size, 1)))))
    return numbered.withColumn(out, fold.cast("int")).drop("__rn")


def shuffled(key: Column, seed: int) -> Column:
    """A pseudorandom order that depends on the key and the seed only."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))


def random_folds(df: DataFrame, key: str, k: int, seed: int = 0, n: int | None = None) -> DataFrame:
    n = df.count() if n is None else n
    return blocks(df, [shuffled(F.col(key), seed), F.col(key)], max(2, min(k, n)))


def group_folds(df: DataFrame, group: str, k: int, seed: int | None = 0, key: str | None = None) -> DataFrame:
    """Whole groups in one fold. Fewer than two groups: random folds of rows by ``key``. Without a seed groups go in order."""
    groups = df.select(group).distinct()
    m = groups.count()
    if m < 2:
        return random_folds(df, key or group, k, seed or 0)
    order = [F.col(group)] if seed is None else [shuffled(F.col(group), seed), F.col(group)]
    return df.join(blocks(groups, order, min(k, m)), group)


def leave_group_out(df: DataFrame, group: str) -> DataFrame:
    """A fold for each group, numbered in order."""
    groups = df.select(group).distinct()
    return df.join(ranked(groups, [F.col(group)], "fold"), group)


def stratified_folds(df: DataFrame, label: str, key: list[str], k: int, seed: int | None = 0) -> DataFrame:
    """Each label's rows are split evenly; inside a label rows go by hash, or by ``key`` without a seed. A label with half of all rows is no single task."""
    order = [F.col(c) for c in key] if seed is None else [shuffled(F.concat_ws("|", *key), seed), *map(F.col, key)]
    numbered = written(ranked(df, [F.col(label), *order], "__rn"), "strata")
    strata = numbered.groupBy(F.col(label).alias("__label")).agg(F.min("__rn").alias("__first"), F.count("*").alias("__n"))
    at, size, more = F.col("__rn") - F.col("__first"), F.expr(f"__n div {k}"), F.col("__n") % k
    fold = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return numbered.join(strata, F.col(label).eqNullSafe(F.col("__label"))).withColumn("fold", fold.cast("int")).drop("__label", "__first", "__n", "__rn")


def quantile_labels(df: DataFrame, y: str, bins: int, out: str = "stratum") -> DataFrame:
    """``df`` with the quantile bin of a continuous target, as a label to stratify by; bins of equal edges fall together."""
    edges = quantiles(df, F.col(y), [i / bins for i in range(1, bins)]) or []
    label = F.lit(0)
    for edge in sorted(set(edges)):
        label = label + F.when(F.col(y) >= edge, 1).otherwise(0)
    return df.withColumn(out, label)


def time_folds(df: DataFrame, time: str, key: str, k: int) -> DataFrame:
    return blocks(df, [F.col(time), F.col(key)], k)


def three_way_split(df: DataFrame, key: str, validation: float = 0.2, test: float = 0.2, seed: int | None = 0) -> DataFrame:
    """``df`` with ``split``: test, then validation, then train, in a shuffled order (in key order without a seed)."""
    n = df.count()
    if n < 6:
        raise ValueError("a three-way split needs six rows")
    n_test, n_val = (max(1, round(n * f)) for f in (test, validation))
    while n - n_test - n_val < 1:
        if n_test >= n_val:
            n_test -= 1
        else:
            n_val -= 1
    order = [F.col(key)] if seed is None else [shuffled(F.col(key), seed), F.col(key)]
    rn = F.col("__rn")
    return ranked(df, order, "__rn").withColumn("split", F.when(rn < n_test, "test").when(rn < n_test + n_val, "validation").otherwise("train")).drop("__rn")


def grouped_split(df: DataFrame, group: str, validation: float = 0.2, test: float = 0.2, seed: int | None = 0) -> DataFrame:
    return df.join(three_way_split(df.select(group).distinct(), group, validation, test, seed), group)


def check_split(split: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(rows, repeated, missing, unknown, parts): a sound split has no repeated, missing or unknown keys and three parts."""
    one = split.groupBy(key).agg(F.count("*").alias("__c"))
    return split.agg(F.count("*").alias("rows"), F.count_distinct("split").alias("parts")).crossJoin(
        one.agg(F.count(F.when(F.col("__c") > 1, 1)).alias("repeated"))
    ).crossJoin(expected.select(key).exceptAll(split.select(key)).agg(F.count("*").alias("missing"))).crossJoin(split.select(key).exceptAll(expected.select(key)).agg(F.count("*").alias("unknown")))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): a digest of a table's rows that no order or partitioning changes."""
    row = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))
    h = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sha2(F.coalesce(F.sum(h).cast("string"), F.lit("")), 256).alias("digest"))


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each key; the order should name its ties."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def learning_curve_area(df: DataFrame, by: list[str], step: str, score: str, budget: int, higher_is_better: bool = True) -> DataFrame:
    """The step integral of the best score so far over evaluations, per unit of budget; repeated counts have no width."""
    w = Window.partitionBy(*by).orderBy(step, score)
    best = (F.max if higher_is_better else F.min)(score).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    width = F.lead(step, 1, budget).over(w) - F.col(step)
    return df.withColumns({"__b": best, "__w": width}).groupBy(*by).agg((F.sum(F.col("__b") * F.col("__w")) / budget).alias("area"))
