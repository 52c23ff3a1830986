"""Registered queries: series, tabular, scoring, ordered, joins and diagnostics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqlforms as S
from .catalogue import query
from .functions.expr import nz, select_block
from .operators import combine, ordered, scoring, series, tabular


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *keys: str, places: int = 6) -> DataFrame:
    """``df`` with doubles rounded, no negative zeros, and moved by 3e-8 off the exact halves that decimals make."""
    return df.select(*((F.round(F.col(c) + 3e-8, places) + F.lit(0.0)).alias(c) if t in ("double", "float") and c not in keys else F.col(c) for c, t in df.dtypes))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, series): each user's values in time order."""
    e = table(spark, sf_dir, "events")
    rows = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("r"))
    return rows.select("user_id", F.transform("r", lambda x: x["value"]).alias("series"))


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("series"), "label")


EXTRA_BLOCKS = {
    "source_shift": series.source_shift,
    "source_volatility": series.source_volatility,
    "source_tail_head": series.source_tail_head,
    "energy_weights": lambda s: [("boundary_energy_weight", series.boundary_energy_weight(s)), ("late_energy_weight", series.late_energy_weight(s))],
}
FIXED_ONLY = {"spectral_basic", "structural_break_baseline_outputs", "row_multiscale_tail_outputs"}


def _series_query(source: str, block: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if source == "embeddings":
            df, key, boundary, length = embedding_series(spark, sf_dir), "vec_id", 32, 64
        else:
            df, key, boundary, length = event_series(spark, sf_dir), "user_id", None, None
        if block in EXTRA_BLOCKS:
            s = series.Series(df, "series", boundary, length)
            out = s.select([key], EXTRA_BLOCKS[block](s))
        else:
            out = series.series_features(df, [key], [block], "series", boundary, length)
        return rounded(out)

    return run


#: Short names: seg_basic_events and so on.
for _block in (*series.SERIES_BLOCKS, *EXTRA_BLOCKS):
    _short = _block.replace("segment_", "seg_").replace("_outputs", "")
    if _block == "row_time_basis_outputs":
        continue
    query(f"{_short}_emb", S.series_sql("embeddings", _block))(_series_query("embeddings", _block))
    if _block not in FIXED_ONLY:
        query(f"{_short}_events", S.series_sql("events", _block))(_series_query("events", _block))


def _context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: hours since 2024 of the last event, a period, and the length of the series."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(((F.unix_micros(F.max(F.col("ts").cast("timestamp"))) / 1e6 - 1704067200) / 3600).alias("sample_time"), (F.col("user_id") % 3).cast("double").alias("sample_period"), (F.count("*") * 0.5).alias("lookback_observed"))
    return event_series(spark, sf_dir).join(last, "user_id")


_CONTEXT_SQL = """
WITH r AS (SELECT user_id, (epoch_us(max(ts)) / 1e6 - 1704067200) / 3600 AS t, (user_id % 3)::DOUBLE AS p, count(*) AS n FROM events GROUP BY user_id),
g AS (SELECT greatest(max(t), 1.0) AS scale FROM r),
c AS (SELECT user_id, t / scale AS u, ln(1 + greatest(t, 0)) / greatest(ln(1 + scale), 1.0) AS lu, (p >= 2)::INT::DOUBLE AS two, least(greatest(0.5 * n / n, 0), 1) AS o FROM r, g)
SELECT user_id, {} FROM c
"""
_CONTEXT_SELECT = "round(u + 3e-8, 6) + 0.0 AS sample_time_norm, round(lu + 3e-8, 6) + 0.0 AS sample_time_log_norm, two AS sample_period_two, round(o + 3e-8, 6) + 0.0 AS lookback_observed_fraction"
_BASIS_SELECT = ", ".join(
    f"round({e} + 3e-8, 6) + 0.0 AS {n}"
    for n, e in {
        "time_basis_norm": "u", "time_basis_log_norm": "lu", "time_basis_sq": "u * u", "time_basis_cube": "u * u * u", "time_basis_sqrt": "sqrt(greatest(u, 0))",
        "time_basis_sin1": "sin(pi() * u)", "time_basis_cos1": "cos(pi() * u)", "time_basis_sin2": "sin(2 * pi() * u)", "time_basis_cos2": "cos(2 * pi() * u)",
        "observed_basis_fraction": "o", "observed_basis_sq": "o * o", "time_observed_interaction": "u * o", "time_basis_period_two": "two",
    }.items()
)


@query("ctx_row_context", _CONTEXT_SQL.format(_CONTEXT_SELECT))
def ctx_row_context(spark, sf_dir):
    return rounded(series.series_features(_context_rows(spark, sf_dir), ["user_id"], ["row_context_outputs"]))


@query("ctx_time_basis", _CONTEXT_SQL.format(_BASIS_SELECT))
def ctx_time_basis(spark, sf_dir):
    return rounded(series.series_features(_context_rows(spark, sf_dir), ["user_id"], ["row_time_basis_outputs"]))


# --- tabular ---------------------------------------------------------------------------

KEYS = ["l_orderkey", "l_linenumber"]
_pairs4 = [(i, j) for i in range(4) for j in range(i + 1, 4)]
_mean_sql = {x: f"({x} - (SELECT avg({x}) FROM lineitem))" for x in S.X}
_row_mean = f"(({' + '.join(S.X)}) / 4)"
_row_std = "sqrt((" + " + ".join(f"pow({x} - {_row_mean}, 2)" for x in S.X) + ") / 4)"
_list = f"[{', '.join(S.X)}]"
TABULAR_SQL: dict[str, dict[str, str]] = {
    "tabular_raw": {f"raw_{i}": x for i, x in enumerate(S.X)},
    "tabular_centered": {f"centered_{i}": _mean_sql[x] for i, x in enumerate(S.X)},
    "tabular_abs": {f"abs_{i}": f"abs({x})" for i, x in enumerate(S.X)},
    "tabular_square": {f"square_{i}": f"{x} * {x}" for i, x in enumerate(S.X)},
    "tabular_summary": {"row_mean": _row_mean, "row_std": _row_std, "row_min": f"list_min({_list})", "row_max": f"list_max({_list})"},
    "tabular_low_rank_interactions": {f"interaction_{i}_{i + 1}": f"{_mean_sql[S.X[i]]} * {_mean_sql[S.X[i + 1]]}" for i in range(3)},
    "tabular_signed_log": {f"signed_log_{i}": f"sign({x}) * ln(1 + abs({x}))" for i, x in enumerate(S.X)},
    "tabular_sine": {f"sin_{i}": f"sin({x})" for i, x in enumerate(S.X)},
    "tabular_tanh": {f"tanh_{i}": f"tanh({x})" for i, x in enumerate(S.X)},
    "tabular_sine_interactions": {f"sin_interaction_{i}_{j}": f"sin({S.X[i]} * {S.X[j]})" for i, j in _pairs4},
    "tabular_gated_log": {f"positive_gate_log_{i}_{(i + 1) % 4}": f"CASE WHEN {S.X[i]} > 0 THEN ln(1 + abs({S.X[(i + 1) % 4]})) ELSE 0 END" for i in range(4)},
    "tabular_quantile_summary": {f"row_q{p}": f"list_aggregate({_list}, 'quantile_cont', {p / 100})" for p in (10, 25, 50, 75, 90)},
}


def _rounded_sql(features: dict[str, str], source: str = "lineitem", keys: str = "l_orderkey, l_linenumber", places: int = 6) -> str:
    return f"SELECT {keys}, " + ", ".join(f"round(({e})::DOUBLE + 3e-8, {places}) + 0.0 AS {n}" for n, e in features.items()) + f" FROM {source}"


def _places(block: str) -> int:
    return 2 if "square" in block else 4 if "inter" in block or "centered" in block else 6


def _tabular_query(block: str):
    return lambda spark, sf_dir: rounded(tabular.tabular_features(table(spark, sf_dir, "lineitem"), KEYS, list(S.X), [block]), places=_places(block))


for _block, _sql in TABULAR_SQL.items():
    query(_block.replace("tabular_", "tab_"), _rounded_sql(_sql, places=_places(_block)))(_tabular_query(_block))

_z = [f"least(greatest(({x} - avg({x}) OVER ()) / greatest(stddev_pop({x}) OVER (), 1e-8), -5), 5)" for x in S.X]


@query(
    "tab_interaction_outputs",
    f"WITH z AS (SELECT l_orderkey, l_linenumber, {', '.join(f'{e} AS z{i}' for i, e in enumerate(_z))} FROM lineitem) "
    + _rounded_sql(
        {"z_mean": "(z0 + z1 + z2 + z3) / 4", "z_max": "greatest(z0, z1, z2, z3)", "z_min": "least(z0, z1, z2, z3)", "z_abs_mean": "(abs(z0) + abs(z1) + abs(z2) + abs(z3)) / 4"}
        | {f"z_interaction_{i}_{i + 1}": f"z{i} * z{i + 1}" for i in range(3)},
        "z",
    ),
)
def tab_interaction_outputs(spark, sf_dir):
    return rounded(tabular.interaction_outputs(table(spark, sf_dir, "lineitem"), KEYS, list(S.X)))


@query("weight_row_norm", f"WITH n AS (SELECT l_orderkey, l_linenumber, sqrt(({' + '.join(f'{x} * {x}' for x in S.X)}) / 4) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, round(1 / (1 + n / greatest((SELECT quantile_cont(n, 0.5) FROM n), 1e-8)) + 3e-8, 6) + 0.0 AS weight FROM n")
def weight_row_norm(spark, sf_dir):
    t, w = tabular.row_norm_weight(tabular.Table(table(spark, sf_dir, "lineitem"), list(S.X)))
    return rounded(select_block(t.df, KEYS, [("weight", w)]))



def _x_block() -> list:
    return [(f"x{i}", F.col(x)) for i, x in enumerate(S.X)]


@query("combine_blocks", _rounded_sql({f"x{i}": x for i, x in enumerate(S.X)} | {f"square_{i}": f"{x} * {x}" for i, x in enumerate(S.X)}, places=2))
def combine_blocks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    _, squares = tabular.TABULAR_BLOCKS["tabular_square"](tabular.Table(li, list(S.X)))
    return rounded(select_block(li, KEYS, combine.combine(_x_block(), squares)), places=2)


_CALLABLES = {
    "identity": (combine.identity, "{x}"),
    "sigmoid_gate": (lambda: combine.sigmoid_gate(0.5), "1 / (1 + exp(-0.5 * {x}))"),
    "clipped_linear": (lambda: combine.clipped_linear(0.5), "least(greatest(0.5 + 0.5 * {x}, 0), 1)"),
    "tanh": (lambda: combine.source_callable("tanh", 0.1), "tanh(0.1 * {x})"),
}
for _name, (_make, _form) in _CALLABLES.items():
    query(f"activated_{_name}", _rounded_sql({f"{_name}_x{i}": _form.format(x=x) for i, x in enumerate(S.X)}))(
        lambda spark, sf_dir, make=_make: rounded(select_block(table(spark, sf_dir, "lineitem"), KEYS, combine.activated(make(), _x_block())))
    )


@query("projection_outputs", _rounded_sql({"global_projection": " + ".join(f"{x} * {w}" for x, w in zip(S.X, (0.2, 0.4, 0.6, 0.8), strict=True))}))
def projection_outputs(spark, sf_dir):
    return rounded(select_block(table(spark, sf_dir, "lineitem"), KEYS, combine.projection([0.2, 0.4, 0.6, 0.8], _x_block())))


@query("residual_rules", _rounded_sql({"huber": "CASE WHEN abs(r) <= 10 THEN 1 ELSE 10 / greatest(abs(r), 1e-6) END", "source_huber": "least(1, 10 / greatest(abs(r), 1e-8))", "soft_l1": "1 / sqrt(1 + (r / 10) * (r / 10))", "identity": "1.0"}, "(SELECT *, l_quantity - 25 AS r FROM lineitem)"))
def residual_rules(spark, sf_dir):
    r = F.col("l_quantity") - 25
    rules = {"huber": combine.huber_rule(10), "source_huber": combine.source_rule("huber", 10), "soft_l1": combine.source_rule("soft_l1", 10), "identity": combine.identity_rule()}
    return rounded(select_block(table(spark, sf_dir, "lineitem"), KEYS, [(n, f(r)) for n, f in rules.items()]))


@query(
    "weights_normalized",
    "WITH a AS (SELECT *, l_quantity / avg(l_quantity) OVER () AS w1, l_tax / avg(l_tax) OVER () AS w2 FROM lineitem) SELECT l_orderkey, l_linenumber, round(w1 + 3e-8, 6) + 0.0 AS w, round(w1 * w2 / avg(w1 * w2) OVER () + 3e-8, 6) + 0.0 AS both_w FROM a",
)
def weights_normalized(spark, sf_dir):
    li = combine.normalized_weight(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), "w")
    li = combine.combined_weight(li, [F.col("l_quantity"), F.col("l_tax"), None], "both_w")
    return rounded(li.select(*KEYS, "w", "both_w"))


# --- scoring ---------------------------------------------------------------------------

_ORD = "(SELECT *, o_totalprice AS y, 150000 + (o_custkey % 100) * 1000.0 AS p FROM orders)"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumns({"y": F.col("o_totalprice").cast("double"), "p": 150000 + (F.col("o_custkey") % 100) * 1000.0})


_BREAK = "count(*) AS n, round(-sqrt(avg((y - p) * (y - p))) + 3e-8, 4) + 0.0 AS score, round(sqrt(avg((y - p) * (y - p))) + 3e-8, 4) + 0.0 AS raw, round(avg(y - p) + 3e-8, 4) + 0.0 AS residual_mean, round(avg(abs(y - p)) + 3e-8, 4) + 0.0 AS abs_residual_mean"


@query("score_metrics", f"SELECT round(1 - avg((y - p) * (y - p)) / var_pop(y) + 3e-8, 6) + 0.0 AS variance_explained, round(sqrt(avg((y - p) * (y - p))) + 3e-8, 4) + 0.0 AS rmse, round(avg(abs(y - p)) + 3e-8, 4) + 0.0 AS mae, round(sqrt(avg((y - p) * (y - p))) / stddev_pop(y) + 3e-8, 6) + 0.0 AS nrmse FROM {_ORD}")
def score_metrics(spark, sf_dir):
    y, p = F.col("y"), F.col("p")
    return _orders(spark, sf_dir).agg(
        (F.round(scoring.variance_explained(y, p) + 3e-8, 6) + 0.0).alias("variance_explained"), (F.round(scoring.rmse(y, p) + 3e-8, 4) + 0.0).alias("rmse"), (F.round(scoring.mae(y, p) + 3e-8, 4) + 0.0).alias("mae"), (F.round(scoring.nrmse(y, p) + 3e-8, 6) + 0.0).alias("nrmse")
    )


@query("score_by_group", f"WITH o AS {_ORD}, f AS (SELECT DISTINCT o_custkey FROM o ORDER BY 1 LIMIT 20) SELECT o_custkey, {_BREAK} FROM o JOIN f USING (o_custkey) GROUP BY o_custkey")
def score_by_group(spark, sf_dir):
    return rounded(scoring.by_group(_orders(spark, sf_dir), "o_custkey", "y", "p"), places=4)


@query("score_by_regime", f"SELECT o_orderstatus, {_BREAK} FROM {_ORD} GROUP BY o_orderstatus")
def score_by_regime(spark, sf_dir):
    return rounded(scoring.by_group(_orders(spark, sf_dir), "o_orderstatus", "y", "p"), places=4)


_EDGES = "SELECT list_sort(list_distinct(quantile_cont({v}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM o"
_BIN = "len(list_filter(e[2 : len(e) - 1], lambda x: x <= {v}))::INT"


@query("score_by_target_bin", f"WITH o AS {_ORD}, q AS ({_EDGES.format(v='y')}), b AS (SELECT o.*, {_BIN.format(v='y')} AS bin FROM o, q) SELECT bin, {_BREAK}, round(min(y) + 3e-8, 4) + 0.0 AS low, round(max(y) + 3e-8, 4) + 0.0 AS high FROM b GROUP BY bin")
def score_by_target_bin(spark, sf_dir):
    return rounded(scoring.by_target_bin(_orders(spark, sf_dir), "y", "p"), places=4)


@query("score_by_time_bin", f"WITH o AS (SELECT *, epoch(o_orderdate)::DOUBLE AS t FROM {_ORD}), q AS ({_EDGES.format(v='t')}), b AS (SELECT o.*, {_BIN.format(v='t')} AS bin FROM o, q) SELECT bin, {_BREAK}, round(avg(p) + 3e-8, 4) + 0.0 AS prediction_mean, min(t) AS low, max(t) AS high FROM b GROUP BY bin")
def score_by_time_bin(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("t", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double"))
    return rounded(scoring.by_time_bin(o, "t", "y", "p"), places=4)


_corr = lambda x, y: f"CASE WHEN stddev_pop({x}) < 1e-12 OR stddev_pop({y}) < 1e-12 THEN 0 ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


@query("corr_alignment", " UNION ALL ".join(f"SELECT '{x}' AS feature, round({_corr(x, 'l_extendedprice')} + 3e-8, 6) + 0.0 AS corr, round({_corr(f'({x} * {x})', 'l_extendedprice')} + 3e-8, 6) + 0.0 AS squared FROM lineitem" for x in ("l_quantity", "l_discount", "l_tax")))
def corr_alignment(spark, sf_dir):
    li, xs = table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"]
    plain = scoring.alignment(li, xs, "l_extendedprice")
    square = scoring.alignment(li, xs, "l_extendedprice", squared=True).withColumnRenamed("corr", "squared")
    return rounded(plain.join(square, "feature"))


# --- windows, ranks, folds ---------------------------------------------------------------


@query(
    "win_running",
    "SELECT user_id, event_id, round(sum(value) OVER w + 3e-8, 4) + 0.0 AS running_sum, max(value) OVER w AS running_max, min(value) OVER w AS running_min, round(avg(value) OVER w + 3e-8, 4) + 0.0 AS running_mean, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 3e-8, 4) + 0.0 AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
)
def win_running(spark, sf_dir):
    done = ordered.running(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return rounded(done.select("user_id", "event_id", "running_sum", "running_max", "running_min", "running_mean", "step"), places=4)


@query("rank_mid", "SELECT o_orderkey, round((rank() OVER (ORDER BY o_totalprice) - 1 + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0) / (count(*) OVER () - 1) + 3e-8, 9) + 0.0 AS mid_rank FROM orders")
def rank_mid(spark, sf_dir):
    done = ordered.mid_ranks(table(spark, sf_dir, "orders"), "o_totalprice")
    return rounded(done.select("o_orderkey", "mid_rank"), places=9)


@query("fold_time_blocked", "SELECT o_orderkey, (ntile(5) OVER (ORDER BY o_orderdate, o_orderkey) - 1)::INT AS fold FROM orders")
def fold_time_blocked(spark, sf_dir):
    return ordered.time_folds(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 5).select("o_orderkey", "fold")


@query("fold_group", "WITH g AS (SELECT o_custkey, (ntile(5) OVER (ORDER BY o_custkey) - 1)::INT AS fold FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, o_custkey, fold FROM orders JOIN g USING (o_custkey)")
def fold_group(spark, sf_dir):
    return ordered.group_folds(table(spark, sf_dir, "orders"), "o_custkey", 5, seed=None).select("o_orderkey", "o_custkey", "fold")


@query("fold_leave_group_out", "SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS fold FROM orders")
def fold_leave_group_out(spark, sf_dir):
    return ordered.leave_group_out(table(spark, sf_dir, "orders"), "o_orderpriority").select("o_orderkey", "o_orderpriority", "fold")


@query("fold_stratified", "SELECT o_orderkey, o_orderstatus, (ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1)::INT AS fold FROM orders")
def fold_stratified(spark, sf_dir):
    return ordered.stratified_folds(table(spark, sf_dir, "orders"), "o_orderstatus", ["o_orderkey"], 4, seed=None).select("o_orderkey", "o_orderstatus", "fold")


@query("fold_random", "SELECT o_orderkey, (ntile(5) OVER (ORDER BY md5('7|' || o_orderkey), o_orderkey) - 1)::INT AS fold FROM orders")
def fold_random(spark, sf_dir):
    return ordered.random_folds(table(spark, sf_dir, "orders"), "o_orderkey", 5, seed=7).select("o_orderkey", "fold")


_SPLIT = "CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + nv THEN 'validation' ELSE 'train' END AS split"


@query("split_three_way", f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS nt, greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS nv FROM orders) SELECT o_orderkey, {_SPLIT} FROM r")
def split_three_way(spark, sf_dir):
    return ordered.three_way_split(table(spark, sf_dir, "orders"), "o_orderkey", seed=None).select("o_orderkey", "split")


@query("split_grouped", f"WITH r AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS rn, greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS nt, greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS nv FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, o_custkey, {_SPLIT} FROM orders JOIN r USING (o_custkey)")
def split_grouped(spark, sf_dir):
    return ordered.grouped_split(table(spark, sf_dir, "orders"), "o_custkey", seed=None).select("o_orderkey", "o_custkey", "split")


@query("split_check", "SELECT count(*) AS rows, 3::BIGINT AS parts, 0::BIGINT AS repeated, 0::BIGINT AS missing, 0::BIGINT AS unknown FROM orders")
def split_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return ordered.check_split(ordered.three_way_split(o, "o_orderkey", seed=3), o, "o_orderkey")


@query("split_fingerprint", "SELECT count(*) AS rows, sha256(sum(('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_totalprice)), 1, 15))::HUGEINT)::VARCHAR) AS digest FROM orders")
def split_fingerprint(spark, sf_dir):
    return ordered.fingerprint(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


_EDGES4 = "list_sort(list_distinct((SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) FROM orders)))"


@query("fold_quantile_labels", f"WITH b AS (SELECT o_orderkey, len(list_filter({_EDGES4}, lambda e: o_totalprice >= e))::INT AS stratum FROM orders) SELECT o_orderkey, (ntile(4) OVER (PARTITION BY stratum ORDER BY o_orderkey) - 1)::INT AS fold FROM b")
def fold_quantile_labels(spark, sf_dir):
    from .plans.folds import stratified

    return stratified(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", 4, seed=None).select("o_orderkey", "fold")


@query(
    "fold_dispatch",
    "WITH g AS (SELECT o_custkey, ntile(5) OVER (ORDER BY o_custkey) - 1 AS fold FROM (SELECT DISTINCT o_custkey FROM orders)), c AS (SELECT list(n ORDER BY fold) AS counts, count(*) AS k, sum(n) AS n FROM (SELECT fold, count(*) AS n FROM g GROUP BY fold)) "
    "SELECT 'group_random' AS method, n::BIGINT AS n_groups, k::BIGINT AS actual_folds, array_to_string(counts, ',') AS counts, 0::BIGINT AS overlap, '' AS reason FROM c UNION ALL SELECT 'random', 0, 5, '', 0, 'group key was not supplied' UNION ALL SELECT 'time_blocked', 0, 5, array_to_string((SELECT list(n ORDER BY fold) FROM (SELECT fold, count(*) AS n FROM (SELECT ntile(5) OVER (ORDER BY o_orderdate, o_orderkey) AS fold FROM orders) GROUP BY fold)), ','), 0, ''",
)
def fold_dispatch(spark, sf_dir):
    """What the strategies report: by groups, by groups without their column, by time."""
    from .plans.folds import FoldStrategy

    o, rows = table(spark, sf_dir, "orders"), []
    for s in (FoldStrategy("group_random", "o_custkey"), FoldStrategy("group_random", "absent"), FoldStrategy("time_blocked", time_key="o_orderdate")):
        folded, about = s.split(o, "o_orderkey", "o_totalprice", 5, None)
        counts = about.get("validation_group_counts") or about.get("validation_block_sizes") or []
        rows.append((about["method"], about.get("n_groups", 0), about.get("actual_folds", folded.select("fold").distinct().count()), ",".join(map(str, counts)), about.get("fold_group_overlap_count", 0), about.get("reason", "")))
    return spark.createDataFrame(rows, "method string, n_groups long, actual_folds long, counts string, overlap long, reason string")


@query("topk_orders", "SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))::INT AS rank FROM orders) WHERE rank <= 3")
def topk_orders(spark, sf_dir):
    done = ordered.top_k(table(spark, sf_dir, "orders"), 3, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])
    return done.select("o_custkey", "o_orderkey", "o_totalprice", "rank")


_TRACE = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value FROM events"


@query("hist_learning_curve_area", f"WITH e AS ({_TRACE}), b AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS best, lead(t, 1, 100) OVER (PARTITION BY user_id ORDER BY t) - t AS w FROM e) SELECT user_id, round(sum(best * w) / 100 + 3e-8, 6) + 0.0 AS area FROM b GROUP BY user_id")
def hist_learning_curve_area(spark, sf_dir):
    from pyspark.sql.window import Window

    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, sf_dir, "events").select("user_id", t.alias("t"), "value")
    return rounded(ordered.learning_curve_area(e, ["user_id"], "t", "value", 100))


# --- joins, sets, aggregates ---------------------------------------------------------------

from .operators import relational as R  # noqa: E402
from .plans import linalg  # noqa: E402

_BIG = "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 12"


def _big_customers(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 12")


@query("semi_groups", f"SELECT o_orderkey FROM orders WHERE o_custkey IN ({_BIG})")
def semi_groups(spark, sf_dir):
    return R.in_groups(table(spark, sf_dir, "orders"), _big_customers(spark, sf_dir), "o_custkey").select("o_orderkey")


@query("anti_groups", f"SELECT o_orderkey FROM orders WHERE o_custkey NOT IN ({_BIG})")
def anti_groups(spark, sf_dir):
    return R.in_groups(table(spark, sf_dir, "orders"), _big_customers(spark, sf_dir), "o_custkey", inside=False).select("o_orderkey")


@query("set_overlap", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_overlap(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return R.overlap(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey")


@query("set_uncovered", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_uncovered(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.uncovered(table(spark, sf_dir, "customer"), o.where("c_custkey % 2 = 0"), o.where("c_custkey % 2 <> 0"), key="c_custkey")


@query("subset_split", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS n FROM orders) WHERE rn <= n")
def subset_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return R.subset(o, ordered.three_way_split(o, "o_orderkey", seed=None), "o_orderkey", "test").select("o_orderkey")


@query("bin_lookup", "SELECT (CASE WHEN l_quantity >= 10 THEN 1 ELSE 0 END + CASE WHEN l_quantity >= 20 THEN 1 ELSE 0 END + CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END)::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def bin_lookup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(R.bin_of(F.col("l_quantity"), [10, 20, 40]).alias("bin")).agg(F.count("*").alias("n"))


@query("longest_prefix", "SELECT o_orderkey, CASE WHEN starts_with(o_orderpriority, '1-U') THEN '1-U' WHEN starts_with(o_orderpriority, '1') THEN '1' WHEN starts_with(o_orderpriority, '2-') THEN '2-' END AS prefix FROM orders")
def longest_prefix(spark, sf_dir):
    return R.longest_prefix(table(spark, sf_dir, "orders"), "o_orderpriority", ["1", "1-U", "2-"]).select("o_orderkey", "prefix")


@query("pair_products", _rounded_sql({f"{a}_x_{b}": f"{a} * {b}" for i, a in enumerate(S.X) for b in S.X[i + 1 :]}, places=4))
def pair_products(spark, sf_dir):
    return rounded(R.pair_products(table(spark, sf_dir, "lineitem"), KEYS, list(S.X)), places=4)


@query("standardizer", _rounded_sql({f"z_{x}": f"({x} - avg({x}) OVER ()) / CASE WHEN stddev_pop({x}) OVER () < 1e-8 THEN 1 ELSE stddev_pop({x}) OVER () END" for x in S.X}))
def standardizer(spark, sf_dir):
    return rounded(R.standardized(table(spark, sf_dir, "lineitem"), KEYS, list(S.X)))


@query("profile_columns", " UNION ALL ".join(f"SELECT '{x}' AS \"column\", count(*) AS n, 1.0::DOUBLE + 0.0 AS finite, round(avg({x}) + 3e-8, 4) + 0.0 AS mean, round(stddev_pop({x}) + 3e-8, 4) + 0.0 AS std, round(min({x}) + 3e-8, 4) + 0.0 AS min, round(max({x}) + 3e-8, 4) + 0.0 AS max FROM lineitem" for x in S.X))
def profile_columns(spark, sf_dir):
    return rounded(R.profile(table(spark, sf_dir, "lineitem"), list(S.X)), places=4)


_HIST_ROWS = "SELECT event_type AS name, event_id AS step, value AS importance, value / 1000 AS alignment, value - 200 AS score, event_id % 3 = 0 AS selected FROM events"


@query(
    "hist_alternatives",
    f"WITH h AS ({_HIST_ROWS}) SELECT name, count(*)::BIGINT AS participation_count, count(*) FILTER (WHERE selected)::BIGINT AS selected_count, max_by(importance, step) AS last_importance, max(step) AS last_step, round(avg(importance) + 3e-8, 6) + 0.0 AS mean_importance, round(greatest(max(alignment), 0) + 3e-8, 6) + 0.0 AS max_target_alignment, round(greatest(max(score), 0) + 3e-8, 6) + 0.0 AS best_config_score FROM h GROUP BY name",
)
def hist_alternatives(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("name"), F.col("event_id").alias("step"), F.col("value").alias("importance"), (F.col("value") / 1000).alias("alignment"), (F.col("value") - 200).alias("score"), (F.col("event_id") % 3 == 0).alias("selected"))
    first = R.history(None, rows.where("step % 2 = 0"))
    done = R.history(first, rows.where("step % 2 = 1"))
    return rounded(done.drop("sum_importance"), "last_importance")


@query("dep_rollup", "WITH d AS (SELECT unnest([l_returnflag, l_linestatus]) AS dep, l_quantity FROM lineitem) SELECT dep, count(*) AS n, round(sum(l_quantity) + 3e-8, 4) + 0.0 AS total, round(avg(l_quantity) + 3e-8, 4) + 0.0 AS mean, round(max(l_quantity) + 3e-8, 4) + 0.0 AS most FROM d GROUP BY dep")
def dep_rollup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("deps", F.array("l_returnflag", "l_linestatus"))
    return rounded(R.rollup(li, "deps", "l_quantity"), places=4)


_FEATURES = (
    "SELECT p_partkey, 'output.' || p_brand || '.f' || p_partkey AS name, ['output.' || p_brand, 'base.' || p_type] AS dependencies, p_size / 50.0 AS importance, p_retailprice / 2000 AS shap_importance, (p_size - 10) / 50.0 AS target_alignment,"
    " p_retailprice / 1000 AS shap_mean_abs, (p_size - 25) / 25.0 AS residual_corr, p_size / 49.0 AS redundancy, p_size / 20.0 AS weight_stability FROM part"
)
_ROLL = (
    "name, feature_count, round(importance + 3e-8, 4) + 0.0 AS importance, round(shap_importance + 3e-8, 4) + 0.0 AS shap_importance, round(max_target_alignment + 3e-8, 4) + 0.0 AS max_target_alignment, round(mean_abs_shap + 3e-8, 4) + 0.0 AS mean_abs_shap,"
    " round(mean_abs_residual_corr + 3e-8, 4) + 0.0 AS mean_abs_residual_corr, round(mean_redundancy + 3e-8, 4) + 0.0 AS mean_redundancy, round(mean_weight_stability + 3e-8, 4) + 0.0 AS mean_weight_stability"
)
_SUBNODES = (
    f"SELECT name, count(*) AS feature_count, sum(importance) AS importance, sum(shap_importance) AS shap_importance, greatest(max(target_alignment), 0) AS max_target_alignment, avg(shap_mean_abs) AS mean_abs_shap, avg(abs(residual_corr)) AS mean_abs_residual_corr,"
    f" avg(redundancy) AS mean_redundancy, avg(weight_stability) AS mean_weight_stability FROM (SELECT * EXCLUDE (name), unnest(dependencies) AS name FROM ({_FEATURES})) GROUP BY name"
)


def _features(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    output = F.concat(F.lit("output."), "p_brand")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(output, F.lit(".f"), "p_partkey").alias("name"), F.array(output, F.concat(F.lit("base."), "p_type")).alias("dependencies"), (size / 50.0).alias("importance"), (price / 2000).alias("shap_importance"), ((size - 10) / 50.0).alias("target_alignment"),
        (price / 1000).alias("shap_mean_abs"), ((size - 25) / 25.0).alias("residual_corr"), (size / 49.0).alias("redundancy"), (size / 20.0).alias("weight_stability"),
    )


@query("subnode_rollup", f"SELECT {_ROLL} FROM ({_SUBNODES})")
def subnode_rollup(spark, sf_dir):
    return rounded(R.subnodes(_features(spark, sf_dir)), places=4)


@query(
    "alternative_rollup",
    f"WITH s AS ({_SUBNODES}), c AS (SELECT DISTINCT 'output.' || o_orderpriority AS name FROM orders UNION SELECT min(name) FROM s) SELECT {_ROLL.replace('name,', 'coalesce(s.name, c.name) AS name,', 1).replace('feature_count,', 'coalesce(feature_count, 0) AS feature_count,', 1).replace('round(', 'round(coalesce(').replace(' + 3e-8', ', 0) + 3e-8')}, split_part(coalesce(s.name, c.name), '.', 1) AS node, split_part(coalesce(s.name, c.name), '.', 2) AS alternative, c.name IS NOT NULL AS selected FROM s FULL JOIN c ON s.name = c.name",
)
def alternative_rollup(spark, sf_dir):
    features = _features(spark, sf_dir)
    least = R.subnodes(features).agg(F.min("name").alias("name"))
    chosen = table(spark, sf_dir, "orders").select(F.concat(F.lit("output."), "o_orderpriority").alias("name")).union(least)
    return rounded(R.alternatives(features, chosen), places=4)


@query("config_search_summary", "SELECT o_orderpriority, count(*) AS evaluated, min(o_totalprice) AS least, max(o_totalprice) AS best_config_score, round(avg(o_totalprice) + 3e-8, 4) + 0.0 AS score_mean, round(stddev_pop(o_totalprice) + 3e-8, 4) + 0.0 AS score_std, sum(o_custkey % 7)::BIGINT AS n_features_global, arg_max(o_custkey % 7, (o_totalprice, -o_orderkey)) AS n_features_best_config FROM orders GROUP BY o_orderpriority")
def config_search_summary(spark, sf_dir):
    configs = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderkey").alias("planner_index"), F.col("o_totalprice").alias("score"), (F.col("o_custkey") % 7).alias("n_features"))
    return rounded(R.search_summary(configs, ["o_orderpriority"]), "least", "best_config_score", places=4)


@query("config_search_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8")
def config_search_top(spark, sf_dir):
    return R.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 8, [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("feedback_risky", f"SELECT name, round(redundancy + 3e-8, 6) + 0.0 AS redundancy, round(weight_stability + 3e-8, 6) + 0.0 AS weight_stability FROM ({_FEATURES}) WHERE redundancy > 0.98 OR weight_stability < 0.25")
def feedback_risky(spark, sf_dir):
    return rounded(R.risky(_features(spark, sf_dir)).select("name", "redundancy", "weight_stability"))


@query("history_tail", "SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 40")
def history_tail(spark, sf_dir):
    return R.last_rows(table(spark, sf_dir, "events"), 40, [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "value")


@query("smoke_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 24")
def smoke_rows(spark, sf_dir):
    return R.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 24, [F.col("o_orderkey")])


@query("archive_best", "SELECT user_id, arg_min(event_id, (value, event_id)) AS event_id, min(value) AS value FROM events GROUP BY user_id")
def archive_best(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return R.best_row(e, ["user_id"], [F.col("value"), F.col("event_id")])


@query("migration_steps", "SELECT event_id, user_id FROM events WHERE event_id > 0 AND event_id % 25 = 0")
def migration_steps(spark, sf_dir):
    return R.every(table(spark, sf_dir, "events"), "event_id", 25).select("event_id", "user_id")


@query("research_medians", "SELECT event_type, round(median(value) FILTER (WHERE event_id % 10 <> 0) + 3e-8, 6) + 0.0 AS median, min(value) FILTER (WHERE event_id % 10 <> 0) AS least, max(value) FILTER (WHERE event_id % 10 <> 0) AS most, round(avg((event_id % 10 = 0)::INT) + 3e-8, 6) + 0.0 AS failure_rate FROM events GROUP BY event_type")
def research_medians(spark, sf_dir):
    return rounded(R.spread_of(table(spark, sf_dir, "events"), ["event_type"], "value", F.col("event_id") % 10 == 0), "least", "most")


def _report_sql() -> str:
    part = lambda name, role, key, source: f"SELECT '{name}' AS part, '{role}' AS role, {key} AS key, {_BREAK} FROM {source}"
    binned = lambda v: f"(SELECT o.*, {_BIN.format(v=v)} AS bin FROM o, (SELECT list_sort(list_distinct(quantile_cont({v}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM o))"
    return f"WITH o AS (SELECT *, epoch(o_orderdate)::DOUBLE AS t FROM {_ORD}) " + " UNION ALL ".join(
        [
            part("overall", "", "''", "o"),
            part("target_bin", "y", "bin::VARCHAR", binned("y")) + " GROUP BY bin",
            part("group", "o_orderstatus", "o_orderstatus", "o") + " GROUP BY o_orderstatus",
            part("time_bin", "t", "bin::VARCHAR", binned("t")) + " GROUP BY bin",
            part("role", "regime", "o_orderpriority", "o") + " GROUP BY o_orderpriority",
        ]
    )


@query("objective_report", _report_sql())
def objective_report(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("t", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double"))
    return rounded(scoring.objective(o, "y", "p", group="o_orderstatus", time="t", roles={"regime": "o_orderpriority", "event": "o_orderstatus"}), places=4)


# --- readouts ----------------------------------------------------------------------------


def _ridge_row(spark, model, names):
    return rounded(spark.createDataFrame([(n, float(b)) for n, b in zip([*names, "(intercept)"], [*model.coef, model.intercept], strict=True)], "feature string, coef double"), places=4)


@query(
    "ridge_one_feature",
    "WITH s AS (SELECT avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_extendedprice) AS c, count(*) AS n FROM lineitem), b AS (SELECT *, (n * c / sx) / (n + 100.0) / sx AS b FROM s) SELECT 'l_quantity' AS feature, round(b + 3e-8, 4) + 0.0 AS coef FROM b UNION ALL SELECT '(intercept)', round(my - mx * b + 3e-8, 4) + 0.0 FROM b",
)
def ridge_one_feature(spark, sf_dir):
    return _ridge_row(spark, linalg.ridge(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", alpha=100.0), ["l_quantity"])


@query(
    "ridge_two_features",
    """WITH s AS (SELECT avg(l_quantity) m1, avg(l_tax) m2, stddev_pop(l_quantity) s1, stddev_pop(l_tax) s2, avg(l_extendedprice) my, covar_pop(l_quantity, l_tax) c12, covar_pop(l_quantity, l_extendedprice) c1, covar_pop(l_tax, l_extendedprice) c2, count(*)::DOUBLE n FROM lineitem),
g AS (SELECT *, n + 1000.0 AS a, n * c12 / s1 / s2 AS o, n * c1 / s1 AS r1, n * c2 / s2 AS r2 FROM s),
b AS (SELECT *, (a * r1 - o * r2) / (a * a - o * o) / s1 AS b1, (a * r2 - o * r1) / (a * a - o * o) / s2 AS b2 FROM g)
SELECT 'l_quantity' AS feature, round(b1 + 3e-8, 4) + 0.0 AS coef FROM b UNION ALL SELECT 'l_tax', round(b2 + 3e-8, 4) + 0.0 FROM b UNION ALL SELECT '(intercept)', round(my - m1 * b1 - m2 * b2 + 3e-8, 4) + 0.0 FROM b""",
)
def ridge_two_features(spark, sf_dir):
    return _ridge_row(spark, linalg.ridge(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice", alpha=1000.0), ["l_quantity", "l_tax"])


def _loo_sql(xs: tuple[str, str, str], y: str, w: str, source: str = "lineitem") -> str:
    """Leave-one-out errors of three features for each penalty, with the inverse of the 3 x 3 matrix written out."""
    grid = ", ".join(f"({i}, {a!r}::DOUBLE)" for i, a in enumerate(map(float, linalg.ALPHAS)))
    one = ", ".join(f"avg({x}) AS m{i}, stddev_pop({x}) AS s{i}" for i, x in enumerate(xs))
    z = ", ".join(f"({x} - m{i}) / s{i} AS z{i}" for i, x in enumerate(xs))
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    centred = ", ".join(f"z{i} - sum(u * z{i}) OVER () / sum(u) OVER () AS c{i}, sum(u * z{i}) OVER () / sum(u) OVER () AS k{i}" for i in range(3))
    gram = ", ".join([*(f"sum(u * c{i} * c{j}) AS g{i}{j}" for i, j in pairs), *(f"sum(u * c{i} * (y - ym)) AS r{i}" for i in range(3)), *(f"any_value(k{i}) AS k{i}" for i in range(3)), "any_value(ym) AS ym"])
    a = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    cofactor = lambda i, j: f"({a((i + 1) % 3, (j + 1) % 3)} * {a((i + 2) % 3, (j + 2) % 3)} - {a((i + 1) % 3, (j + 2) % 3)} * {a((i + 2) % 3, (j + 1) % 3)})"
    inverse = ", ".join(f"{cofactor(j, i)} / (a00 * {cofactor(0, 0)} + a01 * {cofactor(0, 1)} + a02 * {cofactor(0, 2)}) AS v{i}{j}" for i in range(3) for j in range(3))
    beta = ", ".join("+".join(f"v{i}{j} * r{j}" for j in range(3)) + f" AS b{i}" for i in range(3))
    lever = " + ".join(f"c{i} * c{j} * v{i}{j}" for i in range(3) for j in range(3))
    rows = [f"SELECT '{x}' AS feature, round(b{i} / s{i} + 3e-8, 4) + 0.0 AS coef, alpha FROM best, one" for i, x in enumerate(xs)]
    intercept = " - ".join(["ym", *(f"(m{i} + k{i} * s{i}) * b{i} / s{i}" for i in range(3))])
    return f"""
WITH one AS (SELECT {one}, avg({w}) AS mw FROM {source}),
t AS (SELECT {z}, {y} AS y, {w} / mw AS u FROM {source}, one),
c AS (SELECT *, sum(u * y) OVER () / sum(u) OVER () AS ym, {centred} FROM t),
g AS (SELECT {gram} FROM c),
alphas(place, alpha) AS (VALUES {grid}),
m AS (SELECT *, {", ".join(f"g{i}{j} + {'alpha' if i == j else '0'} AS a{i}{j}" for i, j in pairs)} FROM g, alphas),
v AS (SELECT *, {inverse} FROM m),
b AS (SELECT *, {beta} FROM v),
loss AS (
  SELECT place, sum(u * pow((y - b.ym - c0 * b0 - c1 * b1 - c2 * b2) / greatest(1 - u * ({lever}), 1e-8), 2)) AS loss
  FROM c, b GROUP BY place),
best AS (SELECT b.* FROM b JOIN loss USING (place) ORDER BY loss, place LIMIT 1)
{" UNION ALL ".join(rows)} UNION ALL SELECT '(intercept)', round({intercept} + 3e-8, 4) + 0.0, alpha FROM best, one
"""


@query("ridge_loo", _loo_sql(("l_quantity", "l_discount", "l_tax"), "l_extendedprice", "l_quantity"))
def ridge_loo(spark, sf_dir):
    """The penalty of the least leave-one-out error, with weights."""
    li = table(spark, sf_dir, "lineitem")
    model = linalg.ridge(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", weight="l_quantity")
    return _ridge_row(spark, model, ["l_quantity", "l_discount", "l_tax"]).crossJoin(spark.createDataFrame([(float(model.alpha),)], "alpha double"))


@query("evaluate_structural_seed")
def evaluate_structural_seed(spark, sf_dir):
    from .plans.evaluate import evaluate, result_table
    from .plans.graph import structural_seed

    df = embedding_series(spark, sf_dir).select("series", F.col("label").cast("double").alias("y"), (F.col("vec_id") % 3).cast("int").alias("fold"))
    return result_table(spark, evaluate(structural_seed(), df, {"series": "series"}, "y", "fold", boundary=32, length=64))


@query("evaluate_tabular_seed")
def evaluate_tabular_seed(spark, sf_dir):
    from .plans.evaluate import evaluate, result_table
    from .plans.graph import tabular_seed

    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("y"), F.pmod(F.xxhash64("l_orderkey"), F.lit(3)).cast("int").alias("fold"))
    return result_table(spark, evaluate(tabular_seed(), li, {"x": ["l_quantity", "l_discount", "l_tax"]}, "y", "fold"))


def _frozen(spark, sf_dir):
    """A readout of two columns, fitted on orders with even keys."""
    from .plans.frozen import fit_frozen
    from .plans.graph import Alternative, Graph

    g = Graph("raw")
    g.add("x", "input")
    g.add("base", "intermediate", Alternative("raw", "tabular_raw", ("x",)))
    g.add("output", "output", Alternative("raw", "pass_outputs", ("base",)))
    li = table(spark, sf_dir, "lineitem")
    return li, fit_frozen(g, {}, li.where("l_orderkey % 2 = 0"), {"x": ["l_quantity"]}, "l_extendedprice")


_FROZEN_FIT = """
WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_orderkey % 2 = 0),
one AS (SELECT avg(x) AS m, stddev_pop(x) AS s, avg(y) AS ym, count(*) AS n, covar_pop(x, y) AS c FROM t),
alphas(place, alpha) AS (VALUES {grid}),
b AS (SELECT place, alpha, m, s, ym, n, n * c / s / (n + alpha) AS b FROM one, alphas),
loss AS (SELECT place, sum(pow((y - ym - (x - m) / s * b) / greatest(1 - pow((x - m) / s, 2) / (n + alpha), 1e-8), 2)) AS loss FROM t, b GROUP BY place),
f AS (SELECT m, s, ym, b FROM b JOIN loss USING (place) ORDER BY loss, place LIMIT 1)
"""
_FROZEN_FIT = _FROZEN_FIT.replace("{grid}", ", ".join(f"({i}, {a!r}::DOUBLE)" for i, a in enumerate(map(float, linalg.ALPHAS))))


@query("frozen_predict", _FROZEN_FIT + "SELECT l_orderkey, l_linenumber, round(ym + (l_quantity - m) / s * b + 3e-8, 4) + 0.0 AS prediction FROM lineitem, f WHERE l_orderkey % 2 = 1")
def frozen_predict(spark, sf_dir):
    li, model = _frozen(spark, sf_dir)
    return rounded(model.predict(li.where("l_orderkey % 2 = 1"), {"x": ["l_quantity"]}).select(*KEYS, "prediction"), places=4)


@query("linear_contributions", _FROZEN_FIT + ", c AS (SELECT (l_quantity - m) / s * b AS v FROM lineitem, f WHERE l_orderkey % 2 = 1) SELECT 'output.raw.raw_0' AS feature, round(avg(v) + 3e-8, 4) + 0.0 AS mean, round(avg(abs(v)) + 3e-8, 4) + 0.0 AS mean_abs, round(stddev_pop(v) + 3e-8, 4) + 0.0 AS std FROM c")
def linear_contributions(spark, sf_dir):
    from .plans.frozen import contribution_summary

    li, model = _frozen(spark, sf_dir)
    done = model.contributions(li.where("l_orderkey % 2 = 1"), {"x": ["l_quantity"]})
    return rounded(contribution_summary(done, list(model.features)), places=4)
