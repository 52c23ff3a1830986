"""Registered queries against their SQL, over the smallest tables."""

import os

import duckdb
import pytest

from braid import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return round(float(v), 9) + 0.0 if isinstance(v, float) else v


#: One or two of each family; every query is run by the driver over larger tables.
SOME = [
    "seg_basic_events", "seg_robust_emb", "trend_late_window_emb", "cusum_basic_emb", "shape_post_concentration_events", "spectral_basic_emb", "structural_break_baseline_emb",
    "row_multiscale_tail_emb", "row_baseline_events", "ctx_time_basis", "tab_centered", "tab_low_rank_interactions", "tab_quantile_summary", "tab_interaction_outputs", "weight_row_norm",
    "weights_normalized", "residual_rules", "activated_sigmoid_gate", "projection_outputs", "score_metrics", "score_by_group", "score_by_target_bin", "score_by_time_bin", "corr_alignment", "win_running", "rank_mid",
    "fold_time_blocked", "fold_group", "fold_stratified", "split_three_way", "split_check", "topk_orders", "hist_learning_curve_area", "hist_alternatives", "set_uncovered", "standardizer", "ridge_one_feature", "ridge_two_features",
]


@pytest.mark.parametrize("name", SOME)
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted((tuple(plain(row[i]) for i in places) for row in result.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["row_cusum_local_events", "row_baseline_events"])
def test_series_that_come_back_to_their_peak(spark, tmp_path, name):
    """A repeated series reaches its largest running sum once a period; the place told is that of the SQL."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id + 100000 * k AS event_id, ts + to_days(30 * k::INT) AS ts, user_id, event_type, value, props FROM '{SF}/events.parquet', range(4) t(k)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = catalogue.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()[name]}) ORDER BY user_id").fetchall()
    got = [tuple(r) for r in df.orderBy("user_id").collect()]
    assert [tuple(map(plain, r)) for r in got] == [tuple(map(plain, r)) for r in want]


@pytest.mark.parametrize("name", ["row_baseline_events", "row_local_events", "trend_basic_events"])
def test_series_of_few_values(spark, tmp_path, name):
    """Users with one to six events: a mean of no value and a slope of one value are missing, as in the SQL."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM '{SF}/events.parquet') WHERE r <= 1 + user_id % 6) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = catalogue.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()[name]}) ORDER BY user_id").fetchall()
    got = [tuple(r) for r in df.orderBy("user_id").collect()]
    assert [tuple(map(plain, r)) for r in got] == [tuple(map(plain, r)) for r in want]


def test_every_query_with_sql_is_registered():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert len(catalogue.queries()) > 90


@pytest.mark.parametrize(("name", "n"), [("evaluate_structural_seed", 48), ("evaluate_tabular_seed", 36)])
def test_evaluations_plan_the_whole_space(spark, name, n):
    rows = catalogue.queries()[name](spark, SF).collect()
    assert len(rows) == n and all(r.approximate_score is not None for r in rows)
    assert sum(r.score is not None for r in rows) == 16 and sum(r.selected for r in rows) == 1
