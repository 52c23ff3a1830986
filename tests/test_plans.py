"""Graphs, planning, readouts, evaluation, sources and streams, against NumPy and plain Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from braid.operators import ordered, scoring
from braid.operators.series import series_features
from braid.plans import graph as G
from braid.plans import linalg, maintain, planner, rank
from braid.plans.evaluate import evaluate, result_table
from braid.sources import readers
from braid.streaming import lookback


def test_seeds_have_the_known_spaces():
    for g, n in ((G.tabular_seed(), 36), (G.structural_seed(), 48)):
        configs, whole = planner.plan(g, 64)
        assert whole == n == len(configs) == len({tuple(sorted(c.items())) for c in configs})


def test_planner_covers_under_a_budget():
    g = G.structural_seed()
    configs, whole = planner.plan(g, 6)
    assert len(configs) == 6 and whole == 48 and configs[0] == g.default_config()
    assert all(n > 0 for axis in planner.coverage(g, configs).values() for n in axis.values())
    assert planner.plan(g, 6) == (configs, whole)


def test_finalists_keep_the_default():
    g = G.structural_seed()
    configs, _ = planner.plan(g, 12)
    scores = [float(i) for i in range(len(configs))]
    assert configs.index(g.default_config()) in planner.finalists(g, configs, scores, 4)


def test_graph_documents_round_trip(tmp_path):
    g = G.tabular_seed()
    G.write_graph(g, str(tmp_path / "g.json"), note="x")
    assert G.graph_hash(G.read_graph(str(tmp_path / "g.json"))) == G.graph_hash(g)
    d = json.loads((tmp_path / "g.json").read_text())
    d["graph"]["name"] = "other"
    (tmp_path / "g.json").write_text(json.dumps(d))
    with pytest.raises(ValueError):
        G.read_graph(str(tmp_path / "g.json"))


def test_graphs_reject_cycles_and_unknown_parents():
    g = G.tabular_seed()
    g.nodes["base_features"].alternatives.append(G.Alternative("loop", "combine_blocks", ("output",)))
    with pytest.raises(ValueError, match="cycle"):
        g.validate()
    h = G.tabular_seed()
    h.nodes["base_features"].alternatives.append(G.Alternative("odd", "combine_blocks", ("nowhere",)))
    with pytest.raises(ValueError, match="unknown parent"):
        h.validate()


def test_changes_clean_and_leave_the_graph_alone():
    g = G.tabular_seed()
    before = G.graph_hash(g)
    out = maintain.change(g, {"add": [{"node": "nonlinear_features", "id": "sine", "primitive": "tabular_sine", "parents": ["x"]}, {"node": "nonlinear_features", "id": "abs2", "primitive": "tabular_abs", "parents": ["x"]}], "globals": {"unused": [1.0]}})
    ids = [a.id for a in out.nodes["nonlinear_features"].alternatives]
    assert ids == ["abs", "square", "interactions", "sine"] and "unused" not in out.globals
    assert G.graph_hash(g) == before
    with pytest.raises(ValueError):
        maintain.change(g, {"remove": [{"node": "summary_features", "id": "summary"}]})


def test_transfer_counts_reasons():
    source = maintain.change(G.tabular_seed(), {"add": [{"node": "nonlinear_features", "id": "sine", "primitive": "tabular_sine", "parents": ["x"]}]})
    out, why = maintain.transfer(source, G.tabular_seed())
    assert why["copied"] == 1 and why["known already"] > 5
    assert "sine" in [a.id for a in out.nodes["nonlinear_features"].alternatives]


def test_search_accepts_equal_scores_and_salvages():
    g = G.tabular_seed()
    good = {"node": "nonlinear_features", "id": "sine", "primitive": "tabular_sine", "parents": ["x"]}
    bad = {"node": "nonlinear_features", "id": "worse", "primitive": "tabular_tanh", "parents": ["x"]}
    score = lambda h: -sum(a.id == "worse" for a in h.nodes["nonlinear_features"].alternatives)
    out, best, log = maintain.search(g, score, [{"add": [good, bad]}, {"add": [{"node": "none", "id": "q", "primitive": "p"}]}], 5)
    assert best == 0 and log[0]["accepted"] and log[0]["salvaged"] and not log[1]["accepted"] and "error" in log[1]
    assert "sine" in [a.id for a in out.nodes["nonlinear_features"].alternatives]


def by_loo(x, y, w=None):
    """Ridge with the penalty of the least leave-one-out error, from full matrices."""
    w = np.ones(len(y)) if w is None else w / w.mean()
    mu, sd = x.mean(0), x.std(0)
    sd[sd < 1e-8] = 1
    z = (x - mu) / sd
    zc, yc = z - np.average(z, axis=0, weights=w), y - np.average(y, weights=w)
    best = None
    for a in linalg.ALPHAS:
        inv = np.linalg.inv(zc.T @ (zc * w[:, None]) + a * np.eye(x.shape[1]))
        beta = inv @ (zc.T @ (w * yc))
        lever = w * np.einsum("ij,jk,ik->i", zc, inv, zc)
        loss = np.average(((yc - zc @ beta) / np.maximum(1 - lever, 1e-8)) ** 2, weights=w)
        if best is None or loss < best[0]:
            best = loss, a, beta / sd
    return best[1], best[2]


@pytest.mark.parametrize("weighted", [False, True])
def test_ridge_against_full_matrices(spark, weighted):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4)) * [1, 10, 0.1, 1] + [0, 100, 0, 5]
    y = x @ [1, 0.2, -3, 0] + rng.normal(size=120)
    w = rng.lognormal(size=120)
    df = spark.createDataFrame([(*map(float, r), float(t), float(v)) for r, t, v in zip(x, y, w, strict=True)], "a double, b double, c double, d double, y double, w double")
    got = linalg.ridge(df, ["a", "b", "c", "d"], "y", "w" if weighted else None)
    alpha, coef = by_loo(x, y, w if weighted else None)
    assert got.alpha == pytest.approx(alpha) and got.coef == pytest.approx(coef, rel=1e-8)


def test_evaluation_finds_the_break(spark):
    df = readers.load(spark, {"adapter": "synthetic-structural-break", "n_samples": 90, "length": 32, "seed": 3}).withColumn("fold", (F.col("row_id") % 3).cast("int"))
    result = evaluate(G.structural_seed(), df, {"series": "series"}, "y", "fold", boundary=16, length=32, most=4)
    assert result.score > 0.2 and len(result.features) == 21
    assert result.score == pytest.approx(np.mean(result.fold_scores))
    rows = result_table(spark, result).collect()
    assert len(rows) == 4 and sum(r.selected for r in rows) == 1 and max(r.score for r in rows) == pytest.approx(result.score)


def test_rank_ensemble(spark):
    df = readers.load(spark, {"adapter": "synthetic-tabular", "n_samples": 80, "n_features": 5, "seed": 4})
    wide, names = rank.expand(df, [f"x{i}" for i in range(5)], "y", top=3)
    assert len(names) == 5 + 3 + 3
    model = rank.fit(wide, names, "y", most=4, power=1.5)
    assert sum(model.weights) == pytest.approx(1)
    c = model.predict(wide).agg(F.corr("rank_score", "y").alias("c")).first().c
    assert c > 0.5


def test_generators_do_not_depend_on_partitions(spark):
    a = readers.load(spark, {"adapter": "synthetic-tabular", "n_samples": 50, "seed": 9})
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, a.repartition(7).collect()))
    s = readers.load(spark, {"adapter": "synthetic-structural-break", "n_samples": 20, "length": 16})
    spiked = readers.inject_outliers(s, part=1.0)
    pairs = s.join(spiked.select("row_id", F.col("series").alias("t")), "row_id").collect()
    assert all(sum(abs(x - y) > 4 for x, y in zip(r.series, r.t, strict=True)) == 1 for r in pairs)


def test_loaders(spark, tmp_path):
    np.savez(tmp_path / "d.npz", features=np.arange(6.0).reshape(3, 2), y=np.array([1, 2, 3]), other=np.zeros(2))
    (tmp_path / "m.json").write_text(json.dumps({"adapter": "external-npz", "path": "d.npz", "input_keys": ["features"]}))
    rows = readers.load(spark, {"adapter": "external-manifest", "manifest_path": str(tmp_path / "m.json")}).orderBy("row_id").collect()
    assert [r.y for r in rows] == [1.0, 2.0, 3.0] and rows[1].features == [2.0, 3.0]
    with pytest.raises(ValueError, match="unknown adapter"):
        readers.load(spark, {"adapter": "none"})
    with pytest.raises(KeyError):
        readers.load_npz(spark, {"path": str(tmp_path / "d.npz"), "input_keys": ["absent"]})


def test_folds_cover_and_keep_groups(spark):
    df = spark.range(103).withColumn("g", F.col("id") % 11)
    for folds in (ordered.random_folds(df, "id", 5, seed=1), ordered.group_folds(df, "g", 4, seed=1)):
        assert folds.count() == 103
    assert ordered.group_folds(df, "g", 4, seed=1).groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = sorted(r["count"] for r in ordered.random_folds(df, "id", 5, seed=1).groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]


def test_series_of_odd_lengths_and_values(spark):
    rows = [(1, [1.0]), (2, []), (3, [2.0, 2.0]), (4, [1.0, float("nan"), 3.0, 4.0]), (5, [1.0, 2.0, 4.0, 8.0, 16.0])]
    df = spark.createDataFrame(rows, "row_id long, series array<double>")
    out = series_features(df, ["row_id"], ["segment_basic", "trend_basic", "cusum_basic", "shape_drawdown"]).collect()
    assert len(out) == 5 and all(v is not None and np.isfinite(v) for r in out for v in r[1:])


def test_series_sums_round_in_order(spark):
    """Means and slopes are plain sums in the order of the series, bit for bit, so that the SQL's roundings are theirs."""
    x = [round(((i * 7919) % 9973) / 20, 2) for i in range(240)]
    out = series_features(spark.createDataFrame([(1, x)], "row_id long, series array<double>"), ["row_id"], ["row_baseline_outputs"]).first()

    def total(values):
        s = 0.0
        for v in values:
            s += v
        return s

    t = [-1 + 2.0 * i / 239 for i in range(240)]
    assert out["last_vs_older_mean"] == x[-1] - total(x[:120]) / 120
    assert out["full_window_slope"] == total(v * u for v, u in zip(x, t, strict=True)) / total(u * u for u in t)


def test_safe_corr_of_constants(spark):
    df = spark.range(10).selectExpr("id * 1.0D AS x", "3.0D AS c")
    assert df.agg(scoring.safe_corr(F.col("x"), F.col("c")).alias("r")).first().r == 0


def test_stream_history_equals_batch(spark, tmp_path):
    schema = "name string, step long, importance double, alignment double, score double, selected boolean"
    rows = [(f"n{i % 3}", i, i * 0.5, -1.0 if i % 2 else 0.3, i - 20.0, i % 4 == 0) for i in range(30)]
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = lookback.keep_history(lookback.stream_of(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    from braid.operators.relational import history

    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").glob("version=*"))
    got = spark.read.parquet(str(tmp_path / "out" / f"version={last}"))
    want = history(None, spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_lookback_windows(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(5)] + [("b", 0, 9.0)], "e string, t long, v double")
    got = {(r.e, r.t): r.series for r in lookback.lookback(df, "e", ["t"], "v", 3).collect()}
    assert got["a", 4] == [2.0, 3.0, 4.0] and got["a", 0] == [0.0] and got["b", 0] == [9.0]


def test_expressions(spark):
    from braid.functions.source import ground_truth, translate

    df = spark.createDataFrame([(2.0, -3.0, [1.0, 2.0, 4.0])], "x double, y double, s array<double>")
    names = {c: F.col(c) for c in df.columns}
    for text, want in (("x * y + 1", -5.0), ("clip(abs(y), 0, 2)", 2.0), ("mean(s) - median(s)", 1 / 3), ("where(x > y, sqrt(square(x)), 0)", 2.0), ("std(diff(s))", 0.5), ("quantile(s, 0.25)", 1.5)):
        assert df.select(translate(text, names).alias("v")).first().v == pytest.approx(want)
    for text in ("__import__('os')", "x.__class__", "[x for x in s]", "lambda: 1", "open(x)", "x if x else y", "x ="):
        with pytest.raises(ValueError):
            translate(text, names)
    assert df.select(ground_truth("safe_ratio", [F.col("x"), F.col("y")], offset=1.0).alias("v")).first().v == 0.5


def test_protocol_seals_the_test_rows(spark):
    from braid.plans.protocol import Budget, SealedProtocol

    rows = spark.range(30).withColumn("y", F.col("id") * 1.0)
    parts = {"train": rows.where("id < 10"), "validation": rows.where("id >= 10 AND id < 20"), "test": rows.where("id >= 20")}
    p = SealedProtocol(parts, "id")
    with pytest.raises(PermissionError):
        p.part("test")
    with pytest.raises(PermissionError):
        p.evaluate(lambda d: d)
    p.finalize()
    assert p.evaluate(lambda d: d).count() == 10
    with pytest.raises(PermissionError):
        p.evaluate(lambda d: d)
    with pytest.raises(ValueError):
        SealedProtocol(parts | {"test": rows.where("id >= 15")}, "id")
    b = Budget({"calls": 2, "seconds": 10})
    b.spend(calls=1, seconds=4)
    with pytest.raises(RuntimeError):
        b.spend(calls=1, seconds=7)
    assert b.used == {"calls": 1, "seconds": 4}


def test_baselines_and_refinement(spark):
    from braid.plans.protocol import RawRidge, random_features, refine

    rows = [(float(i), float("nan") if i % 5 == 0 else float(i % 7), 2.0 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    done = RawRidge.fit(df, ["a", "b"], "y").predict(df)
    assert done.agg(scoring.variance_explained(F.col("y"), F.col("prediction")).alias("v")).first().v > 0.99
    wide, names = random_features(df, ["a", "b"], 8)
    assert len(names) == 8 and wide.select(*names).dropna().count() == 60
    values, loss = refine({"g": [0.0, 1.0]}, lambda v: (v["g"][0] - 0.15) ** 2 + (v["g"][1] - 1) ** 2, steps=6)
    assert loss < 0.15**2 and values["g"][1] == 1.0
