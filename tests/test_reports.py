"""Frozen readouts, reports, fold strategies, schemas, sinks and generated tasks, against NumPy and by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from braid.operators import ordered, relational, scoring, series
from braid.plans import evaluate as E
from braid.plans import report
from braid.plans.folds import FoldStrategy, fold_strategy
from braid.plans.frozen import contribution_summary, fit_frozen
from braid.plans.graph import structural_seed, tabular_seed
from braid.plans.linalg import ALPHAS
from braid.sources import readers, sinks, tasks
from braid.sources.schema import TaskSchema, infer_schema, schema_of


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 3))
    y = x[:, 0] - 0.5 * x[:, 1] ** 2 + 0.1 * rng.normal(size=240)
    df = spark.createDataFrame([(i, *map(float, r), float(t), i % 3, "ab"[i % 2]) for i, (r, t) in enumerate(zip(x, y, strict=True))], "row_id long, a double, b double, c double, y double, fold int, kind string")
    return df.cache()


INPUTS = {"x": ["a", "b", "c"]}


def test_frozen_readout_predicts_unseen_rows(spark, rows):
    g = tabular_seed()
    config = g.default_config()
    train, rest = rows.where("row_id < 160"), rows.where("row_id >= 160")
    model = fit_frozen(g, config, train, INPUTS, "y")
    # the same features by hand from the superset, fitted with NumPy
    s = E.Superset(g, train, INPUTS)
    own = s.features(config)
    data = s.frame([F.col("y")]).toPandas()
    x, y = data[own].to_numpy(), data["y"].to_numpy()
    mean, sd = x.mean(axis=0), np.where(x.std(axis=0) < 1e-8, 1.0, x.std(axis=0))
    z = (x - mean) / sd
    u, d, vt = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    losses = []
    for alpha in ALPHAS:
        fit = y.mean() + u @ (d**2 / (d**2 + alpha) * (u.T @ (y - y.mean())))
        lever = (u**2 * (d**2 / (d**2 + alpha))).sum(axis=1)
        losses.append((((y - fit) / np.maximum(1 - lever, 1e-8)) ** 2).sum())
    alpha = ALPHAS[int(np.argmin(losses))]
    beta = vt.T @ (d / (d**2 + alpha) * (u.T @ (y - y.mean())))
    assert model.readout.alpha == pytest.approx(alpha)
    got = model.predict(train, INPUTS).toPandas()
    assert np.allclose(got["prediction"], y.mean() + z @ beta, atol=1e-6)
    assert model.predict(rest, INPUTS).columns == [*rest.columns, "prediction"]
    assert model.score(rest, INPUTS, "y") < rest.agg(F.stddev_pop("y")).first()[0]
    parts = model.contributions(rest, INPUTS)
    both = parts.join(model.predict(rest, INPUTS).select("row_id", "prediction"), "row_id")
    error = both.agg(F.max(F.abs(F.aggregate("contributions", F.col("base"), lambda t, v: t + v) - F.col("prediction")))).first()[0]
    assert error < 1e-9
    assert {r.feature for r in contribution_summary(parts, list(model.features)).collect()} == set(model.features)
    with pytest.raises(ValueError):
        model.predict(rest, {"x": ["a", "b"]})
    weighted = fit_frozen(g, config | {"ridge_g": "huber"}, train, INPUTS, "y")
    assert not np.allclose(weighted.readout.coef, model.readout.coef)


def test_reports_of_an_evaluation(spark, rows, tmp_path):
    result = E.evaluate(tabular_seed(), rows, INPUTS, "y", "fold", most=6, keep=3, carry=("kind", "row_id"))
    d = result.diagnostics
    done = result.out_of_fold().toPandas()
    assert len(done) == 240 and d["prediction_std"] == pytest.approx(done["prediction"].std(ddof=0)) and d["residual_std"] == pytest.approx((done["__y"] - done["prediction"]).std(ddof=0))
    s = E.Superset(result_graph := tabular_seed(), rows, INPUTS)
    own, names = s.features(result.config), s.labels(result.config)
    data = s.frame([F.col("row_id")]).toPandas().sort_values("row_id")
    done = done.sort_values("row_id")
    residual = (done["__y"] - done["prediction"]).to_numpy()
    by_name = {r["name"]: r for r in d["features"]}
    assert set(by_name) == set(names) and sum(r["importance"] for r in d["features"]) == pytest.approx(1)
    for column, name in zip(own, names, strict=True):
        x, row = data[column].to_numpy(), by_name[name]
        if x.std() < 1e-9:
            continue
        assert row["target_corr"] == pytest.approx(np.corrcoef(x, done["__y"])[0, 1], abs=1e-7)
        assert row["target_quadratic_corr"] == pytest.approx(np.corrcoef(x * x, done["__y"])[0, 1], abs=1e-6)
        assert row["residual_corr"] == pytest.approx(np.corrcoef(x, residual)[0, 1], abs=1e-7)
        z = (x - x.mean()) / x.std()
        assert row["shap_mean_abs"] == pytest.approx(np.abs(z * row["global_coef"]).mean(), rel=1e-6)
        assert row["shap_std"] == pytest.approx((z * row["global_coef"]).std(), rel=1e-6)
        assert row["depth"] == len(row["dependencies"]) and row["dependencies"][0].startswith("output.")
    # the roll-ups agree with those of a table
    table = spark.createDataFrame([(r["name"], r["dependencies"], r["importance"], r["shap_importance"], r["target_alignment"], r["shap_mean_abs"], r["residual_corr"], r["redundancy"], r["weight_stability"]) for r in d["features"]], "name string, dependencies array<string>, importance double, shap_importance double, target_alignment double, shap_mean_abs double, residual_corr double, redundancy double, weight_stability double")
    for r in relational.subnodes(table).collect():
        own_row = next(x for x in d["subnodes"] if x["name"] == r.name)
        assert all(own_row[k] == pytest.approx(r[k]) for k in relational.ROLLED)
    chosen = {f"{n}.{a}" for n, a in result.config.items()}
    assert chosen <= {r["name"] for r in d["alternatives"] if r["selected"]}
    search = d["configuration_search"]
    assert search["evaluated"] == 3 and search["planned"] == 6 and search["capped"] and search["best_config_score"] == pytest.approx(result.score)
    top = report.feedback(result, 2)
    assert len(top["top_features"]) == 2 and top["score"] == result.score
    report.write_report(str(tmp_path / "run"), "a run", d["alternatives"], score=result.score)
    assert json.loads((tmp_path / "run.json").read_text())["score"] == result.score and "| name |" in (tmp_path / "run.md").read_text()
    assert result_graph.name == "tabular_seed"


def test_readouts_over_random_features_and_the_pool(spark, rows):
    from braid.plans.protocol import RandomFeatureRidge

    df = rows.withColumn("b", F.when(F.col("row_id") % 17 == 0, float("nan")).otherwise(F.col("b")))
    model = RandomFeatureRidge.fit(df, ["a", "b", "c"], "y", size=64, seed=2)
    got = model.predict(df).toPandas()
    x = got[["a", "b", "c"]].to_numpy()
    x = np.where(np.isfinite(x), x, np.nanmedian(x, axis=0))
    z = model.expand(x)
    assert z.shape == (240, 67) and np.allclose(got["prediction"], z @ model.model.coef + model.model.intercept)
    u = z - z.mean(axis=0)
    y = got["y"].to_numpy()
    sd = np.where(z.std(axis=0) < 1e-8, 1.0, z.std(axis=0))
    beta = np.linalg.solve((u / sd).T @ (u / sd) + model.model.alpha * np.eye(67), (u / sd).T @ (y - y.mean())) / sd
    assert np.allclose(beta, model.model.coef, atol=1e-6)
    assert ((got["y"] - got["prediction"]) ** 2).mean() < got["y"].var() / 2
    pool = E.evaluate(tabular_seed(), rows, INPUTS, "y", "fold", most=6, keep=3).diagnostics["valid_feature_pool"]
    assert pool["n_configurations"] > 1 and pool["rmse"] < rows.agg(F.stddev_pop("y")).first()[0]


def test_screening_by_absolute_errors(spark, rows):
    result = E.evaluate(tabular_seed(), rows, INPUTS, "y", "fold", metric="mae", most=8, keep=2)
    g = tabular_seed()
    for row in result.table:
        model_scores = row["approximate_score"]
        s = E.Superset(g, rows, INPUTS)
        own = s.features(row["config"])
        data = s.frame([F.col("y"), F.col("fold")]).toPandas()
        x, y, here = data[own].to_numpy(), data["y"].to_numpy(), data["fold"].to_numpy() != 0
        mean, sd = x[here].mean(axis=0), np.where(x[here].std(axis=0) < 1e-8, 1.0, x[here].std(axis=0))
        z = (x - mean) / sd
        alpha, t = ALPHAS[len(ALPHAS) // 2], y[here]
        beta = np.linalg.lstsq(np.vstack((z[here], math.sqrt(alpha) * np.eye(len(own)))), np.append(t - t.mean(), np.zeros(len(own))), rcond=None)[0]
        assert model_scores == pytest.approx(-np.abs(y[~here] - t.mean() - z[~here] @ beta).mean(), abs=1e-6)


def test_fold_strategies(spark, rows):
    folded, about = FoldStrategy("group_random", "kind").split(rows, "row_id", "y", 5, 0)
    assert about["n_groups"] == 2 and about["actual_folds"] == 2 and about["fold_group_overlap_count"] == 0 and about["validation_group_counts"] == [1, 1]
    folded, about = FoldStrategy("leave_group_out", "absent").split(rows, "row_id", "y", 4, 0)
    assert about["method"] == "random" and about["reason"] and sorted(r["count"] for r in folded.groupBy("fold").count().collect()) == [60] * 4
    folded, about = fold_strategy("time_blocked").split(rows, "row_id", "y", 3, 0)
    assert about["reason"] and about["validation_block_sizes"] == [80, 80, 80]
    folded, about = fold_strategy("stratified").split(rows, "row_id", "y", 4, 0)
    assert {r["count"] for r in folded.groupBy("fold").count().collect()} == {60} and about["stratify_bins"] == 5
    by_kind = fold_strategy("stratified").split(rows.withColumn("label", F.col("row_id") % 2), "row_id", "label", 4, 3)[0]
    assert {r["count"] for r in by_kind.groupBy("fold", "label").count().collect()} == {30}
    own, about = fold_strategy(lambda df, key, y, k, seed: df.withColumn("fold", (F.col(key) % k).cast("int"))).split(rows, "row_id", "y", 6)
    assert own.select("fold").distinct().count() == 6
    assert fold_strategy(group_key="kind").name == "group_random"
    with pytest.raises(ValueError):
        FoldStrategy("odd").split(rows, "row_id", "y", 2)


def test_objective_report_and_constant_targets(spark, rows):
    df = rows.withColumn("p", F.col("a"))
    got = scoring.objective(df, "y", "p", group="kind", time="row_id", roles={"regime": "fold", "event": "kind"}).collect()
    assert {r.part for r in got} == {"overall", "target_bin", "group", "time_bin", "role"}
    assert all(sum(r.n for r in got if r.part == part) == 240 for part in ("overall", "target_bin", "group", "time_bin", "role"))
    with pytest.raises(Exception, match="does not vary"):
        rows.agg(scoring.nrmse(F.lit(1.0), F.col("a"))).collect()


def test_result_rows(spark):
    from braid.plans.protocol import result_rows

    row = {"task": "t", "method": "m", "seed": 1, "split": "validation", "status": "ok", "metrics": {"rmse": 1}, "usage": {"seconds": 2}}
    got = result_rows(spark, [row, row | {"seed": 2, "status": "failed", "metrics": None}]).collect()
    assert got[0].metrics == {"rmse": 1.0} and got[1].metrics == {}
    for bad in ([row, row], [row | {"status": "odd"}], [row | {"metrics": {"rmse": float("nan")}}]):
        with pytest.raises(ValueError):
            result_rows(spark, bad)


def test_schemas(spark, rows, tmp_path):
    s = infer_schema(spark.createDataFrame([], "y double, x array<double>, Unit_ID long, cycle int, event int, other double"), default_input="x")
    assert [(i.name, i.kind, i.roles) for i in s.inputs] == [("x", "numeric_matrix", ("feature",)), ("Unit_ID", "group_id", ("group", "unit")), ("cycle", "time_index", ("time", "sequence")), ("event", "event_label", ("event",)), ("other", "numeric_vector", ())]
    assert s.role_map()["group"] == ["Unit_ID"] and s.with_role("time", "event") == ["cycle", "event"]
    assert TaskSchema.from_dict(s.to_dict()) == s == schema_of(s.to_dict())
    (tmp_path / "s.json").write_text(json.dumps(s.to_dict()))
    assert schema_of(str(tmp_path / "s.json")) == s and schema_of(None, rows).inputs[0].name == "row_id"
    with pytest.raises(ValueError):
        TaskSchema("t", "tabular", ())


def test_sinks(spark, rows, tmp_path):
    split = ordered.three_way_split(rows.select("row_id"), "row_id", seed=1)
    sinks.write_splits(split, f"file://{tmp_path}/splits", seed=1)
    back, about = sinks.read_splits(spark, f"file://{tmp_path}/splits")
    assert about == {"seed": 1} and sorted(map(tuple, back.collect())) == sorted(map(tuple, split.select("row_id", "split").collect()))
    with pytest.raises(ValueError):
        sinks.write_splits(split.union(split.limit(1)), f"file://{tmp_path}/bad")
        sinks.read_splits(spark, f"file://{tmp_path}/bad")
    log = f"file://{tmp_path}/log"
    for step in (3, 1):
        sinks.append_events(spark.createDataFrame([(step, "x")], "step long, what string"), log)
    (tmp_path / "log" / "part-torn.json").write_text('{"step": 9, "wh\n\n')
    assert sinks.event_count(spark, log) == 3 and sinks.last_event(spark, log, "step", "step long, what string") == {"step": 3, "what": "x"}
    for name, text in (("train", "1 2 3\n4 5 6\n"), ("validation", "7 8 9\n"), ("test", "\n10  11 12\n")):
        (tmp_path / f"{name}.txt").write_text(text)
    table, parts = sinks.curate(spark, {n: f"file://{tmp_path}/{n}.txt" for n in sinks.PARTS})
    assert sorted(map(tuple, table.collect())) == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0), (2, 7.0, 8.0, 9.0), (3, 10.0, 11.0, 12.0)]
    assert sorted(map(tuple, parts.collect())) == [(0, "train"), (1, "train"), (2, "validation"), (3, "test")]
    rows.select("row_id", F.col("a").alias("prediction")).write.csv(f"file://{tmp_path}/p", header=True)
    assert sinks.read_predictions(spark, f"file://{tmp_path}/p", "row_id", rows).count() == 240
    with pytest.raises(ValueError):
        sinks.read_predictions(spark, f"file://{tmp_path}/p", "row_id", rows.where("row_id > 5"))


@pytest.mark.parametrize("name", list(tasks.TASKS))
def test_generated_tasks(spark, name):
    task = tasks.TASKS[name]
    a = tasks.generate(spark, name, "train", 400, 3, steps=True)
    assert sorted(map(str, a.collect())) == sorted(map(str, tasks.generate(spark, name, "train", 400, 3, steps=True).repartition(5).collect()))
    other = tasks.generate(spark, name, "validation", 400, 3).toPandas()
    got = a.toPandas()
    assert not np.allclose(got["y"], other["y"]) and np.isfinite(got["y"]).all()
    missing = np.isnan(got[[f"x{i}" for i in range(task.width)]].to_numpy()).mean()
    assert abs(missing - task.missing) < 0.03
    if not task.missing:
        again = tasks.with_steps(a.select("row_id", *(f"x{i}" for i in range(task.width)), F.col("target").alias("was")), task).toPandas()
        assert np.allclose(again["target"], again["was"])
    for column, (source, r) in task.copies.items():
        both = got[[f"x{column}", f"x{source}"]].dropna()
        assert abs(np.corrcoef(both.T)[0, 1] - r) < 0.12
    far = tasks.generate(spark, name, "extrapolation", 200, 3).toPandas()
    active = far[[f"x{i}" for i in task.active]].abs().to_numpy()
    assert np.nanmin(active) >= 1.25 and np.nanmax(active) <= 2.25


def test_half_of_the_series_break_and_a_fifth_are_spiked(spark):
    df = readers.load(spark, {"adapter": "synthetic-structural-break", "n_samples": 41, "length": 24, "seed": 2})
    assert df.where("y = 1").count() == 20 and df.count() == 41
    spiked = readers.inject_outliers(df).select("row_id", F.col("series").alias("s")).join(df, "row_id")
    assert spiked.where(F.expr("s <> series")).count() == 8


@pytest.mark.parametrize("block", list(series.SERIES_BLOCKS))
def test_blocks_over_empty_null_and_one_value_series(spark, block):
    df = spark.createDataFrame([(1, []), (2, None), (3, [1.5]), (4, [None, 2.0, float("nan")]), (5, [1.0, 2.0, 4.0, 8.0])], "id long, series array<double>")
    if block in ("row_context_outputs", "row_time_basis_outputs"):
        df = df.withColumns({"sample_time": F.lit(1.0), "sample_period": F.lit(1.0), "lookback_observed": F.lit(1.0)})
    fixed = {"length": 4, "boundary": 2} if block in ("spectral_basic", "structural_break_baseline_outputs", "row_multiscale_tail_outputs") else {}
    got = series.series_features(df, ["id"], [block], "series", **fixed).collect()
    assert {r.id for r in got} == {1, 2, 3, 4, 5}
    assert all(v is not None and math.isfinite(v) for r in got for k, v in r.asDict().items() if k != "id")


def test_no_window_takes_a_whole_table(spark, rows):
    """Plans whose windows or sorts would put all rows in one task."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (ordered.ranked(rows, [F.col("y")]), ordered.mid_ranks(rows, "y"), ordered.stratified_folds(rows, "kind", ["row_id"], 3), ordered.blocks(rows, [F.col("y")], 3), scoring.quantile_bins(rows, "y")):
        assert "SinglePartition" not in plan(df)
    assert ordered.quantiles(rows, F.col("y"), [0.0, 0.25, 0.5, 1.0]) == pytest.approx(np.quantile(rows.toPandas()["y"], [0.0, 0.25, 0.5, 1.0]).tolist())
    assert ordered.quantiles(rows.limit(0), F.col("y"), [0.5]) is None


def test_structural_seed_reports_its_weights(spark):
    df = readers.load(spark, {"adapter": "synthetic-structural-break", "n_samples": 60, "length": 32, "seed": 4}).withColumn("fold", (F.col("row_id") % 3).cast("int"))
    result = E.evaluate(structural_seed(), df, {"series": "series"}, "y", "fold", boundary=16, length=32, most=3, keep=3)
    assert len(result.alphas) == 3 and result.diagnostics["global_ridge"]["alpha"] > 0 and result.diagnostics["folds"]["std"] >= 0


def test_equal_rows_are_one_row_with_a_count(spark, rows, monkeypatch):
    """The passes see each different row once; scores and penalties are those of all rows one by one."""
    seen = []

    class Watched(E.Held):
        def __init__(self, df):
            super().__init__(df)
            seen.append((len(self.rows), self.take(["__n"]).sum()))

    monkeypatch.setattr(E, "Held", Watched)
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("row_id") % 4).cast("int"))))
    counted = E.evaluate(tabular_seed(), many, INPUTS, "y", "fold", most=6, keep=3)
    monkeypatch.setattr(E.Superset, "counted", lambda s, y, fold: s.table.df.select("*", y.alias("__y"), fold.alias("__fold"), F.lit(1.0).alias("__n")))
    single = E.evaluate(tabular_seed(), many, INPUTS, "y", "fold", most=6, keep=3)
    assert seen == [(rows.count(), many.count()), (many.count(), many.count())]
    assert counted.config == single.config and counted.alphas == single.alphas
    assert [r["score"] for r in counted.table if "score" in r] == pytest.approx([r["score"] for r in single.table if "score" in r], rel=1e-9)
    for name in ("prediction_std", "residual_std", "effective_rank", "mean_max_corr"):
        assert counted.diagnostics[name] == pytest.approx(single.diagnostics[name], rel=1e-6)  # roots of eigenvalues near 0
    assert counted.diagnostics["valid_feature_pool"] == pytest.approx(single.diagnostics["valid_feature_pool"], rel=1e-6)
