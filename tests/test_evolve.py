"""Documents, source alternatives, contracts, and searches with their logs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from braid.__main__ import main
from braid.plans import evaluate as E
from braid.plans import evolve as V
from braid.plans.documents import Document, apply, parse
from braid.plans.graph import Alternative, Graph, graph_from_dict, graph_hash, graph_to_dict, structural_seed, tabular_seed, with_alternative
from braid.plans.maintain import BUILT_IN

BLOCK = """
yaml
rationale: "blocks of keys"
hypotheses:
  - "One idea."
globals:
  - name: "scale_retry"
    value: [1.35]
    trainable: true
nodes:
  - name: "extra"
    kind: "intermediate"
remove:
  []
add:
  - kind: "add_alternative"
    target_node: "extra"
    alternative_id: "halved"
    parents: "['x']"
    primitive: "source"
    source: "lambda ctx, values: values['x'] / 2"
    output_contract: {"type": "feature_block", "min_columns": 1}
  - {"target_node": "output", "alternative_id": "with_extra", "primitive": "pass_outputs", "parents": ["base_features", "extra"]}
  - target_node: "ridge_g"
    alternative_id: "huber_retry"
    parents: []
    primitive: "huber_residual_weight"
    global_refs: ["scale_retry"]
"""
KEYED = """Here it is:
```yaml
rationale: one line each
remove:
  - nonlinear_features.square
add:
  base_features:
    - "lambda ctx, values: np.log1p(np.abs(values['x']))"
    - "lambda ctx, values: [values['x'] * values['x'], np.tanh(values['x'])]"
```
"""


def test_documents():
    d = parse(BLOCK)
    assert d.rationale == "blocks of keys" and d.hypotheses == ["One idea."] and len(d.add) == 3
    g = apply(tabular_seed(), d)
    assert g.globals["scale_retry"] == [1.35] and "scale_retry" in g.trainable
    assert g.nodes["extra"].alternatives[0].contract == (("min_columns", 1), ("type", "feature_block"))
    assert g.nodes["ridge_g"].alternatives[-1].globals == ("scale_retry",)
    assert graph_hash(graph_from_dict(graph_to_dict(g))) == graph_hash(g)
    k = parse(KEYED)
    assert [a["parents"] for a in k.add] == [["x"], ["x"]] and len({a["alternative_id"] for a in k.add}) == 2
    assert [a["alternative_id"] for a in parse(KEYED).add] == [a["alternative_id"] for a in k.add]
    assert [a.id for a in apply(tabular_seed(), k).nodes["nonlinear_features"].alternatives] == ["abs", "interactions"]
    for bad in ("  - lost", "no colon", "add:\n  - just text", "remove:\n  - nodot", "add:\n  key:\n      deep: er"):
        with pytest.raises(ValueError):
            parse(bad)
    with pytest.raises(ValueError):
        apply(tabular_seed(), Document(nodes=[{"name": "o2", "kind": "output"}]))
    with pytest.raises(ValueError):
        apply(tabular_seed(), Document(add=[{"target_node": "x", "alternative_id": "a", "primitive": "tabular_raw"}]))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 2))
    return spark.createDataFrame([(i, *map(float, r), float(r[0] ** 2 + 0.1 * r[1]), i % 3) for i, r in enumerate(x)], "row_id long, a double, b double, y double, fold int").cache()


def test_source_alternatives_are_features(spark, rows):
    g = Graph("sources", globals={"k": [2.0]})
    g.add("x", "input")
    g.add("base", "intermediate", Alternative("own", "source", ("x",), ("k",), (), "lambda ctx, values: [np.tanh(values['x']) * globals['k'], values['x'] * values['x']]"))
    g.add("more", "intermediate", Alternative("own", "source", ("base",), (), (), "abs(base) + 1"))
    g.add("output", "output", Alternative("all", "pass_outputs", ("base", "more")))
    s = E.Superset(g, rows, {"x": ["a", "b"]})
    columns, names = s.features({}), s.labels({})
    got = s.frame([F.col("row_id"), F.col("a"), F.col("b")]).toPandas()
    x = got[["a", "b"]].to_numpy()
    base = np.column_stack((2 * np.tanh(x), x * x))
    assert np.allclose(got[columns].to_numpy(), np.column_stack((base, np.abs(base) + 1)))
    assert len(set(names)) == 8
    result = E.evaluate(g, rows, {"x": ["a", "b"]}, "y", "fold")
    assert result.score > 0.99
    assert result.diagnostics["features"][0]["dependencies"][0] == "output.all"
    for text in ("__import__('os')", "lambda x: x", "values['x'].data", "open('f')"):
        bad = with_alternative(g, "base", Alternative("bad", "source", ("x",), (), (), text))
        with pytest.raises(ValueError):
            E.Superset(bad, rows, {"x": ["a", "b"]}).features({"base": "bad"})


def test_sources_over_series(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0, 3.0, 4.0 + i, 1.0, 0.5 * i]) for i in range(12)], "y long, series array<double>")
    g = with_alternative(structural_seed(), "trend_stats", Alternative("own", "source", ("series",), (), (), "[mean(post) - mean(pre), std(series)]"))
    s = E.Superset(g, df, {"series": "series"}, 3, 6)
    config = g.default_config() | {"trend_stats": "own"}
    own = [c for c, n in zip(s.features(config), s.labels(config), strict=True) if n.startswith("output.raw_concat.source_")]
    got = s.frame([F.col("series").alias("v")]).toPandas()
    v = np.stack(got["v"])
    assert np.allclose(got[own].to_numpy(), np.column_stack((v[:, 3:].mean(axis=1) - v[:, :3].mean(axis=1), v.std(axis=1))))


def test_array_functions_of_sources(spark):
    from braid.functions.source import translate

    df = spark.createDataFrame([([1.0, 2.0, 4.0],)], "a array<double>")
    for text, want in (
        ("cumsum(a)", [1.0, 3.0, 7.0]), ("concatenate([a, ones(2)])", [1.0, 2.0, 4.0, 1.0, 1.0]), ("linspace(0, 1, 3)", [0.0, 0.5, 1.0]), ("full(2, 3)", [3.0, 3.0]),
        ("zeros(1)", [0.0]), ("sort(asarray(a))", [1.0, 2.0, 4.0]), ("sum(cumsum(a))", 11.0),
    ):
        assert df.select(translate(text, {"a": F.col("a")}).alias("v")).first().v == want


def test_contracts(rows):
    def seen(contract):
        g = with_alternative(tabular_seed(), "base_features", Alternative("c", "tabular_raw", ("x",), (), (), "", tuple(sorted(contract.items()))))
        return E.Superset(g, rows, {"x": ["a", "b"]}).features(g.default_config() | {"base_features": next(a.id for a in g.nodes["base_features"].alternatives if a.contract)})

    assert seen({"n_columns": 2, "type": "feature_block"})
    for wrong in ({"n_columns": 3}, {"min_columns": 4}, {"max_columns": 1}, {"type": "sample_weight"}):
        with pytest.raises((ValueError, TypeError)):
            seen(wrong)


def toy(g):
    """A score of graphs that needs no data: known alternatives, good and bad ones."""
    ids = [a.id for n in g.nodes.values() for a in n.alternatives]
    if "broken" in ids:
        raise ValueError("broken")
    return sum(x.startswith("good") for x in ids) - 5.0 * sum(x.startswith("bad") for x in ids)


def adds(*ids):
    return Document(add=[{"target_node": "base_features", "alternative_id": i, "primitive": "tabular_abs", "parents": ["x"], "params": {"p": float(sum(map(ord, i)))}} for i in ids])


def test_search_repairs_salvages_logs_and_goes_on(tmp_path):
    documents = [adds("good1"), adds("bad1", "good2"), adds("broken"), adds("good1"), adds("good3")]
    propose = lambda g, s, step: documents[step - 1]
    fixed = lambda g, d, error: adds("good4") if "broken" in error else None
    first = V.evolve(tabular_seed(), toy, propose, 3, str(tmp_path / "run"), repair=fixed)
    assert first.score == 3 and first.step == 3 and [e["accepted"] for e in first.events] == [True, False, True]
    assert first.events[1]["salvaged"] == ["base_features.good2"] and "first_error" in first.events[2]
    with open(tmp_path / "run" / "events.jsonl", "a") as out:
        out.write('{"step": 4, "acc')  # a step that did not end
    run = V.evolve(tabular_seed(), toy, propose, 5, str(tmp_path / "run"), repair=fixed)
    assert run.step == 5 and run.score == 4 and run.version == 4 and "error" in run.events[3]
    about = V.inspect(str(tmp_path / "run"))
    assert about["best"]["score"] == 4 and about["failed"] == 1 and "good3" in about["nodes"]["base_features"]
    V.export_best(str(tmp_path / "run"), str(tmp_path / "best.json"))
    assert json.loads((tmp_path / "best.json").read_text())["metadata"]["version"] == 4
    assert V.recheck(str(tmp_path / "run"), toy)["same"] and not V.recheck(str(tmp_path / "run"), lambda g: 0.0)["same"]
    assert len(list((tmp_path / "run" / "archive").iterdir())) == 5
    with pytest.raises(FileNotFoundError):
        V.export_best(str(tmp_path / "none"), str(tmp_path / "x.json"))


def test_promotion_rules_and_guards():
    same = lambda g, s, step: adds(f"other{step}")
    assert V.evolve(tabular_seed(), toy, same, 2).version == 2
    assert V.evolve(tabular_seed(), toy, same, 2, strict=True).version == 0
    good = lambda g, s, step: adds(f"good{step}")
    assert V.evolve(tabular_seed(), toy, good, 3, validate=lambda g: min(toy(g), 1)).version == 1
    clock = iter(range(100))
    stopped = V.evolve(tabular_seed(), toy, good, 10, guard=V.Guard(seconds=2.5, now=lambda: next(clock)))
    assert 0 < stopped.step < 10
    assert V.resident_mb() > 0
    with pytest.raises(V.Stopped):
        V.Guard(memory_mb=0.001).check()


def test_islands_migrate_and_reject_stale_results(tmp_path):
    propose = lambda g, s, step: adds(f"good{step}") if g.name == "a" else adds(f"bad{step}")
    graphs = [tabular_seed(), tabular_seed()]
    graphs[0].name = "a"
    runs = V.islands(graphs, toy, propose, 4, migrate_every=2, threads=2, folder=str(tmp_path))
    assert runs[0].score == 4 and runs[1].score >= 2
    assert sum("migrated_from" in e for e in V.Log(str(tmp_path)).events()) >= 1
    event = {}
    assert not V.settle(runs, 0, runs[0].version - 1, V.Run(graphs[0], 99.0), event) and event["stale"] and runs[0].score == 4


def test_built_in_proposals_apply():
    g = tabular_seed()
    propose = V.built_in([d for d in BUILT_IN if d["add"][0]["parents"] == ["x"]])
    before = sum(len(n.alternatives) for n in g.nodes.values())
    for step in range(1, 8):
        g = apply(g, propose(g, 0.0, step))
    assert len(BUILT_IN) == 32 and sum(len(n.alternatives) for n in g.nodes.values()) == before + 7


def test_command_line(spark, tmp_path, capsys):
    folder = str(tmp_path / "cli")
    assert main(["evolve", "--folder", folder, "--rows", "60", "--steps", "1", "--configurations", "2"]) == 0
    assert main(["inspect", "--folder", folder]) == 0
    out = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert out[0]["steps"] == 1 and out[1]["best"]["score"] == pytest.approx(out[0]["score"])
