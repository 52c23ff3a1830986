"""Evaluating a graph: every planned configuration from one projection of the data.

1. All blocks that any configuration needs become columns of one superset, each different
   (primitive, parameters, parents) once. Rows of a table that are equal in inputs, target and fold
   are one row with a count. Only these are kept between passes; each pass computes its columns anew.
2. One pass sums the superset's cross products by fold and sample weight. Training folds
   are sums of other folds, configurations are submatrices, standardizing is arithmetic on
   them, so fits for any penalty need no further pass.
3. One pass gives the leave-one-out errors of all finalists, folds and penalties; one more per
   reweighting step; one gives the sums that the scores are made of.

Features are computed over the whole batch before folds are cut, so batch statistics
see validation rows too. A configuration's score is the mean of its fold scores.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Block, nz
from ..functions.source import source_parts, translate
from ..operators import combine
from ..operators.series import SERIES_BLOCKS, Series, boundary_energy_weight, late_energy_weight, with_time_scale
from ..operators.tabular import TABULAR_BLOCKS, Table, row_norm_weight
from .graph import Alternative, Graph, feature_signature
from .linalg import ALPHAS, HELD_VALUES, Held, Moments, Ridge, Solver, chosen, effective_rank, first_least, moments, summed, target_correlations
from .planner import Config, coverage, finalists, plan
from .report import alternative_rows, feature_rows, search_summary, subnode_rows

IRLS_STEPS = 2
FINALISTS = 16
ALL = -1  # the fold that no row is of


class Superset:
    """The columns that configurations of a graph refer to, over one batch."""

    def __init__(self, g: Graph, df: DataFrame, inputs: dict[str, object], boundary: int | Column | None = None, length: int | None = None):
        """``inputs`` maps an input node to a column name (a series) or a list of names (a table)."""
        self.g, self.inputs = g, inputs
        self.table = self.series = None
        source = next(iter(inputs.values()))
        if isinstance(source, str):
            self.series = Series(with_time_scale(df), source, boundary, length)
        else:
            self.table = Table(df, list(source))
        self.given = list(df.columns)
        self.made: dict[tuple, list[tuple[str, str]]] = {}
        self.columns: dict[str, Column] = {}
        self.level: dict[str, int] = {}

    def _key(self, a: Alternative, config: Config) -> tuple:
        """What an alternative's result depends on under a configuration."""
        return (a.primitive, a.params, a.source, tuple((n, tuple(self.g.globals[n])) for n in a.globals), tuple(self._key(self._chosen(p, config), config) for p in self._made_parents(a)))

    def _made_parents(self, a: Alternative) -> list[str]:
        return [p for p in a.parents if self.g.nodes[p].kind != "input"]

    def _chosen(self, name: str, config: Config) -> Alternative:
        node = self.g.nodes[name]
        return node.alternative(config.get(name, node.alternatives[0].id))

    def block(self, a: Alternative, config: Config) -> list[tuple[str, str]]:
        """(column, name) of an alternative's block; made once for all configurations that share it."""
        key = self._key(a, config)
        if key not in self.made:
            parents = self._made_parents(a)
            blocks = [self.block(self._chosen(p, config), config) for p in parents if self.g.nodes[p].kind != "callable"]
            families = [self._family(self._chosen(p, config)) for p in parents if self.g.nodes[p].kind == "callable"]
            flat = [x for b in blocks for x in b]
            if a.primitive in ("pass_outputs", "combine_blocks"):
                self.made[key] = flat
            elif a.primitive == "activated_outputs" and families[-1].name == "identity":
                self.made[key] = [(c, f"identity_{n}") for c, n in flat]
            else:
                level = 1 + max((self.level[c] for c, _ in flat), default=-1)
                own = self._source(a, dict(zip(parents, blocks, strict=False))) if a.primitive == "source" else self._make(a, [(n, F.col(c)) for c, n in flat], families)
                self.made[key] = [(self._column(c, level), n) for n, c in own]
            a.check(len(self.made[key]))
        return self.made[key]

    def _source(self, a: Alternative, blocks: dict[str, list[tuple[str, str]]]) -> Block:
        """The features of an expression: over a series its values are arrays, over blocks it is taken column by column."""
        globals_ = {n: F.lit(float(self.g.globals[n][0])) for n in a.globals}
        names: list[dict[str, Column]] = [dict(globals_)]
        if self.series is not None:
            names[0] |= {"series": self.series.whole.values, "pre": self.series.pre.values, "post": self.series.post.values}
        if blocks:
            width = max(map(len, blocks.values()))
            names = [names[0] | {p: F.col(b[min(i, len(b) - 1)][0]) for p, b in blocks.items()} for i in range(width)]
        elif self.table is not None:
            names = [names[0] | {p: self.table.x(i) for p in a.parents} for i in range(self.table.width)]
        name = f"source_{hashlib.sha256(a.source.encode()).hexdigest()[:6]}"
        return [(f"{name}_{k}_{i}", translate(part, own)) for k, part in enumerate(source_parts(a.source)) for i, own in enumerate(names)]

    def _column(self, c: Column, level: int) -> str:
        own = f"__f{len(self.columns)}"
        self.columns[own], self.level[own] = c.cast("double"), level
        return own

    def _family(self, a: Alternative) -> combine.Family:
        params, g = dict(a.params), self.g.globals
        scale = params.get("scale", float(g["gate_scale"][0]) if "gate_scale" in g else 1.0)
        match a.primitive:
            case "identity_callable":
                return combine.identity()
            case "sigmoid_gate_callable":
                return combine.sigmoid_gate(scale)
            case "clipped_linear_callable":
                return combine.clipped_linear(scale)
        raise TypeError(f"{a.primitive!r} is no callable")

    def _make(self, a: Alternative, parents: Block, families: list[combine.Family]) -> Block:
        if a.primitive in SERIES_BLOCKS:
            return SERIES_BLOCKS[a.primitive](self.series)
        if a.primitive in TABULAR_BLOCKS:
            self.table, block = TABULAR_BLOCKS[a.primitive](self.table)
            return block
        if a.primitive == "activated_outputs":
            if not families:
                raise TypeError("the last parent of an activated output is a callable")
            return combine.activated(families[-1], parents)
        if a.primitive == "projection_outputs":
            return combine.projection(self.g.globals["projection_vector"], parents)
        raise ValueError(f"unknown primitive {a.primitive!r}")

    def features(self, config: Config) -> list[str]:
        """The superset's columns for all output alternatives, in order; ``labels`` names them."""
        return [c for c, _ in self._outputs(config)]

    def labels(self, config: Config) -> list[str]:
        return [n for _, n in self._outputs(config)]

    def _outputs(self, config: Config) -> list[tuple[str, str]]:
        return [(c, f"{node.name}.{a.id}.{n}") for node in self.g.of_kind("output") for a in node.alternatives for c, n in self.block(a, config)]

    def dependencies(self, config: Config) -> list[list[str]]:
        """For each feature, the alternatives (node.alternative) that it is made of, its output's first."""
        return [self._below(f"{node.name}.{a.id}", a, config) for node in self.g.of_kind("output") for a in node.alternatives for _ in self.block(a, config)]

    def _below(self, name: str, a: Alternative, config: Config) -> list[str]:
        found = [name]
        for p in self._made_parents(a):
            chosen = self._chosen(p, config)
            found += [x for x in self._below(f"{p}.{chosen.id}", chosen, config) if x not in found]
        return found

    def weight(self, config: Config) -> Column | None:
        if "ridge_w" not in self.g.nodes:
            return None
        node = self.g.nodes["ridge_w"]
        a = node.alternative(config.get("ridge_w", node.alternatives[0].id))
        match a.primitive:
            case "uniform_sample_weight":
                return None
            case "boundary_energy_weight":
                return boundary_energy_weight(self.series)
            case "late_energy_weight":
                return late_energy_weight(self.series)
            case "tabular_row_norm_weight":
                self.table, w = row_norm_weight(self.table)
                return w
        raise ValueError(f"unknown weight {a.primitive!r}")

    def rule(self, config: Config) -> float | None:
        """The scale of the Huber rule, or None for no reweighting."""
        if "ridge_g" not in self.g.nodes:
            return None
        node = self.g.nodes["ridge_g"]
        a = node.alternative(config.get("ridge_g", node.alternatives[0].id))
        if a.primitive == "identity_residual_weight":
            return None
        if a.primitive == "huber_residual_weight":
            return max(float(self.g.globals.get("residual_huber_scale", [1.0])[0]), 1e-6)
        raise ValueError(f"unknown residual rule {a.primitive!r}")

    def counted(self, y: Column, fold: Column) -> DataFrame:
        """The table's different rows of inputs, ``__y`` and ``__fold``, with ``__n``, their count, and what blocks need of the batch."""
        df = self.table.df
        batch = [c for c in df.columns if c not in self.given]
        rows = df.select(*self.table.columns, y.alias("__y"), fold.alias("__fold"), *batch)
        return rows.groupBy(*rows.columns).agg(F.count("*").cast("double").alias("__n"))

    def frame(self, keep: list[str], df: DataFrame | None = None) -> DataFrame:
        """``keep`` and the superset's columns; ``df`` stands in for the table's rows."""
        if df is None:
            df = self.series.steps.build() if self.series else self.table.df
        # a block over other blocks' columns comes in a later projection
        for level in sorted(set(self.level.values())):
            now = {n: c for n, c in self.columns.items() if self.level[n] == level}
            df = df.withColumns(now)
            df = df.withColumns({n: nz(F.col(n)) for n in now})
        return df.select(*keep, *self.columns)


@dataclass
class Result:
    score: float
    config: Config
    features: list[str]
    fold_scores: list[float]
    models: list[Ridge]
    table: list[dict] = field(default_factory=list)  # a row for each configuration that was looked at
    diagnostics: dict = field(default_factory=dict)
    alphas: list[float] = field(default_factory=list)
    frame: DataFrame | None = None  # the winner's features, target, fold and the columns that were kept
    columns: list[str] = field(default_factory=list)

    def out_of_fold(self, name: str = "prediction") -> DataFrame:
        """The rows that were evaluated, each with the prediction of the model that did not see it."""
        out = F.lit(None).cast("double")
        for f, model in enumerate(self.models):
            out = F.when(F.col("__fold") == f, model.column(self.columns)).otherwise(out)
        return self.frame.withColumn(name, out).drop(*self.columns)


def _fold_score(metric: str, n: float, sy: float, syy: float, see: float, sae: float) -> float:
    """The oriented score of a fold from its sums."""
    if n <= 0:
        return float("nan")
    if metric == "variance_explained":
        mse, var = see / n, max(syy / n - (sy / n) ** 2, 0.0)
        if var < 1e-12:
            return 1.0 if mse < 1e-12 else -mse
        return 1 - mse / var
    return -float(np.sqrt(see / n)) if metric == "rmse" else -sae / n


def evaluate(
    g: Graph,
    df: DataFrame,
    inputs: dict[str, object],
    y: str,
    fold: str,
    boundary: int | Column | None = None,
    length: int | None = None,
    metric: str = "variance_explained",
    most: int = 64,
    keep: int = FINALISTS,
    irls_steps: int = IRLS_STEPS,
    carry: tuple[str, ...] = (),
) -> Result:
    """The best planned configuration of ``g``; ``fold`` is a column of fold numbers from 0, ``carry`` are columns to report by.

    More than ``keep`` planned configurations are screened first, on fold 0 at the middle
    penalty. A score that is not a number wins first, then the greatest, ties to the
    earlier configuration.
    """
    g.validate()
    configs, whole = plan(g, most)
    s = Superset(g, df, inputs, boundary, length)
    per = [s.features(c) for c in configs]
    w_exprs: dict[str, Column | None] = {}
    w_names = []
    for c in configs:
        name = c.get("ridge_w", "")
        if name not in w_exprs:
            w_exprs[name] = s.weight(c)
        w_names.append(name)
    weight_columns = {}
    for i, (name, w) in enumerate(w_exprs.items()):
        weight_columns[name] = "__one" if w is None else f"__w{i}"
        if w is not None:
            s.level[f"__w{i}"] = 0
            s.columns[f"__w{i}"] = F.greatest(nz(w.cast("double")), F.lit(0.0))
    features = [n for n in s.columns if n.startswith("__f")]
    own = [F.col(y).cast("double").alias("__y"), F.col(fold).cast("int").alias("__fold")]
    given = s.frame([*own, *map(F.col, carry)])
    if s.table:
        kept = s.counted(*own).persist()
        frame = s.frame(["__y", "__fold", "__n"], kept).withColumn("__one", F.lit(1.0))
    else:
        kept = frame = given.withColumns({"__one": F.lit(1.0), "__n": F.lit(1.0)}).persist()
    try:
        out = _evaluate(g, s, frame, configs, whole, per, w_names, weight_columns, features, metric, keep, irls_steps)
    finally:
        kept.unpersist()
    out.columns = s.features(out.config)
    out.frame = given.select("__y", "__fold", *carry, *dict.fromkeys(out.columns))
    return out


def _evaluate(g, s, frame, configs, whole, per, w_names, weight_columns, features, metric, keep, irls_steps) -> Result:
    columns = [*features, "__y"]
    weights = list(dict.fromkeys(["__one", *weight_columns.values()]))
    mean = lambda c: F.sum(F.col(c) * F.col("__n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("__n")))
    first = frame.agg(F.max("__fold").alias("k"), F.count("*").alias("n"), *(mean(c).alias(f"m{i}") for i, c in enumerate([*columns, *weight_columns.values()]))).first()
    folds = first[0] + 1
    shift = np.array(first[2 : 2 + len(columns)], dtype=np.float64)
    w_mean = dict(zip(weight_columns, first[2 + len(columns) :], strict=True))
    if first[1] * (len(columns) + len(weight_columns) + 2) <= HELD_VALUES:
        frame = Held(frame.select(*columns, *weights, "__n", "__fold"))
    sums = moments(frame, columns, "__fold", folds, weights, shift, "__n")
    place = {c: i for i, c in enumerate(columns)}
    w_place = {name: weights.index(c) for name, c in weight_columns.items()}

    def training(f: int, j: int) -> Moments:
        n = sum(sums[k, j][0] for k in range(folds) if k != f)
        return Moments.of(n, sum(sums[k, j][1] for k in range(folds) if k != f), shift)

    # no row is of fold ALL, so its training rows are all rows
    train = {(f, j): training(f, j) for f in (ALL, *range(folds)) for j in range(len(weights))}

    def solver(i: int, f: int, weighted: Moments | None = None) -> Solver:
        at = [place[c] for c in per[i]] + [place["__y"]]
        return Solver.of(weighted or train[f, w_place[w_names[i]]].take(at), train[f, 0].take(at))

    table = [{"planner_index": i, "config": c, "n_features": len(per[i])} for i, c in enumerate(configs)]
    chosen = list(range(len(configs)))
    if len(configs) > keep:
        models = {i: solver(i, 0).fit(float(ALPHAS[len(ALPHAS) // 2])) for i in chosen}
        if metric == "mae":  # absolute errors are no moments: one pass
            found = _errors(frame, columns, [(i, 0) for i in chosen], per, {(i, 0): m for i, m in models.items()}, place)
            approximate = [_fold_score(metric, *found[i, 0]) for i in chosen]
        else:
            n, raw = sums[0, 0]
            val = Moments.of(n, raw, shift)
            approximate = []
            for i in chosen:
                m, b = val.take([*(place[c] for c in per[i]), place["__y"]]), np.append(models[i].coef, -1.0)
                bias = float(m.mean @ b) + models[i].intercept
                see = float(b @ m.cross @ b) + n * bias * bias
                mean_y, syy = float(m.mean[-1]), float(m.cross[-1, -1]) + n * float(m.mean[-1]) ** 2
                approximate.append(_fold_score(metric, n, n * mean_y, syy, see, 0.0))
        for i, score in zip(chosen, approximate, strict=True):
            table[i]["approximate_score"] = score
        chosen = finalists(g, configs, approximate, keep)

    # exact fits: the penalty by leave-one-out errors, one pass for all finalists and folds
    rules = {i: s.rule(configs[i]) for i in chosen}

    def exact(index: list[tuple[int, int]]) -> dict:
        fits = _select(frame, columns, weight_columns, index, per, w_names, {k: solver(*k) for k in index}, None, place)
        ruled = [k for k in index if rules[k[0]] is not None]
        for _ in range(irls_steps if ruled else 0):
            again = _reweighted(frame, columns, weight_columns, ruled, per, w_names, w_mean, fits, rules, train, shift, place)
            solvers = {k: solver(*k, weighted=again[k][0]) for k in ruled}
            fits |= _select(frame, columns, weight_columns, ruled, per, w_names, solvers, (fits, rules, {k: again[k][1] for k in ruled}, w_mean), place)
        return fits

    index = [(i, f) for i in chosen for f in range(folds)]
    fits = exact(index)
    sizes = _errors(frame, columns, index, per, fits, place)
    best = None
    for i in chosen:
        scores = [_fold_score(metric, *sizes[i, f]) for f in range(folds)]
        table[i] |= {"score": float(np.mean(scores)), "fold_scores": scores, "alphas": [fits[i, f].alpha for f in range(folds)]}
    for i in chosen:
        score = table[i]["score"]
        if np.isnan(score):
            best = i
            break
        if best is None or score > table[best]["score"]:
            best = i
    at = [place[c] for c in per[best]]
    labels, config = s.labels(configs[best]), configs[best]
    models = [fits[best, f] for f in range(folds)]
    overall = exact([(best, ALL)])[best, ALL]
    whole_m = train[ALL, 0]
    stats = target_correlations(frame, [columns[a] for a in at], "__y", "__n", "__fold", whole_m.take(at), models, [train[f, 0].take(at) for f in range(folds)])
    features_found = feature_rows(labels, s.dependencies(config), models, overall, [train[f, 0].take(at) for f in range(folds)], whole_m.take(at), stats)
    scores = table[best]["fold_scores"]
    diagnostics = {
        "features": features_found,
        "subnodes": subnode_rows(features_found),
        "alternatives": alternative_rows(features_found, {n: c for n, c in config.items() if g.nodes[n].kind in ("intermediate", "callable", "fitting")}, table[best]["score"]),
        "effective_rank": effective_rank(whole_m.take(at)) if at else 0.0,
        "mean_max_corr": float(np.mean([r["max_corr"] for r in features_found])) if features_found else 0.0,
        "global_ridge": {"alpha": overall.alpha, "intercept": overall.intercept, "residual_reweighted": rules[best] is not None},
        "prediction_std": stats["prediction_std"],
        "residual_std": stats["residual_std"],
        "folds": {"mean": float(np.mean(scores)), "std": float(np.std(scores)), "scores": scores},
        "configuration_search": search_summary([r for r in table if "score" in r], whole, len(configs)),
        "valid_feature_pool": pool_fit(s, configs, per, train[ALL, 0], shift, place, frame, columns),
        "planner": {"planned": len(configs), "total": whole, "axes": coverage(g, configs)},
        "signatures": len({feature_signature(g, c) for c in configs}),
    }
    return Result(table[best]["score"], config, labels, scores, models, table, diagnostics, [m.alpha for m in models])


def pool_fit(s: Superset, configs: list[Config], per: list[list[str]], whole: Moments, shift: np.ndarray, place: dict[str, int], frame, columns: list[str]) -> dict:
    """One unweighted readout over the features of all configurations that were planned, each different matrix side by side."""
    different = list(dict.fromkeys(tuple(p) for p in per))
    pool = [c for matrix in different for c in matrix]
    at = [place[c] for c in pool] + [place["__y"]]
    m = whole.take(at)
    solver = Solver.of(m, m)

    short = solver.merged(at[:-1])  # a feature of several configurations is one column
    own = sorted(set(at[:-1]))

    def held_out(rows: np.ndarray) -> dict[int, np.ndarray]:
        return {0: short.held_out(chosen(rows, own), rows[:, at[-1]], np.ones(len(rows)), rows[:, -1])}

    model = solver.fit(float(ALPHAS[first_least(summed(frame, [*columns, "__n"], held_out).get(0, np.zeros(len(ALPHAS))))]))
    b = np.append(model.coef, -1.0)
    bias = float(m.mean @ b) + model.intercept
    see, n = float(b @ m.cross @ b) + m.n * bias * bias, max(m.n, 1)
    return {"n_configurations": len(different), "n_features": len(pool), "alpha": model.alpha, "intercept": model.intercept, "rmse": float(np.sqrt(max(see, 0.0) / n))}


def _irls_weight(residual: np.ndarray, scale: float) -> np.ndarray:
    size = np.abs(residual)
    return np.where(size <= scale, 1.0, scale / np.maximum(size, 1e-6))


def _select(frame, columns, weight_columns, index, per, w_names, solvers, reweight, place) -> dict:
    """The fit of least leave-one-out error for each (configuration, fold)."""
    names = [*columns, *weight_columns.values(), "__n", "__fold"]
    at_w = {n: len(columns) + i for i, n in enumerate(weight_columns)}
    jobs = [(n, i, f, [place[c] for c in per[i]], at_w[w_names[i]], solvers[i, f]) for n, (i, f) in enumerate(index)]
    extra = None if reweight is None else [(reweight[0][k], reweight[1][k[0]], reweight[2][k]) for k in index]
    y_at = place["__y"]

    def kernel(rows: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        training = {f: np.flatnonzero(rows[:, -1] != f) for f in {job[2] for job in jobs}}
        for n, _, f, at, w_at, sol in jobs:
            here = training[f]
            x, y, w = chosen(rows, at, here), rows[here, y_at], rows[here, w_at]
            if extra is not None:
                model, scale, mean = extra[n]
                w = w * _irls_weight(y - model.predict(x), scale) / max(mean, 1e-300)
            out[n] = sol.held_out(x, y, w, rows[here, -2])
        return out

    losses = summed(frame, names, kernel)
    return {k: solvers[k].fit(float(ALPHAS[first_least(losses[n])])) for n, k in enumerate(index)}


def _reweighted(frame, columns, weight_columns, ruled, per, w_names, w_mean, fits, rules, train, shift, place) -> dict:
    """(moments of its features and target under base weight times residual weight, mean residual weight) of each training fold."""
    names = [*columns, *weight_columns.values(), "__n", "__fold"]
    at_w = {n: len(columns) + i for i, n in enumerate(weight_columns)}
    jobs = [(n, f, [place[c] for c in per[i]], at_w[w_names[i]], fits[i, f], rules[i]) for n, (i, f) in enumerate(ruled)]
    y_at = place["__y"]

    def kernel(rows: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        training = {f: np.flatnonzero(rows[:, -1] != f) for f in {job[1] for job in jobs}}
        for n, f, at, w_at, model, scale in jobs:
            here = training[f]
            v, times = chosen(rows, [*at, y_at], here), rows[here, -2]
            r = _irls_weight(v[:, -1] - model.predict(v[:, :-1]), scale) * times
            u = np.column_stack((np.ones(len(v)), v - shift[[*at, y_at]]))
            out[n] = np.concatenate(([times.sum(), r.sum()], ((u * (rows[here, w_at] * r)[:, None]).T @ u).ravel()))
        return out

    sums = summed(frame, names, kernel)
    out = {}
    for n, k in enumerate(ruled):
        count, r_sum = sums[n][:2]
        mean, at = r_sum / max(count, 1), [*jobs[n][2], y_at]
        out[k] = Moments.of(count, sums[n][2:].reshape(len(at) + 1, -1) / max(mean, 1e-300), shift[at]), mean
    return out


def _errors(frame, columns, index, per, fits, place) -> dict:
    """(n, sum y, sum y^2, sum of squared and of absolute errors) of each validation fold."""
    y_at = place["__y"]
    jobs = [(n, f, [place[c] for c in per[i]], fits[i, f]) for n, (i, f) in enumerate(index)]

    def kernel(rows: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        held = {f: np.flatnonzero(rows[:, -1] == f) for f in {job[1] for job in jobs}}
        for n, f, at, model in jobs:
            here = held[f]
            y, times = rows[here, y_at], rows[here, -2]
            e = y - model.predict(chosen(rows, at, here))
            out[n] = np.array([times.sum(), times @ y, times @ (y * y), times @ (e * e), times @ np.abs(e)])
        return out

    sums = summed(frame, [*columns, "__n", "__fold"], kernel)
    return {k: tuple(sums[n]) for n, k in enumerate(index)}


def result_table(spark, result: Result) -> DataFrame:
    """A row for each planned configuration: its choices, scores, penalties and whether it won."""
    rows = [
        (r["planner_index"], dict(r["config"]), r["n_features"], float(r["approximate_score"]) if "approximate_score" in r else None, float(r["score"]) if "score" in r else None, [float(x) for x in r.get("fold_scores", [])], r["config"] == result.config)
        for r in result.table
    ]
    return spark.createDataFrame(rows, "planner_index int, config map<string,string>, n_features int, approximate_score double, score double, fold_scores array<double>, selected boolean")
