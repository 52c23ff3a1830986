"""What an evaluation reports: features, the alternatives behind them, the search, and what to look at first.

These are tables of one row for each feature or configuration of a graph, so they are made on the driver.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

from .linalg import EPS, Moments, Ridge, correlations

TOP = 8
LIKELY_COPY, UNSTABLE = 0.98, 0.25


def feature_rows(labels: list[str], dependencies: list[list[str]], models: list[Ridge], overall: Ridge, train: list[Moments], whole: Moments, stats: dict) -> list[dict]:
    """A row for each feature of the winner, the most important first. Coefficients are those of z-scores."""
    p = len(labels)
    if not p:
        return []
    unit = lambda m: np.where(m.std < EPS, 1.0, m.std)
    coef = np.array([m.coef * unit(t) for m, t in zip(models, train, strict=True)])
    mean, std, size = coef.mean(axis=0), coef.std(axis=0), np.abs(coef).mean(axis=0)
    own = overall.coef * unit(whole)
    given = np.abs(overall.coef) * stats["distance"]  # mean magnitude of z times coefficient
    corr = correlations(whole)
    rows = [
        {
            "name": labels[j],
            "dependencies": dependencies[j],
            "depth": len(dependencies[j]),
            "importance": float(size[j] / max(size.sum(), EPS)),
            "coef_sign": int(np.sign(mean[j])),
            "target_alignment": float(abs(stats["target"][j])),
            "target_corr": float(stats["target"][j]),
            "target_quadratic_corr": float(stats["target_squared"][j]),
            "max_corr": float(corr[j].max(initial=0)),
            "n_high_corr": int((corr[j] > 0.9).sum()),
            "most_correlated": labels[int(corr[j].argmax())] if corr[j].max(initial=0) > 0 else "",
            "redundancy": float(corr[j].max(initial=0)),
            "residual_corr": float(stats["residual"][j]),
            "residual_quadratic_corr": float(stats["residual_squared"][j]),
            "weight_stability": float(abs(mean[j]) / max(std[j], EPS)),
            "mean_abs_coef": float(size[j]),
            "global_coef": float(own[j]),
            "shap_mean": 0.0,  # z-scores have mean 0
            "shap_mean_abs": float(given[j]),
            "shap_std": float(abs(overall.coef[j]) * whole.std[j]),
            "shap_importance": float(given[j] / max(given.sum(), EPS)),
            "shap_target_corr": float(np.sign(overall.coef[j]) * stats["target"][j]),
            "cv_shap_mean_abs": float(stats["held_out_distance"][j]),
        }
        for j in range(p)
    ]
    return sorted(rows, key=lambda r: -r["importance"])


#: What a roll-up of features holds for each alternative: its name, the feature's field, and how values are taken together.
ROLLED = (
    ("importance", "importance", sum),
    ("shap_importance", "shap_importance", sum),
    ("max_target_alignment", "target_alignment", lambda v: max(0.0, *v)),
    ("mean_abs_shap", "shap_mean_abs", np.mean),
    ("mean_abs_residual_corr", "residual_corr", lambda v: np.mean(np.abs(v))),
    ("mean_redundancy", "redundancy", np.mean),
    ("mean_weight_stability", "weight_stability", np.mean),
)


def subnode_rows(features: list[dict]) -> list[dict]:
    """The features by each alternative that they depend on, the most important first."""
    held: dict[str, list[dict]] = {}
    for row in features:
        for name in row["dependencies"]:
            held.setdefault(name, []).append(row)
    rows = [{"name": name, "feature_count": len(own)} | {out: float(take([r[key] for r in own])) for out, key, take in ROLLED} for name, own in held.items()]
    return sorted(rows, key=lambda r: -r["importance"])


def alternative_rows(features: list[dict], chosen: dict[str, str], score: float) -> list[dict]:
    """:func:`subnode_rows` with the chosen alternatives marked; chosen ones without features have zeros."""
    rows = {r["name"]: r | {"selected": False} for r in subnode_rows(features)}
    for node, id in chosen.items():
        name = f"{node}.{id}"
        rows.setdefault(name, {"name": name, "feature_count": 0} | {out: 0.0 for out, _, _ in ROLLED})["selected"] = True
    for name, row in rows.items():
        node, _, id = name.rpartition(".")
        row |= {"node": node, "alternative": id, "config_score": float(score)}
    return sorted(rows.values(), key=lambda r: (-r["importance"], -r["max_target_alignment"], r["name"]))


def search_summary(rows: list[dict], total: int, planned: int, top: int = TOP) -> dict:
    """The search over configurations (rows with ``score``, ``n_features`` and ``config``) in figures, with its ``top`` rows."""
    scores = np.array([r["score"] for r in rows])
    best = sorted(rows, key=lambda r: -r["score"])[:top]
    some = len(scores) > 0
    return {
        "evaluated": len(rows),
        "planned": planned,
        "total": total,
        "capped": total > len(rows),
        "planner_capped": total > planned,
        "screening_capped": planned > len(rows),
        "score_range": [float(scores.min()), float(scores.max())] if some else [0.0, 0.0],
        "score_mean": float(scores.mean()) if some else 0.0,
        "score_std": float(scores.std()) if some else 0.0,
        "best_config_score": float(scores.max()) if some else 0.0,
        "n_features_global": sum(r["n_features"] for r in rows),
        "n_features_best_config": best[0]["n_features"] if best else 0,
        "top_configs": [{k: r[k] for k in ("score", "n_features", "config")} for r in best],
    }


def feedback(result, most: int = TOP) -> dict:
    """What to look at first: the top of each table, and features that are likely copies or unstable."""
    d = result.diagnostics
    risky = [r for r in d["features"] if r["redundancy"] > LIKELY_COPY or r["weight_stability"] < UNSTABLE]
    return {
        "score": result.score,
        "config": result.config,
        "top_features": d["features"][:most],
        "top_subnodes": d["subnodes"][:most],
        "top_alternatives": d["alternatives"][:most],
        "risky_features": risky[:most],
        "configuration_search": d["configuration_search"],
        "folds": d["folds"],
    }


def write_report(path: str, title: str, rows: list[dict], **facts) -> None:
    """``path``.json with all there is, and ``path``.md with the rows as a table."""
    Path(f"{path}.json").write_text(json.dumps({"title": title, **facts, "rows": rows}, indent=1, sort_keys=True) + "\n")
    columns = list(dict.fromkeys(k for r in rows for k in r))
    shown = lambda v: f"{v:.6g}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [f"# {title}", "", *(f"* {k}: {shown(v)}" for k, v in facts.items()), "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(shown(r.get(c)) for c in columns) + " |" for r in rows]
    Path(f"{path}.md").write_text("\n".join(lines) + "\n")
