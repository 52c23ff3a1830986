"""Cleaning graphs, changing them by documents, and carrying nodes between them."""

from __future__ import annotations

from dataclasses import dataclass, field

from .graph import Alternative, Graph, Node

Change = dict


@dataclass
class Report:
    collapsed: list[str] = field(default_factory=list)
    nodes: list[str] = field(default_factory=list)
    globals: list[str] = field(default_factory=list)


def clean(g: Graph) -> tuple[Graph, Report]:
    """A copy without repeated alternatives, empty nodes, unreachable nodes and unused globals, in this order."""
    g, report = g.clone(), Report()
    for node in g.nodes.values():
        first: dict[tuple, Alternative] = {}
        for a in node.alternatives:
            if a.meaning() in first:
                report.collapsed.append(f"{node.name}.{a.id}")
            else:
                first[a.meaning()] = a
        node.alternatives = list(first.values())
    live_roots = {n.name for n in g.of_kind("output", "fitting")}
    empty = [n.name for n in g.nodes.values() if n.kind != "input" and not n.alternatives and n.name not in live_roots]
    for name in empty:
        del g.nodes[name]
    reachable = g.reachable()
    lost = [n.name for n in g.nodes.values() if n.kind != "input" and n.name not in reachable]
    for name in lost:
        del g.nodes[name]
    report.nodes = empty + lost
    used = {x for n in g.nodes.values() for a in n.alternatives for x in a.globals}
    report.globals = [x for x in g.globals if x not in used]
    for x in report.globals:
        del g.globals[x]
    g.trainable &= set(g.globals)
    g.validate()
    return g, report


def change(g: Graph, document: Change) -> Graph:
    """A changed copy: new globals, then nodes, removals, additions; then cleaned and checked. The graph itself is not touched.

    ``document`` may have ``globals`` (name to values), ``nodes`` (name, kind), ``remove``
    and ``add`` (node, and an id or an alternative). Globals can be added, not replaced.
    """
    out = g.clone()
    for name, values in document.get("globals", {}).items():
        if name in out.globals:
            raise ValueError(f"global {name!r} is there already")
        out.globals[name] = list(map(float, values))
    for n in document.get("nodes", ()):
        out.add(n["name"], n["kind"])
    for r in document.get("remove", ()):
        node = out.nodes[r["node"]]
        node.alternative(r["id"])
        node.alternatives = [a for a in node.alternatives if a.id != r["id"]]
        if not node.alternatives:
            raise ValueError(f"{node.name} would have no alternative")
    for a in document.get("add", ()):
        node = out.nodes[a["node"]]
        if any(b.id == a["id"] for b in node.alternatives):
            raise ValueError(f"{node.name}.{a['id']} is there already")
        if node.kind == "input":
            raise ValueError(f"{node.name} is an input")
        node.alternatives.append(Alternative.from_dict(a))
    out.validate()
    return clean(out)[0]


def transfer(source: Graph, target: Graph) -> tuple[Graph, dict[str, int]]:
    """A copy of ``target`` with the alternatives of ``source`` that fit, and counts of why others did not.

    A node is matched by name and kind; an alternative needs its parents and globals there
    with equal kinds and lengths, and is left out if its meaning or id is known or it would close a cycle.
    """
    out, why = target.clone(), {}

    def count(reason: str) -> None:
        why[reason] = why.get(reason, 0) + 1

    for node in source.nodes.values():
        own: Node | None = out.nodes.get(node.name)
        for a in node.alternatives:
            if own is None or own.kind != node.kind:
                count("no such node")
            elif any(p not in out.nodes or out.nodes[p].kind != source.nodes[p].kind for p in a.parents):
                count("parents differ")
            elif any(len(out.globals.get(x, ())) != len(source.globals[x]) for x in a.globals):
                count("globals differ")
            elif any(b.meaning() == a.meaning() for b in own.alternatives):
                count("known already")
            elif any(b.id == a.id for b in own.alternatives):
                count("id taken")
            else:
                own.alternatives.append(a)
                try:
                    out.validate()
                    count("copied")
                except ValueError:
                    own.alternatives.pop()
                    count("cycle")
    return out, why


def search(g: Graph, score, proposals, steps: int, strict: bool = False):
    """Mutate, evaluate, promote: (graph, score, log). ``score`` maps a graph to a number, higher better; ``proposals`` yields documents.

    A document that fails is logged and skipped. One that does not improve is tried again
    addition by addition. Equal scores are accepted unless ``strict``.
    """
    best, log = score(g), []
    better = lambda s: s > best if strict else s >= best
    for step, document in zip(range(steps), proposals, strict=False):
        tries = [document, *({"add": [a], "globals": document.get("globals", {})} for a in document.get("add", ()) if len(document.get("add", ())) > 1)]
        entry = {"step": step, "accepted": False, "score": None, "best_score": best}
        for doc in tries:
            try:
                candidate = change(g, doc)
                s = score(candidate)
            except (KeyError, ValueError, TypeError) as error:
                entry["error"] = str(error)
                continue
            entry["score"] = s
            if better(s):
                g, best = candidate, s
                entry |= {"accepted": True, "best_score": best, "salvaged": doc is not document}
                break
        log.append(entry)
    return g, best, log


_SEGMENTS = ("segment_stats", "trend_stats", "shape_stats")
#: Fixed values: (node, primitive, parents) of the additions that a search may draw on when nothing else proposes.
_ADDITIONS = (
    ("base_features", "tabular_signed_log", ("x",)),
    ("base_features", "tabular_sine", ("x",)),
    ("nonlinear_features", "tabular_tanh", ("x",)),
    ("nonlinear_features", "tabular_sine_interactions", ("x",)),
    ("nonlinear_features", "tabular_gated_log", ("x",)),
    ("summary_features", "tabular_quantile_summary", ("x",)),
    ("ridge_w", "tabular_row_norm_weight", ("x",)),
    ("output", "pass_outputs", ("base_features", "summary_features")),
    ("output", "activated_outputs", ("base_features", "nonlinear_features", "activation")),
    ("output", "projection_outputs", ("base_features", "nonlinear_features")),
    ("shape_stats", "spectral_basic", ("series",)),
    ("segment_stats", "segment_robust", ("series",)),
    ("segment_stats", "segment_late_shift", ("series",)),
    ("trend_stats", "trend_late_window", ("series",)),
    ("segment_stats", "row_recent_change", ("series",)),
    ("shape_stats", "row_volatility_burst", ("series",)),
    ("shape_stats", "row_cusum_local", ("series",)),
    ("activation", "sigmoid_gate_callable", ()),
    ("output", "structural_break_baseline_outputs", ("series",)),
    ("output", "event_detection_outputs", ("series",)),
    ("output", "interaction_outputs", _SEGMENTS),
    ("output", "row_local_outputs", ("series",)),
    ("output", "row_time_basis_outputs", ("series",)),
    ("output", "row_multiscale_tail_outputs", ("series",)),
    ("output", "row_baseline_outputs", ("series",)),
    ("output", "row_context_outputs", ("series",)),
    ("output", "projection_outputs", _SEGMENTS),
    ("shape_stats", "shape_drawdown", ("series",)),
    ("shape_stats", "shape_post_concentration", ("series",)),
    ("ridge_w", "boundary_energy_weight", ("series",)),
    ("ridge_w", "late_energy_weight", ("series",)),
    ("ridge_g", "huber_residual_weight", ()),
)
_NUMBERS = {"projection_outputs": ["projection_vector"], "sigmoid_gate_callable": ["gate_scale"], "huber_residual_weight": ["residual_huber_scale"]}
BUILT_IN = [{"add": [{"node": node, "id": f"{primitive}_added", "primitive": primitive, "parents": list(parents), "globals": _NUMBERS.get(primitive, [])}]} for node, primitive, parents in _ADDITIONS]
