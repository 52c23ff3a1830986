"""The graph: nodes whose alternatives compete, and its translation to one projection.

Alternatives name a primitive, parents and parameters; they hold no data and no code.
Node kinds: ``input``, ``intermediate``, ``callable``, ``output``, ``fitting``.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

KINDS = ("input", "intermediate", "callable", "output", "fitting")
CHOSEN = ("intermediate", "callable", "fitting")
FITTING_NAMES = ("ridge_w", "ridge_g")


@dataclass(frozen=True)
class Alternative:
    id: str
    primitive: str
    parents: tuple[str, ...] = ()
    globals: tuple[str, ...] = ()
    params: tuple[tuple[str, float], ...] = ()
    source: str = ""  # of the primitive "source": an expression over the parents
    contract: tuple[tuple[str, object], ...] = ()  # what the result has to be: type, n_columns, min_columns, max_columns

    def meaning(self) -> tuple:
        return (self.primitive, self.parents, self.globals, self.params, self.source)

    def to_dict(self) -> dict:
        more = ({"source": self.source} if self.source else {}) | ({"contract": dict(self.contract)} if self.contract else {})
        return {"id": self.id, "primitive": self.primitive, "parents": list(self.parents), "globals": list(self.globals), "params": dict(self.params)} | more

    @classmethod
    def from_dict(cls, d: dict) -> Alternative:
        pairs = lambda key: tuple(sorted(d.get(key, {}).items()))
        return cls(d["id"], d["primitive"], tuple(d.get("parents", ())), tuple(d.get("globals", ())), pairs("params"), d.get("source", ""), pairs("contract"))

    def check(self, columns: int) -> None:
        """Raise unless a block of so many columns is what the contract says."""
        says = dict(self.contract)
        if says.get("type", "feature_block") not in ("feature_block", "array"):
            raise TypeError(f"{self.id} gives features, not a {says['type']}")
        for key, wrong in (("n_columns", lambda n: columns != n), ("min_columns", lambda n: columns < n), ("max_columns", lambda n: columns > n)):
            if says.get(key) is not None and wrong(int(says[key])):
                raise ValueError(f"{self.id} gives {columns} columns; its contract says {key} {says[key]}")


@dataclass
class Node:
    name: str
    kind: str
    alternatives: list[Alternative] = field(default_factory=list)

    def alternative(self, id: str) -> Alternative:
        for a in self.alternatives:
            if a.id == id:
                return a
        raise KeyError(f"{self.name} has no alternative {id!r}")


@dataclass
class Graph:
    name: str
    nodes: dict[str, Node] = field(default_factory=dict)
    globals: dict[str, list[float]] = field(default_factory=dict)
    trainable: set[str] = field(default_factory=set)

    def add(self, name: str, kind: str, *alternatives: Alternative) -> Node:
        if kind not in KINDS:
            raise ValueError(f"unknown node kind {kind!r}")
        if name in self.nodes:
            raise ValueError(f"node {name!r} is there already")
        self.nodes[name] = Node(name, kind, list(alternatives))
        return self.nodes[name]

    def clone(self) -> Graph:
        return graph_from_dict(graph_to_dict(self))

    def of_kind(self, *kinds: str) -> list[Node]:
        return [n for n in self.nodes.values() if n.kind in kinds]

    def reachable(self, roots: list[str] | None = None) -> set[str]:
        """Nodes that the roots (outputs and fitting rules, if none are given) depend on, themselves included."""
        todo = list(roots) if roots is not None else [n.name for n in self.of_kind("output", "fitting")]
        seen: set[str] = set()
        while todo:
            name = todo.pop()
            if name not in seen:
                seen.add(name)
                todo += [p for a in self.nodes[name].alternatives for p in a.parents]
        return seen

    def space(self) -> dict[str, list[str]]:
        live = self.reachable()
        return {n.name: [a.id for a in n.alternatives] for n in self.of_kind(*CHOSEN) if n.name in live and n.alternatives}

    def default_config(self) -> dict[str, str]:
        return {name: ids[0] for name, ids in self.space().items()}

    def validate(self) -> None:
        """Raise unless the graph is a DAG of known parents with one output and known fitting nodes."""
        if len(self.of_kind("output")) != 1:
            raise ValueError("a graph has exactly one output node")
        for n in self.of_kind("fitting"):
            if n.name not in FITTING_NAMES:
                raise ValueError(f"fitting nodes are {FITTING_NAMES}, not {n.name!r}")
        state: dict[str, int] = {}
        for root in self.nodes:
            stack = [(root, iter(self._parents(root)))]
            if state.get(root):
                continue
            state[root] = 1
            while stack:
                name, parents = stack[-1]
                for p in parents:
                    if p not in self.nodes:
                        raise ValueError(f"{name} has an unknown parent {p!r}")
                    if state.get(p) == 1:
                        raise ValueError(f"a cycle goes through {p!r}")
                    if not state.get(p):
                        state[p] = 1
                        stack.append((p, iter(self._parents(p))))
                        break
                else:
                    state[name] = 2
                    stack.pop()
        for n in self.nodes.values():
            for a in n.alternatives:
                for g in a.globals:
                    if g not in self.globals:
                        raise ValueError(f"{n.name}.{a.id} refers to an unknown global {g!r}")

    def _parents(self, name: str) -> list[str]:
        return [p for a in self.nodes[name].alternatives for p in a.parents]


def graph_to_dict(g: Graph) -> dict:
    nodes = [{"name": n.name, "kind": n.kind, "alternatives": [a.to_dict() for a in n.alternatives]} for n in g.nodes.values()]
    return {"name": g.name, "nodes": nodes, "globals": {k: list(v) for k, v in g.globals.items()}, "trainable": sorted(g.trainable)}


def graph_from_dict(d: dict) -> Graph:
    g = Graph(d["name"], globals={k: list(map(float, v)) for k, v in d.get("globals", {}).items()}, trainable=set(d.get("trainable", ())))
    for n in d["nodes"]:
        g.add(n["name"], n["kind"], *map(Alternative.from_dict, n["alternatives"]))
    return g


def graph_hash(g: Graph) -> str:
    return hashlib.sha256(json.dumps(graph_to_dict(g), sort_keys=True).encode()).hexdigest()


def write_graph(g: Graph, path: str, **metadata) -> None:
    with open(path, "w") as out:
        json.dump({"hash": graph_hash(g), "graph": graph_to_dict(g), "metadata": metadata}, out, indent=1, sort_keys=True)


def read_graph(path: str) -> Graph:
    with open(path) as f:
        d = json.load(f)
    g = graph_from_dict(d["graph"])
    if d.get("hash") not in (None, graph_hash(g)):
        raise ValueError("the graph is not the one that was hashed")
    return g


def feature_signature(g: Graph, config: dict[str, str]) -> tuple:
    """What a configuration's features depend on; equal for configurations that share a feature matrix."""
    memo: dict[str, tuple] = {}

    def of(name: str) -> tuple:
        if name not in memo:
            node = g.nodes[name]
            if node.kind == "input":
                memo[name] = (name,)
            else:
                memo[name] = alternative(node.alternative(config.get(name, node.alternatives[0].id)))
        return memo[name]

    def alternative(a: Alternative) -> tuple:
        return (a.primitive, a.params, a.source, tuple((n, tuple(g.globals[n])) for n in a.globals), tuple(of(p) for p in a.parents))

    return tuple((a.id, alternative(a)) for n in g.of_kind("output") for a in n.alternatives)


#: The shared numbers of both seed graphs; names of their nodes, alternatives and primitives below are fixed too.
_SHARED = {"gate_scale": [1.0], "projection_vector": [0.2 + 0.8 * i / 15 for i in range(16)], "residual_huber_scale": [1.0]}


def _finish(g: Graph, parents: tuple[str, ...], weights: list[Alternative]) -> Graph:
    g.globals, g.trainable = {k: list(v) for k, v in _SHARED.items()}, {"gate_scale", "projection_vector"}
    gate = ("gate_scale",)
    g.add("activation", "callable", Alternative("identity", "identity_callable"), Alternative("sigmoid_gate", "sigmoid_gate_callable", (), gate), Alternative("clipped_linear", "clipped_linear_callable", (), gate))
    g.add("output", "output", Alternative("raw_concat", "pass_outputs", parents), Alternative("activated", "activated_outputs", (*parents, "activation")), Alternative("projection", "projection_outputs", parents, ("projection_vector",)))
    g.add("ridge_w", "fitting", *weights)
    g.add("ridge_g", "fitting", Alternative("identity", "identity_residual_weight"), Alternative("huber", "huber_residual_weight", (), ("residual_huber_scale",)))
    g.validate()
    return g


def tabular_seed(source: str = "x") -> Graph:
    g = Graph("tabular_seed")
    g.add(source, "input")
    p = (source,)
    g.add("base_features", "intermediate", Alternative("raw", "tabular_raw", p), Alternative("centered", "tabular_centered", p))
    g.add("nonlinear_features", "intermediate", Alternative("abs", "tabular_abs", p), Alternative("square", "tabular_square", p), Alternative("interactions", "tabular_low_rank_interactions", p))
    g.add("summary_features", "intermediate", Alternative("summary", "tabular_summary", p))
    return _finish(g, ("base_features", "nonlinear_features", "summary_features"), [Alternative("uniform", "uniform_sample_weight")])


def structural_seed(source: str = "series") -> Graph:
    g = Graph("structural_break_seed")
    g.add(source, "input")
    g.add("boundary", "input")
    p = (source,)
    g.add("segment_stats", "intermediate", Alternative("basic", "segment_basic", p), Alternative("robust", "segment_robust", p))
    g.add("trend_stats", "intermediate", Alternative("linear", "trend_basic", p))
    g.add("shape_stats", "intermediate", Alternative("cusum", "cusum_basic", p), Alternative("spectral", "spectral_basic", p))
    return _finish(g, ("segment_stats", "trend_stats", "shape_stats"), [Alternative("uniform", "uniform_sample_weight"), Alternative("boundary_energy", "boundary_energy_weight", p)])


def without(g: Graph, node: str, id: str) -> Graph:
    """A copy of the graph without an alternative."""
    out = g.clone()
    out.nodes[node].alternatives = [a for a in out.nodes[node].alternatives if a.id != id]
    return out


def with_alternative(g: Graph, node: str, a: Alternative) -> Graph:
    out = g.clone()
    if any(b.id == a.id for b in out.nodes[node].alternatives):
        a = replace(a, id=f"{a.id}_{len(out.nodes[node].alternatives)}")
    out.nodes[node].alternatives.append(a)
    out.validate()
    return out
