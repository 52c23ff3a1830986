"""Task schemas: what each input is, inferred from a DataFrame's types and names or read from JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Names that tell what an input is, its kind and its roles.
KNOWN: dict[tuple[str, ...], tuple[str, tuple[str, ...]]] = {
    ("regime", "regime_id", "degradation_regime"): ("regime_id", ("regime",)),
    ("fault", "fault_mode", "fault_id"): ("fault_mode", ("fault_mode",)),
    ("group", "group_id", "unit", "unit_id", "engine", "engine_id", "entity", "entity_id", "sample_id"): ("group_id", ("group", "unit")),
    ("time", "time_index", "cycle", "cycle_index", "timestamp"): ("time_index", ("time", "sequence")),
    ("event", "event_label", "event_indicator"): ("event_label", ("event",)),
    ("censoring", "censoring_indicator", "censored"): ("censoring_indicator", ("censoring",)),
}


@dataclass(frozen=True)
class InputSpec:
    name: str
    kind: str = "numeric_vector"
    description: str = ""
    shape: tuple[str, ...] = ("n_samples",)
    roles: tuple[str, ...] = ()


@dataclass(frozen=True)
class TaskSchema:
    name: str
    kind: str
    inputs: tuple[InputSpec, ...]
    target: InputSpec = InputSpec("y", "numeric_target", "1-D target aligned with n_samples.")
    default_input: str = ""
    metadata: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = [i.name for i in self.inputs]
        if not names or len(set(names)) != len(names):
            raise ValueError("a schema has inputs, each of its own name")
        if self.default_input and self.default_input not in names:
            raise ValueError(f"the default input {self.default_input!r} is no input")
        object.__setattr__(self, "default_input", self.default_input or names[0])

    def input(self, name: str) -> InputSpec:
        return next((i for i in self.inputs if i.name == name), None) or _no_input(name)

    def with_role(self, *roles: str) -> list[str]:
        return [i.name for i in self.inputs if set(roles) & set(i.roles)]

    def role_map(self) -> dict[str, list[str]]:
        return {role: self.with_role(role) for role in dict.fromkeys(r for i in self.inputs for r in i.roles)}

    def to_dict(self) -> dict:
        return json.loads(json.dumps(asdict(self)))

    @classmethod
    def from_dict(cls, d: dict) -> TaskSchema:
        spec = lambda x: InputSpec(x["name"], x.get("kind", "numeric_vector"), x.get("description", ""), tuple(x.get("shape", ("n_samples",))), tuple(x.get("roles", ())))
        target = {"target": spec(d["target"])} if "target" in d else {}
        return cls(d["name"], d["kind"], tuple(map(spec, d["inputs"])), default_input=d.get("default_input", ""), metadata=dict(d.get("metadata") or {}), **target)


def _no_input(name: str):
    raise KeyError(f"no input {name!r}")


def infer_schema(df: DataFrame, default_input: str = "", target: str = "y", name: str = "external-tabular") -> TaskSchema:
    """The schema of a table's columns but the target: kinds from types and names, roles from names."""
    columns = [f for f in df.schema.fields if f.name != target]
    first = default_input if any(f.name == default_input for f in columns) else columns[0].name
    specs = []
    for f in columns:
        wide = isinstance(f.dataType, T.ArrayType)
        kind, roles = ("numeric_matrix" if wide else "numeric_vector"), (("feature",) if f.name == first else ())
        for names, (known, more) in KNOWN.items():
            if f.name.lower() in names:
                kind, roles = known, tuple(dict.fromkeys((*roles, *more)))
        specs.append(InputSpec(f.name, kind, f"Inferred input {f.name!r}.", ("n_samples", "n_features") if wide else ("n_samples",), roles))
    return TaskSchema(name, "tabular", tuple(specs), default_input=first, metadata={"inferred": True})


def schema_of(what: TaskSchema | dict | str | None, df: DataFrame | None = None, **infer) -> TaskSchema:
    """A schema from itself, a dictionary, a JSON file, or a table."""
    if isinstance(what, TaskSchema):
        return what
    if isinstance(what, dict):
        return TaskSchema.from_dict(what)
    if what:
        return TaskSchema.from_dict(json.loads(Path(what).expanduser().read_text()))
    if df is None:
        raise ValueError("a schema or a table is needed")
    return infer_schema(df, **infer)
