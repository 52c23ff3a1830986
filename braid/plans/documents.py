"""Change documents: what a proposer writes to change a graph, read from text.

A document is a small part of YAML: top-level keys, lists of strings, and lists of one-level mappings, either as
blocks or as JSON on a line. ``add`` may also be keyed by node with one expression for each new alternative.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from .graph import Graph
from .maintain import change

SECTIONS = ("hypotheses", "rationale", "nodes", "add", "remove", "globals")


@dataclass
class Document:
    rationale: str = ""
    hypotheses: list[str] = field(default_factory=list)
    nodes: list[dict] = field(default_factory=list)
    add: list[dict] = field(default_factory=list)
    remove: list[dict] = field(default_factory=list)
    globals: list[dict] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {k: getattr(self, k) for k in SECTIONS}

    def single(self, row: dict) -> Document:
        """One of the additions alone, with all that it may need."""
        return Document(self.rationale, self.hypotheses, self.nodes, [row], [], self.globals)

    def changes(self) -> dict:
        """What :func:`braid.plans.maintain.change` takes."""
        added = [
            {"node": a["target_node"], "id": a["alternative_id"], "primitive": a.get("primitive") or "source", "parents": strings(a.get("parents", [])), "globals": strings(a.get("global_refs", [])), "params": a.get("params") or {}, "source": a.get("source", ""), "contract": a.get("output_contract") or {}}
            for a in self.add
        ]
        return {
            "globals": {x["name"]: numbers(x.get("value", [])) for x in self.globals},
            "nodes": [{"name": n["name"], "kind": n["kind"]} for n in self.nodes],
            "remove": [{"node": r["target_node"], "id": r["alternative_id"]} for r in self.remove],
            "add": added,
        }


def apply(g: Graph, document: Document) -> Graph:
    """A changed copy of the graph. New nodes are intermediate or callable ones."""
    for n in document.nodes:
        if n["kind"] not in ("intermediate", "callable"):
            raise ValueError(f"a document adds no {n['kind']} node")
    out = change(g, document.changes())
    out.trainable |= {x["name"] for x in document.globals if x["name"] in out.globals and truth(x.get("trainable", True))}
    return out


def scalar(text: str):
    """A value on a line: JSON, a quoted string, or a plain one."""
    text = text.strip()
    try:
        return json.loads(text)
    except ValueError:
        pass
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    return text


def strings(value) -> list[str]:
    """A list of strings, also where a list was written as a string."""
    if isinstance(value, str):
        value = scalar(value.strip()) if value.strip().startswith("[") else [x for x in (p.strip() for p in value.split(",")) if x]
        if isinstance(value, str):  # a list in single quotes
            value = [x.strip().strip("'\"") for x in value.strip("[]").split(",") if x.strip()]
    return [str(x) for x in value]


def numbers(value) -> list[float]:
    value = scalar(value) if isinstance(value, str) else value
    return [float(x) for x in (value if isinstance(value, list) else [value])]


def truth(value) -> bool:
    return value.strip().lower() in ("true", "yes", "1") if isinstance(value, str) else bool(value)


def body(text: str) -> str:
    """The document in a text: the fenced block that holds one, or all of it without a language tag."""
    for block in re.findall(r"```[a-z]*\n(.*?)```", text, flags=re.DOTALL):
        if re.search(r"^(add|remove|rationale):", block, flags=re.MULTILINE):
            return block
    return re.sub(r"^\s*ya?ml\s*\n", "", text, flags=re.IGNORECASE)


def parse(text: str) -> Document:
    """A document from text; ValueError where it is none."""
    found: dict[str, object] = {}
    section, item, node = None, None, None
    for line in body(text).splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        depth = len(line) - len(line.lstrip(" "))
        key, colon, rest = bare.partition(":")
        if depth == 0:
            if not colon:
                raise ValueError(f"no key on the line {line!r}")
            section, item, node = key.strip(), None, None
            found[section] = scalar(rest) if rest.strip() else []
        elif section is None:
            raise ValueError(f"a line without a section: {line!r}")
        elif bare == "[]":
            found[section] = []
        elif bare.startswith("- "):
            value = bare[2:].strip()
            mapping = re.match(r"[A-Za-z_][\w-]*:(\s|$)", value)
            if node is not None:
                found[section].append(_expression(node, scalar(value), sum(a["target_node"] == node for a in found[section])))
                continue
            item = {mapping[0].strip()[:-1]: scalar(value[mapping.end() :])} if mapping else None
            found[section].append(scalar(value) if item is None else item)
        elif item is not None and colon:
            item[key.strip()] = scalar(rest)
        elif section == "add" and colon and not rest.strip():
            node = key.strip()
        else:
            raise ValueError(f"only lists and mappings of one level are read: {line!r}")
    rows = {k: found.get(k) or [] for k in ("nodes", "add", "remove", "globals")}
    rows["remove"] = [_removal(r) if isinstance(r, str) else r for r in rows["remove"]]
    for name, own in rows.items():
        if not isinstance(own, list) or not all(isinstance(r, dict) for r in own):
            raise ValueError(f"{name} is a list of mappings")
    return Document(str(found.get("rationale") or ""), strings(found.get("hypotheses") or []), **rows)


def _removal(name: str) -> dict:
    node, dot, id = name.partition(".")
    if not dot:
        raise ValueError(f"{name!r} is not node.alternative")
    return {"target_node": node, "alternative_id": id}


def _expression(node: str, item, place: int) -> dict:
    """An addition from its expression; its parents are what it takes from ``values``, its id depends on its text."""
    row = dict(item) if isinstance(item, dict) else {"source": str(item)}
    source = row.get("source", "")
    taken = lambda what: list(dict.fromkeys(re.findall(rf"{what}\[\s*['\"](\w+)['\"]\s*\]", source)))
    row.setdefault("parents", taken("values"))
    row.setdefault("global_refs", taken("globals"))
    row.setdefault("alternative_id", f"source_{hashlib.sha256(f'{node}|{source}'.encode()).hexdigest()[:10]}")
    return {"primitive": "source", "target_node": node} | row
