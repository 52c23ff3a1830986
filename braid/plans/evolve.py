"""Searching graphs: propose, change, evaluate, promote; in one line or on islands, with a log that a later run goes on from.

What is kept under a run's folder: ``events.jsonl`` (a line for each step, flushed to disk before the next step begins),
``best.json`` (the best graph, replaced whole) and ``archive/`` (every graph that was promoted).
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from .documents import Document, apply
from .graph import Graph, graph_hash, graph_to_dict, read_graph, write_graph

Score = Callable[[Graph], float]
Propose = Callable[[Graph, float, int], Document]
Repair = Callable[[Graph, Document, str], Document | None]
FAILURES = (KeyError, ValueError, TypeError)


class Stopped(RuntimeError):
    """A run has reached its limit."""


@dataclass
class Guard:
    """Limits of a run; ``now`` is a clock in seconds."""

    seconds: float | None = None
    memory_mb: float | None = None
    now: Callable[[], float] = time.monotonic
    began: float | None = None

    def check(self, *_: object) -> None:
        """Raise if the run is over its time, or the driver over its memory. Also a progress callback."""
        self.began = self.now() if self.began is None else self.began
        if self.seconds is not None and self.now() - self.began > self.seconds:
            raise Stopped(f"{self.seconds} s are over")
        if self.memory_mb is not None and resident_mb() > self.memory_mb:
            raise Stopped(f"more than {self.memory_mb} MB are in use")


def resident_mb() -> float:
    """The memory of this process; 0 where the system does not tell."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20
    except OSError:
        return 0.0


@dataclass
class Run:
    """The state of a search: the graph, its score, how often it was replaced, and the events so far."""

    graph: Graph
    score: float
    version: int = 0
    step: int = 0
    events: list[dict] = field(default_factory=list)


class Log:
    """A run's folder."""

    def __init__(self, folder: str):
        self.at = Path(folder)
        (self.at / "archive").mkdir(parents=True, exist_ok=True)

    def event(self, row: dict) -> None:
        with open(self.at / "events.jsonl", "ab+") as out:
            if out.tell():
                out.seek(-1, os.SEEK_END)
                if out.read(1) != b"\n":  # a line was torn
                    out.write(b"\n")
            out.write(json.dumps(row, sort_keys=True).encode() + b"\n")
            out.flush()
            os.fsync(out.fileno())

    def events(self) -> list[dict]:
        """The lines that parse; a torn last line is the step that did not end."""
        rows = []
        path = self.at / "events.jsonl"
        for line in path.read_text().splitlines() if path.exists() else ():
            try:
                rows.append(json.loads(line))
            except ValueError:
                continue
        return rows

    def promoted(self, run: Run) -> None:
        about = {"score": run.score, "version": run.version, "step": run.step}
        write_graph(run.graph, str(self.at / "archive" / f"{run.version:06}.json"), **about)
        write_graph(run.graph, str(self.at / "best.new"), **about)
        os.replace(self.at / "best.new", self.at / "best.json")

    def best(self) -> tuple[Graph, dict] | None:
        path = self.at / "best.json"
        return (read_graph(str(path)), json.loads(path.read_text())["metadata"]) if path.exists() else None


def promotes(score: float, best: float, strict: bool = False) -> bool:
    return score > best if strict else score >= best


def attempt(run: Run, document: Document, score: Score, validate: Score | None = None, strict: bool = False, repair: Repair | None = None) -> tuple[Run, dict]:
    """One step: the run after it, and its event.

    A document that fails may be repaired once. One that does not improve is tried again addition by addition, each
    on what was promoted before. With ``validate`` a graph has to be strictly better by both scores.
    """
    event: dict = {"step": run.step + 1, "accepted": False, "score": None, "mutation": document.to_dict(), "salvaged": []}

    def better(g: Graph, than: Run) -> tuple[bool, float]:
        s = score(g)
        ok = promotes(s, than.score, strict or validate is not None)
        return ok and (validate is None or validate(g) > validate(than.graph)), s

    def tried(own: Document, base: Run) -> tuple[Run | None, float | None, str]:
        try:
            g = apply(base.graph, own)
            ok, s = better(g, base)
            return (Run(g, s, base.version + 1, run.step) if ok else None), s, ""
        except FAILURES as error:
            return None, None, f"{type(error).__name__}: {error}"

    done, s, error = tried(document, run)
    if error and repair and (again := repair(run.graph, document, error)) is not None:
        event |= {"first_error": error, "mutation": again.to_dict()}
        document = again
        done, s, error = tried(document, run)
    if error:
        event["error"] = error
    event |= {"score": s, "accepted": done is not None}
    if done is None and not error and len(document.add) > 1:
        base = run
        for row in document.add:
            kept, _, _ = tried(document.single(row), base)
            if kept is not None:
                base = kept
                event["salvaged"].append(f"{row['target_node']}.{row['alternative_id']}")
        done = base if base is not run else None
    out = done or Run(run.graph, run.score, run.version)
    out.step, out.events = run.step + 1, [*run.events, event]
    event |= {"best_score": out.score, "version": out.version, "graph": graph_hash(out.graph)}
    return out, event


def evolve(
    g: Graph, score: Score, propose: Propose, steps: int, folder: str | None = None, validate: Score | None = None, strict: bool = False, repair: Repair | None = None, guard: Guard | None = None,
) -> Run:
    """Go ``steps`` steps from ``g``, or on from what ``folder`` holds. A guard that stops the run leaves what was promoted."""
    log = Log(folder) if folder else None
    known = log.best() if log else None
    if known:
        run = Run(known[0], known[1]["score"], known[1]["version"], max([known[1]["step"], *(e["step"] for e in log.events())]), log.events())
    else:
        run = Run(g.clone(), score(g))
        if log:
            log.promoted(run)
    for _ in range(max(0, steps - run.step)):
        try:
            if guard:
                guard.check()
            before = run.version
            run, event = attempt(run, propose(run.graph, run.score, run.step + 1), score, validate, strict, repair)
        except Stopped as stop:
            if log:
                log.event({"step": run.step, "stopped": str(stop), "best_score": run.score})
            return run
        if log:
            if run.version > before:
                log.promoted(run)
            log.event(event)
    return run


def islands(graphs: list[Graph], score: Score, propose: Propose, rounds: int, migrate_every: int = 0, threads: int = 1, folder: str | None = None, **how) -> list[Run]:
    """Several searches side by side, a step of each in a round; every ``migrate_every`` rounds the best graph replaces the worst island's.

    With ``threads`` the islands' Spark jobs of a round run at the same time. What a round proposes is judged against the island's
    graph when the round began; a result whose island has been replaced since is stale and is logged, not promoted.
    """
    log = Log(folder) if folder else None
    runs = [Run(g.clone(), score(g)) for g in graphs]
    for turn in range(1, rounds + 1):
        base = list(runs)
        work = lambda i: attempt(base[i], propose(base[i].graph, base[i].score, turn), score, **how)
        with ThreadPoolExecutor(threads) as pool:
            results = list(pool.map(work, range(len(runs))))
        for i, (run, event) in enumerate(results):
            settle(runs, i, base[i].version, run, event)
            if log:
                log.event({"island": i} | event)
        if migrate_every and turn % migrate_every == 0:
            row = migrate(runs)
            if row and log:
                log.event({"round": turn} | row)
    if log:
        log.promoted(max(runs, key=lambda r: r.score))
    return runs


def settle(runs: list[Run], island: int, base_version: int, run: Run, event: dict) -> bool:
    """Take a result in, unless its island has gone on without it."""
    if runs[island].version != base_version:
        event |= {"accepted": False, "stale": True, "best_score": runs[island].score}
        return False
    runs[island] = run
    return True


def migrate(runs: list[Run]) -> dict | None:
    """The best island's graph replaces the worst island's; None if there is no better one."""
    best = max(range(len(runs)), key=lambda i: (runs[i].score, -i))
    worst = min(range(len(runs)), key=lambda i: (runs[i].score, i))
    if runs[best].score <= runs[worst].score:
        return None
    source, old = runs[best], runs[worst]
    runs[worst] = Run(source.graph.clone(), source.score, old.version + 1, old.step, old.events)
    return {"migrated_from": best, "migrated_to": worst, "best_score": source.score}


def inspect(folder: str) -> dict:
    """What a run has come to."""
    log = Log(folder)
    events, best = log.events(), log.best()
    return {
        "steps": sum("mutation" in e for e in events),
        "accepted": sum(bool(e.get("accepted")) for e in events),
        "failed": sum("error" in e for e in events),
        "best": None if best is None else best[1],
        "nodes": None if best is None else {n["name"]: [a["id"] for a in n["alternatives"]] for n in graph_to_dict(best[0])["nodes"]},
    }


def export_best(folder: str, path: str) -> None:
    g, about = Log(folder).best() or _nothing(folder)
    write_graph(g, path, **about)


def recheck(folder: str, score: Score, tolerance: float = 1e-9) -> dict:
    """Score the best graph again and log whether it still has the score that it was promoted with."""
    g, about = Log(folder).best() or _nothing(folder)
    now = score(g)
    row = {"recheck": True, "score": now, "was": about["score"], "same": abs(now - about["score"]) <= tolerance}
    Log(folder).event(row)
    return row


def _nothing(folder: str):
    raise FileNotFoundError(f"{folder} holds no run")


def built_in(additions: Iterable[dict]) -> Propose:
    """A proposer that takes single additions (as in ``maintain.BUILT_IN``) one after the other."""
    rows = [dict(a) for d in additions for a in d["add"]]

    def propose(g: Graph, score: float, step: int) -> Document:
        a = rows[(step - 1) % len(rows)]
        id = a["id"] if all(b.id != a["id"] for b in g.nodes[a["node"]].alternatives) else f"{a['id']}_{step}"
        return Document(rationale=f"add {a['primitive']}", add=[{"target_node": a["node"], "alternative_id": id, "primitive": a["primitive"], "parents": a["parents"], "global_refs": a.get("globals", [])}])

    return propose
