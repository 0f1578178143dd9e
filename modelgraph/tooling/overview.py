"""One look at a project: its models, what they promise, what they read, what a
change of each reaches, and, with a store, what is current and stale."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path
from typing import Any

from ..lineage import blast_radius
from ..lint import lint
from ..plans import Project
from ..syntax import read_module


def overview(project: Project, runner: Any = None) -> dict:
    """All of it as plain data."""
    compiled = project.check()
    live = runner.store.live() if runner else {}
    stale = set(runner.stale(list(compiled), runner.hashes(runner.sources_of(list(compiled)), runner.sources))) if runner else set()
    models = {}
    for name, c in compiled.items():
        reached = blast_radius(compiled, [(name, column) for column in c.schema])
        models[name] = {
            "contract": project.models[name].contract, "owner": project.models[name].attributes.get("owner"), "fingerprint": c.fingerprint, "reads": list(dict.fromkeys(c.inputs)),
            "columns": {n: f"{x.type}{'' if x.nullable else ' nonnull'}" for n, x in c.schema.items()}, "reached": sorted({m for m, _ in reached} - {name}),
            "run": live.get(name), "stale": name in stale if runner else None, "tests": sum(len(t.expects) for t in project.tests if t.model == name),
        }
    return {"models": models, "warnings": lint(project), "history": [{k: e.get(k) for k in ("run", "at", "models", "reason")} for e in runner.store.history()[-10:]] if runner else []}


def shown(found: dict) -> str:
    """An overview as text."""
    out = []
    for name, m in found["models"].items():
        state = "" if m["stale"] is None else " [stale]" if m["stale"] else f" [run {m['run']}]"
        out.append(f"{name}{state}  contract {m['contract'] or '-'}  owner {m['owner'] or '-'}  tests {m['tests']}")
        out.append(f"  reads {', '.join(m['reads'])}; a change reaches {', '.join(m['reached']) or 'nothing'}")
    out += [f"run {e['run']} at {e['at']}: {', '.join(e['models'])}" for e in found["history"]]
    return "\n".join(out + found["warnings"]) + "\n"


def profile(path: str, run: Callable[[Project], dict[str, tuple[float, int]]] | None = None) -> list[tuple[str, float, int | None]]:
    """(phase, milliseconds, rows) of reading, checking and, with ``run``, of
    computing each model."""
    out: list[tuple[str, float, int | None]] = []
    began = time.perf_counter()
    text = Path(path).read_text()
    read_module(text)
    out.append(("read", 1000 * (time.perf_counter() - began), None))
    began = time.perf_counter()
    project = Project.from_file(path)
    project.check()
    out.append(("check", 1000 * (time.perf_counter() - began), None))
    for name, (seconds, rows) in (run(project) if run else {}).items():
        out.append((name, 1000 * seconds, rows))
    return out
