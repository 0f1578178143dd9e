"""Warnings about definitions that are accepted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from . import ir
from .plans import Project

Finding = tuple[str, str]


def _no_contract(p: Project) -> Iterator[Finding]:
    yield from ((m.name, "no contract") for m in p.models.values() if not m.contract)


def _no_owner(p: Project) -> Iterator[Finding]:
    yield from ((m.name, "no owner") for m in p.models.values() if not m.attributes.get("owner"))


def _passes_all_on(p: Project) -> Iterator[Finding]:
    shaping = (ir.Outputs, ir.Group)
    yield from ((m.name, "passes all columns on") for m in p.models.values() if not any(isinstance(s, shaping) for s in m.statements))


def _open_secret(p: Project) -> Iterator[Finding]:
    for m in p.models.values():
        for c in p.contracts[m.contract].columns if m.contract else ():
            if c.promise.label and not c.promise.guarded:
                yield f"{m.name}.{c.name}", f"classified {c.promise.label} but not protected"


def _unread(p: Project) -> Iterator[Finding]:
    used = {i for c in p.compiled.values() for i in c.depends}.union(*map(p.pipeline_models, p.pipelines))
    yield from ((name, "read by no model or pipeline") for name in p.models if name not in used and len(p.models) > 1)


def _twins(p: Project) -> Iterator[Finding]:
    firsts: dict[str, str] = {}
    for name, c in p.compiled.items():
        first = firsts.setdefault(repr((p.models[name].statements, c.inputs)), name)
        if first != name:
            yield name, f"the same as {first}"


#: Codes and what they look for; fixed values.
RULES: dict[str, Callable[[Project], Iterator[Finding]]] = {
    "W001": _no_contract,
    "W002": _no_owner,
    "W003": _passes_all_on,
    "W004": _open_secret,
    "W005": _unread,
    "W006": _twins,
}


def lint(project: Project) -> list[str]:
    project.check()
    return sorted(f"{code} {where}: {what}" for code, rule in RULES.items() for where, what in rule(project))
