"""coalesce, if and case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOL, UNKNOWN, Typed, least_upper_of, to_spark
from .catalog import Arguments, function


def _unified(a: Arguments, values: list[Typed], nullable: bool) -> Typed:
    t = least_upper_of([v.type for v in values])
    if t == UNKNOWN:
        raise a.reject("no type fits " + ", ".join(str(v.type) for v in values), "E058")
    return Typed(t, nullable)


def _conditions(a: Arguments, conditions: list[Typed]) -> None:
    for c in conditions:
        if c.type not in (BOOL, UNKNOWN):
            raise a.reject(f"a condition has to be bool, got {c.type}", "E090")


@function("coalesce", ["any"], 1, None, rule=lambda a: _unified(a, list(a.typed), all(v.nullable for v in a.typed)))
def _coalesce(a: Arguments, c: list[Column]) -> Column:
    kind = to_spark(least_upper_of(a.types))
    return F.coalesce(*[x.cast(kind) for x in c])


def _if_rule(a: Arguments) -> Typed:
    _conditions(a, [a.typed[0]])
    return _unified(a, list(a.typed[1:]), any(v.nullable for v in a.typed[1:]))


@function("if", ["any", "any", "any"], rule=_if_rule)
def _if(a: Arguments, c: list[Column]) -> Column:
    kind = to_spark(least_upper_of(a.types[1:]))
    return F.when(c[0].cast("boolean"), c[1].cast(kind)).otherwise(c[2].cast(kind))


def _arms(n: int) -> tuple[list[int], list[int]]:
    """Positions of conditions and of values; an odd last one is the else."""
    return list(range(0, n - n % 2, 2)), [*range(1, n, 2), *([n - 1] if n % 2 else [])]


def _case_rule(a: Arguments) -> Typed:
    conditions, values = _arms(len(a.typed))
    _conditions(a, [a.typed[i] for i in conditions])
    picked = [a.typed[i] for i in values]
    return _unified(a, picked, len(a.typed) % 2 == 0 or any(v.nullable for v in picked))


@function("case", ["any"], 2, None, rule=_case_rule, doc="the first true condition's value; null without an else")
def _case(a: Arguments, c: list[Column]) -> Column:
    conditions, values = _arms(len(c))
    kind = to_spark(least_upper_of([a.types[i] for i in values]))
    out = F.lit(None).cast(kind) if len(c) % 2 == 0 else c[-1].cast(kind)
    for i in reversed(conditions):
        out = F.when(c[i].cast("boolean"), c[i + 1].cast(kind)).otherwise(out)
    return out
