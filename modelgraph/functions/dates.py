"""Calendar functions. Units come as keywords (``days: 3``) or bare words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..ir import Keyword, Lit
from ..types import DATE, INT64, Typed
from .catalog import Arguments, Rule, function

#: Months or days in a unit.
_SHIFT = {"years": ("months", 12), "quarters": ("months", 3), "months": ("months", 1), "weeks": ("days", 7), "days": ("days", 1)}
_TRUNC = ("year", "quarter", "month", "week", "day")


def _shift_rule(a: Arguments) -> Typed:
    unit = a.exprs[1]
    if not isinstance(unit, Keyword):
        raise a.reject("the amount is written with its unit, as in days: 1", "E072")
    if unit.name not in _SHIFT:
        raise a.reject(f"unknown unit {unit.name!r}", "E071")
    return Typed(a.types[0], a.any_nullable)


def _unit(a: Arguments, i: int, units: tuple[str, ...]) -> str:
    e = a.exprs[i]
    if not isinstance(e, Lit) or not isinstance(e.value, str):
        raise a.reject("the unit is a bare word or a string", "E072")
    if e.value not in units:
        raise a.reject(f"unknown unit {e.value!r}", "E071")
    return e.value


def _shifted(sign: int) -> Callable[[Arguments, list[Column]], Column]:
    def lower(a: Arguments, c: list[Column]) -> Column:
        kind, size = _SHIFT[a.exprs[1].name]  # type: ignore[attr-defined]
        n = (c[1] * (sign * size)).cast("int")
        if a.types[0] == DATE:
            return F.add_months(c[0], n) if kind == "months" else F.date_add(c[0], n)
        step = F.make_ym_interval(F.lit(0), n) if kind == "months" else F.make_dt_interval(n)
        return c[0] + step

    return lower


for _name, _sign in (("date_add", 1), ("date_sub", -1)):
    function(_name, ["temporal", "int"], rule=_shift_rule, doc="keeps the type; the day is clamped to the month's end")(_shifted(_sign))


def truncated(c: Column, unit: str, is_date: bool) -> Column:
    if is_date:
        return c if unit == "day" else F.trunc(c, unit)
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def _trunc_rule(a: Arguments) -> Typed:
    _unit(a, 1, _TRUNC)
    return Typed(a.types[0], a.typed[0].nullable)


@function("date_trunc", ["temporal", "string"], rule=_trunc_rule, doc="weeks start on Monday; a date stays a date")
def _date_trunc(a: Arguments, c: list[Column]) -> Column:
    return truncated(c[0], _unit(a, 1, _TRUNC), a.types[0] == DATE)


def _diff_rule() -> Rule:
    def rule(a: Arguments) -> Typed:
        if a.types[0] != a.types[1]:
            raise a.reject("both dates have to be of one type", "E073")
        _unit(a, 2, (*_TRUNC, "weeks"))
        return Typed(INT64, a.typed[0].nullable or a.typed[1].nullable)

    return rule


@function("date_diff", ["temporal", "temporal", "string"], rule=_diff_rule(), doc="boundaries crossed from the first to the second")
def _date_diff(a: Arguments, c: list[Column]) -> Column:
    unit = _unit(a, 2, (*_TRUNC, "weeks"))
    x, y = c[0].cast("date"), c[1].cast("date")
    if unit in ("year", "quarter", "month"):
        per = {"year": 1, "quarter": 4, "month": 12}[unit]
        part = {"year": lambda d: F.lit(0), "quarter": F.quarter, "month": F.month}[unit]
        at = lambda d: F.year(d) * per + part(d)
        return (at(y) - at(x)).cast("long")
    if unit == "day":
        return F.datediff(y, x).cast("long")
    return F.floor(F.datediff(F.trunc(y, "week"), F.trunc(x, "week")) / 7).cast("long")
