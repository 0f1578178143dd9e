"""Array functions. Indices count from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOL, INT64, UNKNOWN, Type, Typed, array, to_spark
from .catalog import Arguments, Rule, function, gives

SCALARS = ("int64", "float64", "string", "bool", "date", "timestamp", "uuid")
SORTABLE = ("int64", "float64", "string", "bool", "date", "timestamp")


def holds(t: Type | None) -> bool:
    """Whether arrays may have such elements."""
    return t is not None and (t.name in (*SCALARS, "json", "decimal", "money") or (t.name == "array" and holds(t.element)))


def _construct_rule(a: Arguments) -> Typed:
    known = {t for t in a.types if t != UNKNOWN}
    if len(known) != 1 or not holds(next(iter(known))):
        raise a.reject("the elements have to be of one supported type, and one of them typed")
    return Typed(array(next(iter(known))), False)


@function("array_construct", ["any"], 1, None, rule=_construct_rule, aliases=["list"])
def _construct(a: Arguments, c: list[Column]) -> Column:
    kind = to_spark(next(t for t in a.types if t != UNKNOWN))
    return F.array(*[x.cast(kind) for x in c])


@function("array_length", ["array"], rule=gives(INT64))
def _length(a: Arguments, c: list[Column]) -> Column:
    return F.when(c[0].isNotNull(), F.size(c[0])).cast("long")


@function("array_get", ["array", "int"], rule=lambda a: Typed(a.types[0].element or UNKNOWN, True), doc="null beyond the ends")
def _get(a: Arguments, c: list[Column]) -> Column:
    inside = (c[1] >= 0) & (c[1] < F.size(c[0]))
    return F.when(inside, F.get(c[0], F.when(inside, c[1]).otherwise(0).cast("int")))


def _needle(base: int, needle: int, elements: tuple[str, ...], result: Type | None, nullable: bool | None = True) -> Rule:
    def rule(a: Arguments) -> Typed:
        t, n = a.types[base], a.types[needle]
        if t.name != "array" or t.element is None or t.element.name not in elements:
            raise a.reject(f"needs an array of plain elements, got {t}")
        if n not in (t.element, UNKNOWN):
            raise a.reject(f"{n} is no element of {t}")
        return Typed(result or t, a.any_nullable if nullable is None else nullable)

    return rule


@function("array_contains", ["any", "any"], rule=_needle(0, 1, SCALARS, BOOL, None), doc="null if either argument is; null elements don't match")
def _contains(a: Arguments, c: list[Column]) -> Column:
    v = c[1].cast(to_spark(a.types[0].element or UNKNOWN))
    return F.when(c[0].isNotNull() & v.isNotNull(), F.coalesce(F.array_contains(c[0], v), F.lit(False)))


def _concat_rule(a: Arguments) -> Typed:
    if a.types[0].name != "array" or not holds(a.types[0].element) or a.types[0] != a.types[1]:
        raise a.reject(f"needs two arrays of one type, got {a.types[0]} and {a.types[1]}")
    return Typed(a.types[0], a.any_nullable)


@function("array_concat", ["any", "any"], rule=_concat_rule)
def _concat(a: Arguments, c: list[Column]) -> Column:
    return F.concat(c[0], c[1])


@function("array_append", ["any", "any"], rule=_needle(0, 1, SCALARS, None), doc="null if either argument is")
def _append(a: Arguments, c: list[Column]) -> Column:
    v = c[1].cast(to_spark(a.types[0].element or UNKNOWN))
    return F.when(c[0].isNotNull() & v.isNotNull(), F.array_append(c[0], v))


@function("array_prepend", ["any", "any"], rule=_needle(1, 0, SCALARS, None), doc="the value comes first, then the array")
def _prepend(a: Arguments, c: list[Column]) -> Column:
    v = c[0].cast(to_spark(a.types[1].element or UNKNOWN))
    return F.when(c[1].isNotNull() & v.isNotNull(), F.array_prepend(c[1], v))


@function("array_remove", ["any", "any"], rule=_needle(0, 1, SCALARS, None), doc="a null value removes nothing; null elements stay")
def _remove(a: Arguments, c: list[Column]) -> Column:
    v = c[1].cast(to_spark(a.types[0].element or UNKNOWN))
    return F.filter(c[0], lambda x: x.isNull() | v.isNull() | (x != v))


@function("array_index_of", ["any", "any"], rule=_needle(0, 1, SCALARS, INT64), doc="null if it isn't there")
def _index_of(a: Arguments, c: list[Column]) -> Column:
    v = c[1].cast(to_spark(a.types[0].element or UNKNOWN))
    return F.nullif(F.array_position(c[0], v), F.lit(0).cast("long")) - 1


def _sort_rule(a: Arguments) -> Typed:
    t = a.types[0]
    if t.name != "array" or t.element is None or t.element.name not in SORTABLE:
        raise a.reject(f"can't sort {t}")
    return Typed(t, True)


@function("array_sort", ["any"], rule=_sort_rule, doc="ascending, nulls last")
def _sort(a: Arguments, c: list[Column]) -> Column:
    return F.array_sort(c[0])
