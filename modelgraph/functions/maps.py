"""Map and struct functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import MAP_VALUES, STRING, UNKNOWN, Typed, map_of, struct, to_spark
from .catalog import Arguments, function


def _pairs(a: Arguments) -> None:
    if len(a.types) % 2:
        raise a.reject("takes pairs", "E062")


def _map_rule(a: Arguments) -> Typed:
    _pairs(a)
    if any(t not in (STRING, UNKNOWN) for t in a.types[0::2]):
        raise a.reject("keys are strings")
    known = {t for t in a.types[1::2] if t != UNKNOWN}
    if not known:
        raise a.reject("needs a value with a type", "E062")
    if len(known) > 1 or next(iter(known)).name not in MAP_VALUES:
        raise a.reject("the values have to be of one type that a map may hold")
    return Typed(map_of(next(iter(known))), False)


@function("map", ["any"], 2, None, rule=_map_rule, aliases=["dict"])
def _map(a: Arguments, c: list[Column]) -> Column:
    kind = to_spark(next(t for t in a.types[1::2] if t != UNKNOWN))
    return F.create_map(*[x if i % 2 == 0 else x.cast(kind) for i, x in enumerate(c)])


@function("map_get", ["map", "string"], rule=lambda a: Typed(a.types[0].value or UNKNOWN, True), doc="null for a missing, null or empty key")
def _map_get(a: Arguments, c: list[Column]) -> Column:
    return F.try_element_at(c[0], F.nullif(c[1], F.lit("")))


def _struct_rule(a: Arguments) -> Typed:
    _pairs(a)
    names = [a.literal(i) for i in range(0, len(a.exprs), 2)]
    if not all(isinstance(n, str) for n in names):
        raise a.reject("field names are string literals")
    return Typed(struct(list(zip(names, a.types[1::2], strict=True))), False)  # type: ignore[arg-type]


@function("struct", ["any"], 2, None, rule=_struct_rule)
def _struct(a: Arguments, c: list[Column]) -> Column:
    return F.struct(*[c[i + 1].alias(str(a.literal(i))) for i in range(0, len(c), 2)])


def _field_rule(a: Arguments) -> Typed:
    name = a.literal(1)
    if not isinstance(name, str):
        raise a.reject("the field is a string literal")
    return Typed(dict(a.types[0].fields).get(name, UNKNOWN), True)


@function("struct_get", ["struct", "string"], rule=_field_rule, doc="null if there is no such field")
def _struct_get(a: Arguments, c: list[Column]) -> Column:
    name = str(a.literal(1))
    return c[0].getField(name) if name in dict(a.types[0].fields) else F.lit(None)
