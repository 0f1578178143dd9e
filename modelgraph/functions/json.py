"""JSON functions.  Documents are strings in tables.  Within a model they are
variants: a document is parsed once, and what one function gives another takes on
without becoming text in between."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOL, JSON, STRING, UNKNOWN, Typed
from .catalog import Arguments, Rule, function

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_PATH = re.compile(r"\$(?:\.[A-Za-z_][A-Za-z0-9_]*|\[\d+\])*")


def _member_rule(result: Typed) -> Rule:
    def rule(a: Arguments) -> Typed:
        key = a.literal(1)
        if isinstance(key, str) and not _NAME.fullmatch(key):
            raise a.reject(f"{key!r} is no plain key; json_path() takes paths", "E074")
        return result

    return rule


def _at(c: list[Column], a: Arguments) -> Column:
    """The member as a variant: a literal key is a path step, any other value is
    looked up as one exact key."""
    doc, key = a.document(0, c), a.literal(1)
    if isinstance(key, str):
        return F.try_variant_get(doc, f"$.{key}", "variant")
    escaped = F.replace(F.replace(c[1], F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    path = F.when(F.length(c[1]) > 0, F.concat(F.lit("$['"), escaped, F.lit("']")))
    return F.when(path.isNotNull(), F.try_variant_get(doc, F.coalesce(path, F.lit("$['']")), "variant"))


def as_json(v: Column) -> Column:
    return F.to_json(v)


def as_scalar(v: Column) -> Column:
    kind = F.substring(F.schema_of_variant(v), 1, 4)  # a prefix costs much less than a pattern
    return F.when(~kind.isin("OBJE", "ARRA", "VOID"), F.try_variant_get(v, "$", "string"))


@function("json_get", ["json", "string"], rule=_member_rule(Typed(JSON, True)), doc="a JSON null stays one; a missing member is null", variant=lambda a, c: _at(c, a))
def _get(a: Arguments, c: list[Column]) -> Column:
    return as_json(_at(c, a))


@function("json_value", ["json", "string"], rule=_member_rule(Typed(STRING, True)), doc="scalars as text; null for all else")
def _value(a: Arguments, c: list[Column]) -> Column:
    return as_scalar(_at(c, a))


def _path_rule(a: Arguments) -> Typed:
    path = a.literal(1)
    if not isinstance(path, str) or not _PATH.fullmatch(path):
        raise a.reject("the path is a literal of $, .name and [n]", "E074")
    return Typed(JSON, True)


def _along(a: Arguments, c: list[Column]) -> Column:
    return F.try_variant_get(a.document(0, c), str(a.literal(1)), "variant")


@function("json_path", ["json", "string"], rule=_path_rule, variant=_along)
def _path(a: Arguments, c: list[Column]) -> Column:
    return as_json(_along(a, c))


def _build_rule(a: Arguments) -> Typed:
    if len(a.types) % 2:
        raise a.reject("takes pairs", "E062")
    for i in range(0, len(a.exprs), 2):
        key = a.literal(i)
        if not isinstance(key, str) or not _NAME.fullmatch(key):
            raise a.reject("keys are literal plain names", "E074")
    return Typed(JSON, True)


@function("json_build", ["any"], 2, None, rule=_build_rule, doc="null values become JSON nulls")
def _build(a: Arguments, c: list[Column]) -> Column:
    def part(i: int) -> Column:
        t = a.types[i]
        value = a.document(i, c) if t == JSON else c[i].cast("string") if t == UNKNOWN else c[i]
        return value.alias(str(a.literal(i - 1)))

    return F.to_json(F.struct(*[part(i) for i in range(1, len(c), 2)]), {"ignoreNullFields": "false"})


@function("json_is_null", ["json"], rule=lambda a: Typed(BOOL, True))
def _is_null(a: Arguments, c: list[Column]) -> Column:
    doc = a.document(0, c)
    return F.when(c[0].isNotNull() if not a.documents else doc.isNotNull(), F.is_variant_null(doc))
