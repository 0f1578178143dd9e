"""String functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import BOOL, INT64, STRING, Typed
from .catalog import Arguments, function, gives


def first_nullable(t):  # noqa: ANN001, ANN201
    return lambda a: Typed(t, a.typed[0].nullable)


def like(value: Column, pattern: Column) -> Column:
    """LIKE without an escape character: backslashes stand for themselves."""
    return F.like(value, F.replace(pattern, F.lit("\\"), F.lit("\\\\")))


@function("upper", ["string"], rule=gives(STRING))
def _upper(a: Arguments, c: list[Column]) -> Column:
    return F.upper(c[0])


@function("lower", ["string"], rule=gives(STRING))
def _lower(a: Arguments, c: list[Column]) -> Column:
    return F.lower(c[0])


@function("concat", ["any"], 1, None, rule=gives(STRING), doc="null if any argument is null")
def _concat(a: Arguments, c: list[Column]) -> Column:
    return F.concat(*[x.cast("string") for x in c])


@function("length", ["string"], rule=gives(INT64), doc="in characters")
def _length(a: Arguments, c: list[Column]) -> Column:
    return F.length(c[0]).cast("long")


@function("substring", ["string", "int", "int"], 2, rule=first_nullable(STRING), doc="from a 1-based start, or from the end if it is negative")
def _substring(a: Arguments, c: list[Column]) -> Column:
    start = c[1].cast("int")
    if len(c) == 2:
        return F.substring(c[0], F.when(start == 0, 1).otherwise(start), F.length(c[0]))
    length = c[2].cast("int")
    # position 0 stands before the text and uses up one character of the length
    return F.substring(c[0], F.when(start == 0, 1).otherwise(start), F.when(start == 0, length - 1).otherwise(length))


@function("trim", ["string"], rule=gives(STRING))
def _trim(a: Arguments, c: list[Column]) -> Column:
    return F.trim(c[0])


@function("ltrim", ["string"], rule=gives(STRING))
def _ltrim(a: Arguments, c: list[Column]) -> Column:
    return F.ltrim(c[0])


@function("rtrim", ["string"], rule=gives(STRING))
def _rtrim(a: Arguments, c: list[Column]) -> Column:
    return F.rtrim(c[0])


@function("replace", ["string", "string", "string"], rule=gives(STRING))
def _replace(a: Arguments, c: list[Column]) -> Column:
    return F.replace(c[0], c[1], c[2])


@function("lpad", ["string", "int", "string"], rule=gives(STRING))
def _lpad(a: Arguments, c: list[Column]) -> Column:
    return F.lpad(c[0], c[1].cast("int"), c[2])


@function("rpad", ["string", "int", "string"], rule=gives(STRING))
def _rpad(a: Arguments, c: list[Column]) -> Column:
    return F.rpad(c[0], c[1].cast("int"), c[2])


@function("startswith", ["string", "string"], rule=gives(BOOL))
def _startswith(a: Arguments, c: list[Column]) -> Column:
    return F.startswith(c[0], c[1])


@function("like", ["string", "string"], rule=gives(BOOL))
def _like(a: Arguments, c: list[Column]) -> Column:
    return like(c[0], c[1])


@function("rlike", ["string", "string"], rule=gives(BOOL), doc="true if the expression matches anywhere")
def _rlike(a: Arguments, c: list[Column]) -> Column:
    return F.rlike(c[0], c[1])


@function("split_part", ["string", "string", "int"], rule=first_nullable(STRING), doc="1-based; the empty string for 0 or out of range")
def _split_part(a: Arguments, c: list[Column]) -> Column:
    n = c[2].cast("int")
    return F.when(n == 0, F.when(c[0].isNotNull(), "")).otherwise(F.split_part(c[0], c[1], F.when(n == 0, 1).otherwise(n)))


@function("regexp_replace", ["string", "string", "string"], rule=gives(STRING), doc="all matches")
def _regexp_replace(a: Arguments, c: list[Column]) -> Column:
    return F.regexp_replace(c[0], c[1], c[2])


@function("left", ["string", "int"], rule=first_nullable(STRING), doc="a negative number leaves out so many at the other end")
def _left(a: Arguments, c: list[Column]) -> Column:
    n = c[1].cast("int")
    return F.substring(c[0], F.lit(1), F.when(n < 0, F.greatest(F.length(c[0]) + n, F.lit(0))).otherwise(n))


@function("right", ["string", "int"], rule=first_nullable(STRING), doc="a negative number leaves out so many at the other end")
def _right(a: Arguments, c: list[Column]) -> Column:
    n = c[1].cast("int")
    take = F.least(F.when(n < 0, F.greatest(F.length(c[0]) + n, F.lit(0))).otherwise(n), F.length(c[0]))
    return F.substring(c[0], F.length(c[0]) - take + 1, take)
