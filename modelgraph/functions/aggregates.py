"""Aggregate functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import FLOAT64, INT64, UNKNOWN, Typed, array, to_spark
from .catalog import Arguments, function, of_first


@function("count", ["any"], 0, 1, rule=lambda a: Typed(INT64, False), aggregate=True, window=True, doc="rows, or rows where the argument isn't null")
def _count(a: Arguments, c: list[Column]) -> Column:
    return F.count(c[0] if c else F.lit(1))


@function("sum", ["number"], rule=of_first(), aggregate=True, window=True, doc="keeps the argument's type")
def _sum(a: Arguments, c: list[Column]) -> Column:
    return F.sum(c[0])


@function("avg", ["number"], rule=lambda a: Typed(FLOAT64, a.typed[0].nullable), aggregate=True, window=True)
def _avg(a: Arguments, c: list[Column]) -> Column:
    return F.avg(c[0].cast("double"))


@function("max", ["any"], rule=of_first(), aggregate=True, window=True)
def _max(a: Arguments, c: list[Column]) -> Column:
    return F.max(c[0])


@function("min", ["any"], rule=of_first(), aggregate=True, window=True)
def _min(a: Arguments, c: list[Column]) -> Column:
    return F.min(c[0])


def _agg_rule(a: Arguments) -> Typed:
    if a.types[0].name == "array" or a.types[0] == UNKNOWN:
        raise a.reject("needs a typed argument that is no array")
    return Typed(array(a.types[0]), True)


@function("array_agg", ["any"], rule=_agg_rule, aggregate=True, doc="the group's values that aren't null; null if there are none")
def _array_agg(a: Arguments, c: list[Column]) -> Column:
    found = F.collect_list(c[0])
    return F.nullif(found, F.array().cast(to_spark(array(a.types[0]))))
