"""Functions that only stand before ``over``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import INT64, Typed
from .catalog import Arguments, function, of_first

for _name, _make in (("row_number", F.row_number), ("rank", F.rank), ("dense_rank", F.dense_rank)):
    function(_name, [], rule=lambda a: Typed(INT64, False), window=True)(lambda a, c, make=_make: make())


def _offset(name: str):  # noqa: ANN202
    make = {"lag": F.lag, "lead": F.lead}[name]

    def lower(a: Arguments, c: list[Column]) -> Column:
        steps = a.literal(1) if len(c) > 1 else 1
        if not isinstance(steps, int) or isinstance(steps, bool):
            raise a.reject("the number of rows is a literal")
        if len(c) < 3:
            return make(c[0], steps)
        return F.when(make(F.lit(True), steps).isNull(), c[2]).otherwise(make(c[0], steps)) if a.literal(2) is None else make(c[0], steps, a.literal(2))

    return lower


for _name in ("lag", "lead"):
    function(_name, ["any", "int", "any"], 1, rule=lambda a: Typed(a.types[0], True), window=True)(_offset(_name))


@function("first_value", ["any"], rule=of_first(), window=True)
def _first(a: Arguments, c: list[Column]) -> Column:
    return F.first(c[0])


@function("last_value", ["any"], rule=of_first(), window=True, doc="over the default frame, so up to the current row where there is a sort")
def _last(a: Arguments, c: list[Column]) -> Column:
    return F.last(c[0])
