"""Models from Python: the same definitions without the text language.

    m = (model("paid").from_("orders").join("left", "refunds", "orders.id == refunds.id")
         .filter("not is_test").group(["country"], total="sum(amount)").sort("total desc"))

Expressions are written as in the text language."""

from __future__ import annotations

import dataclasses

from . import ir
from .syntax import read_expression
from .syntax.reader import Reader


def _keys(keys: tuple[str, ...]) -> tuple[tuple[ir.Expr, bool], ...]:
    return tuple(Reader(k).sort_key() for k in keys)


def _outputs(kind: str, items: dict[str, str]) -> ir.Outputs:
    return ir.Outputs(kind, tuple((n, read_expression(e)) for n, e in items.items()))


class ModelBuilder:
    """Adds one statement at a time; ``build`` gives the definition."""

    def __init__(self, name: str, contract: str | None = None, **attributes: str):
        self.definition = ir.Model(name, contract=contract, attributes=attributes)

    def _add(self, s: ir.Statement) -> ModelBuilder:
        self.definition.statements.append(s)
        return self

    def from_(self, table: str) -> ModelBuilder:
        return self._add(ir.From(table))

    def join(self, kind: str, table: str, on: str, expect: str | None = None) -> ModelBuilder:
        return self._add(ir.Join(kind, table, read_expression(on), expect))

    def filter(self, condition: str) -> ModelBuilder:
        return self._add(ir.Filter(read_expression(condition)))

    def let(self, **values: str) -> ModelBuilder:
        for n, e in values.items():
            self._add(ir.Let(n, read_expression(e)))
        return self

    def select(self, **items: str) -> ModelBuilder:
        return self._add(_outputs("select", items))

    def group(self, keys: list[str], having: str | None = None, **aggregates: str) -> ModelBuilder:
        body: list[ir.Statement] = [_outputs("aggregate", aggregates)] if aggregates else []
        if having:
            body.append(ir.Filter(read_expression(having)))
        return self._add(ir.Group(tuple(map(read_expression, keys)), tuple(body)))

    def sort(self, *keys: str) -> ModelBuilder:
        return self._add(ir.Sort(_keys(keys)))

    def take(self, count: int, skip: int = 0) -> ModelBuilder:
        return self._add(ir.Take(count, skip))

    def expand(self, name: str, to: str | None = None) -> ModelBuilder:
        return self._add(ir.Expand(name, to or name))

    def union(self, table: str, all: bool = False) -> ModelBuilder:
        return self._add(ir.SetOp("union", all, table))

    def intersect(self, table: str) -> ModelBuilder:
        return self._add(ir.SetOp("intersect", False, table))

    def except_(self, table: str) -> ModelBuilder:
        return self._add(ir.SetOp("except", False, table))

    def dedup(self, *by: str) -> ModelBuilder:
        return self._add(ir.Dedup(tuple(map(read_expression, by))))

    def incremental(self, strategy: str, cdc_column: str, *keys: str) -> ModelBuilder:
        self.definition.upkeep = dataclasses.replace(self.definition.upkeep, merge=ir.Merge(strategy), merge_on=tuple(map(read_expression, keys)), watermark=cdc_column)
        return self

    def build(self) -> ir.Model:
        return self.definition


def model(name: str, contract: str | None = None, **attributes: str) -> ModelBuilder:
    return ModelBuilder(name, contract, **attributes)
