"""Checks a model and turns it into a lazy DataFrame.

Names live in two scopes.  The *inner* one has the columns of the tables and, for
names no table has, the lets; joins, lets and filters see it.  The *outer* one
has the lets before the columns; outputs, group keys, windows and sorts see it.
An expression is bound once, to its type, its lineage and a function that makes
the Spark column, so what is checked is what runs.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import ir
from ..errors import ModelError
from ..functions import find
from ..functions.catalog import Arguments, Function
from ..functions.strings import like
from ..operators import relational as rel
from ..types import BOOL, FLOAT64, INT64, JSON, STRING, UNKNOWN, UUID, Column, Type, Typed, arithmetic, fits, least_upper, parse_type, to_spark

if TYPE_CHECKING:
    from .project import Project

Emit = Callable[[], SparkColumn]


@dataclass(frozen=True)
class Origin:
    """Where a column's values come from."""

    node: str
    column: str
    kind: str  # passthrough, joined, derived, aggregated, grouped, windowed, expanded, set


@dataclass
class Bound:
    typed: Typed
    emit: Emit
    origins: tuple[Origin, ...] = ()
    variant: Emit | None = None  # of a JSON value that needn't be text

    @property
    def type(self) -> Type:
        return self.typed.type


@dataclass
class JoinCheck:
    """Keys that have to be unique for a join's promise to hold."""

    table: str
    expect: str
    left_keys: list[str]
    right_keys: list[str]


@dataclass
class Compiled:
    """A checked model."""

    model: ir.Model
    schema: dict[str, Column]
    lineage: dict[str, tuple[Origin, ...]]
    reads: set[tuple[str, str]]
    depends: list[str]
    inputs: list[str]
    joins: list[JoinCheck]
    fingerprint: str
    lower: Callable[[Callable[[str], DataFrame]], DataFrame]
    grouped: bool = False
    loose: bool = False  # whether another run over the same tables may give other rows


@dataclass
class _Window:
    """A window of an output."""

    name: str  # of the column, if it is joined
    fn: Function
    parts: list[Bound]
    keys: list[tuple[Bound, bool]]
    made: Emit
    typed: Typed
    nested: bool  # whether it is made of other windows

    @property
    def partition(self) -> frozenset[int]:
        return frozenset(map(id, self.parts))

    @property
    def keyed(self) -> bool:
        """Whether the value follows from the row's keys and how often each occurs."""
        used = [*self.parts, *(k for k, _ in self.keys)]
        if self.nested or not used or not all(_plain(k) for k in used):
            return False
        return self.fn.name in ("rank", "dense_rank") if self.keys else self.fn.aggregate


class _Outer:
    """What a binding may use besides names."""

    def __init__(self, aggregates: bool = False, windows: bool = False, where: str = ""):
        self.aggregates, self.windows, self.where = aggregates, windows, where


class _Compiler:
    def __init__(self, project: Project, model: ir.Model):
        self.project, self.model = project, model
        self.columns: dict[str, Bound] = {}
        self.lets: dict[str, Bound] = {}
        self.tables: dict[str, dict[str, Bound]] = {}
        self.order: list[str] = []
        self.inputs: list[str] = []
        self.ops: list[Callable[[DataFrame, Callable[[str], DataFrame]], DataFrame]] = []
        self.filters: list[Bound] = []
        self.outputs: list[tuple[str, Bound]] = []
        self.sorts: list[tuple[ir.Expr, bool]] = []
        self.taken: ir.Take | None = None
        self.distinct = False
        self.dedup: list[str] = []
        self.expanded = False
        self.joined = False
        self.set_open = self.set_seen = False
        self.grouped = self.in_group = False
        self.keys: list[tuple[str, Bound, ir.Expr]] = []
        self.aggregated: list[tuple[str, Emit]] = []
        self.having: list[Bound] = []
        self.reads: set[tuple[str, str]] = set()
        self.checks: list[JoinCheck] = []
        self.frame: DataFrame | None = None  # the rows that outputs are made of
        self.documents: dict[int, tuple[str, Bound]] = {}
        self.asked: set[str] = set()  # documents that what was emitted last reads
        self.parsed = False  # whether they stand beside the columns already
        self.windows: list[_Window] = []
        self.over = False  # whether what was bound last has a window
        self.over_outputs: set[int] = set()
        self.joined_windows: set[str] = set()  # those that stand beside the columns already
        self.loose = False

    # -- names
    def input(self, name: str) -> dict[str, Column]:
        if name in self.project.sources:
            columns = self.project.sources[name].columns
            if not columns:
                raise ModelError("E021", f"source {name!r} declares no columns")
            return {c.name: c for c in columns}
        if name in self.project.compiled:
            self.loose |= self.project.compiled[name].loose
            return self.project.compiled[name].schema
        if name in self.project.models:
            raise ModelError("E024", f"model {name!r} isn't checked yet")
        raise ModelError("E020", f"unknown input {name!r}")

    def inner(self, name: str) -> Bound | None:
        return self.columns.get(name) or self.lets.get(name)

    def outer(self, name: str) -> Bound | None:
        return self.lets.get(name) or self.columns.get(name)

    def after_group(self, name: str) -> Bound | None:
        return next((b for n, b in reversed(self.outputs) if n == name), None)

    def resolve(self, ref: ir.Ref, look: Callable[[str], Bound | None]) -> Bound:
        if ref.table is not None:
            if ref.table not in self.tables:
                raise ModelError("E041", f"unknown table {ref.table!r}", self.model.line)
            found = self.tables[ref.table].get(ref.name)
            if found is None:
                raise ModelError("E040", f"{ref.table!r} has no column {ref.name!r}", self.model.line)
            if look == self.after_group:
                key = next((n for n, b, _ in self.keys if b is found), None)
                if key is None:
                    raise ModelError("E040", f"{ref.table}.{ref.name} is no group key", self.model.line)
                return self.after_group(key) or found
            return found
        found = look(ref.name)
        if found is None:
            raise ModelError("E040", f"unknown column {ref.name!r} in model {self.model.name!r}", self.model.line)
        return found

    # -- expressions
    def bind(self, e: ir.Expr, look: Callable[[str], Bound | None], use: _Outer) -> Bound:
        match e:
            case ir.Lit(v):
                return self.literal(v)
            case ir.Ref():
                found = self.resolve(e, look)
                self.reads |= {(o.node, o.column) for o in found.origins}
                self.over |= id(found) in self.over_outputs
                return found
            case ir.Unary(op, arg):
                a = self.bind(arg, look, use)
                if op == "not":
                    return Bound(Typed(BOOL, a.typed.nullable), lambda: ~a.emit().cast("boolean"), _derived(a))
                if not (a.type.numeric or a.type.name in ("money", "unknown")):
                    raise ModelError("E053", f"can't negate {a.type}")
                return Bound(a.typed, lambda: -a.emit(), _derived(a))
            case ir.Binary(op, left, right):
                if op == "in" and isinstance(right, ir.Items):
                    return self.within(left, right, look, use)
                return binary(op, self.bind(left, look, use), self.bind(right, look, use))
            case ir.Over():
                return self.window(e, look, use)
            case ir.Call():
                return self.call(e, look, use)
            case ir.Star():
                raise ModelError("E064", "'*' stands in count(*) only")
            case ir.Keyword(name):
                raise ModelError("E072", f"{name}: is an argument of date functions only")
        raise ModelError("E055", f"{type(e).__name__.lower()} can't stand here")

    @staticmethod
    def literal(v: object) -> Bound:
        if v is None:
            return Bound(Typed(UNKNOWN, True), lambda: F.lit(None))
        if isinstance(v, bool):
            return Bound(Typed(BOOL, False), lambda: F.lit(v))
        if isinstance(v, int):
            return Bound(Typed(INT64, False), lambda: F.lit(v).cast("long"))
        if isinstance(v, float):
            return Bound(Typed(FLOAT64, False), lambda: F.lit(v))
        return Bound(Typed(STRING, False), lambda: F.lit(v))

    def within(self, left: ir.Expr, right: ir.Items, look: Callable[[str], Bound | None], use: _Outer) -> Bound:
        a, items = self.bind(left, look, use), [self.bind(i, look, use) for i in right.items]
        for i in items:
            binary("==", a, i)
        return Bound(Typed(BOOL, a.typed.nullable), lambda: a.emit().isin(*[i.emit() for i in items]), _derived(a, *items))

    def arguments(self, e: ir.Call, look: Callable[[str], Bound | None], use: _Outer) -> list[Bound]:
        return [self.bind(a.value if isinstance(a, ir.Keyword) and e.name in ("date_add", "date_sub") else a, look, use) for a in e.args]

    def call(self, e: ir.Call, look: Callable[[str], Bound | None], use: _Outer) -> Bound:
        if e.name == "cast":
            return self.cast(e, look, use)
        fn = find(e.name)
        star = any(isinstance(a, ir.Star) for a in e.args)
        if star and (e.name != "count" or len(e.args) != 1):
            raise ModelError("E064", "'*' stands in count(*) only")
        if e.distinct and (e.name != "count" or star or len(e.args) != 1):
            raise ModelError("E096", "distinct stands in count(distinct x) only")
        if fn.aggregate:
            if not use.aggregates:
                raise ModelError("E056", f"{e.name}() stands in a group body only")
            return self.aggregate(fn, e, star)
        if fn.window:
            raise ModelError("E065", f"{e.name}() needs over (...)")
        args = self.arguments(e, look, use)
        documents = tuple(self.document(x) if x.type == JSON else None for x in args)
        typed, made = applied(fn, e, args, documents)
        variant = (lambda: fn.variant(Arguments(e.name, tuple(x.typed for x in args), e.args, documents), [x.emit() for x in args])) if fn.variant else None
        return Bound(typed, made, _derived(*args), variant)

    def document(self, b: Bound) -> Emit:
        """A JSON value as a variant.  In the outputs that is a hidden column, so
        all of them share one parse."""
        if b.variant:
            return b.variant
        name, _ = self.documents.setdefault(id(b), (f"__d{len(self.documents)}", b))

        def emit() -> SparkColumn:
            self.asked.add(name)
            return rel.col(name) if self.parsed else F.try_parse_json(b.emit())

        return emit

    def aggregate(self, fn: Function, e: ir.Call, star: bool) -> Bound:
        """A hidden column of the grouped rows."""
        args = [] if star else self.arguments(e, self.outer, _Outer(where="an aggregate"))
        typed, made = applied(fn, dataclasses.replace(e, args=() if star else e.args), args)
        if e.distinct:
            made = lambda: F.count_distinct(args[0].emit())
        name = f"__a{len(self.aggregated)}"
        self.loose |= not _repeats(fn, typed)
        kind = to_spark(typed.type)
        self.aggregated.append((name, lambda: made().cast(kind)))
        origins = tuple(dataclasses.replace(o, kind="aggregated") for a in args for o in a.origins)
        return Bound(typed, lambda: rel.col(name), origins)

    def cast(self, e: ir.Call, look: Callable[[str], Bound | None], use: _Outer) -> Bound:
        if any(isinstance(a, ir.Keyword) for a in e.args):
            raise ModelError("E072", "cast() takes no keyword")
        if len(e.args) != 2 or not isinstance(e.args[1], ir.Lit) or not isinstance(e.args[1].value, str):
            raise ModelError("E062", 'cast() takes a value and a type, as in cast(x, "int64")')
        a, t = self.bind(e.args[0], look, use), parse_type(e.args[1].value, self.project.domains)
        kind = to_spark(t)

        def made() -> SparkColumn:
            c = a.emit()
            if t == INT64 and a.type == STRING:
                return F.round(c.cast("decimal(38,10)")).cast("long")
            if t == INT64 and (a.type.numeric or a.type.name == "money") and a.type != INT64:
                return F.round(c).cast("long")
            return c.cast(kind)

        return Bound(Typed(t, a.typed.nullable), made, _derived(a))

    def window(self, e: ir.Over, look: Callable[[str], Bound | None], use: _Outer) -> Bound:
        fn = find(e.call.name)
        if e.call.distinct:
            raise ModelError("E096", "count(distinct x) takes no over (...)")
        if not fn.window:
            raise ModelError("E065", f"{e.call.name}() takes no over (...)")
        if not use.windows:
            raise ModelError("E065", f"over (...) can't stand in {use.where or 'here'}")
        if any(isinstance(a, ir.Star) for a in e.call.args):
            raise ModelError("E064", "write count() over (...)")
        plain = _Outer(where="a window")
        self.over = False
        args = self.arguments(e.call, look, plain)
        parts = [self.bind(p, look, plain) for p in e.partition_by]
        keys = [(self.bind(k, look, plain), d) for k, d in e.sort]
        nested, self.over = self.over, True
        typed, made = applied(fn, e.call, args)
        ranking = not fn.aggregate and fn.name not in ("first_value", "last_value")
        w = _Window(f"__w{len(self.windows)}", fn, parts, keys, made, typed, nested)
        self.windows.append(w)

        def over() -> SparkColumn:
            if fn.aggregate and not parts and not keys and self.frame is not None:
                # of all rows: partial aggregates and one row, instead of all rows in one task
                return self.frame.agg(made()).scalar().cast(to_spark(typed.type))
            if fn.name in ("rank", "dense_rank") and not keys:
                return F.lit(1).cast("long")  # all rows are peers
            if w.name in self.joined_windows:
                return rel.col(w.name)
            spec = Window.partitionBy(*[p.emit() for p in parts])
            order = [rel.nulls_last(k.emit(), d) for k, d in keys] or ([F.lit(1)] if ranking else [])
            return made().over(spec.orderBy(*order) if order else spec).cast(to_spark(typed.type))

        origins = tuple(dataclasses.replace(o, kind="windowed") for a in (*args, *parts, *(k for k, _ in keys)) for o in a.origins)
        return Bound(typed, over, tuple(dict.fromkeys(origins)))

    def join_windows(self, df: DataFrame) -> DataFrame:
        """Windows that follow from a row's keys are made of one row for each key
        and joined to the rows: a task would else hold all rows of a partition.
        Where another window of that partition is left, they stay beside it.  The
        rows are read twice, so these have to be the same both times."""
        literal = ("rank", "dense_rank")
        windows = [] if self.loose else [w for w in self.windows if w.keys or (w.parts if w.fn.aggregate else w.fn.name not in literal)]
        held = {w.partition for w in windows if not w.keyed}
        groups: dict[tuple[frozenset[int], frozenset[int]], list[_Window]] = {}
        for w in windows:
            if w.partition not in held and w.keyed:
                groups.setdefault((w.partition, frozenset(id(k) for k, _ in w.keys)), []).append(w)
        rows = df
        for ws in groups.values():
            bound = {id(b): b for b in [*ws[0].parts, *(k for k, _ in ws[0].keys)]}
            names = {i: f"{ws[0].name}_{j}" for j, i in enumerate(bound)}
            keys = {names[i]: b.emit() for i, b in bound.items()}
            if ws[0].keys:
                places = {w.name: (w.fn.name == "dense_rank", [(names[id(k)], d) for k, d in w.keys]) for w in ws}
                keyed = rel.ranks(rows, keys, [names[id(p)] for p in ws[0].parts], places)
            else:
                keyed = rel.grouped(rows, keys, {w.name: w.made().cast(to_spark(w.typed.type)) for w in ws})
            df = rel.beside(df, keyed, keys)
            self.joined_windows |= {w.name for w in ws}
        return df

    # -- statements
    def run(self) -> Compiled:
        for s in self.model.statements:
            self.statement(s)
        return self.finish()

    def statement(self, s: ir.Statement) -> None:
        if not isinstance(s, ir.SetOp):
            self.set_open = False
        match s:
            case ir.From(table):
                self.do_from(table)
            case ir.Join():
                self.do_join(s)
            case ir.Filter(condition) if self.in_group:
                self.having.append(self.condition(condition, self.after_group, _Outer(aggregates=True, where="a group's filter")))
            case ir.Filter(condition):
                self.filters.append(self.condition(condition, self.inner, _Outer(where="filter")))
            case ir.Let(name, value):
                self.lets[name] = self.bind(value, self.inner, _Outer(where="let"))
                if name not in self.order:
                    self.order.append(name)
            case ir.Outputs(_, items):
                for name, e in items:
                    self.output(name, e)
            case ir.Group(keys, body):
                self.do_group(keys, body)
            case ir.Sort(keys):
                self.sorts += keys
            case ir.Take():
                self.taken = s
            case ir.Expand():
                self.do_expand(s)
            case ir.SetOp():
                self.do_set(s)
            case ir.Dedup(by):
                self.do_dedup(by)
            case _:
                raise ModelError("E060", f"unknown statement {type(s).__name__}")

    def condition(self, e: ir.Expr, look: Callable[[str], Bound | None], use: _Outer) -> Bound:
        return self.bind(e, look, use)

    def do_from(self, table: str) -> None:
        if self.inputs:
            raise ModelError("E076", f"model {self.model.name!r} already reads from {self.inputs[0]!r}", self.model.line)
        self.inputs.append(table)
        entries = {n: Bound(Typed(c.type, c.nullable), lambda n=n: rel.col(n), (Origin(table, n, "passthrough"),)) for n, c in self.input(table).items()}
        self.columns.update(entries)
        self.tables[table] = entries
        self.order += entries
        self.ops.append(lambda df, get: get(table))

    def do_join(self, s: ir.Join) -> None:
        if not self.inputs:
            raise ModelError("E076", "a join needs a from first", self.model.line)
        self.inputs.append(s.table)
        prefix = f"__j{len(self.inputs) - 1}_"
        schema = self.input(s.table)
        entries = {n: Bound(Typed(c.type, c.nullable), lambda n=n: rel.col(prefix + n), (Origin(s.table, n, "joined"),)) for n, c in schema.items()}
        saved_tables, saved_columns = dict(self.tables), dict(self.columns)
        self.tables.setdefault(s.table, entries)
        self.columns.update({prefix + n: b for n, b in entries.items()})
        on = self.bind(s.on, self.inner, _Outer(where="a join condition"))
        if s.expect:
            self.checks.append(_cardinality(s, self.inputs[0], list(saved_tables.get(self.inputs[0], {}))))
        if s.kind in ("semi", "anti"):  # the right side is gone afterwards
            self.tables, self.columns = saved_tables, saved_columns
        else:
            self.order += [prefix + n for n in entries]
        self.joined = True
        self.ops.append(lambda df, get: rel.join(df, get(s.table), on.emit(), s.kind, prefix))

    def do_expand(self, s: ir.Expand) -> None:
        if self.in_group or self.expanded or not self.inputs:
            raise ModelError("E075", "a model expands one array, behind its from and before its group")
        if self.set_seen:
            raise ModelError("E076", "expand stands before a set operation or in another model")
        table = self.tables[self.inputs[0]]
        found = table.get(s.name)
        if found is None or found.type.name != "array" or found.type.element is None or found.type.element.name == "array":
            raise ModelError("E075", f"{s.name!r} is no column of {self.inputs[0]!r} that holds an array of plain elements")
        if s.to != s.name and s.to in table:
            raise ModelError("E075", f"{self.inputs[0]!r} has a column {s.to!r} already")
        self.expanded = True
        physical = f"__e_{s.to}"
        origin = tuple(Origin(o.node, o.column, "expanded") for o in found.origins)
        self.columns[s.to] = Bound(Typed(found.type.element, True), lambda: rel.col(physical), origin)
        if s.to not in self.order:
            self.order.append(s.to)
        self.ops.append(lambda df, get: rel.expand(df, s.name, physical))

    def close(self) -> None:
        """Apply the filters gathered so far."""
        gathered, self.filters = self.filters, []
        for f in gathered:
            self.ops.append(lambda df, get, f=f: df.filter(f.emit().cast("boolean")))

    def do_set(self, s: ir.SetOp) -> None:
        if not self.inputs:
            raise ModelError("E076", f"{s.op} needs a from first")
        if self.joined:
            raise ModelError("E076", f"join behind the {s.op}, not before it")
        if self.set_seen and not self.set_open:
            raise ModelError("E076", "set operations stand one behind the other")
        if self.outputs or self.sorts or self.taken or self.grouped:
            raise ModelError("E076", f"{s.op} stands before select, group, sort and take")
        if s.table in self.project.sources:
            raise ModelError("E076", f"{s.op} takes a model; {s.table!r} is a source")
        right = self.input(s.table)
        if list(right) != self.order:
            raise ModelError("E077", f"{s.op} needs the columns {self.order}, {s.table!r} has {list(right)}")
        if s.table not in self.inputs:
            self.inputs.append(s.table)
        self.close()
        left = {n: self.outer(n) for n in self.order}
        types: dict[str, Type] = {}
        for n, b in left.items():
            t = least_upper(b.type, right[n].type)  # type: ignore[union-attr]
            if t == UNKNOWN or (t.name == "money" and b.type != right[n].type):  # type: ignore[union-attr]
                raise ModelError("E077", f"{s.op}: {n!r} is {b.type} and {right[n].type}")  # type: ignore[union-attr]
            types[n] = t
            self.reads |= {(o.node, o.column) for o in b.origins} | {(s.table, n)}  # type: ignore[union-attr]

        def op(df: DataFrame, get: Callable[[str], DataFrame]) -> DataFrame:
            a = df.select(*[left[n].emit().cast(to_spark(t)).alias(n) for n, t in types.items()])  # type: ignore[union-attr]
            b = get(s.table).select(*[rel.col(n).cast(to_spark(t)).alias(n) for n, t in types.items()])
            return rel.combine(a, b, s.op, s.all)

        self.ops.append(op)
        self.columns = {
            n: Bound(Typed(types[n], b.typed.nullable or right[n].nullable), lambda n=n: rel.col(n), (*b.origins, Origin(s.table, n, "set")))  # type: ignore[union-attr]
            for n, b in left.items()
        }
        self.lets = {}
        self.tables = dict.fromkeys([*self.tables, s.table], self.columns)
        self.set_open = self.set_seen = True

    def do_dedup(self, by: tuple[ir.Expr, ...]) -> None:
        if not by:
            self.distinct = True
            return
        if self.distinct:
            raise ModelError("E076", "dedup and dedup by don't go together")
        for k in by:
            if isinstance(k, ir.Over) or any(isinstance(c, ir.Over) for c in ir.children(k)):
                raise ModelError("E065", "over (...) can't stand in dedup")
            if not isinstance(k, ir.Ref) or k.table is not None:
                raise ModelError("E076", "dedup by takes output columns")
            self.dedup.append(k.name)

    def do_group(self, keys: tuple[ir.Expr, ...], body: tuple[ir.Statement, ...]) -> None:
        self.grouped = True
        for k in keys:
            b = self.bind(k, self.outer, _Outer(where="group keys"))
            name = k.name if isinstance(k, ir.Ref) else f"g{len(self.keys)}"
            physical = f"__k{len(self.keys)}"
            self.keys.append((name, b, k))
            origins = tuple(Origin(o.node, o.column, "grouped") for o in b.origins) if isinstance(k, ir.Ref) else (Origin(self.model.name, name, "grouped"),)
            self.outputs.append((name, Bound(b.typed, lambda p=physical: rel.col(p), origins)))
        self.in_group = True
        for s in body:
            self.statement(s)
        self.in_group = False

    def output(self, name: str, e: ir.Expr) -> None:
        if self.in_group:
            if isinstance(e, ir.Ref) and e.table is None and e.name in [n for n, _, _ in self.keys]:
                self.outputs.append((name, self.after_group(e.name)))  # type: ignore[arg-type]
                return
            if isinstance(e, ir.Over):
                raise ModelError("E065", f"over (...) can't stand in a group body ({name})")
            if not isinstance(e, ir.Call) or e.name == "cast" or not find(e.name).aggregate:
                raise ModelError("E050", f"{name!r} in a group body has to be an aggregate or a group key")
            self.outputs.append((name, self.bind(e, self.after_group, _Outer(aggregates=True, where="a group body"))))
            return
        use = _Outer(windows=True)
        self.over = False
        if self.grouped:
            self.outputs.append((name, self.bind(e, self.after_group, use)))
        else:
            self.outputs.append((name, self.bind(e, self.lateral, use)))
        if self.over:
            self.over_outputs.add(id(self.outputs[-1][1]))

    def lateral(self, name: str) -> Bound | None:
        """Columns first; names only outputs have may be used further on."""
        return self.outer(name) or self.after_group(name)

    def sorting(self, name: str) -> Bound | None:
        """Outputs first."""
        return self.after_group(name) or (None if self.grouped else self.outer(name))

    # -- the end
    def finish(self) -> Compiled:
        m = self.model
        if not self.inputs:
            raise ModelError("E060", f"model {m.name!r} reads from nothing", m.line)
        self.close()
        if not self.outputs:
            self.outputs = [(n, self.outer(n)) for n in self.order]  # type: ignore[misc]
        named: dict[str, Bound] = {}
        for n, b in self.outputs:
            named[n] = b
        for k in self.dedup:
            if k not in named:
                raise ModelError("E076", f"dedup by {k!r}, which is no output")
        sorts: list[tuple[str, Bound | None, bool]] = []
        for i, (e, descending) in enumerate(self.sorts):
            if isinstance(e, ir.Ref) and e.table is None and e.name in named:
                sorts.append((e.name, None, descending))
                continue
            if self.dedup or self.distinct:
                raise ModelError("E076", "behind a dedup only output columns sort")
            look = self.sorting
            b = self.bind(e, self.after_group if self.grouped and isinstance(e, ir.Ref) and e.table else look, _Outer(aggregates=self.grouped, where="sort"))
            sorts.append((f"__s{i}", b, descending))
        schema = {n: Column(n, b.type, b.typed.nullable) for n, b in named.items()}
        for n, c in schema.items():
            if c.type.name == "decimal" and not 0 <= c.type.scale <= c.type.precision <= 38:
                raise ModelError("E070", f"{m.name}.{n} is {c.type}, which can't be stored")
        if m.upkeep.ages:
            for p in m.upkeep.partitions:
                if isinstance(p, ir.Ref) and p.name not in schema:
                    raise ModelError("E095", f"{m.name} is kept fresh by {p.name!r}, which is no output")
        self.verify_incremental(schema)
        self.verify_contract(schema)
        ops, keys, aggregated, having = list(self.ops), list(self.keys), list(self.aggregated), list(self.having)
        grouped, distinct, dedup, taken = self.grouped, self.distinct, list(self.dedup), self.taken

        def lower(get: Callable[[str], DataFrame]) -> DataFrame:
            df: DataFrame = None  # type: ignore[assignment]
            for op in ops:
                df = op(df, get)
            if grouped:
                groups = [b.emit().alias(f"__k{i}") for i, (_, b, _) in enumerate(keys)]
                cells = [make().alias(n) for n, make in aggregated]
                if not cells:
                    df = df.select(*groups).distinct()
                else:
                    df = df.groupBy(*groups).agg(*cells) if groups else df.agg(*cells)
                for h in having:
                    df = df.filter(h.emit().cast("boolean"))
            if self.documents and not grouped:
                self.asked.clear()
                for b in [*named.values(), *[b for _, b, _ in sorts if b is not None]]:
                    b.emit()
                df = df.withColumns({n: F.try_parse_json(b.emit()) for n, b in self.documents.values() if n in self.asked})
                self.parsed = True
            self.frame = df
            df = self.join_windows(df)
            hidden = [b.emit().alias(n) for n, b, _ in sorts if b is not None]
            df = df.select(*[b.emit().cast(to_spark(b.type)).alias(n, metadata={"logical": str(b.type)}) for n, b in named.items()], *hidden)
            self.parsed, self.frame, self.joined_windows = False, None, set()
            if distinct:
                df = rel.distinct_rows(df)
            if dedup:
                df = rel.dedup_by(df, dedup)
            if sorts:
                df = df.orderBy(*[rel.nulls_last(rel.col(n), d) for n, _, d in sorts])
            if taken:
                df = rel.take(df, taken.count, taken.skip)
            return df.drop(*[n for n, b, _ in sorts if b is not None]) if hidden else df

        depends = self.project.dependencies(m.name)
        return Compiled(
            model=m, schema=schema, lineage={n: b.origins for n, b in named.items()}, reads=self.reads, depends=depends,
            inputs=list(self.inputs), joins=self.checks, fingerprint=fingerprint(self.project, m, depends), lower=lower, grouped=grouped,
            loose=self.loose or taken is not None or not all(_repeats(w.fn, w.typed) for w in self.windows),
        )

    def verify_incremental(self, schema: dict[str, Column]) -> None:
        up, name = self.model.upkeep, self.model.name
        if not up.merges:
            return
        if self.grouped:
            raise ModelError("E087", f"{name}: a grouped model can't be merged, new rows would change old groups")
        if up.watermark not in schema:
            raise ModelError("E088", f"{name}: a merge needs a cdc_column among the outputs")
        named = [k.name for k in up.merge_on if isinstance(k, ir.Ref) and k.name in schema]
        if up.merge is ir.Merge.UPSERT and (not named or len(named) < len(up.merge_on)):
            raise ModelError("E089", f"{name}: upsert needs merge_keys among the outputs")

    def verify_contract(self, schema: dict[str, Column]) -> None:
        name = self.model.contract
        if not name:
            return
        if name not in self.project.contracts:
            raise ModelError("E061", f"unknown contract {name!r}")
        for want in self.project.contracts[name].columns:
            got, where = schema.get(want.name), f"{self.model.name}.{want.name}"
            if got is None:
                raise ModelError("E010", f"{where} is missing")
            if not fits(want.type, got.type):
                raise ModelError("E011", f"{where} is {got.type}, the contract says {want.type}")
            if not want.nullable and got.nullable:
                raise ModelError("E012", f"{where} can be null, the contract says nonnull")
            if (want.promise.values or want.promise.label) and got.type != STRING:
                raise ModelError("E013", f"{where} is {got.type}; enum and classification are for strings")


def _derived(*parts: Bound) -> tuple[Origin, ...]:
    keep = ("aggregated", "windowed", "expanded", "set")
    return tuple(dict.fromkeys(o if o.kind in keep else dataclasses.replace(o, kind="derived") for p in parts for o in p.origins))


def _plain(key: Bound) -> bool:
    """Whether a window's key is a value of the rows that groups and joins."""
    t = key.type
    return (t.numeric or t.temporal or t.name == "money" or t in (STRING, BOOL, UUID)) and bool(key.origins)


def _repeats(fn: Function, typed: Typed) -> bool:
    """Whether a function gives the same value in whatever order it meets its rows."""
    return fn.name in ("count", "min", "max", "rank", "dense_rank") or (fn.name == "sum" and typed.type != FLOAT64)


def applied(fn: Function, e: ir.Call, args: list[Bound], documents: tuple[Emit | None, ...] = ()) -> tuple[Typed, Emit]:
    """Check a call and give its type and its column."""
    a = Arguments(e.name, tuple(x.typed for x in args), e.args, documents)
    typed = fn.check(a)
    return typed, lambda: fn.lower(a, [x.emit() for x in args])


def binary(op: str, a: Bound, b: Bound) -> Bound:
    """An infix operator on two bound sides."""
    x, y = a.type, b.type
    nullable = a.typed.nullable or b.typed.nullable
    origins = _derived(a, b)
    if op in ("like", "rlike"):
        if any(t not in (STRING, UNKNOWN) for t in (x, y)):
            raise ModelError("E051", f"{op} compares strings, not {x} and {y}")
        return Bound(Typed(BOOL, nullable or UNKNOWN in (x, y)), lambda: like(a.emit(), b.emit()) if op == "like" else F.rlike(a.emit(), b.emit()), origins)
    if op in ("==", "!=", "<", "<=", ">", ">="):
        if not ((x.numeric and y.numeric) or x == y or UNKNOWN in (x, y)):
            raise ModelError("E051", f"can't compare {x} with {y}")
        make = {"==": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}[op]
        return Bound(Typed(BOOL, nullable or UNKNOWN in (x, y)), lambda: make(a.emit(), b.emit()), origins)
    if op == "in":
        raise ModelError("E055", "in needs a list")
    if op in ("and", "or"):
        if x != BOOL or y != BOOL:
            raise ModelError("E052", f"{op} joins conditions, not {x} and {y}")
        return Bound(Typed(BOOL, nullable), lambda: a.emit() & b.emit() if op == "and" else a.emit() | b.emit(), origins)
    if op == "+" and x == y == STRING:
        return Bound(Typed(STRING, nullable), lambda: F.concat(a.emit(), b.emit()), origins)
    t = arithmetic(op, x, y)
    if t == UNKNOWN:
        raise ModelError("E053", f"no {op} for {x} and {y}")
    kind = to_spark(t)

    def made() -> SparkColumn:
        p, q = a.emit(), b.emit()
        match op:
            case "||":
                return F.concat(p, q)
            case "+":
                out = p + q
            case "-":
                out = p - q
            case "*":
                out = p * q
            case "/":
                return F.try_divide(p.cast("double"), q.cast("double"))
            case _:
                out = F.try_mod(p, q)
        return out if t in (INT64, FLOAT64) else out.cast(kind)

    return Bound(Typed(t, nullable), made, origins)


def _conjuncts(e: ir.Expr) -> list[ir.Expr]:
    return [*_conjuncts(e.left), *_conjuncts(e.right)] if isinstance(e, ir.Binary) and e.op == "and" else [e]


def _touches(e: ir.Expr, table: str) -> bool:
    return (isinstance(e, ir.Ref) and e.table == table) or any(_touches(c, table) for c in ir.children(e))


def _cardinality(s: ir.Join, left: str, left_columns: list[str]) -> JoinCheck:
    """Keys of the equalities that a join's promise rests on."""
    if s.kind in ("semi", "anti"):
        raise ModelError("E079", f"a {s.kind} join never multiplies rows; it takes no expect")

    def plain_left(e: ir.Expr) -> str | None:
        return e.name if isinstance(e, ir.Ref) and (e.table == left or (e.table is None and e.name in left_columns)) else None

    def plain_right(e: ir.Expr) -> str | None:
        return e.name if isinstance(e, ir.Ref) and e.table == s.table else None

    lefts: list[str] = []
    rights: list[str] = []
    for c in _conjuncts(s.on):
        if not _touches(c, s.table):
            continue  # it only filters the left rows
        sides = [(c.left, c.right), (c.right, c.left)] if isinstance(c, ir.Binary) and c.op == "==" else []
        for mine, other in sides:
            key = plain_right(mine)
            if key is not None and not _touches(other, s.table):
                rights.append(key)
                if plain_left(other) is not None:
                    lefts.append(plain_left(other))  # type: ignore[arg-type]
                break
        else:
            raise ModelError("E079", f"expect {s.expect} rests on equalities with plain columns of {s.table!r}")
    if not rights or (s.expect == "one_to_one" and not lefts):
        raise ModelError("E079", f"expect {s.expect} needs an equality between columns of both sides")
    return JoinCheck(s.table, str(s.expect), list(dict.fromkeys(lefts)), list(dict.fromkeys(rights)))


def fingerprint(project: Project, m: ir.Model, depends: list[str]) -> str:
    """Hash of what a model means: its definition and those it reads."""
    shape = dataclasses.replace(m, line=None, attributes={})
    sources = [repr(project.sources[s.table]) for s in m.statements if isinstance(s, (ir.From, ir.Join)) and s.table in project.sources]
    above = [project.compiled[d].fingerprint for d in depends if d in project.compiled]
    return hashlib.sha256("|".join([repr(shape), *sources, *above]).encode()).hexdigest()[:16]


def compile_model(project: Project, model: ir.Model) -> Compiled:
    return _Compiler(project, model).run()
