"""Definitions: expressions, statements and declarations."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field

from .types import Column


# -- expressions ------------------------------------------------------------

@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: object


@dataclass(frozen=True)
class Template(Expr):
    parts: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Items(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class Comprehension(Expr):
    body: Expr
    name: str
    over: Expr


@dataclass(frozen=True)
class Ref(Expr):
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Keyword(Expr):
    name: str
    value: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...] = ()
    distinct: bool = False


@dataclass(frozen=True)
class Over(Expr):
    call: Call
    partition_by: tuple[Expr, ...] = ()
    sort: tuple[tuple[Expr, bool], ...] = ()


@dataclass(frozen=True)
class MakeModel(Expr):
    """A model that a function makes; its name may be a template."""

    name: Expr
    model: Model


def children(e: Expr) -> tuple[Expr, ...]:
    match e:
        case Unary(_, a):
            return (a,)
        case Binary(_, a, b):
            return (a, b)
        case Keyword(_, v):
            return (v,)
        case Call(_, args):
            return args
        case Over(call, parts, sort):
            return (*call.args, *parts, *(k for k, _ in sort))
        case Items(items):
            return items
    return ()


# -- statements -------------------------------------------------------------

@dataclass(frozen=True)
class Statement:
    pass


@dataclass(frozen=True)
class From(Statement):
    table: str


@dataclass(frozen=True)
class Join(Statement):
    kind: str
    table: str
    on: Expr
    expect: str | None = None


@dataclass(frozen=True)
class Filter(Statement):
    condition: Expr


@dataclass(frozen=True)
class Let(Statement):
    name: str
    value: Expr


@dataclass(frozen=True)
class Outputs(Statement):
    """select, derive or aggregate."""

    kind: str
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Group(Statement):
    keys: tuple[Expr, ...]
    body: tuple[Statement, ...]


@dataclass(frozen=True)
class Sort(Statement):
    keys: tuple[tuple[Expr, bool], ...]


@dataclass(frozen=True)
class Take(Statement):
    count: int
    skip: int = 0


@dataclass(frozen=True)
class Expand(Statement):
    name: str
    to: str


@dataclass(frozen=True)
class SetOp(Statement):
    op: str
    all: bool
    table: str


@dataclass(frozen=True)
class Dedup(Statement):
    by: tuple[Expr, ...] = ()


# -- declarations -----------------------------------------------------------

@dataclass
class Source:
    name: str
    columns: list[Column] = field(default_factory=list)
    attributes: dict[str, str] = field(default_factory=dict)


@dataclass
class Contract:
    name: str
    columns: list[Column] = field(default_factory=list)


class Merge(enum.Enum):
    """How a run brings new rows into the snapshot before."""

    REPLACE = "replace"
    APPEND = "append"
    UPSERT = "upsert"


@dataclass(frozen=True)
class Upkeep:
    """How a model's snapshots are stored and kept up."""

    partitions: tuple[Expr, ...] = ()
    ages: tuple[str, ...] = ()  # the oldest they may be
    age_of: str | None = None  # the column that tells, instead of the last run's time
    merge: Merge | None = None
    merge_on: tuple[Expr, ...] = ()
    watermark: str | None = None  # only rows above its largest value are new

    @property
    def merges(self) -> bool:
        return self.merge in (Merge.APPEND, Merge.UPSERT)


@dataclass
class Model:
    name: str
    statements: list[Statement] = field(default_factory=list)
    contract: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)
    upkeep: Upkeep = Upkeep()
    line: int | None = None


@dataclass(frozen=True)
class ExpectRows:
    """The number of rows compares with a number."""

    op: str
    value: object


@dataclass(frozen=True)
class ExpectValues:
    """Each value of a column compares with a literal; nulls pass."""

    column: str
    op: str
    value: object


@dataclass(frozen=True)
class ExpectParents:
    """Each value of a column stands in a column of another model; nulls pass."""

    column: str
    model: str
    parent: str


Expectation = ExpectRows | ExpectValues | ExpectParents


@dataclass
class Test:
    __test__ = False
    model: str
    expects: list[Expectation] = field(default_factory=list)


@dataclass
class Fn:
    name: str
    params: list[tuple[str, str]]
    body: Expr


@dataclass
class Pipeline:
    """Models that run together, with other tables for some sources."""

    name: str
    models: list[Expr] = field(default_factory=list)
    env: str = ""
    overrides: dict[str, dict[str, str]] = field(default_factory=dict)


@dataclass
class Module:
    imports: list[str] = field(default_factory=list)
    sources: list[Source] = field(default_factory=list)
    contracts: list[Contract] = field(default_factory=list)
    domains: list[tuple[str, str]] = field(default_factory=list)
    models: list[Model] = field(default_factory=list)
    tests: list[Test] = field(default_factory=list)
    fns: list[Fn] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)
    pipelines: list[Pipeline] = field(default_factory=list)
