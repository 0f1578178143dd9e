"""Registry of functions and the checks they share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ModelError
from ..ir import Expr, Lit
from ..types import INT64, JSON, STRING, UNKNOWN, Type, Typed

#: What an argument of a kind may be.
KINDS: dict[str, Callable[[Type], bool]] = {
    "any": lambda t: True,
    "number": lambda t: t.numeric or t.name == "money",
    "string": lambda t: t == STRING,
    "int": lambda t: t == INT64,
    "temporal": lambda t: t.temporal,
    "json": lambda t: t == JSON,
    "array": lambda t: t.name == "array",
    "map": lambda t: t.name == "map",
    "struct": lambda t: t.name == "struct",
}
#: Kinds whose first argument has to have a type of its own.
_CONTAINERS = ("array", "map", "struct", "json")


@dataclass(frozen=True)
class Arguments:
    """The arguments of one call, as the rules see them."""

    name: str
    typed: tuple[Typed, ...]
    exprs: tuple[Expr, ...]
    documents: tuple[Callable[[], Column] | None, ...] = ()

    @property
    def types(self) -> list[Type]:
        return [a.type for a in self.typed]

    @property
    def any_nullable(self) -> bool:
        return any(a.nullable for a in self.typed)

    def literal(self, i: int) -> object:
        e = self.exprs[i]
        return e.value if isinstance(e, Lit) else None

    def document(self, i: int, c: Sequence[Column]) -> Column:
        """JSON argument ``i`` as a variant, parsed once if it is known as one."""
        known = self.documents[i] if i < len(self.documents) else None
        return known() if known else F.try_parse_json(c[i])

    def reject(self, why: str, code: str = "E063") -> ModelError:
        return ModelError(code, f"{self.name}(): {why}")


Rule = Callable[[Arguments], Typed]
Lower = Callable[[Arguments, list[Column]], Column]


@dataclass(frozen=True)
class Function:
    name: str
    kinds: tuple[str, ...]
    least: int
    most: int | None
    rule: Rule
    lower: Lower
    aggregate: bool = False
    window: bool = False
    doc: str = ""
    variant: Lower | None = None

    def kind(self, i: int) -> str:
        return self.kinds[min(i, len(self.kinds) - 1)] if self.kinds else "any"

    def check(self, args: Arguments) -> Typed:
        """The call's type, or the error that it is."""
        n = len(args.typed)
        if n < self.least or (self.most is not None and n > self.most):
            want = str(self.least) if self.least == self.most else f"{self.least} or more" if self.most is None else f"{self.least} to {self.most}"
            raise args.reject(f"takes {want} arguments, got {n}", "E062")
        for i, t in enumerate(args.types):
            kind = self.kind(i)
            if t == UNKNOWN and not (i == 0 and kind in _CONTAINERS):
                continue  # null takes the type that is asked for
            if not KINDS[kind](t):
                raise args.reject(f"argument {i + 1} has to be {kind}, got {t}")
        return self.rule(args)


CATALOG: dict[str, Function] = {}


def find(name: str) -> Function:
    if name not in CATALOG:
        raise ModelError("E059", f"unknown function {name!r}")
    return CATALOG[name]


def function(name: str, kinds: Sequence[str] = (), least: int | None = None, most: int | None = -1, *, rule: Rule, aggregate: bool = False, window: bool = False, doc: str = "", variant: Lower | None = None, aliases: Sequence[str] = ()) -> Callable[[Lower], Lower]:
    """Register the decorated lowering; by default it takes exactly the listed
    kinds of arguments.  ``variant`` gives a JSON result that isn't text yet."""
    lowest = len(kinds) if least is None else least
    highest = len(kinds) if most == -1 else most

    def add(lower: Lower) -> Lower:
        for n in (name, *aliases):
            CATALOG[n] = Function(n, tuple(kinds), lowest, highest, rule, lower, aggregate, window, doc, variant)
        return lower

    return add


def gives(t: Type, nullable: bool | None = None) -> Rule:
    """A fixed type; null if any argument is, unless said otherwise."""
    return lambda a: Typed(t, a.any_nullable if nullable is None else nullable)


def of_first(nullable: bool | None = None) -> Rule:
    """The first argument's type."""
    return lambda a: Typed(a.types[0], a.typed[0].nullable if nullable is None else nullable)
