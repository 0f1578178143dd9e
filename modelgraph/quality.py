"""Checks on data: contracts, join promises and declarative tests."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ir
from .errors import ModelError, PinError
from .operators.relational import col
from .plans.compiler import JoinCheck
from .syntax.printer import expectation
from .types import Type, to_spark


def _holds(wanted: Type, got: T.DataType) -> bool:
    """Whether a physical type can stand for a logical one: the same, or a
    smaller integer for an integer."""
    if wanted.name == "int64":
        return isinstance(got, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if wanted.numeric and isinstance(got, T.LongType):
        return True
    return got == to_spark(wanted)


def pin(df: DataFrame, contract: ir.Contract, where: str) -> None:
    """Hold data against a contract: columns and types by the schema; nulls,
    values and uniqueness in one pass over the rows."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for c in contract.columns:
        if c.name not in kinds:
            raise PinError("PIN", f"{where}: column {c.name!r} is missing")
        if not _holds(c.type, kinds[c.name]):
            raise PinError("PIN", f"{where}.{c.name} is {kinds[c.name].simpleString()}, the contract says {c.type}")
    counts = violations(df, contract)
    if not counts.columns:
        return
    row = counts.first().asDict()
    broken = [f"{where}.{name.replace('__', ' ')} in {n} rows" for name, n in row.items() if n]
    if broken:
        raise PinError("PIN", "; ".join(broken))


def violations(df: DataFrame, contract: ir.Contract) -> DataFrame:
    """One row with the number of rows that break each promise of a contract,
    by one pass over the data.  Columns are named ``<column>__<what>``."""
    keys = [c.name for c in contract.columns if c.promise.key]
    cells, names = [], []
    for c in contract.columns:
        if not c.nullable or c.promise.key == "primary":
            names.append(f"{c.name}__is null")
            cells.append(F.count_if(col(c.name).isNull()).alias(names[-1]))
        if known := sorted(c.promise.values):
            names.append(f"{c.name}__isn't one of " + ", ".join(known))
            cells.append(F.count_if(~col(c.name).isin(*known)).alias(names[-1]))
        if c.promise.key:
            names.append(f"{c.name}__isn't unique")
            if len(keys) == 1:
                cells.append((F.count(F.lit(1)) - F.count_distinct(col(c.name))).alias(names[-1]))
    if not names:
        return df.select()
    # distinct counts of several columns in one aggregate would send each row once for
    # each of them; counted by themselves, only the keys' own groups are sent
    twice = {f"{k}__isn't unique": _repeated(df, k) for k in keys} if len(keys) > 1 else {}
    base = df.agg(*cells) if cells else df.sparkSession.range(1).select()
    return base.select("*", *[c.alias(n) for n, c in twice.items()]).select(*[col(n) for n in names])


def _repeated(df: DataFrame, key: str) -> Column:
    """Rows less distinct values of a column."""
    groups = df.groupBy(col(key)).agg(F.count(F.lit(1)).alias("__rows"))
    return groups.agg(F.coalesce(F.sum("__rows"), F.lit(0)) - F.count(col(key))).scalar()


def _twice(df: DataFrame, keys: list[str]) -> bool:
    """Whether some rows share their keys; rows with a null key match nothing."""
    known = df.select(*[col(k) for k in keys]).na.drop("any")
    return not known.groupBy(*[col(k) for k in keys]).count().filter("count > 1").isEmpty()


def hold_join(check: JoinCheck, left: DataFrame, right: DataFrame, where: str) -> None:
    """Raise if a join would multiply rows against its promise."""
    if _twice(right, check.right_keys):
        raise PinError("PIN", f"{where}: {check.table} has several rows for one {', '.join(check.right_keys)}, the join expects {check.expect}")
    if check.expect == "one_to_one" and check.left_keys and _twice(left, check.left_keys):
        raise PinError("PIN", f"{where}: several rows share {', '.join(check.left_keys)}, the join expects one_to_one")


_COMPARE: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def run_tests(tests: Iterable[ir.Test], frame: Callable[[str], DataFrame], only: set[str] | None = None) -> list[str]:
    """Evaluate declarative tests; one line for each that holds, an error at the
    first that doesn't."""
    lines = []
    for t in tests:
        if only is not None and t.model not in only:
            continue
        for e, failed in broken(t, frame):
            if failed:
                raise ModelError("E081", f"test {t.model}: {expectation(e)}: {failed}")
            lines.append(f"{t.model}: {expectation(e)}")
    return lines


def broken(t: ir.Test, frame: Callable[[str], DataFrame]) -> list[tuple[ir.Expectation, str]]:
    """What is wrong by each expectation of a test, or nothing.  The rows are
    counted, and all values compared, in one pass."""
    df = frame(t.model)
    cells = {e: F.count(F.lit(1)) if isinstance(e, ir.ExpectRows) else F.count_if(~_COMPARE[e.op](col(e.column), F.lit(e.value))) for e in t.expects if not isinstance(e, ir.ExpectParents)}
    row = df.agg(F.count(F.lit(1)), *cells.values()).first()
    counts = dict(zip(cells, row[1:], strict=True))
    out = []
    for e in t.expects:
        match e:
            case ir.ExpectRows(op, value):
                out.append((e, "" if _COMPARE[op](row[0], value) else f"there are {row[0]}"))
            case ir.ExpectValues():
                out.append((e, f"{counts[e]} of {row[0]} rows break it" if counts[e] else ""))
            case ir.ExpectParents(column, model, parent):
                parents = frame(model).select(col(parent).alias("__there"))
                orphans = df.filter(col(column).isNotNull()).join(parents, col(column) == F.col("__there"), "left_anti").count()
                out.append((e, f"{orphans} rows are orphans" if orphans else ""))
    return out
