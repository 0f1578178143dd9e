"""Each operator is one DataFrame expression that Catalyst plans."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def nulls_last(key: Column, descending: bool = False) -> Column:
    return key.desc_nulls_last() if descending else key.asc_nulls_last()


def join(left: DataFrame, right: DataFrame, on: Column, kind: str, prefix: str) -> DataFrame:
    """Join with the right columns renamed to ``prefix`` + name; semi and anti
    joins add no columns.  Catalyst and AQE pick the algorithm."""
    right = right.select([col(c).alias(prefix + c) for c in right.columns])
    return left.join(right, on, {"semi": "left_semi", "anti": "left_anti"}.get(kind, kind))


def _holds_map(t: T.DataType) -> bool:
    match t:
        case T.MapType():
            return True
        case T.ArrayType():
            return _holds_map(t.elementType)
        case T.StructType():
            return any(_holds_map(f.dataType) for f in t.fields)
    return False


def comparable(c: Column, t: T.DataType) -> Column:
    """A value with its maps, at any depth, as sorted entries: maps don't compare."""
    if not _holds_map(t):
        return c
    match t:
        case T.MapType():
            return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), comparable(e["value"], t.valueType).alias("value"))))
        case T.ArrayType():
            return F.transform(c, lambda x: comparable(x, t.elementType))
    return F.when(c.isNotNull(), F.struct(*[comparable(c[f.name], f.dataType).alias(f.name) for f in t.fields]))


def _restored(c: Column, t: T.DataType) -> Column:
    """What ``comparable`` was made of."""
    if not _holds_map(t):
        return c
    match t:
        case T.MapType():
            return F.map_from_entries(F.transform(c, lambda e: F.struct(e["key"], _restored(e["value"], t.valueType))))
        case T.ArrayType():
            return F.transform(c, lambda x: _restored(x, t.elementType))
    return F.when(c.isNotNull(), F.struct(*[_restored(c[f.name], f.dataType).alias(f.name) for f in t.fields]))


def _compared(work: Callable[..., DataFrame], *frames: DataFrame) -> DataFrame:
    """Run ``work`` on frames of one schema in a form that compares."""
    held = {f.name: f.dataType for f in frames[0].schema.fields if _holds_map(f.dataType)}
    if not held:
        return work(*frames)
    out = work(*[df.withColumns({n: comparable(col(n), t) for n, t in held.items()}) for df in frames])
    return out.withColumns({n: _restored(col(n), t) for n, t in held.items()})


def distinct_rows(df: DataFrame) -> DataFrame:
    return _compared(DataFrame.distinct, df)


def combine(left: DataFrame, right: DataFrame, op: str, all_rows: bool) -> DataFrame:
    """union [all], intersect, except; rows match by column name."""
    right = right.select([col(c) for c in left.columns])
    if op == "union" and all_rows:
        return left.union(right)
    work = {"union": lambda a, b: a.union(b).distinct(), "intersect": DataFrame.intersect, "except": DataFrame.subtract}[op]
    return _compared(work, left, right)


def dedup_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key: the first by all other columns, ascending.  Only
    the best row of a key leaves a task before the shuffle."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rest = [comparable(col(c), kinds[c]) for c in df.columns if c not in keys]
    order = [nulls_last(c) for c in rest] or [F.lit(1)]
    window = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(window)).filter("__nth = 1").drop("__nth")


def grouped(df: DataFrame, keys: dict[str, Column], cells: dict[str, Column]) -> DataFrame:
    """A row for each key, with named aggregates."""
    return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*[c.alias(n) for n, c in cells.items()])


def ranks(df: DataFrame, keys: dict[str, Column], parts: Sequence[str], places: dict[str, tuple[bool, list[tuple[str, bool]]]]) -> DataFrame:
    """Ranks by key: ``places`` has of each whether it is dense, and the keys it
    sorts by.  A rank is one more than the rows of all keys before."""
    counted = grouped(df, keys, {"__n": F.count(F.lit(1))})
    cells = []
    for name, (dense, order) in places.items():
        window = Window.partitionBy(*[col(p) for p in parts]).orderBy(*[nulls_last(col(n), d) for n, d in order])
        before = F.sum("__n").over(window.rowsBetween(Window.unboundedPreceding, -1))
        cells.append((F.dense_rank().over(window) if dense else F.coalesce(before, F.lit(0)) + 1).cast("long").alias(name))
    return counted.select(*[col(k) for k in keys], *cells)


def beside(df: DataFrame, keyed: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Each row with the row of its key, where null is a key too."""
    on = [value.eqNullSafe(col(n)) for n, value in keys.items()]
    return df.join(keyed, functools.reduce(lambda a, b: a & b, on), "left")


def expand(df: DataFrame, source: str, to: str) -> DataFrame:
    """A row for each element; none for a null or empty array."""
    return df.withColumn(to, F.explode(col(source)))


def take(df: DataFrame, count: int, skip: int = 0) -> DataFrame:
    return (df.offset(skip) if skip else df).limit(count)
