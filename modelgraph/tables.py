"""What is known of a project, as tables: lineage, what a change reaches, changes,
findings, promises of joins and tests."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ir
from .lineage import blast_radius, changes
from .lint import lint
from .operators.relational import col
from .plans import Project
from .plans.compiler import JoinCheck
from .quality import broken
from .syntax.printer import expectation


def lineage(spark: SparkSession, project: Project) -> DataFrame:
    """(model, column, from_node, from_column, kind)."""
    rows = [(m, c, o.node, o.column, o.kind) for m, x in project.check().items() for c, origins in x.lineage.items() for o in origins]
    return spark.createDataFrame(rows, "model string, column string, from_node string, from_column string, kind string")


def radius(spark: SparkSession, project: Project, changed: list[tuple[str, str]]) -> DataFrame:
    """(node, column) of the changed columns and all that is made from them."""
    return spark.createDataFrame(sorted(blast_radius(project.check(), changed)), "node string, column string")


def differences(spark: SparkSession, old: Project, new: Project) -> DataFrame:
    """(model, column, kind, breaking) of the changes from one version to another."""
    found = changes(old.check(), new.check(), old.contracts, new.contracts)
    return spark.createDataFrame([(c.model, c.column, c.kind, c.breaking) for c in found], "model string, column string, kind string, breaking boolean")


def findings(spark: SparkSession, project: Project) -> DataFrame:
    """(code, place, what) of the warnings."""
    rows = [(line[:4], *line[5:].split(": ", 1)) for line in lint(project)]
    return spark.createDataFrame(rows, "code string, place string, what string")


def expectations(spark: SparkSession, tests: Iterable[ir.Test], frame: Callable[[str], DataFrame]) -> DataFrame:
    """(model, expects, holds) of declarative tests."""
    rows = [(t.model, expectation(e), not failed) for t in tests for e, failed in broken(t, frame)]
    return spark.createDataFrame(rows, "model string, expects string, holds boolean")


def broken_joins(checks: Iterable[tuple[str, JoinCheck]], frame: Callable[[str], DataFrame]) -> DataFrame | None:
    """(model, joins, expects, keys_twice): for each promise of a join, how many
    keys of the joined table stand in several rows; lazily, in one pass each."""
    out = None
    for model, check in checks:
        keys = [col(k) for k in check.right_keys]
        twice = frame(check.table).select(*keys).na.drop("any").groupBy(*keys).count().filter("count > 1")
        row = twice.agg(F.count(F.lit(1)).alias("keys_twice")).select(F.lit(model).alias("model"), F.lit(check.table).alias("joins"), F.lit(check.expect).alias("expects"), "keys_twice")
        out = row if out is None else out.union(row)
    return out
