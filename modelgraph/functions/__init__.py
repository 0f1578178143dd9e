"""The function catalog: for each function its arity, argument kinds, result
type and its lowering to Spark columns."""

from . import aggregates, arrays, conditionals, dates, json, maps, strings, windows  # noqa: F401
from .catalog import CATALOG, Function, find

__all__ = ["CATALOG", "Function", "find"]
