"""Text front end: a module of definitions from its source text."""

from .reader import read_expression, read_module

__all__ = ["read_expression", "read_module"]
