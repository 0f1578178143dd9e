"""Relational operators on DataFrames, as models use them."""

from .relational import combine, dedup_by, distinct_rows, expand, join, nulls_last, take

__all__ = ["combine", "dedup_by", "distinct_rows", "expand", "join", "nulls_last", "take"]
