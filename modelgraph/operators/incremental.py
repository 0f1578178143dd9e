"""Merging new rows into a previous result by a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import col


def delta(previous: DataFrame, current: DataFrame, watermark: str) -> DataFrame:
    """Rows of ``current`` above the highest watermark of ``previous``.  The
    value is fetched and stands in the plan as a literal, so that the filter is
    pushed down to the scan."""
    top = previous.agg(F.max(col(watermark))).first()[0]
    return current if top is None else current.filter(col(watermark) > F.lit(top).cast(current.schema[watermark].dataType))


def append(previous: DataFrame, current: DataFrame, watermark: str) -> DataFrame:
    return previous.select(*[col(c) for c in current.columns]).unionByName(delta(previous, current, watermark))


def upsert(previous: DataFrame, current: DataFrame, watermark: str, keys: Sequence[str]) -> DataFrame:
    """New rows take the place of all previous ones with their keys."""
    new = delta(previous, current, watermark)
    kept = previous.select(*[col(c) for c in current.columns]).join(new.select(*[col(k) for k in keys]).distinct(), list(keys), "left_anti")
    return kept.select(*[col(c) for c in current.columns]).unionByName(new)
