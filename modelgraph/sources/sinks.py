"""Where rows can be written: files, databases, tables of the catalog."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

#: Formats by the ending of a path.
ENDINGS = {"parquet": "parquet", "orc": "orc", "csv": "csv", "json": "json", "jsonl": "json"}


def write(df: DataFrame, target: str, options: Mapping[str, str] | None = None, mode: str = "overwrite") -> None:
    """Write ``df`` to ``target``: ``jdbc:...`` (with a ``dbtable`` among the
    options), a path with a known ending, or the name of a catalog table."""
    options = dict(options or {})
    if target.startswith("jdbc:"):
        df.write.format("jdbc").mode(mode).options(url=target, **options).save()
        return
    kind = options.pop("format", None)
    ending = target.rstrip("/").rpartition(".")[2]
    if ending in ENDINGS or "/" in target:
        kind = kind or ENDINGS.get(ending, "parquet")
        defaults = {"header": "true"} if kind == "csv" else {}
        df.write.format(kind).mode(mode).options(**defaults | options).save(target)
        return
    df.write.format(kind or "parquet").mode(mode).options(**options).saveAsTable(target)
