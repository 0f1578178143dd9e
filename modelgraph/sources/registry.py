"""Registry of source tables and their projection to declared columns."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ir
from ..errors import ModelError
from ..operators.relational import col
from ..types import to_spark


def read(spark: SparkSession, location: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """A table by path or name; the ending says the format: ``.parquet``,
    ``.orc``, ``.csv``, ``.json``; ``jdbc:`` URLs need a ``dbtable`` option."""
    options = dict(options or {})
    if location.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=location, **options).load()
    for ending, kind in ((".parquet", "parquet"), (".orc", "orc"), (".csv", "csv"), (".json", "json"), (".jsonl", "json")):
        if location.rstrip("/").endswith(ending):
            extra = {"header": "true", "inferSchema": "true"} if kind == "csv" else {}
            return spark.read.format(kind).options(**(extra | options)).load(location)
    if "/" in location:
        return spark.read.options(**options).parquet(location)
    return spark.table(location)


def conformed(df: DataFrame, source: ir.Source) -> DataFrame:
    """The declared columns of a source, cast to their types.  Nothing else is
    read, so the scan is pruned to them."""
    have = set(df.columns)
    missing = [c.name for c in source.columns if c.name not in have]
    if missing:
        raise ModelError("E021", f"source {source.name!r} has no column {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in source.columns:
        wanted = to_spark(c.type)
        out.append(col(c.name) if kinds[c.name] == wanted else col(c.name).cast(wanted).alias(c.name))
    return df.select(*out)


class Sources:
    """Tables by source name: a DataFrame, or a path or table name to read."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | str] | None = None):
        self.spark = spark
        self.tables: dict[str, DataFrame | str] = dict(tables or {})

    @classmethod
    def folder(cls, spark: SparkSession, path: str, names: list[str]) -> Sources:
        return cls(spark, {n: f"{path}/{n}.parquet" for n in names})

    def overridden(self, overrides: Mapping[str, DataFrame | str | Mapping[str, str]]) -> Sources:
        """With other tables for some sources; a pipeline gives ns and dataset,
        which name the table ``ns.dataset`` or a registered ``dataset``."""
        tables = dict(self.tables)
        for name, value in overrides.items():
            if name not in tables:
                raise ModelError("E020", f"override of unknown source {name!r}")
            if isinstance(value, Mapping):
                ns, dataset = value.get("ns"), value.get("dataset", name)
                tables[name] = self.tables.get(dataset, f"{ns}.{dataset}" if ns else dataset)
            else:
                tables[name] = value
        return Sources(self.spark, tables)

    def raw(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ModelError("E020", f"no table for source {name!r}")
        value = self.tables[name]
        return read(self.spark, value) if isinstance(value, str) else value

    def identity(self, source: ir.Source) -> str | None:
        """A hash of the listing of a source's files (path, length, time of change)
        and of its declared columns; nothing if it isn't read from files."""
        value = self.tables.get(source.name)
        if not isinstance(value, str) or "/" not in value or value.startswith("jdbc:"):
            return None
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(value)
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return None
        files, found = [], system.listFiles(path, True)
        while found.hasNext():
            f = found.next()
            if not f.getPath().getName().startswith(("_", ".")):
                files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return hashlib.sha256(repr(([(c.name, str(c.type)) for c in source.columns], sorted(files))).encode()).hexdigest()[:16]

    def get(self, source: ir.Source) -> DataFrame:
        return conformed(self.raw(source.name), source)
