"""Publication of runs as tables of a catalog, in any table format whose connector
the session has.

Each model of a run becomes a table of its own, ``<model>__<run>``, never changed
afterwards.  Only when all are written and counted do the views ``<model>`` and the
record of the catalog name the run, so readers see all of it or nothing."""

from __future__ import annotations

import json

from ..errors import ModelError
from .store import Store

_RECORD = "catalog.json"


class Catalog:
    def __init__(self, store: Store, database: str = "default", kind: str = "parquet"):
        self.store, self.spark, self.database, self.kind = store, store.spark, database, kind

    def record(self) -> dict:
        return json.loads(self.store.text(_RECORD) or '{"current": null, "runs": {}}')

    def _table(self, model: str, run: str) -> str:
        return f"`{self.database}`.`{model}__{run}`"

    def _models(self, run: str) -> dict[str, int]:
        known = self.record()["runs"]
        if run not in known:
            raise ModelError("E100", f"run {run!r} isn't in the catalog")
        return known[run]

    def _point(self, record: dict, run: str) -> None:
        for model in record["runs"][run]:
            self.spark.sql(f"CREATE OR REPLACE VIEW `{self.database}`.`{model}` AS SELECT * FROM {self._table(model, run)}")
        self.store.put(_RECORD, json.dumps(record | {"current": run}, sort_keys=True))

    def publish(self, run: str) -> dict[str, int]:
        """Publish a run's snapshots; the rows of each model."""
        made: list[str] = []
        rows: dict[str, int] = {}
        try:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}`")
            for model in self.store.entry(run)["models"]:
                df = self.store.read("runs", run, "models", model)
                made.append(self._table(model, run))
                df.write.format(self.kind).mode("overwrite").saveAsTable(made[-1])
                rows[model] = self.spark.table(made[-1]).count()
                if rows[model] != df.count():
                    raise ModelError("E100", f"{made[-1]} holds {rows[model]} rows, the snapshot another number")
        except Exception as e:  # a missing connector shows in many ways
            for t in made:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            raise e if isinstance(e, ModelError) else ModelError("E100", f"can't publish as {self.kind}: {str(e).splitlines()[0]}") from e
        record = self.record()
        record["runs"][run] = rows
        self._point(record, run)
        return rows

    def verify(self, run: str, independent: bool = False) -> dict[str, int]:
        """Count a published run's tables again and hold them against the record;
        ``independent``: by reading their files without Spark."""
        out = {}
        for model, wanted in self._models(run).items():
            try:
                table = self.spark.table(self._table(model, run))
                out[model] = self._counted(table.inputFiles()) if independent else table.count()
            except ModelError:
                raise
            except Exception as e:
                raise ModelError("E100", f"{model!r} of run {run} can't be read: {str(e).splitlines()[0]}") from e
            if out[model] != wanted:
                raise ModelError("E100", f"{model!r} of run {run} has {out[model]} rows, {wanted} were published")
        return out

    def _counted(self, files: list[str]) -> int:
        import pyarrow.parquet as pq
        from pyarrow import fs

        if self.kind != "parquet":
            raise ModelError("E100", f"no second reader for {self.kind}")
        total = 0
        for f in files:
            system, path = fs.FileSystem.from_uri(f)
            total += pq.ParquetFile(path, filesystem=system).metadata.num_rows
        return total

    def rollback(self, run: str) -> None:
        """Let the views show a run that was published before."""
        self.verify(run)
        self._point(self.record(), run)

    def gc(self, keep: int = 2, apply: bool = False) -> list[str]:
        """Runs beyond the last ``keep`` and the current one; dropped with ``apply``."""
        record = self.record()
        order = [e["run"] for e in self.store.history() if e["run"] in record["runs"]]
        order = list(dict.fromkeys(reversed(order)))
        gone = [r for r in [*order, *[r for r in record["runs"] if r not in order]][keep:] if r != record["current"]]
        if apply:
            for run in gone:
                for model in record["runs"].pop(run):
                    self.spark.sql(f"DROP TABLE IF EXISTS {self._table(model, run)}")
            self.store.put(_RECORD, json.dumps(record, sort_keys=True))
        return gone
