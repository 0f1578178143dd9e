"""An append-only model as a structured stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from .. import ir
from ..errors import ModelError
from ..plans import Project
from ..sources import Sources, conformed


def streamable(project: Project, name: str) -> bool:
    """Whether each input row gives its output rows on its own: filters, lets,
    joins with tables, expansion and plain outputs, but no window."""

    def window(e: ir.Expr) -> bool:
        return isinstance(e, ir.Over) or any(window(c) for c in ir.children(e))

    for s in project.models[name].statements:
        if isinstance(s, (ir.Group, ir.Sort, ir.Take, ir.SetOp, ir.Dedup)):
            return False
        if isinstance(s, ir.Outputs) and any(window(e) for _, e in s.items):
            return False
    return True


def append_stream(project: Project, name: str, stream: DataFrame, sources: Sources, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run a model over ``stream``, which stands for its from table, and append
    the rows as Parquet; joined tables come from ``sources``.  With the
    checkpoint every input row counts once, over restarts too."""
    project.check([name])
    if not streamable(project, name):
        raise ModelError("E087", f"model {name!r} isn't row by row; it can't run over a stream")
    first = next(s.table for s in project.models[name].statements if isinstance(s, ir.From))
    if first in project.sources:
        stream = conformed(stream, project.sources[first])

    def get(node: str) -> DataFrame:
        if node == first:
            return stream
        return sources.get(project.sources[node]) if node in project.sources else project.frame(node, sources)

    out = project.compiled[name].lower(get)
    return out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
