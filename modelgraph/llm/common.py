"""Shared plumbing: scratch tables on the cluster's shared folder, exact running
totals without a single-task window, and distributed connected components."""

from __future__ import annotations

import atexit
import functools
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOTS: list[tuple[SparkSession, str]] = []


@functools.lru_cache(maxsize=1)
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="modelgraph-")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` as the
    session has it.  Where it is unset, a temporary folder serves in local mode
    only, where all tasks run on this machine."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (known or _local_root()).rstrip("/")


def release() -> None:
    """Delete the scratch tables made so far; frames that read them are void then.
    Long sessions call it between jobs, the driver's exit does anyway."""
    while _ROOTS:
        spark, path = _ROOTS.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already; the folder is scratch
            pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; deleted when the driver exits."""
    if not _ROOTS:
        atexit.register(release)
    path = f"{shared_dir(spark)}/modelgraph-{uuid.uuid4().hex[:12]}-{name}"
    _ROOTS.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet on the shared folder and read it back.

    This cuts the lineage durably: the files outlive any executor, and what is
    computed twice downstream is read instead."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tagged(base: DataFrame) -> DataFrame:
    """Add ``_tag`` to rows (_doc, text, ...): a number that tells rows of one _doc
    apart by their text, rising with its MD5; 0 where a _doc has one row.

    The table is stored in between if some _doc has several rows."""
    shared = base.groupBy("_doc").count().filter("count > 1").select("_doc")
    if shared.isEmpty():
        return base.withColumn("_tag", F.lit(0).cast("long"))
    base = base.withColumn("_digest", F.md5(F.coalesce(F.col("text"), F.lit(""))))
    texts = base.select("_doc", "_digest").join(shared, "_doc", "left_semi").distinct()
    # numbers rise over the sorted partitions
    numbered = stored(texts.sort("_doc", "_digest").withColumn("_tag", F.monotonically_increasing_id() + 1), "tags")
    # always by shuffle: the numbers may grow with the documents
    whole = base.join(numbered.hint("merge"), ["_doc", "_digest"], "left").withColumn("_tag", F.coalesce("_tag", F.lit(0)))
    return stored(whole.drop("_digest"), "tagged")


def running_totals(df: DataFrame, order: Sequence[Column], values: dict[str, str], name: str) -> DataFrame:
    """Add, for each ``{new: column}``, the exclusive running sum of ``column``
    in ``order`` over the whole table.

    Rows are dealt by range (so a hot key spreads as long as ``order`` ends in
    something distinct), summed per range, and only the one row per range meets
    in a single task.  The result doesn't depend on where the ranges are cut."""
    spark = df.sparkSession
    dealt = stored(df.repartitionByRange(shuffle_parts(spark), *order).withColumn("_range", F.spark_partition_id()), name)
    per = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in values.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_range", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in values])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in values.items()}).join(per, "_range")
    return out.withColumns({n: F.col(n) + F.col(f"_base_{n}") for n in values}).drop("_range", *[f"_base_{n}" for n in values])


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of the undirected ``edges`` (columns a, b: long).

    Returns (node, component), the component being its smallest node; nodes
    without an edge don't appear.  Each round hooks every node to its smallest
    neighbour, shortens the chains and contracts the graph, so the edges left
    shrink geometrically.  All state is in tables on the shared folder."""
    spark = edges.sparkSession
    edges = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), f"{name}-edges")
    mapping = None
    step = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("parent")), f"{name}-hook{step}")
        for _ in range(2):
            up = hook.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            hook = hook.join(up, "parent").select("node", F.col("above").alias("parent"))
        hook = stored(hook, f"{name}-short{step}")
        if mapping is None:
            mapping = hook.select("node", F.col("parent").alias("component"))
        else:
            mapping = mapping.join(hook.select(F.col("node").alias("component"), "parent"), "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        mapping = stored(mapping, f"{name}-map{step}")
        a = hook.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        b = hook.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = stored(edges.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).filter("a <> b").distinct(), f"{name}-edges{step}")
        step += 1
    return mapping if mapping is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def utf8(value: str | None) -> bytes:
    """UTF-8 bytes of a text; null is the empty text."""
    return value.encode("utf-8", "surrogatepass") if value else b""


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` (text or binary) holds about
    ``limit`` bytes in each; a longer single row still comes whole."""
    for batch in batches:
        array = batch.column(batch.schema.get_field_index(column))
        start = size = 0
        for i, n in enumerate(pc.binary_length(array).to_pylist()):
            if i > start and size + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if len(array) > start:
            yield batch.slice(start)
