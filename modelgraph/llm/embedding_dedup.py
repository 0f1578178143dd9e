"""Embedding near-duplicates by an exact metric range join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so the threshold is a radius.
Pivots drawn from the vectors of a label partition them into cells by the nearest
pivot.  By the triangle inequality a vector can only have a partner in another
cell if it lies within the radius of the plane between the two pivots; to those
cells it is copied, and then cells join independently: every vector finds all
its partners in the cell it is at home in.  Links are counted, not emitted; a
cell passes on just enough links to connect what is connected.

How many pivots a label gets is weighed on the vectors drawn as pivots: more of
them make cells smaller but copies more, and where vectors lie in all directions
alike, copies soon cost more than the comparisons they save.

Equal vectors of a label form a class that is compared once.  Cells beyond
``BLOCK_BYTES`` are joined block by block, so memory stays bounded however the
vectors crowd.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without label, are linked with nothing and kept; vectors of
different dimension don't link; repeated rows are equal vectors; rows that share
a vec_id are one node of the components; a row without vec_id is linked with
nothing; finite vectors of any length count, they are scaled by their largest
component before their length is taken; an empty table gives an empty result;
extra columns don't enter the plan.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, shuffle_parts, stored, table

THRESHOLD = 0.98
#: Vectors of a label for each one drawn as a possible pivot.
CELL = 500
#: Bytes of the unit vectors in a block of a larger cell.
BLOCK_BYTES = 16_000_000
#: Vectors drawn, over all labels, at most; cells of more vectors are larger.
MAX_PIVOTS = 4096
#: Seconds that a copy costs on its way, and a comparison of two components.
SHIP, COMPARE = 1e-4, 2.5e-10


def _matrix(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    at = np.cumsum(np.r_[0, [len(v) for v in column]])
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    unit = np.stack(vectors).astype(np.float64)
    unit /= np.abs(unit).max(axis=1)[:, None]  # first, so no square overflows or vanishes
    return unit / np.sqrt((unit * unit).sum(axis=1))[:, None]


def _within(unit: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector, and whether it reaches into each cell."""
    d2 = np.maximum(0.0, 2 - 2 * unit @ pivots.T)
    apart = np.sqrt(np.maximum(1e-24, 2 - 2 * pivots @ pivots.T))
    home = d2.argmin(axis=1)
    rows = np.arange(len(home))
    reach = (d2 - d2[rows, home][:, None]) / (2 * apart[home]) <= radius
    reach[rows, home] = True
    return home, reach


def chosen(drawn: np.ndarray, n: int, radius: float) -> np.ndarray:
    """As many of the drawn vectors as make the cheapest pivots for ``n`` vectors
    like them."""
    best, least = 1, SHIP + n * COMPARE * drawn.shape[1]
    sample, k = drawn[-256:], 2
    while k <= len(drawn) - min(len(sample), len(drawn) // 2):
        copies = _within(sample, drawn[:k], radius)[1].sum(axis=1).mean()
        cost = copies * (SHIP + n / k * COMPARE * drawn.shape[1])
        if cost < least:
            best, least = k, cost
        k *= 2
    return drawn[:best]


def _assigned(batches: Iterable[pa.RecordBatch], pivots: object, radius: float) -> Iterator[pa.RecordBatch]:
    """A row for the home cell of each vector and for each cell it is copied to."""
    by: dict[tuple[int, int], np.ndarray] = pivots.value  # type: ignore[attr-defined]
    for batch in batches:
        label, cls, rep, n = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("label", "cls", "rep", "copies"))
        vectors = _matrix(batch.column(batch.schema.get_field_index("embedding")))
        rows: list[tuple] = []
        groups: dict[tuple[int, int], list[int]] = {}
        for i, (a, v) in enumerate(zip(label, vectors, strict=True)):
            groups.setdefault((a, len(v)), []).append(i)
        for (a, dim), members in groups.items():
            raw = [vectors[i].tobytes() for i in members]  # as exact as it came
            p = by.get((a, dim))
            if p is None or len(p) < 2:
                rows += [(a, dim, 0, True, cls[i], rep[i], n[i], x) for i, x in zip(members, raw, strict=True)]
                continue
            home, reach = _within(_unit([vectors[i] for i in members]), p, radius)
            for k, i in enumerate(members):
                rows += [(a, dim, c, c == home[k], cls[i], rep[i], n[i], raw[k]) for c in np.flatnonzero(reach[k]).tolist()]
        for k in range(0, len(rows), 20_000):
            c = list(zip(*rows[k : k + 20_000], strict=True))
            kinds = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], names=["label", "dim", "cell", "home", "cls", "rep", "copies", "vector"])


def _pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, partners) for the rows of ``a`` among those of ``b``."""
    for k in range(0, len(a), 64):
        cos = a[k : k + 64] @ b.T
        near = np.abs(cos - threshold) < 1e-9
        for i, j in np.argwhere(near).tolist():  # decided by an exactly rounded sum
            cos[i, j] = math.fsum((a[k + i] * b[j]).tolist())
        hit = cos >= threshold
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            yield k + i, np.flatnonzero(hit[i])


def _joined(batches: Iterable[pa.RecordBatch], threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (label, dim, cell, a, b). kind 0: (class, its
    smallest vec_id, copies it links with); kind 1: a link of two vec_ids."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    for _, run in itertools.groupby(rows(), key=lambda r: r[:5]):
        members = sorted(run, key=lambda r: (not r[5], r[6], r[7], r[8]))
        seekers = [r for r in members if r[5]]
        others = [r for r in members if not r[5]]
        out: list[tuple] = []
        x, y = (_unit([np.frombuffer(r[9], kind) for r in side]) if side else np.empty((0, 1)) for side in (seekers, others))
        copies = np.array([r[8] for r in others], dtype=np.int64)
        root = list(range(len(seekers) + len(others)))

        def find(i: int, root: list[int] = root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        here = {(r[6], r[7]): i for i, r in enumerate(seekers)}
        same = [here.get((r[6], r[7]), len(seekers) + j) for j, r in enumerate(others)]
        for i, partners in _pairs(x, y, threshold) if len(x) and len(y) else ():
            mine = seekers[i]
            n = 0
            for j in partners.tolist():
                if same[j] == i:
                    continue
                n += int(copies[j])
                p, q = find(i), find(same[j])
                if p != q:
                    root[p] = q
                    out.append((1, mine[7], others[j][7], 0))
            if n:
                out.append((0, mine[6], mine[7], n))
        for k in range(0, len(out), 20_000):
            c = list(zip(*out[k : k + 20_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in c], names=["kind", "a", "b", "n"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``vectors`` (vec_id, embedding,
    label)."""
    spark = vectors.sparkSession
    radius = math.sqrt(2 - 2 * threshold) + 1e-6
    e = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.coalesce(
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall(e, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v)) & F.exists(e, lambda v: v != 0), F.lit(False)
    )
    kind = vectors.schema["embedding"].dataType.elementType
    single = kind.simpleString() == "float"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<float>" if single else "array<double>"), usable.alias("usable"))
    # equal doubles, so -0.0 is 0.0
    known = rows.filter("usable").withColumn("embedding", F.transform("embedding", lambda v: F.when(v == 0, F.lit(0).cast(v_type(single))).otherwise(v)))
    known = known.withColumns({"cls": F.xxhash64("label", "embedding"), "cls2": F.xxhash64("embedding", F.lit(7))}).drop("usable")
    classes = known.groupBy("label", "cls", "cls2", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes, "classes")

    # possible pivots: some vectors of each label
    sizes = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL).withColumn("k", F.ceil(F.col("n") / CELL))
    total = sizes.agg(F.sum("k")).first()[0] or 0
    share = min(1.0, MAX_PIVOTS / max(1, total))
    chance = F.pmod(F.xxhash64("cls", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = classes.join(sizes, "label").filter(chance < F.lit(share) * F.col("k") / F.col("n"))
    drawn: dict[tuple[int, int], list[np.ndarray]] = {}
    count: dict[int, int] = {}
    # in the order of a hash, so that reruns take the same ones
    for r in few.orderBy(F.xxhash64("cls", F.lit(12)), "cls").limit(2 * MAX_PIVOTS).select("label", "n", "embedding").collect() if total else []:
        drawn.setdefault((r["label"], len(r["embedding"])), []).append(np.array(r["embedding"]))
        count[r["label"]] = r["n"]
    shared = spark.sparkContext.broadcast({k: chosen(_unit(v), count[k[0]], radius) for k, v in drawn.items()})

    cells = classes.repartition(shuffle_parts(spark)).mapInArrow(lambda it: _assigned(it, shared, radius), "label long, dim long, cell long, home boolean, cls long, rep long, copies long, vector binary")
    cells = stored(cells, "cells")
    key = ["label", "dim", "cell"]
    per = cells.groupBy(*key).agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("rows"))
    blocks = lambda n: F.ceil(F.col(n) * F.col("dim") * 8 / BLOCK_BYTES).cast("long")
    per = per.filter("homes > 0").select(*key, blocks("homes").alias("na"), blocks("rows").alias("nb"))
    cells = cells.join(per, key)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    seekers = cells.filter("home").withColumn("a", F.pmod(F.xxhash64("cls", "rep", F.lit(1)), F.col("na"))).withColumn("b", upto("nb")).withColumn("seeks", F.lit(True))
    others = cells.withColumn("b", F.pmod(F.xxhash64("cls", "rep", F.lit(2)), F.col("nb"))).withColumn("a", upto("na")).withColumn("seeks", F.lit(False))
    columns = [*key, "a", "b", "seeks", "cls", "rep", "copies", "vector"]
    tasks = seekers.select(columns).union(others.select(columns)).repartition(shuffle_parts(spark), *key, "a", "b").sortWithinPartitions(*key, "a", "b")
    width = "<f4" if single else "<f8"
    found = stored(tasks.mapInArrow(lambda it: _joined(it, threshold, width), "kind long, a long, b long, n long"), "links")

    counts = found.filter("kind = 0").groupBy(F.col("a").alias("cls"), F.col("b").alias("rep")).agg(F.sum("n").alias("others"))
    comps = components(found.filter("kind = 1").select("a", "b"), "vectors")
    named = classes.drop("embedding").join(counts, ["cls", "rep"], "left").join(comps, F.col("rep") == comps["node"], "left")
    links = (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long")
    named = named.select("label", "cls", "cls2", links.alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    mine = known.select("vec_id", "label", "cls", "cls2").join(named, ["label", "cls", "cls2"]).select("vec_id", "n_links", "component_id")
    # what can't be compared takes no part in the joins
    mine = mine.union(rows.filter("NOT usable").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return mine.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def v_type(single: bool) -> str:
    return "float" if single else "double"


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), n AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
), c AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id
"""
