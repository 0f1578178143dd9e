"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Documents are cut into pieces of at most ``capacity`` tokens.  The pieces are
dealt into cells of bounded size; on every cell a few islands evolve packings:
the crossover injects whole well-filled bins of one parent into the other,
removes the bins that hold duplicates, and best-fits the displaced pieces.
Between epochs the islands of a cell pass their elite on to the next island.
Pieces that end in loosely filled bins are dealt anew, together with those of
other cells, and packed again, so the loss doesn't add up over cells.

Defined cases: a null or empty text is one piece, the end id alone; repeated
rows, and rows without doc_id, are packed one by one; pieces of one length are
taken in the order of their row; an empty table gives an empty result; a document
of any length becomes as many pieces as it needs; extra columns don't enter the
plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, stored, table
from .tokens import default_path, encoder

CAPACITY = 2048
END_ID = 0
#: Pieces in a cell, on average.
CELL = 3000
ISLANDS = 2
POPULATION = 4
#: Generations of an epoch at most, and without a better packing before it ends.
GENERATIONS = 80
PATIENCE = 16
#: Generations of an epoch on an island whose number of bins can't get smaller;
#: fuller bins are better all the same, for loose ones are dealt anew.
SETTLED = 3
#: Bins that a crossover exchanges pieces with.
TRIES = 64
#: Epochs of evolution; the elite migrates between them.
EPOCHS = 2
#: Bins at least so full are final; pieces of others are dealt anew.
FULL = 0.985
LEVELS = 3


# -- cutting --------------------------------------------------------------

def _pieces(batches: Iterable[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc, end = encoder(path), np.array([END_ID], dtype="<u4").tobytes()
    for batch in chunks(batches, "text", 4_000_000):
        rows: list[list] = [[], [], [], [], [], []]
        texts = batch.column(1).to_pylist()
        for k, ids in enumerate(enc.encode_many(texts)):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for column, v in zip(rows, (k, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                    column.append(v)
        names = [batch.schema.names[0], batch.schema.names[2], "piece", "start", "length", "ids_crc32", "ids"]
        own = pa.array(rows[0], pa.int64())
        arrays = [batch.column(0).take(own), batch.column(2).take(own), pa.array(rows[1], pa.int32()), *[pa.array(c, pa.int64()) for c in rows[2:5]], pa.array(rows[5], pa.binary())]
        n = 7 if with_ids else 6
        yield pa.RecordBatch.from_arrays(arrays[:n], names=names[:n])


def cut(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, row_id, piece, start, length, ids_crc32[, ids]) of all documents.
    ``row_id`` tells rows of ``docs`` apart that share a doc_id."""
    path = path or default_path()
    out = T.StructType([docs.schema["doc_id"], T.StructField("row_id", T.LongType()), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])
    if with_ids:
        out = out.add("ids", T.BinaryType())
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_id")).mapInArrow(lambda it: _pieces(it, path, capacity, with_ids), out)


# -- one island -----------------------------------------------------------

def best_fit(sizes: np.ndarray, items: Iterable[int], bins: np.ndarray, room: list[tuple[int, int]], used: int, capacity: int) -> int:
    """Put ``items`` one by one into the bin they leave the least room in.

    ``room``: sorted (room left, bin) of open bins. Returns the bins in use."""
    for i in items:
        size = int(sizes[i])
        k = bisect_left(room, (size, -1))
        if k == len(room):
            b, left = used, capacity - size
            used += 1
        else:
            left, b = room.pop(k)
            left -= size
        bins[i] = b
        if left:
            insort(room, (left, b))
    return used


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean square of the bins' filling: fuller bins and fewer of them."""
    fill = np.bincount(bins, weights=sizes)
    return float(((fill / capacity) ** 2).sum() / max(1, len(fill)))


def exchanged(sizes: np.ndarray, child: np.ndarray, loose: list[int], used: int, capacity: int, rng: np.random.Generator, tries: int) -> list[int]:
    """Fill bins better by exchanging one or two of their pieces for one or two
    loose ones that take more of the room; what comes out is smaller and easier to
    place.  Looks at ``tries`` bins; returns the pieces that are loose then."""
    loose = sorted(loose, key=lambda i: int(sizes[i]))
    held: dict[int, list[int]] = {}
    for i, b in enumerate(child.tolist()):
        if b >= 0:
            held.setdefault(b, []).append(i)
    for b in rng.permutation(used)[:tries].tolist():
        mine = held.get(b, [])
        room = capacity - int(sizes[mine].sum()) if mine else 0
        if not room or len(loose) < 2:
            continue
        have = sizes[loose]
        best, swap = 0, None
        outs = [(i,) for i in mine] + [(i, j) for k, i in enumerate(mine) for j in mine[:k]]
        for out in outs[:24]:
            size = int(sizes[list(out)].sum())
            one = int(np.searchsorted(have, size + room, side="right")) - 1
            if one >= 0 and have[one] - size > best:
                best, swap = int(have[one]) - size, (out, (one,))
            mate = np.searchsorted(have, size + room - have, side="right") - 1
            fits = np.flatnonzero((mate >= 0) & (mate < np.arange(len(have))))
            if len(fits):
                total = have[fits] + have[mate[fits]]
                k = int(total.argmax())
                if total[k] - size > best:
                    best, swap = int(total[k]) - size, (out, (int(fits[k]), int(mate[fits[k]])))
        if swap:
            out, into = swap
            coming = [loose[k] for k in into]
            child[list(out)], child[coming] = -1, b
            held[b] = [i for i in mine if i not in out] + coming
            loose = sorted([x for k, x in enumerate(loose) if k not in into] + list(out), key=lambda i: int(sizes[i]))
    return loose


def crossover(sizes: np.ndarray, giver: np.ndarray, taker: np.ndarray, capacity: int, rng: np.random.Generator, tries: int = 0) -> np.ndarray:
    """``taker`` with some well-filled bins of ``giver`` put in whole; the pieces
    that this displaces are exchanged with those of ``tries`` bins, then best-fitted."""
    fill = np.bincount(giver, weights=sizes) / capacity
    well = np.flatnonzero(fill >= max(0.9, float(np.quantile(fill, 0.5))))
    if not len(well):
        return taker
    chosen = rng.permutation(well)[: max(1, int(len(well) * rng.uniform(0.1, 0.5)))]
    injected = np.isin(giver, chosen)
    hit = np.unique(taker[injected])
    loose = np.flatnonzero(np.isin(taker, hit) & ~injected)
    fill_t = np.bincount(taker, weights=sizes)
    weak = np.flatnonzero((fill_t < 0.9 * capacity) & ~np.isin(np.arange(len(fill_t)), hit))
    loose = np.concatenate([loose, np.flatnonzero(np.isin(taker, weak) & ~injected)])
    child = np.full(len(sizes), -1, dtype=np.int64)
    kept = np.ones(len(sizes), dtype=bool)
    kept[injected] = kept[loose] = False
    _, ids = np.unique(taker[kept], return_inverse=True)
    child[kept] = ids
    used = int(ids.max()) + 1 if len(ids) else 0
    _, ids = np.unique(giver[injected], return_inverse=True)
    child[injected] = ids + used
    used += int(ids.max()) + 1
    if tries:
        loose = np.array(exchanged(sizes, child, loose.tolist(), used, capacity, rng, tries), dtype=np.int64)
    placed = child >= 0
    left = capacity - np.bincount(child[placed], weights=sizes[placed], minlength=used).astype(np.int64)
    room = sorted((int(r), b) for b, r in enumerate(left) if r)
    order = loose[np.lexsort((rng.random(len(loose)), -sizes[loose]))]
    best_fit(sizes, order.tolist(), child, room, used, capacity)
    return child


def evolve(sizes: np.ndarray, immigrants: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> np.ndarray:
    """The elite of one island: the bin of each piece."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    pool = [(fitness(sizes, b, capacity), b) for b in immigrants]
    while len(pool) < population:
        noise = rng.normal(0, 0.0 if not pool else 0.02 * capacity, len(sizes))
        bins = np.full(len(sizes), -1, dtype=np.int64)
        best_fit(sizes, np.argsort(-(sizes + noise), kind="stable").tolist(), bins, [], 0, capacity)
        pool.append((fitness(sizes, bins, capacity), bins))
    idle = 0
    for turn in range(generations):
        pool.sort(key=lambda x: -x[0])
        if idle >= PATIENCE or (turn >= SETTLED and pool[0][1].max() + 1 == least):
            break
        a, b = rng.choice(len(pool), 2, replace=False)
        child = crossover(sizes, pool[a][1], pool[b][1], capacity, rng, 0 if pool[0][1].max() + 1 == least else TRIES)
        f = fitness(sizes, child, capacity)
        idle = 0 if f > pool[0][0] else idle + 1
        if f > pool[-1][0]:
            pool[-1] = (f, child)
    return max(pool, key=lambda x: x[0])[1]


# -- many islands ---------------------------------------------------------

def _evolved(batches: Iterable[pa.RecordBatch], capacity: int, epoch: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        elites = []
        for r in batch.to_pylist():
            sizes = np.frombuffer(r["sizes"], dtype=np.int32).astype(np.int64)
            come = [np.frombuffer(x, dtype=np.uint16).astype(np.int64) for x in r["immigrants"] or []]
            seed = zlib.crc32(f"{r['cell']} {r['island']} {epoch}".encode())
            elites.append(evolve(sizes, come, capacity, seed).astype(np.uint16).tobytes())
        names = ["cell", "island", "sizes", "elite"]
        yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("island"), batch.column("sizes"), pa.array(elites, pa.binary())], names=names)


def _sizes(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
    return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "sizes": [pdf["length"].to_numpy(np.int32).tobytes()]})


def _assigned(key: tuple, pdf: pd.DataFrame, best: pd.DataFrame, capacity: int, level: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "_row"], ascending=[False, True], kind="stable").reset_index(drop=True)
    size = pdf["length"].to_numpy(np.int64)
    bins = max((np.frombuffer(e, dtype=np.uint16).astype(np.int64) for e in best["elite"]), key=lambda b: fitness(size, b, capacity))
    fill = np.bincount(bins, weights=size)
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(size[order]) - size[order]
    first = np.r_[True, bins[order][1:] != bins[order][:-1]]
    offset = np.empty(len(size), dtype=np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    return pd.DataFrame({"_row": pdf["_row"], "length": size, "sequence_id": (level << 58) + (int(key[0]) << 16) + bins, "offset": offset, "done": fill[bins] >= FULL * capacity})


def _pack_cells(items: DataFrame, cells: int, capacity: int, level: int) -> DataFrame:
    """(_row, length, sequence_id, offset, done) of (_row, length)."""
    items = items.withColumn("cell", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(cells)))
    state = items.groupBy("cell").applyInPandas(_sizes, "cell long, sizes binary")
    state = state.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))).withColumn("immigrants", F.lit(None).cast("array<binary>"))
    for epoch in range(EPOCHS):
        state = state.repartition(max(1, min(cells * ISLANDS, 100_000)), "cell", "island") if epoch == 0 else state
        state = state.select("cell", "island", "sizes", "immigrants").mapInArrow(lambda it, e=epoch: _evolved(it, capacity, e), "cell long, island int, sizes binary, elite binary")
        state = stored(state, f"islands{level}-{epoch}")
        own = state.select("cell", "island", "sizes", F.col("elite").alias("own"))
        moved = state.select("cell", ((F.col("island") + 1) % ISLANDS).alias("island"), "elite")
        elites = state.select("cell", "elite")
        state = own.join(moved, ["cell", "island"]).withColumn("immigrants", F.array("own", "elite"))
    assign = lambda key, a, b: _assigned(key, a, b, capacity, level)
    return items.groupBy("cell").cogroup(elites.groupBy("cell")).applyInPandas(assign, "_row long, length long, sequence_id long, offset long, done boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY, cell: int = CELL, levels: int = LEVELS) -> DataFrame:
    """(_row, sequence_id, offset) of ``pieces`` (_row: distinct long, length:
    1 to ``capacity``).  Sequences are gapless from offset 0."""
    items, done = pieces.select("_row", F.col("length").cast("long").alias("length")), None
    for level in range(levels):
        n = items.count()
        cells = max(1, -(-n // cell))
        packed = stored(_pack_cells(items, cells, capacity, level), f"packed{level}")
        last = level == levels - 1 or cells == 1
        final = (packed if last else packed.filter("done")).select("_row", "sequence_id", "offset")
        done = final if done is None else done.union(final)
        if last:
            break
        items = packed.filter("NOT done").select("_row", "length")
    return done


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    pieces = stored(cut(docs, path, capacity, with_ids).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces, capacity), "_row").drop("_row")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of ``packed_documents(..., with_ids=True)``: the
    little-endian unsigned 32-bit ids, of at most ``capacity`` tokens each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.col("parts"), F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packed_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
