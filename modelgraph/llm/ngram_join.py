"""N-gram Jaccard join by T-occurrence search, as linked components.

A document's set holds the 64-bit hashes of its distinct word shingles.  Equal
sets form a class and one member stands for it.  Classes that may reach the
threshold are brought together exactly: sets are split into parts by hash, more
parts than two linked sets of that size class can differ in, so linked sets have
an equal non-empty part.  The documents with an equal part are sieved: parity
bitmaps of their sets bound the elements they can differ in from below, and only
what passes the bound is connected.  Classes so connected share a cell.  In a cell
inverted lists are searched as a T-occurrence problem with DivideSkip: the short
lists are merged on a heap, the long ones probed by binary search, and documents
with the required overlap are linked.  A candidate that is already connected
with the query needn't be probed, so a group of n near copies costs about n
verifications, and no list of pairs is ever emitted.

Large cells are split into blocks, so memory stays bounded at any cell size; no
cap drops a candidate.

Defined cases: a null or empty text has the empty set and is linked with
nothing; a text with fewer words than a shingle has its whole word sequence as
its one shingle; repeated rows are copies; a row without doc_id is linked with
nothing and has no component; of equal sets the smallest doc_id stands for all;
very long texts are hashed whole; an empty table gives an empty result; extra
columns, of any names, don't enter the plan.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, components, free_name, shuffle_parts, stored, table, utf8

#: Ratio of the largest to the smallest set size of a size class.
RATIO = 1.6
#: Shingles that a block of a large cell holds.
BLOCK_TOKENS = 300_000
#: Weight of list length in DivideSkip's choice of the long lists.
MU = 0.0085
#: Documents with an equal part that are sieved as one group. Parts of more are
#: common; most documents can do without theirs.
SIEVE = 4096

#: Keys of parts that a task gathers before it sends them on, sorted by bucket.
GATHER = 1_200_000
#: Documents of one gathering that make their common key a common one: they go on
#: at once, dealt by document, and only a mark reaches the key's bucket.
HEAVY = 512
#: Bytes of text whose keys fill a bucket.
BUCKET_TEXT = 16_000_000

_WORDS: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    import xxhash

    words = utf8(text).lower().split()  # on bytes: A-Z only, and exactly the contract's white space
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=k)], dtype=np.uint64)
    try:
        ids = list(map(_WORDS.__getitem__, words))
    except KeyError:
        own = {w: xxhash.xxh3_64_intdigest(w) for w in set(words) if w not in _WORDS}
        if len(_WORDS) > 100_000:
            _WORDS.clear()
        ids = [own.get(w) or _WORDS.get(w) or xxhash.xxh3_64_intdigest(w) for w in words]
        _WORDS.update((w, h) for w, h in own.items() if len(w) < 40)  # so the cache is bounded in bytes
    h = np.array(ids, dtype=np.uint64)
    n = len(h) - k + 1
    s = h[:n].copy()
    for i in range(1, k):
        s = _mix(s) + h[i : n + i]
    return np.unique(_mix(s))


@functools.lru_cache(maxsize=8)
def _classes(num: int, den: int) -> tuple[list[int], list[int]]:
    """Largest size, and number of parts, of each size class."""
    most = [1]
    while most[-1] < 1 << 40:
        most.append(max(most[-1] + 1, int(most[-1] * RATIO)))
    return most, [int(1.08 * differ(m, m, num, den)) + 3 + int(math.sqrt(m) / 8) for m in most]


def differ(a: int, b: int, num: int, den: int) -> int:
    """Most elements that only one of two linked sets of these sizes has."""
    return (a + b) * (den - num) // (den + num)


def part_keys(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the set's non-empty parts, for each size class it needs: its own
    and that of the largest set it can be linked with.  With each come the class
    and how many keys of the class it shares with any set it is linked with, at
    least.

    If a set has no more non-empty parts than linked sets can differ in, then
    the empty ones count as parts too."""
    most, parts = _classes(num, den)
    size, out = len(s), []
    largest = size * den // num
    for c in range(bisect_left(most, size), bisect_left(most, largest) + 1) if size else ():
        n = parts[c]
        salted = _mix(s ^ np.uint64(c * 0x9E3779B9 + 1))
        part = (salted % np.uint64(n)).astype(np.int64)
        total = np.zeros(n, dtype=np.uint64)
        np.add.at(total, part, _mix(salted))
        filled = np.bincount(part, minlength=n) > 0
        apart = differ(size, min(most[c], largest), num, den)
        if filled.sum() <= apart:
            filled[:] = True
        index = np.flatnonzero(filled)
        key = _mix(total[index] + np.uint64(c << 44) + index.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out.append((key, np.full(len(index), c), np.full(len(index), len(index) - apart)))
    if not out:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def parity_bits(s: np.ndarray, num: int, den: int) -> bytes:
    """For each of a power of two of slots, whether an odd number of elements
    fall there.  Two sets differ in at least as many elements as their bitmaps
    do in bits; a longer bitmap folds to a shorter one."""
    slots = 64
    while slots < 4 * differ(len(s), len(s), num, den) and slots < 1 << 15:
        slots *= 2
    odd = np.bincount((_mix(s) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sieve(sizes: np.ndarray, bits: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs that may reach the threshold, as many as connect all such pairs."""
    order = np.argsort(sizes, kind="stable")
    root = list(range(len(bits)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    folded: dict[int, np.ndarray] = {}

    def at(width: int) -> np.ndarray:
        if width not in folded:
            rows = []
            for b in bits:
                x = np.frombuffer(b, np.uint8)
                while len(x) > width:
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                rows.append(x if len(x) == width else np.zeros(width, np.uint8))
            folded[width] = np.stack(rows)
        return folded[width]

    links = []
    for k, i in enumerate(order.tolist()):
        near = order[:k][den * sizes[order[:k]] >= num * sizes[i]]
        for width in {len(bits[j]) for j in near.tolist()}:
            same = near[[len(bits[j]) == width for j in near.tolist()]]
            table = at(min(width, len(bits[i])))
            apart = np.bitwise_count(table[same] ^ table[i]).sum(axis=1)
            for j in same[apart <= (sizes[same] + sizes[i]) * (den - num) // (den + num)].tolist():
                if find(i) != find(j):
                    root[find(i)] = find(j)
                    links.append((i, j))
    return links


def set_key(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


# -- candidates -----------------------------------------------------------

DOC, KEY, EDGE, MEMBER, COMMON = 0, 1, 2, 3, 4
_SKETCH = "kind long, a long, b long, c long, n long, bits binary"


def _batch(kind: int, a: object, b: object, c: object = None, n: object = None, bits: object = None) -> pa.RecordBatch:
    size = len(a)  # type: ignore[arg-type]
    column = lambda x: pa.nulls(size, pa.int64()) if x is None else pa.array(x, pa.int64())
    last = pa.nulls(size, pa.binary()) if bits is None else pa.array(bits, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind), pa.int64()), column(a), column(b), column(c), column(n), last], names=["kind", "a", "b", "c", "n", "bits"])


class Gathered:
    """Part keys of a task's documents, sent on as one row a bucket.

    In its bucket a key goes by its low 32 bits: keys that only look equal there
    make a group larger, and the sieve parts them again."""

    def __init__(self, buckets: int):
        self.buckets, self.size = buckets, 0
        self.keys: list[np.ndarray] = []
        self.owner: list[tuple[int, int, int, int]] = []  # doc, class, margin, keys

    def add(self, doc: int, keys: np.ndarray, classes: np.ndarray, margins: np.ndarray) -> None:
        first = np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]])
        for f, e in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
            self.owner.append((doc, int(classes[f]), int(margins[f]), e - f))
        self.keys.append(keys)
        self.size += len(keys)

    def sent(self) -> Iterator[pa.RecordBatch]:
        """The rows of what is gathered, and of keys that are heavy here."""
        if not self.size:
            return
        keys = np.concatenate(self.keys)
        doc, cls, margin, n = (np.array(c, dtype=np.int64) for c in zip(*self.owner, strict=True))
        entry = np.repeat(np.arange(len(doc)), n)
        self.keys, self.owner, self.size = [], [], 0
        full = ((keys >> np.uint64(32)) % np.uint64(self.buckets) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
        order = np.argsort(full, kind="stable")
        full, entry = full[order], entry[order]
        first = np.flatnonzero(np.r_[True, full[1:] != full[:-1]])
        run = np.diff(np.r_[first, len(full)])
        marks = full[first[run >= HEAVY]]
        if len(marks):
            heavy = np.repeat(run >= HEAVY, run)
            yield from _commons(full[heavy].view(np.int64), entry[heavy], doc, cls, margin)
            full, entry = full[~heavy], entry[~heavy]
        bucket, marked = (full >> np.uint64(32)).astype(np.int64), (marks >> np.uint64(32)).astype(np.int64)
        rows = []
        for b in np.unique(np.r_[bucket, marked]).tolist():
            f, e = np.searchsorted(bucket, [b, b + 1])
            mine, at = np.unique(entry[f:e], return_inverse=True)
            rows.append((b, _pack(doc[mine], cls[mine], margin[mine], full[f:e].astype(np.uint32), at, marks[marked == b].astype(np.uint32))))
            if len(rows) == 1000:
                yield _batch(KEY, [r[0] for r in rows], [0] * len(rows), bits=[r[1] for r in rows])
                rows = []
        if rows:
            yield _batch(KEY, [r[0] for r in rows], [0] * len(rows), bits=[r[1] for r in rows])


def _commons(keys: np.ndarray, entry: np.ndarray, doc: np.ndarray, cls: np.ndarray, margin: np.ndarray) -> Iterator[pa.RecordBatch]:
    for f in range(0, len(keys), 100_000):
        at = entry[f : f + 100_000]
        yield _batch(COMMON, keys[f : f + 100_000], doc[at], cls[at].astype(np.int64), margin[at].astype(np.int64))


def _pack(doc: np.ndarray, cls: np.ndarray, margin: np.ndarray, keys: np.ndarray, entry: np.ndarray, marks: np.ndarray) -> bytes:
    """Entries (document, class, margin), sorted keys each with its entry, marks."""
    import zstandard

    parts = [doc.astype("<i8"), cls.astype("u1"), margin.astype("<i4"), np.diff(keys, prepend=np.uint32(0)).astype("<u4"), entry.astype("<u2" if len(doc) <= 1 << 16 else "<u4"), marks.astype("<u4")]
    # numbers of like size stand byte by byte: the high ones are alike
    raw = [np.ascontiguousarray(p.view(np.uint8).reshape(len(p), p.itemsize).T).tobytes() for p in parts]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(doc), len(keys), len(marks)], "<u4").tobytes() + b"".join(raw))


def _unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m, k = np.frombuffer(raw, "<u4", 3).tolist()
    at, out = 12, []
    for size, kind in ((n, "<i8"), (n, "u1"), (n, "<i4"), (m, "<u4"), (m, "<u2" if n <= 1 << 16 else "<u4"), (k, "<u4")):
        width = np.dtype(kind).itemsize
        part = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(part.T).reshape(-1).view(kind))
        at += size * width
    out[3] = np.cumsum(out[3], dtype=np.uint32)
    return out


def _sketched(batches: Iterable[pa.RecordBatch], k: int, num: int, den: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row of kind DOC for each document, then those of its task's part keys."""
    seen: set[tuple[int, int]] = set()  # a task's copies share all keys of the first
    gathered = Gathered(buckets)
    for batch in chunks(batches, "text", 2_000_000):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = shingles(text, k)
            key = set_key(s)
            rows.append((doc_id, *key, len(s), parity_bits(s, num, den)))
            if len(s) and doc_id is not None and key not in seen:
                if len(seen) > 50_000:
                    seen.clear()
                seen.add(key)
                gathered.add(doc_id, *part_keys(s, num, den))
                if gathered.size > GATHER:
                    yield from gathered.sent()
        yield _batch(DOC, *zip(*rows, strict=True))
    yield from gathered.sent()


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come dealt by bucket, one to a partition.  The documents of a key are
    the members of a group named by their set, so that the many keys that near
    copies share name one group.  The documents of a common key become rows of it,
    and all other rows are passed on."""
    parts, bucket = [], 0
    for batch in batches:
        kind = batch.column(0).to_numpy()
        if (kind != KEY).any():
            yield batch.filter(pa.array(kind != KEY))
        for i in np.flatnonzero(kind == KEY).tolist():
            bucket = batch.column(1)[i].as_py()
            parts.append(_unpack(batch.column(5)[i].as_py()))
    if not parts:
        return
    shift = np.cumsum([0, *[len(p[0]) for p in parts]])
    doc, cls, margin, keys = (np.concatenate([p[c] for p in parts]) for c in range(4))
    entry = np.concatenate([p[4].astype(np.uint32) + np.uint32(s) for p, s in zip(parts, shift, strict=False)])
    marks = np.concatenate([p[5] for p in parts])
    parts.clear()
    order = np.argsort(keys, kind="stable")
    keys, entry = keys[order], entry[order]
    del order
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    run = np.diff(np.r_[first, len(keys)])
    common = (run > SIEVE) | np.isin(keys[first], marks)
    if common.any():
        held = np.repeat(common, run)
        yield from _commons(keys[held].astype(np.int64) | np.int64(bucket << 32), entry[held], doc, cls, margin)
    # a group's name is a sum over its members; each name is told once
    several = (run > 1) & ~common
    if not several.any():
        return
    member = doc[entry[np.repeat(several, run)]]
    run = run[several]
    first = np.cumsum(run) - run
    name = _mix(np.add.reduceat(_mix(member.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), first))
    name, once = np.unique(name, return_index=True)
    first, run = first[once], run[once]
    step = max(1, 200_000 // int(run.max()))
    for f in range(0, len(name), step):
        n = run[f : f + step]
        at = np.repeat(first[f : f + step] - np.cumsum(n) + n, n) + np.arange(n.sum())
        yield _batch(MEMBER, np.repeat(name[f : f + step], n).view(np.int64), member[at])


def _sieved(batches: Iterable[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, doc, size, bits) come sorted by group."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    found: list[tuple[int, int]] = []
    for _, run in itertools.groupby(rows(), key=lambda r: r[0]):
        members = list({r[1]: r for r in run}.values())
        links = sieve(np.array([r[2] for r in members], dtype=np.int64), [r[3] for r in members], num, den)
        found += [(members[i][1], members[j][1]) for i, j in links]
        if len(found) > 20_000:
            yield _batch(EDGE, *zip(*found, strict=True))
            found = []
    if found:
        yield _batch(EDGE, *zip(*found, strict=True))


# -- search ---------------------------------------------------------------

def search(sets: list[np.ndarray], parts: list[int] | None, num: int, den: int, all_links: bool = False) -> list[tuple[int, int]]:
    """Links (i, j) between the sets; if ``parts`` are given, between sets of
    different parts only.  Without ``all_links``, enough links to connect what
    is connected."""
    sizes = [len(s) for s in sets]
    order = sorted(range(len(sets)), key=lambda i: (sizes[i], i))
    flat = np.concatenate([sets[i] for i in order])
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    cuts = np.cumsum([0, *[sizes[i] for i in order]])
    lists: dict[int, list[int]] = {}
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for x, i in enumerate(order):
        ids = inverse[cuts[x] : cuts[x + 1]]
        ids = ids[shared[ids]].tolist()
        found = [lists[t] for t in ids if t in lists]
        least = -(-num * sizes[i] // den)
        if found and len(found) >= least:
            found.sort(key=len)
            n_long = min(least - 1, int(least / (MU * math.log2(len(found[-1])) + 1)))
            short, long = found[: len(found) - n_long], found[len(found) - n_long :]
            for y, run in itertools.groupby(heapq.merge(*short)):
                c = sum(1 for _ in run)
                if c < least - n_long:
                    continue
                j = order[y]
                if (parts and parts[i] == parts[j]) or den * sizes[j] < num * sizes[i]:
                    continue
                if not all_links and find(i) == find(j):
                    continue
                need = -(-num * (sizes[i] + sizes[j]) // (num + den))
                left = len(long)
                for entries in long:
                    if c + left < need:
                        break
                    at = bisect_left(entries, y)
                    c += at < len(entries) and entries[at] == y
                    left -= 1
                if c >= need:
                    links.append((i, j))
                    root[find(i)] = find(j)
        for t in ids:
            lists.setdefault(t, []).append(x)
    return links


def _searched(batches: Iterable[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (cell, i, j); each run of these is one search, between
    different parts if there are parts."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for cut in chunks([batch], "tokens", 16_000_000):
                yield from zip(*[c.to_pylist() for c in cut.columns], strict=True)

    for key, run in itertools.groupby(rows(), key=lambda r: r[:3]):
        members = sorted(run, key=lambda r: (r[4], r[5]))
        sets = [np.frombuffer(r[5], dtype=np.uint64) for r in members]
        links = search(sets, None if members[0][3] is None else [r[3] for r in members], num, den)
        if links:
            yield _batch(EDGE, [members[i][4] for i, _ in links], [members[j][4] for _, j in links])


def _shipped(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sets of the documents that stand for a class in a cell of several."""
    for batch in chunks(batches, "text", 8_000_000):
        texts, hi, lo = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "hi", "lo"))
        sets = [shingles(t, k) for t in texts]
        mine = [i for i, s in enumerate(sets) if set_key(s) == (hi[i], lo[i])]
        take = pa.array(mine, pa.int64())
        rest = [batch.column(batch.schema.get_field_index(c)).take(take) for c in ("cell", "rep", "n", "blocks")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array([sets[i].tobytes() for i in mine], pa.binary())], names=["cell", "rep", "n", "blocks", "tokens"])


def linked(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs`` (doc_id, text): two
    documents link when ``den`` times their shared shingles reach ``num`` times
    those of either."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_parts(spark), -(-int(size) // BUCKET_TEXT))
    sketch = docs.mapInArrow(lambda it: _sketched(it, k, num, den, buckets), _SKETCH)
    # one bucket to a partition; all other rows are spread
    place = F.when(F.col("kind") == KEY, F.col("a")).otherwise(F.pmod(F.xxhash64("a", "b", "c"), F.lit(buckets))).cast("int")
    sketch = stored(sketch.repartitionById(buckets, place).mapInArrow(_met, _SKETCH), "sketch")
    found = sketch.filter(F.col("kind") == DOC).select(F.col("a").alias("doc_id"), F.col("b").alias("hi"), F.col("c").alias("lo"), "n")
    bits = sketch.filter((F.col("kind") == DOC) & F.col("a").isNotNull() & (F.col("n") > 0)).select(F.col("a").alias("doc"), F.col("n").alias("size"), "bits")
    groups = sketch.filter(F.col("kind") == MEMBER).select(F.col("a").alias("group"), F.col("b").alias("doc")).distinct()
    groups = groups.join(bits, "doc").select("group", "doc", "size", "bits").repartition(shuffle_parts(spark), "group").sortWithinPartitions("group")
    near = groups.mapInArrow(lambda it: _sieved(it, num, den), _SKETCH).select("a", "b")
    # who shares more keys with a partner than it has common ones shares another one;
    # only the rest is connected by common keys
    common = sketch.filter(F.col("kind") == COMMON).select(F.col("a").alias("key"), F.col("b").alias("doc"), F.col("c").alias("class"), F.col("n").alias("margin"))
    needy = common.groupBy("doc", "class").agg(F.count(F.lit(1)).alias("_common"), F.min("margin").alias("_margin")).filter("_common >= _margin").select("doc", "class")
    bound = common.join(needy, ["doc", "class"])
    lowest = bound.groupBy("key").agg(F.min("doc").alias("low"))
    edges = near.union(bound.join(lowest, "key").select("doc", "low").filter("doc <> low"))
    coarse = components(edges, "coarse")

    # of documents without an empty set, one stands for each class of equal sets
    full = found.filter("doc_id IS NOT NULL AND n > 0")
    classes = stored(full.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")), "classes")
    celled = full.join(coarse, full["doc_id"] == coarse["node"]).groupBy("hi", "lo").agg(F.min("component").alias("cell"))
    celled = stored(celled.join(classes, ["hi", "lo"]), "celled")
    large = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("_members"), F.sum("n").alias("_tokens")).filter("_members > 1")
    celled = celled.join(large.select("cell", _blocks("_tokens").alias("blocks")), "cell")
    # always by shuffle: what is joined to the texts grows with them
    sets = docs.join(celled.hint("merge"), docs["doc_id"] == celled["rep"]).select("text", "hi", "lo", "cell", "rep", "n", "blocks")
    sets = stored(sets.mapInArrow(lambda it: _shipped(it, k), "cell long, rep long, n long, blocks long, tokens binary"), "sets")
    fine = components(_links(sets, num, den), "fine")

    named = classes.join(fine, classes["rep"] == fine["node"], "left").select("hi", "lo", F.coalesce("component", "rep").alias("component_id"))
    # the empty set, which very many documents may have, takes no part in the join
    out = full.join(named, ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = found.filter("doc_id IS NULL OR n = 0")
    return out.union(rest.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id")))


def _blocks(tokens: str) -> Column:
    return F.ceil(F.when(F.col(tokens) > BLOCK_TOKENS, 2 * F.col(tokens) / BLOCK_TOKENS).otherwise(1)).cast("long")


def _links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect what is connected in each cell of ``sets``
    (cell, rep, n, blocks, tokens).

    A cell of one block is searched at once.  A larger one isn't paired block by
    block: first each block is searched for itself, then the smallest member of
    each part found so far, among its like.  Mostly one part holds the bulk of a
    cell by then.  Only what stands outside it is searched against every block,
    and only for links between different parts."""
    spark = sets.sparkSession

    def found(tasks: DataFrame) -> DataFrame:
        tasks = tasks.select("cell", "i", "j", "part", "rep", "tokens").repartition(shuffle_parts(spark), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
        return tasks.mapInArrow(lambda it: _searched(it, num, den), _SKETCH).select("a", "b")

    spread = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), n)
    none = F.lit(None).cast("long")
    links = stored(found(sets.withColumns({"i": spread(1, F.col("blocks")), "j": none, "part": none})), "links")
    parted = sets.filter("blocks > 1")
    if parted.isEmpty():
        return links
    for turn in (1, 2):
        mine = parted.select(F.col("rep").alias("a")).hint("merge")
        parts = components(links.join(mine, "a", "left_semi"), f"parts{turn}")
        label = parted.select("cell", "rep", "n", "blocks").join(parts, F.col("rep") == F.col("node"), "left")
        label = stored(label.select("cell", "rep", "n", "blocks", F.coalesce("component", "rep").alias("part")), f"labels{turn}")
        if turn == 1:
            heads = label.groupBy("cell", "part").agg(F.min("rep").alias("rep"), F.min_by("n", "rep").alias("n"))
            many = heads.groupBy("cell").agg(_blocks_of("n").alias("heads"))
            heads = parted.select("cell", "rep", "tokens").join(heads.select("rep").hint("merge"), "rep").join(many, "cell")
            links = stored(links.union(found(heads.withColumns({"i": spread(2, F.col("heads")), "j": none, "part": none}))), "links-of-heads")
    sizes = label.groupBy("cell", "part").agg(F.sum("n").alias("size"))
    bulk = sizes.groupBy("cell").agg(F.max_by("part", F.struct("size", "part")).alias("bulk"))
    outside = label.join(bulk, "cell").filter("part <> bulk")
    turns = outside.groupBy("cell").agg(_blocks_of("n").alias("turns"))
    outside = stored(outside.select("rep", F.lit(True).alias("outside")), "outside")
    if outside.isEmpty():
        return links
    # (i, j): a block of what stands outside against a block of the cell
    every = parted.join(label.select("rep", "part"), "rep").join(outside.hint("merge"), "rep", "left").join(turns, "cell")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = every.withColumn("j", spread(3, F.col("blocks"))).withColumn("i", upto("turns"))
    seekers = every.filter("outside").withColumn("i", spread(4, F.col("turns"))).withColumn("_own", spread(3, F.col("blocks"))).withColumn("j", upto("blocks")).filter("j <> _own").drop("_own")
    return links.union(found(members.unionByName(seekers)))


def _blocks_of(tokens: str) -> Column:
    """Blocks that the rows of a group fill."""
    return F.greatest(F.lit(1), F.ceil(2 * F.sum(tokens) / BLOCK_TOKENS)).cast("long")


def representatives(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each linked group, the one with the
    smallest doc_id; rows without doc_id stay.  All columns are kept.

    Rows that share a doc_id are linked by their own texts; of those that repeat
    a doc_id and text, one stays."""
    number, nth, name = free_name(docs, "_number"), free_name(docs, "_nth"), free_name(docs, "_gone")
    key = "doc_id"
    if not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        copies = Window.partitionBy("doc_id", "text").orderBy("doc_id")
        docs = docs.withColumn(nth, F.row_number().over(copies)).filter(F.col("doc_id").isNull() | (F.col(nth) == 1)).drop(nth)
        # numbers rise with doc_id over the sorted partitions, so the smallest stays
        docs = docs.sort(F.col("doc_id").cast("long"), F.xxhash64("text"))
        docs = stored(docs.withColumn(number, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "numbered")
        key = number
    found = stored(linked(docs.select(F.col(key).alias("doc_id"), "text"), k, num, den), "linked")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    # always by shuffle: what is joined to the texts grows with them
    kept = docs.join(gone.hint("merge"), docs[key] == F.col(name), "left_anti")
    return kept.drop(number) if key == number else kept


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
