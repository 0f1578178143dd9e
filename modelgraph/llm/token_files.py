"""Token-id files in canonical length-limited Huffman coding.

Ids of all documents are counted globally, code lengths come from package-merge
(no code longer than ``LIMIT`` bits), and codes are canonical, so a file needs
only the lengths.  Documents are dealt by ranges of doc_id and each range becomes
one file of independent blocks; a block keeps the bit offset of every
``STRIDE``-th id, which lets a reader decode all stretches of a block side by
side with one lookup table.

File layout (little-endian)::

    b"MGTOK001"
    blocks:  ids u32 | stretches u32 | bits of each stretch u16[] | code bytes
    footer:  zlib of  code lengths u8[vocabulary]
             zlib of  doc_id i64[] , zlib of doc_id-is-null u8[], zlib of ids per document u64[]
             block offset u64[] , block crc32 u32[]
    trailer: vocabulary, documents, blocks, ids u64, sizes of the four zlib parts u32, footer offset u64, b"MGTOK001"

Files are written under a name of their own per attempt and only named in the
manifest by the attempt that succeeded, so a lost executor leaves no half file
in the result.

Defined cases: a null or empty text is the end id alone; null doc_ids come
first; repeated rows are documents of their own, side by side, and rows that share
or lack a doc_id stand in the order of a hash of their ids; an empty table has no
file and gives an empty result; a document may span any number of blocks; extra
columns, of any names, don't enter the plan.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, scratch_path, shuffle_parts, stored, table
from .tokens import default_path, encoder

MAGIC = b"MGTOK001"
END_ID = 2
#: Longest code in bits; at least 16 for a vocabulary of 49k ids.
LIMIT = 18
#: Ids between two checkpoints, and ids in a block.
STRIDE = 128
BLOCK = 1 << 18


# -- the code -------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge.

    Ids that never occur get length 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    flags, merged = [np.zeros(len(leaves), dtype=bool)], leaves
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        merged = both[by]
        flags.append(by >= len(leaves))
    take = 2 * len(leaves) - 2
    depth = np.zeros(len(leaves), dtype=np.uint8)
    for packages in reversed(flags):
        inner = int(packages[:take].sum())
        depth[: take - inner] += 1
        take = 2 * inner
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    code = last = 0
    used = np.flatnonzero(lengths)
    for i in used[np.argsort(lengths[used], kind="stable")].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def lookup(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each ``limit`` bits that may come: the id, and the code's length << 24."""
    found = np.zeros(1 << limit, dtype=np.uint32)
    codes = canonical_codes(lengths)
    for i in np.flatnonzero(lengths).tolist():
        free = limit - int(lengths[i])
        found[int(codes[i]) << free : (int(codes[i]) + 1) << free] = i | int(lengths[i]) << 24
    return found


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    shifted = codes[ids].astype(np.uint64) << (64 - size - (at & 31)).astype(np.uint64)
    word = at >> 5
    n = int(end[-1] + 31) // 32 + 1
    bits = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
    marks = np.append(at[::STRIDE], end[-1])
    body = bits.astype(np.uint64).astype(">u4").tobytes()[: (int(end[-1]) + 7) // 8]
    return struct.pack("<II", len(ids), len(marks) - 1) + np.diff(marks).astype("<u2").tobytes() + body


def decode_block(block: bytes, found: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    n, lanes = struct.unpack_from("<II", block)
    steps = np.frombuffer(block, "<u2", lanes, 8).astype(np.int64)
    body = block[8 + 2 * lanes :] + bytes(STRIDE * limit // 8 + 16)
    view = np.ndarray((len(body) - 3,), dtype=">u4", buffer=body, strides=(1,))
    at = np.cumsum(steps) - steps
    out = np.empty((STRIDE, lanes), dtype=np.uint32)
    low, mask = 32 - limit, np.uint32((1 << limit) - 1)
    last = len(view) - 1
    for k in range(STRIDE):
        window = view[np.minimum(at >> 3, last)].astype(np.uint32)
        got = found[window >> (low - (at & 7)).astype(np.uint32) & mask]
        out[k] = got & np.uint32(0xFFFFFF)
        at += got >> np.uint32(24)
    return out.T.ravel()[:n]


# -- files ----------------------------------------------------------------

def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    """Streams documents into one file."""

    def __init__(self, path: str, lengths: np.ndarray):
        store, place = _open(path)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(place)
        self.lengths, self.codes = lengths, canonical_codes(lengths)
        self.out.write(MAGIC)
        self.at = len(MAGIC)
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.offsets: list[int] = []
        self.crcs: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.waiting)
        at = 0
        while len(ids) - at >= max(1, least):
            block = encode_block(ids[at : at + BLOCK], self.codes, self.lengths)
            self.offsets.append(self.at)
            self.crcs.append(zlib.crc32(block))
            self.out.write(block)
            self.at += len(block)
            at += min(BLOCK, len(ids) - at)
        self.waiting, self.n_waiting = [ids[at:]], len(ids) - at

    def close(self) -> None:
        if self.n_waiting:
            self._flush(1)
        parts = [zlib.compress(x) for x in (
            self.lengths.tobytes(),
            np.array([d or 0 for d in self.docs], dtype="<i8").tobytes(),
            np.array([d is None for d in self.docs], dtype="u1").tobytes(),
            np.array(self.sizes, dtype="<u8").tobytes(),
        )]
        footer = b"".join(parts) + np.array(self.offsets, "<u8").tobytes() + np.array(self.crcs, "<u4").tobytes()
        trailer = struct.pack("<QQQQIIIIQ", len(self.lengths), len(self.docs), len(self.offsets), sum(self.sizes), *map(len, parts), self.at)
        self.out.write(footer + trailer + MAGIC)
        self.out.close()


_TRAILER = struct.calcsize("<QQQQIIIIQ") + len(MAGIC)


@functools.lru_cache(maxsize=2)
def _lookup(lengths: bytes) -> np.ndarray:
    return lookup(np.frombuffer(lengths, np.uint8))


def read_file(path: str) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """(doc_id, its ids in parts) of each document, block by block."""
    store, place = _open(path)
    with store.open_input_file(place) as f:
        size = f.size()
        tail = f.read_at(_TRAILER, size - _TRAILER)
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{path} is no token file")
        vocabulary, n_docs, n_blocks, _, *sizes, at = struct.unpack("<QQQQIIIIQ", tail[: -len(MAGIC)])
        footer = f.read_at(size - _TRAILER - at, at)
        parts, k = [], 0
        for s in sizes:
            parts.append(zlib.decompress(footer[k : k + s]))
            k += s
        docs, nulls, counts = np.frombuffer(parts[1], "<i8"), np.frombuffer(parts[2], "u1"), np.frombuffer(parts[3], "<u8")
        offsets = np.frombuffer(footer, "<u8", n_blocks, k)
        crcs = np.frombuffer(footer, "<u4", n_blocks, k + 8 * n_blocks)
        found = _lookup(parts[0])
        block, used, ids = 0, 0, np.empty(0, dtype=np.uint32)
        for d, null, n in zip(docs.tolist(), nulls.tolist(), counts.tolist(), strict=True):
            got: list[np.ndarray] = []
            while n:
                if used == len(ids):
                    a = int(offsets[block])
                    b = int(offsets[block + 1]) if block + 1 < n_blocks else at
                    raw = f.read_at(b - a, a)
                    if zlib.crc32(raw) != crcs[block]:
                        raise ValueError(f"block {block} of {path} is damaged")
                    ids, used, block = decode_block(raw, found), 0, block + 1
                got.append(ids[used : used + n])
                n -= len(got[-1])
                used += len(got[-1])
            yield (None if null else d), got


# -- on Spark -------------------------------------------------------------

def _tokenized(batches: Iterable[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in chunks(batches, "text", 4_000_000):
        ids = [np.append(np.frombuffer(x, "<u4"), np.uint32(end_id)) for x in enc.encode_many(batch.column(1).to_pylist())]
        kind = "<u2" if enc.vocab_size <= 1 << 16 else "<u4"
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], names=["doc_id", "ids"])


def _counted(batches: Iterable[pa.RecordBatch], kind: str, vocabulary: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(vocabulary, dtype=np.int64)
    for batch in batches:
        for cut in chunks([batch], "ids", 4_000_000):
            total += np.bincount(np.frombuffer(b"".join(cut.column(0).to_pylist()), kind), minlength=vocabulary)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


def _written(batches: Iterable[pa.RecordBatch], folder: str, lengths: bytes, kind: str) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    path, writer = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}.tok", None
    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            writer = writer or Writer(path, np.frombuffer(lengths, np.uint8))
            writer.add(doc_id, np.frombuffer(ids.as_buffer(), kind))
    if writer:
        writer.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [len(writer.docs)], "n_tokens": [sum(writer.sizes)]})


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents (doc_id, text) in ascending doc_id order.

    Returns the manifest: part, path, n_docs, n_tokens and start (ids in the
    files before)."""
    path = path or default_path()
    spark = docs.sparkSession
    vocabulary = encoder(path).vocab_size
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    tokens = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _tokenized(it, path, end_id), "doc_id long, ids binary"), "tokens")
    counted = tokens.select("ids").mapInArrow(lambda it: _counted(it, kind, vocabulary), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, dtype=np.int64)
    for r in counted.collect():  # at most one row for each id of the vocabulary
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts).tobytes()
    # the hash parts rows that share or lack a doc_id
    dealt = tokens.withColumn("_hash", F.xxhash64("ids")).repartitionByRange(shuffle_parts(spark), "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash").drop("_hash")
    manifest = stored(dealt.mapInArrow(lambda it: _written(it, folder, lengths, kind), "part long, path string, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(batches: Iterable[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows: list[tuple] = []
            held = 0
            for doc_id, parts in read_file(path):
                n, crc = sum(map(len, parts)), 0
                raw = [p.astype("<u4", copy=False).tobytes() for p in parts]
                for x in raw:
                    crc = zlib.crc32(x, crc)
                rows.append((doc_id, start, n, crc, b"".join(raw) if with_ids else None))
                start += n
                held += n if with_ids else 1
                if held > 1_000_000 or len(rows) >= 10_000:
                    yield _rows(rows)
                    rows, held = [], 0
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def read_tokens(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 and the ids as
    little-endian unsigned 32-bit integers."""
    n = max(1, manifest.count())
    files = manifest.select("path", "start").repartition(n, "path")
    return files.mapInArrow(lambda it: _read(it, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op2_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "token-files"))
    return read_tokens(manifest, with_ids=False).drop("ids")
