"""Removal of repeated byte strings by suffix arrays with deep-shallow sorting.

Every string of ``LENGTH`` bytes that also starts earlier (in a smaller doc_id,
or before in the same document) is marked, and the marked bytes are removed.

Sorting all suffixes in one place isn't possible, so suffixes are dealt into
buckets by content: the smallest hash among the 16-byte grams of a string picks
its bucket, so equal strings always meet.  Neighbouring starts mostly share that
gram and travel together as one segment of at most 184 bytes.  Before anything
is sent, a task drops segments it has seen already, so a passage that very many
documents hold reaches its bucket once a task, not once a document.

In a bucket the suffixes that share their gram are sorted deep-shallow: a
multikey quicksort on characters of eight bytes, run over all groups at once,
orders them to a shallow depth, and a blind trie orders each group that still
ties there.  Groups equal over the whole length are the repeats.  Strings that
differ in their gram, or in its place, never tie, so a bucket is sorted in portions
of ``STRINGS`` strings, and its memory follows its bytes, not its strings.

A bucket that outgrows ``BUCKET_LIMIT``, for a gram stands in very many different
places, isn't gathered: its segments stream on and are dealt anew by more of the
bytes around the gram, which equal strings share as well.

Defined cases: a null or empty text has no bytes; texts under ``LENGTH`` bytes
keep all; a null doc_id counts as the largest; rows that repeat a doc_id and text
are the same document, so they don't make each other's strings repeated; rows that
share or lack a doc_id and have other texts are documents of their own, in the
order of the text's MD5; texts of any length are cut into slices that overlap,
which changes no result; of equal strings the one with the smallest (document,
start) stays; an empty table gives an empty result; extra columns may have any
names.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, shuffle_parts, stored, table, tagged, utf8

LENGTH = 100
GRAM = 16
#: Depth in bytes that multikey quicksort sorts to.
SHALLOW = 32
#: Bytes of text that a task works on at once.
SLICE = 2_000_000
#: Bytes of segments that a bucket holds on average.
BUCKET_BYTES = 22_000_000
#: Bytes of segments that a task gathers of one bucket.
BUCKET_LIMIT = 66_000_000
#: Strings of a bucket that a task sorts at once.
STRINGS = 250_000
#: Bytes beside the gram that segments are dealt by, when they are dealt anew.
CONTEXTS = (8, 24, 40)
#: Segments that a task remembers as repeated.
HOT = 100_000

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _words(raw: bytes | bytearray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes at every place, as one number each (8 bytes of padding
    are expected)."""
    return np.ndarray((len(raw) - 7,), dtype=kind, buffer=raw, strides=(1,))


def _gram_hash(words: np.ndarray, at: np.ndarray | slice, behind: np.ndarray | slice) -> np.ndarray:
    return _mix(words[at] * _C1 + _mix(words[behind] * _C2))


def segments(raw: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts in ``raw`` that share their smallest gram.

    ``starts``, ``ends``: the pieces of ``raw`` (increasing) that strings mustn't
    leave.  Returns first start, last start and the gram's place."""
    n = len(raw)
    grams = length - GRAM + 1
    if n < length:
        return (np.empty(0, np.int64),) * 3
    words = _words(raw + bytes(8))
    m = n - GRAM + 1
    low = _gram_hash(words, slice(0, m), slice(8, 8 + m))
    low &= np.uint64(0xFFFFFFFF00000000)
    low |= np.arange(m, dtype=np.uint64)
    span = 1
    while 2 * span <= grams:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < grams:
        low = np.minimum(low[: len(low) - (grams - span)], low[grams - span :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(place) + 1, dtype=np.int8)
    full = ends - starts >= length
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, ends[full] - length + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    new = np.r_[True, place[1:] != place[:-1]]
    new[starts[starts < len(new)]] = True
    first = np.flatnonzero(new & inside | inside & ~np.r_[False, inside[:-1]])
    behind = np.r_[first[1:], len(place)]
    # a run ends before the next one, or where its piece ends
    piece = np.searchsorted(starts, first, side="right") - 1
    last = np.minimum(behind - 1, ends[piece] - length)
    return first, last, place[first]


# -- sorting --------------------------------------------------------------

class BlindTrie:
    """Orders strings by looking at branching bytes first and at one leaf's
    string after; equal strings share a leaf."""

    def __init__(self) -> None:
        self.root: list | None = None  # branch: [depth, {byte: child}]; leaf: [string, members]

    def add(self, s: bytes, member: int) -> None:
        leaf = [s, [member]]
        if self.root is None:
            self.root = leaf
            return
        node = self.root
        while isinstance(node[1], dict):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        differ = int.from_bytes(s, "big") ^ int.from_bytes(node[0], "big")
        if not differ:
            node[1].append(member)
            return
        common, other = len(s) - (differ.bit_length() + 7) // 8, node[0]
        parent, node = None, self.root
        while isinstance(node[1], dict) and node[0] < common:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node[1], dict) and node[0] == common:
            node[1][s[common]] = leaf
            return
        branch = [common, {other[common]: node, s[common]: leaf}]
        if parent is None:
            self.root = branch
        else:
            parent[1][s[parent[0]]] = branch

    def leaves(self) -> Iterator[list[int]]:
        """Members of each leaf, in the order of the strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if isinstance(node[1], dict):
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                yield node[1]


def multikey(words: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes at ``at`` within their groups, on all
    groups at once: each group is split into what is less than, equal to and
    greater than the character of its middle suffix, and the equal part goes on
    with the next character, to ``depth`` bytes.

    Returns the indices of suffixes that tie there, and the group each is in; those
    that stand alone are done."""
    index = np.argsort(group, kind="stable")
    group = group[index]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    deep = np.zeros(len(index), dtype=np.int64)
    made = 0
    while len(index):
        new = np.r_[True, group[1:] != group[:-1]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(index)])
        group = np.cumsum(new) - 1
        tied = (deep >= depth) & (size > 1)[group]
        if tied.any():
            done.append((index[tied], group[tied] + made))
            made += len(first)
        go = (deep < depth) & (size > 1)[group]
        if not go.all():
            index, group, deep = index[go], group[go], deep[go]
            continue
        char = words[at[index] + deep].astype(np.uint64)
        middle = char[first + size // 2][group]
        side = (char >= middle).astype(np.int8) + (char > middle)
        # a stable place for each suffix: its group's first, the smaller sides, its own before
        place = np.empty(len(index), dtype=np.int64)
        base = first.copy()
        for k in range(3):
            mine = side == k
            count = np.cumsum(mine)
            before = count - mine
            place[mine] = (base[group] + before - before[first][group])[mine]
            base += np.diff(np.r_[before[first], count[-1]])
        order = np.empty(len(index), dtype=np.int64)
        order[place] = np.arange(len(index))
        index, side = index[order], side[order]
        group = group * 3 + side  # groups stay where they were
        deep = deep[order] + 8 * (side == 1)
    if not done:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([i for i, _ in done]), np.concatenate([g for _, g in done])


def equal_groups(raw: bytes, at: np.ndarray, group: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Indices of suffixes that are equal over ``length`` bytes, group by group
    (8 bytes of padding are expected)."""
    words = _words(raw, ">u8")
    shallow = min(SHALLOW, length // 8 * 8)
    index, group = multikey(words, at, group, shallow)
    if not len(index):
        return
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    pairs = first[size == 2]
    if len(pairs):  # a trie of two leaves is one comparison
        a, b = index[pairs], index[pairs + 1]
        same = np.ones(len(pairs), dtype=bool)
        for d in [*range(shallow, length - 7, 8), length - 8]:
            same[same] = words[at[a[same]] + d] == words[at[b[same]] + d]
        yield from np.stack([a[same], b[same]], axis=1)
    for f, s in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        trie = BlindTrie()
        for i, p in zip(index[f : f + s].tolist(), at[index[f : f + s]].tolist(), strict=True):
            trie.add(raw[p + shallow : p + length], i)
        for members in trie.leaves():
            if len(members) > 1:
                yield np.array(members)


# -- tasks ----------------------------------------------------------------

def _doc_keys(batch: pa.RecordBatch) -> tuple[list[int], list[int]]:
    return batch.column(batch.schema.get_field_index("_doc")).to_pylist(), batch.column(batch.schema.get_field_index("_tag")).to_pylist()


def _slices(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Documents in slices of a few MB: (doc, tag, place of the slice, bytes);
    slices of a document overlap by all but one byte of a string."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for doc, tag, text in zip(*_doc_keys(batch), texts, strict=True):
            raw = utf8(text.as_py())
            for at in range(0, max(1, len(raw) - length + 1), SLICE):
                part = raw[at : at + SLICE + length - 1]
                if len(part) < length:
                    continue
                held.append((doc, tag, at, part))
                size += len(part)
                if size >= SLICE:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _pack(docs: np.ndarray, tags: np.ndarray, places: np.ndarray, runs: np.ndarray, offsets: np.ndarray, body: bytes) -> bytes:
    import zstandard

    head = struct.pack("<I", len(docs)) + docs.astype("<i8").tobytes() + places.astype("<i8").tobytes() + tags.astype("<i8").tobytes() + runs.astype("u1").tobytes() + offsets.astype("u1").tobytes()
    return zstandard.ZstdCompressor(level=6).compress(head + body)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, memoryview]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4, []
    for kind, size in (("<i8", 8), ("<i8", 8), ("<i8", 8), ("u1", 1), ("u1", 1)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += size * n
    docs, places, tags, runs, offsets = out
    return docs, tags, places, runs, offsets, memoryview(raw)[at:]


def _span_rows(docs: np.ndarray, tags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(doc, tag, starts and ends) of each document."""
    if not len(docs):
        return
    order = np.lexsort((starts, tags, docs))
    docs, tags = docs[order], tags[order]
    both = np.stack([starts[order], ends[order]], axis=1).astype("<i8")
    first = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])])
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(docs)], strict=True):
        yield int(docs[a]), int(tags[a]), both[a:b].tobytes()


_ROWS = "bucket long, doc long, tag long, data binary"


def _out(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())], names=["bucket", "doc", "tag", "data"])


def _dealt(batches: Iterable[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Segments by bucket, and (bucket -1) spans known to be repeated already."""
    hot: dict[bytes, tuple[int, int, int]] = {}
    for held in _slices(batches, length):
        raw = b"".join(p for *_, p in held)
        sizes = np.array([len(p) for *_, p in held])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        first, last, place = segments(raw, starts, ends, length)
        piece = np.searchsorted(starts, first, side="right") - 1
        docs = np.array([d for d, *_ in held], dtype=np.int64)[piece]
        tags = np.array([t for _, t, *_ in held], dtype=np.int64)[piece]
        places = np.array([p for _, _, p, _ in held], dtype=np.int64)[piece] + first - starts[piece]
        words = _words(raw + bytes(8))
        gram = _gram_hash(words, place, place + 8)
        # segments that were here before go no further
        _, inverse, counts = np.unique(gram, return_inverse=True, return_counts=True)
        maybe = np.flatnonzero(counts[inverse] > 1)
        maybe = maybe[np.lexsort((places[maybe], tags[maybe], docs[maybe]))].tolist()
        keep = np.ones(len(first), dtype=bool)
        a, b = first.tolist(), (last + length).tolist()
        seen: dict[bytes, tuple[int, int, int]] = {}
        for i in maybe:
            s, here = raw[a[i] : b[i]], (int(docs[i]), int(tags[i]), int(places[i]))
            there = seen.get(s) or hot.get(s)
            if there is None or there > here:
                seen[s] = here
            elif there < here:
                keep[i] = False
                if s not in hot and len(hot) < HOT:
                    hot[s] = there
        if hot:
            for i in np.flatnonzero(counts[inverse] == 1).tolist():
                s = raw[a[i] : b[i]]
                if s in hot and hot[s] < (int(docs[i]), int(tags[i]), int(places[i])):
                    keep[i] = False
        gone = ~keep
        rows = [(-1, d, t, x) for d, t, x in _span_rows(docs[gone], tags[gone], places[gone], places[gone] + (last - first)[gone] + length)]
        bucket = (gram >> np.uint64(11)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        order = order[keep[order]]
        cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if len(order) else []
        for f, t in zip(cuts, [*cuts[1:], len(order)], strict=True):
            o = order[f:t]
            body = b"".join([raw[a[i] : b[i]] for i in o.tolist()])
            rows.append((int(bucket[o[0]]), 0, 0, _pack(docs[o], tags[o], places[o], (last - first + 1)[o], (place - first)[o], body)))
        if rows:
            yield _out(rows)


def _portions(total: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges, by the running ``total`` (0 first), that hold up to ``limit`` each;
    what holds more by itself comes alone."""
    at = 0
    while at < len(total) - 1:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield at, to
        at = to


def repeats(docs: np.ndarray, tags: np.ndarray, places: np.ndarray, runs: np.ndarray, offsets: np.ndarray, body: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans (docs, tags, starts, ends) of strings that start earlier elsewhere,
    among a bucket's segments (8 bytes of padding are expected behind ``body``)."""
    runs, offsets = runs.astype(np.int64), offsets.astype(np.int64)
    sizes = runs + length - 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    at = starts + offsets
    words = _words(body)
    gram = _gram_hash(words, at, at + 8)
    _, group, counts = np.unique(gram, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(counts[group] > 1)
    out = [(docs[:0], tags[:0], places[:0], places[:0])]
    if len(maybe):
        maybe = maybe[np.lexsort((places[maybe], tags[maybe], docs[maybe], group[maybe]))]
        new = np.flatnonzero(np.r_[True, group[maybe][1:] != group[maybe][:-1], True])
        for f, t in _portions(np.r_[0, np.cumsum(runs[maybe])][new], STRINGS):
            out += _repeats_among(maybe[new[f] : new[t]], docs, tags, places, runs, offsets, starts, group, body, length)
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4))  # type: ignore[return-value]


def _repeats_among(maybe: np.ndarray, docs: np.ndarray, tags: np.ndarray, places: np.ndarray, runs: np.ndarray, offsets: np.ndarray, starts: np.ndarray, group: np.ndarray, body: bytes, length: int) -> Iterator[tuple]:
    """Spans among the segments ``maybe``: whole groups, each in order of (doc, tag,
    place)."""
    # equal segments: all strings of the later ones are repeated
    seen: dict[bytes, int] = {}
    whole, left = [], []
    a = starts[maybe]
    for i, s, e in zip(maybe.tolist(), a.tolist(), (a + runs[maybe] + length - 1).tolist(), strict=True):
        k = seen.setdefault(body[s:e], i)
        if k == i:
            left.append(i)
        elif docs[k] != docs[i] or tags[k] != tags[i] or places[k] != places[i]:
            whole.append(i)
    del seen
    if whole:
        yield docs[whole], tags[whole], places[whole], places[whole] + runs[whole] + length - 1
    _, inverse, counts = np.unique(group[left], return_inverse=True, return_counts=True)
    rest = np.array(left, dtype=np.int64)[counts[inverse] > 1]
    if not len(rest):
        return
    # strings with their gram at the same place can be equal
    grams = length - GRAM + 1
    n, offset = runs[rest], offsets[rest]
    each = np.cumsum(np.bincount(offset - n + 1, minlength=grams + 1) - np.bincount(offset + 1, minlength=grams + 1))[:grams]
    for low, high in _portions(np.r_[0, np.cumsum(each)], STRINGS):
        first = np.clip(offset - high + 1, 0, n)
        m = np.clip(offset - low + 1, 0, n) - first
        owner = np.repeat(rest, m)
        i = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m - first, m)
        key = group[owner] * grams + offsets[owner] - i
        place = places[owner] + i
        marked = np.zeros(len(owner), dtype=bool)
        for members in equal_groups(body, starts[owner] + i, key, length):
            d, t, p = docs[owner[members]], tags[owner[members]], place[members]
            k = np.lexsort((p, t, d))[0]
            marked[members] |= (d != d[k]) | (t != t[k]) | (p != p[k])
        hit = np.flatnonzero(marked)
        if len(hit):
            new = np.r_[True, (np.diff(hit) > 1) | (owner[hit][1:] != owner[hit][:-1])]
            f = hit[new]
            t = hit[np.r_[new[1:], True]]
            yield docs[owner[f]], tags[owner[f]], place[f], place[t] + length


def _finer(bucket: int, part: tuple, length: int, context: int) -> Iterator[tuple[int, int, int, bytes]]:
    """The rows of a blob's segments, dealt by ``context`` bytes more: those behind
    the gram, or before it where the string ends too soon."""
    docs, tags, places, runs, offsets, body = part
    sizes = runs.astype(np.int64) + length - 1
    starts = np.cumsum(sizes) - sizes
    # the first strings of a segment have the gram too near their end
    cut = np.clip(offsets.astype(np.int64) - (length - GRAM - context), 0, runs)
    words = _words(body + bytes(8))
    n = np.r_[cut, runs - cut].astype(np.int64)
    own = np.flatnonzero(n > 0)
    behind, segment = own >= len(runs), own % len(runs)
    shift = np.where(behind, cut[segment], 0)
    gram = starts[segment] + offsets[segment]
    key = _gram_hash(words, gram, gram + 8)
    for d in range(0, context, 8):
        key = _mix(key + words[np.where(behind, gram + GRAM + d, gram - context + d)] * _C2)
    finer = ((key >> np.uint64(17)) % np.uint64(1024)).astype(np.int64) + bucket * 1024
    order = np.argsort(finer, kind="stable")
    cuts = np.flatnonzero(np.r_[True, finer[order][1:] != finer[order][:-1]])
    for f, t in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        o = order[f:t]
        x, sh, m = segment[o], shift[o], n[own[o]]
        a = (starts[x] + sh).tolist()
        text = b"".join([body[i : i + k + length - 1] for i, k in zip(a, m.tolist(), strict=True)])
        yield int(finer[o[0]]), 0, 0, _pack(docs[x], tags[x], places[x] + sh, m, offsets[x].astype(np.int64) - sh, text)


def _spans(parts: list[tuple], length: int) -> list[tuple]:
    """Rows of the spans that a bucket's ``parts`` hold; empties the list."""
    arrays = [np.concatenate([p[k] for p in parts]) for k in range(5)]
    body = b"".join([*[p[5] for p in parts], bytes(8)])
    parts.clear()
    return [(-1, d, t, x) for d, t, x in _span_rows(*repeats(*arrays, body, length))]


def _sorted(batches: Iterable[pa.RecordBatch], length: int, level: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; those of bucket -1 are passed on.  Gives spans,
    as rows of bucket -1, and the rows of a bucket that is dealt anew."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for cut in chunks([batch], "data", 16_000_000):
                yield from zip(*[c.to_pylist() for c in cut.columns], strict=True)

    for bucket, run in itertools.groupby(rows(), key=lambda r: r[0]):
        if bucket < 0:
            for r in run:
                yield _out([r])
            continue
        parts, held = [], 0
        for r in run:
            parts.append(_unpack(r[3]))
            held += len(parts[-1][5])
            if level < len(CONTEXTS) and held > BUCKET_LIMIT:
                for part in parts:
                    for x in _finer(bucket, part, length, CONTEXTS[level]):
                        yield _out([x])
                parts.clear()
        if not parts:
            continue
        found = _spans(parts, length)
        for k in range(0, len(found), 5000):
            yield _out(found[k : k + 5000])


def union(data: list[bytes]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    if not data:
        return []
    spans = np.frombuffer(b"".join(data), "<i8").reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > top[:-1]]
    return list(zip(spans[new, 0].tolist(), top[np.r_[new[1:], True]].tolist(), strict=True))


def _squeezed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the way through the shuffle."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for batch in chunks(batches, "text", 8_000_000):
        texts = pa.array([None if t is None else press.compress(utf8(t)) for t in batch.column(0).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([texts, *batch.columns[1:]], names=["_text", *batch.schema.names[1:]])


def _applied(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True))
        new = [*[pa.array(x, pa.int64()) for x in c[:3]], pa.array(c[3], pa.string()), pa.array(c[4], pa.string()), pa.array(c[5], span)]
        old = [batch.column(batch.schema.get_field_index(f"_c{k}")) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([*old, *new], names=[*names, *_NEW])

    for batch in batches:
        rows: list[tuple] = []
        size = start = 0
        texts, spans = batch.column(batch.schema.get_field_index("_text")), batch.column(batch.schema.get_field_index("_spans"))
        for text, data in zip(texts, spans, strict=True):
            value = None if text.as_py() is None else press.decompress(text.as_py()).decode("utf-8", "surrogatepass")
            raw, gone, kept, at = utf8(value), union(data.as_py() or []), [], 0
            for s, e in gone:
                kept.append(raw[at:s])
                at = e
            rest = b"".join([*kept, raw[at:]])
            left = rest.decode("utf-8", "ignore") if gone else value
            rows.append((len(raw), len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), left, [{"start": s, "end": e} for s, e in gone]))
            # by the length of the texts: how far they were compressed says little
            size += len(raw)
            if size >= 8_000_000:
                yield made(batch.slice(start, len(rows)), rows)
                start, rows, size = start + len(rows), [], 0
        if rows:
            yield made(batch.slice(start), rows)


_NEW = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "removed"]


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut from ``text`` (and ``n_chars`` set
    to its length, if there is such a column); all other columns as they came.  A
    character that a cut leaves incomplete goes as well."""
    names = docs.columns
    rest = [F.col(c) for c in names if c != "text"]
    whole = docs.select("doc_id", "text", F.struct(*rest).alias("row"))
    out = deduplicated(whole, ["row"], length)
    new = {"text": F.col("kept_text")} | ({"n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in names])


def deduplicated(docs: DataFrame, carry: list[str], length: int = LENGTH) -> DataFrame:
    """Columns ``carry`` of each document with n_bytes, n_removed, n_spans,
    kept_sha256, kept_text and the removed spans (byte offsets in the input)."""
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_doc"), "text", *[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)])
    base = tagged(base)
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(size * 3.5) // BUCKET_BYTES))
    dealt = base.select("_doc", "_tag", "text").mapInArrow(lambda it: _dealt(it, length, buckets), _ROWS)
    # one bucket to a partition: dealt by hash, some would get several
    n = max(buckets, shuffle_parts(spark))
    place = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("doc"), F.lit(n))).otherwise(F.col("bucket")).cast("int")
    dealt = dealt.repartitionById(n, place).sortWithinPartitions("bucket")
    found = stored(dealt.mapInArrow(lambda it: _sorted(it, length), _ROWS), "spans")
    spans = found.filter("bucket < 0")
    for level in range(1, len(CONTEXTS) + 1):
        anew = found.filter("bucket >= 0")
        if anew.isEmpty():
            break
        anew = anew.repartition(shuffle_parts(spark), "bucket").sortWithinPartitions("bucket")
        found = stored(anew.mapInArrow(lambda it, k=level: _sorted(it, length, k), _ROWS), f"spans{level}")
        spans = spans.union(found.filter("bucket < 0"))
    spans = spans.groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(F.collect_list("data").alias("_spans"))
    squeezed = base.select("text", *[c for c in base.columns if c != "text"])
    fields = [T.StructField("_text", T.BinaryType()), *squeezed.schema.fields[1:]]
    joined = squeezed.mapInArrow(_squeezed, T.StructType(fields)).join(spans.hint("merge"), ["_doc", "_tag"], "left").select("_text", "_spans", *[f"_c{k}" for k in range(len(carry))])
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = [T.LongType()] * 3 + [T.StringType()] * 2 + [span]
    out = T.StructType([*[docs.schema[c] for c in carry], *[T.StructField(n, k) for n, k in zip(_NEW, kinds, strict=True)]])
    return joined.mapInArrow(lambda it: _applied(it, carry), out)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
