"""Removal of repeated lines and paragraphs by hashing.

A text is tiled into units: its lines, and within a line its sentences (up to and
with a run of ``.!?``), so that a passage set into the middle of other lines is
found by the sentences it holds.  Every unit with a word is normalised (A-Z
lower-cased, white space collapsed, ``.!?`` at the end dropped) and hashed to 128
bits.  Digests meet globally; the occurrence with the smallest (doc_id, offset) is
the first, all others are repeated.  What is removed are paragraphs: stretches of
repeated units, one after another, of at least ``MIN_WORDS`` words together, about
as much as a string of 100 bytes.  A short line goes with the block that it stands
in and stays where it stands alone.  Offsets refer to the text as it came.  A task
combines its own occurrences before they are sent, so a line that very many
documents hold is sent once a task.

Defined cases: a null or empty text has no unit; a null doc_id ranks last; rows
that repeat a doc_id and text are the same document and keep the same units; rows
that share or lack a doc_id and have other texts are documents of their own, in the
order of the text's MD5; of equal units in a document the first counts as
first; an empty table gives an empty result; texts of any length are processed
whole; extra columns may have any names.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, stored, table, tagged, utf8

#: Words of a stretch of repeated units that is removed, at least.
MIN_WORDS = 16
#: Units that a task gathers before it sends them on.
GATHER = 400_000
_SENTENCE = re.compile(r"[^.!?]*[.!?]+|[^.!?]+")
LAST = (1 << 63) - 1


def normal(text: str) -> tuple[bytes, int]:
    """The normalised unit and its number of words."""
    words = utf8(text).lower().split()
    return b" ".join(words).rstrip(b".!? "), len(words)


def units(text: str | None) -> Iterator[tuple[int, int, bytes, int]]:
    """(start, end, normalised unit, words) of each unit with a word; offsets in
    code points."""
    at = 0
    for line in (text or "").split("\n"):
        for m in _SENTENCE.finditer(line):
            key, n = normal(m[0])
            if n:
                yield at + m.start(), at + m.end(), key, n
        at += len(line) + 1


def stretches(text: str | None, repeated: set[int], least: int = MIN_WORDS) -> tuple[int, list[tuple[int, int, int]]]:
    """Number of units, and (start, end, units) of the stretches of units that
    start at one of ``repeated`` and hold ``least`` words together."""
    total, out, run = 0, [], [0, 0, 0, 0]  # start, end, units, words
    for start, end, _, n in itertools.chain(units(text) if repeated else (), [(-1, -1, b"", 0)]):
        total += 1
        if start in repeated:
            run = [run[0] if run[2] else start, end, run[2] + 1, run[3] + n]
        elif run[2]:
            if run[3] >= least:
                out.append((run[0], run[1], run[2]))
            run = [0, 0, 0, 0]
    return (total - 1 if repeated else sum(1 for _ in units(text))), out


_ROWS = "kind long, hi long, lo long, doc long, tag long, start long"


def _combined(rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """The first occurrence of each digest (kind 0), and the others, which are
    repeated for certain (kind 1)."""
    if not rows:
        return
    doc, tag, start = (np.array(c, dtype=np.int64) for c in list(zip(*rows, strict=True))[:3])
    key = np.frombuffer(b"".join(r[3] for r in rows), dtype="<i8").reshape(-1, 2)
    order = np.lexsort((start, tag, doc, key[:, 1], key[:, 0]))
    key, doc, tag, start = key[order], doc[order], tag[order], start[order]
    first = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
    origin = np.flatnonzero(first)[np.cumsum(first) - 1]
    same = (doc == doc[origin]) & (tag == tag[origin]) & (start == start[origin])  # a repeated row, or the unit itself
    for kind, mask in ((0, first), (1, ~same)):
        if mask.any():
            columns = [np.full(int(mask.sum()), kind), key[mask, 0].copy(), key[mask, 1].copy(), doc[mask], tag[mask], start[mask]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["kind", "hi", "lo", "doc", "tag", "start"])


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    rows: list[tuple[int, int, int, bytes]] = []
    for batch in chunks(batches, "text", 8_000_000):
        for doc, tag, text in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_doc", "_tag", "text")], strict=True):
            rows.extend((doc, tag, s, xxhash.xxh3_128_digest(key)) for s, _, key, _ in units(text))
            if len(rows) > GATHER:
                yield from _combined(rows)
                rows = []
    yield from _combined(rows)


_NEW = ["n_chars", "n_units", "n_removed", "removed_chars", "kept_sha256", "kept_text", "removed"]


def _applied(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in chunks([whole], "text", 16_000_000):
            rows = []
            texts, spans = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("_spans"))
            for value, found in zip(texts, spans, strict=True):
                text = value.as_py()
                n, gone = stretches(text, set(found.as_py() or ()))
                kept, at = [], 0
                for s, e, _ in gone:
                    kept.append((text or "")[at:s])
                    at = e
                rest = "".join([*kept, (text or "")[at:]])
                cut = [{"start": s, "end": e} for s, e, _ in gone]
                rows.append((len(text or ""), n, sum(k for *_, k in gone), len(text or "") - len(rest), hashlib.sha256(utf8(rest)).hexdigest(), rest if gone else text, cut))
            c = list(zip(*rows, strict=True))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            new = [*[pa.array(x, pa.int64()) for x in c[:4]], pa.array(c[4], pa.string()), pa.array(c[5], pa.string()), pa.array(c[6], span)]
            old = [batch.column(batch.schema.get_field_index(f"_c{k}")) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*old, *new], names=[*names, *_NEW])


def deduplicated(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Columns ``carry`` of each document with n_chars, n_units, n_removed,
    removed_chars, kept_sha256, kept_text and the removed spans."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_doc"), "text", *[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)])
    base = tagged(base)
    found = stored(base.select("_doc", "_tag", "text").mapInArrow(_hashed, _ROWS), "units")
    place = F.struct("doc", "tag", "start")
    later = found.filter("kind = 0").withColumn("_first", F.min(place).over(Window.partitionBy("hi", "lo"))).filter(place != F.col("_first"))
    gone = later.select("doc", "tag", "start").union(found.filter("kind = 1").select("doc", "tag", "start"))
    spans = gone.groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(F.collect_list("start").alias("_spans"))
    joined = base.join(spans, ["_doc", "_tag"], "left").select("text", "_spans", *[f"_c{k}" for k in range(len(carry))])
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [span]
    out = T.StructType([*[docs.schema[c] for c in carry], *[T.StructField(n, k) for n, k in zip(_NEW, kinds, strict=True)]])
    return joined.mapInArrow(lambda it: _applied(it, carry), out)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"), ["doc_id"])
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "n_chars", "n_units", "n_removed", "removed_chars", "kept_sha256", spans.alias("removed_spans"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), line AS (
  SELECT doc_id, unnest(range(len(ls))) AS k, unnest(ls) AS x FROM l
), spot AS (
  SELECT *, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM line
), part AS (
  SELECT doc_id, k, s AS line_start, unnest(range(len(ps))) AS j, unnest(ps) AS x
  FROM (SELECT *, regexp_extract_all(x, '[^.!?]*[.!?]+|[^.!?]+') AS ps FROM spot)
), unit AS (
  SELECT doc_id, line_start + coalesce(sum(length(x)) OVER (PARTITION BY doc_id, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, x FROM part
), norm AS (
  SELECT doc_id, s, s + length(x) AS e,
    rtrim(array_to_string(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' '), '.!? ') AS key,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
  FROM unit
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, s) AS r, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS place FROM norm WHERE n >= 1
), n AS (
  SELECT doc_id, count(*) AS n_units FROM ranked GROUP BY doc_id
), run AS (
  SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY s) AS g FROM ranked WHERE r > 1
), span AS (
  SELECT doc_id, min(s) AS s, max(e) AS e, count(*) AS units FROM run GROUP BY doc_id, g HAVING sum(n) >= 16
), piece AS (
  SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM span
), cut AS (
  SELECT doc_id, string_agg(substr(t, CAST(p + 1 AS BIGINT), CAST(s - p AS BIGINT)), '' ORDER BY s) AS head, max(e) AS last, sum(e - s) AS removed_chars,
    string_agg(CAST(s AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY s) AS removed_spans
  FROM piece JOIN l USING (doc_id) GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(sum(units) AS BIGINT) AS n_removed FROM span GROUP BY doc_id
)
SELECT doc_id, length(t) AS n_chars, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed,
  CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars,
  sha256(CASE WHEN last IS NULL THEN t ELSE head || substr(t, CAST(last + 1 AS BIGINT)) END) AS kept_sha256, coalesce(removed_spans, '') AS removed_spans
FROM l LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN cut USING (doc_id)
"""
