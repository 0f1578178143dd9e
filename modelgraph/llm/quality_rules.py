"""Quality rules as a short-circuit cascade.

Every rule looks at one document and rejects it or not; a document is kept when
no rule rejects it, so the order of the rules never changes the verdict, only
the work.  The order is chosen by measuring each rule on a sample of documents:
rules come by falling rejections per second among what the rules before let pass,
and a document stops at the first rule that rejects it.  Measures are computed on
demand and shared by the rules.

Defined cases: a null or empty text has no words and fails the base rules; a
repeated row is judged like its twin; rules of equal rate come in the order they
are listed in; texts of any length are measured whole; an empty table gives an
empty result; extra columns of the input, of any names, are carried along by
``apply_rules``.
"""

from __future__ import annotations

import copy
import functools
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, table, utf8

SYMBOLS = b"#*$%&|<>"
#: Documents that the cost and selectivity of rules are measured on.
SAMPLE_ROWS = 600
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Document:
    """Lazily computed measures of one text."""

    def __init__(self, text: str | None):
        self.raw = utf8(text)

    @functools.cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes.split cuts at exactly \x20 and \x09-\x0D

    @functools.cached_property
    def n_words(self) -> int:
        return len(self.words)

    @functools.cached_property
    def word_chars(self) -> int:
        inside = self.raw.translate(None, b" \t\n\x0b\x0c\r")
        return len(inside.decode("utf-8", "surrogatepass"))

    @functools.cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @functools.cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @functools.cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @functools.cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three words that occur twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in self.words], dtype=np.int64)
        _, pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
        key = pair[:-1].astype(np.int64) * len(seen) + ids[2:]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]
    base: bool = False


def too_few_words(d: Document) -> bool:
    return d.n_words < 50


def too_repetitive(d: Document) -> bool:
    return 100 * d.n_repeat_words > 50 * d.n_words


def many_symbols(d: Document) -> bool:
    return 10 * d.n_symbols > d.n_words


def many_dup_lines(d: Document) -> bool:
    return 2 * d.n_dup_lines > max(1, len(d.lines))


def odd_word_length(d: Document) -> bool:
    return not 3 * d.n_words <= d.word_chars <= 10 * d.n_words


def some_repetition(d: Document) -> bool:
    return 100 * d.n_repeat_words > 30 * d.n_words


#: The production rules. The two base rules are those of the contract.
RULES = (
    Rule("too_few_words", too_few_words, base=True),
    Rule("too_repetitive", too_repetitive, base=True),
    Rule("many_symbols", many_symbols),
    Rule("many_dup_lines", many_dup_lines),
    Rule("odd_word_length", odd_word_length),
    Rule("some_repetition", some_repetition),
)


def _measure(batches: Iterable[pa.RecordBatch], rules: tuple[Rule, ...], text: str) -> Iterator[pa.RecordBatch]:
    """The rules in their order, one row each, by what they cost and reject among
    the sample's documents that the rules before let pass.  What those rules have
    measured of a document is known by then, so a rule that shares it costs less."""
    alive = [Document(v) for batch in batches for v in batch.column(batch.schema.get_field_index(text)).to_pylist()]
    left, rows = list(range(len(rules))), []
    while left:
        rate: dict[int, float] = {}
        for k in left:
            probes = [copy.copy(d) for d in alive]  # with what is known, and no more
            began = time.perf_counter()
            hits = sum(bool(rules[k].rejects(d)) for d in probes)
            rate[k] = hits / max(time.perf_counter() - began, 1e-9)
        best = max(left, key=lambda k: (rate[k], -k))
        left.remove(best)
        rows.append((best, len(rows), rate[best]))
        alive = [d for d in alive if not rules[best].rejects(d)]
    columns = list(zip(*rows, strict=True))
    yield pa.RecordBatch.from_pydict({"rule": pa.array(columns[0], pa.int64()), "place": pa.array(columns[1], pa.int64()), "rate": pa.array(columns[2], pa.float64())})


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by falling rejections per second on a sample of ``docs``, each
    measured on what the ones before it let pass.

    The sample, of ``sample_rows`` documents at most, is measured in one task; one
    row a rule comes back."""
    sample = docs.select(text).sample(0.2, seed=7).limit(sample_rows)
    places = sample.mapInArrow(lambda it: _measure(it, rules, text), "rule long, place long, rate double").orderBy("place").collect()
    return tuple(rules[r["rule"]] for r in places[: len(rules)]) if len(places) == len(rules) else tuple(rules)


def cascade(d: Document, rules: tuple[Rule, ...]) -> str | None:
    """Name of the first rule that rejects the document."""
    return next((r.name for r in rules if r.rejects(d)), None)


def _judge(batches: Iterable[pa.RecordBatch], rules: tuple[Rule, ...], text: str, schema: pa.Schema, measures: bool) -> Iterator[pa.RecordBatch]:
    """The input's columns with the verdict; or its first column, the measures
    and the verdict."""
    base = [r for r in rules if r.base]
    names = [*MEASURES, "base_failed", "rule_rejected_by"] if measures else ["rule_rejected_by"]
    for batch in batches:
        rows = []
        for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
            d = Document(value)
            by = cascade(d, rules)
            rows.append([*[getattr(d, m) for m in MEASURES], any(r.rejects(d) for r in base), by] if measures else [by])
        first = batch.columns[:1] if measures else batch.columns
        types = [f.type for f in schema][len(first):]
        new = [pa.array([r[k] for r in rows], types[k]) for k in range(len(names))]
        yield pa.RecordBatch.from_arrays([*first, *new], names=[f.name for f in schema])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", verdict: str = "rule_rejected_by") -> DataFrame:
    """``docs`` with the column ``verdict``: the rule that stopped the document,
    null where it is kept.  All columns of the input stay as they are."""
    rules = ordered(docs, rules, text)
    out = T.StructType([*docs.schema.fields, T.StructField(verdict, T.StringType())])
    return docs.mapInArrow(lambda it: _judge(it, rules, text, _arrow(out), False), out)


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with the columns they came with."""
    verdict = free_name(docs, "rule_rejected_by")
    return apply_rules(docs, rules, verdict=verdict).filter(F.col(verdict).isNull()).drop(verdict)


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The verdict of the cascade with all measures, one row per document."""
    rules = ordered(docs, rules)
    docs = docs.select("doc_id", "text")
    long = [T.StructField(m, T.LongType()) for m in MEASURES]
    out = T.StructType([docs.schema["doc_id"], *long, T.StructField("base_failed", T.BooleanType()), T.StructField("rule_rejected_by", T.StringType())])
    return docs.mapInArrow(lambda it: _judge_all(it, rules, out), out)


def _judge_all(batches: Iterable[pa.RecordBatch], rules: tuple[Rule, ...], out: T.StructType) -> Iterator[pa.RecordBatch]:
    return _judge(batches, rules, "text", _arrow(out), True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measured(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("rule_rejected_by").isNull()).select("doc_id", *MEASURES, "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), pos AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d
), tri AS (
  SELECT doc_id, i, word AS a, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
    OR 2 * n_dup_lines > greatest(1, n_lines) OR word_chars < 3 * n_words OR word_chars > 10 * n_words) AS kept
FROM m
"""
