"""Text quality by a linear model on naive Bayes features.

Indicators of n-grams are scaled by the log ratio of their (smoothed) counts in
the two classes; on these a linear hinge-loss model is fitted by dual coordinate
descent, and its margins are mapped to 0..1 by a fitted logistic curve.

The n-grams are byte trigrams of the text and n-grams of word shapes (letter
case, marks around the letters, and whether the word stood a like distance
before, which shows copied runs).  Both kinds are hashed to ``FEATURES`` slots.

The fit uses at most ``max_train`` labelled documents, those with the smallest
hash of doc_id (the smallest text of a repeated one), and of these the first ones
until their texts hold ``MAX_TRAIN_BYTES``, so it is bounded in rows and bytes;
every document is scored.

Defined cases: a null or empty text has no n-gram and gets the score of the
intercept; rows of ``labels`` that are null or contradict each other aren't
learnt from; without rows of both classes every score is the share of ones
(0.5 without any); repeated documents get equal scores; equal hashes of doc_id are
taken by doc_id; texts of any length are read whole; an empty table gives an empty
result; extra columns, of any names, are never inputs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, utf8

FEATURES = 1 << 18
#: Bound on the labelled rows that the model is fitted on.
MAX_TRAIN = 8000
#: Bound on the bytes of their texts.
MAX_TRAIN_BYTES = 128_000_000
EPOCHS = 20
#: Bound of the dual variables.
C = 0.5

_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")


def _shape(word: bytes) -> int:
    core = _LETTERS.sub(lambda m: b"A" if m[0].isupper() and len(m[0]) > 1 else b"X" if m[0][:1].isupper() else b"x", word[:40])
    return zlib.crc32(core)


_SHAPES: dict[bytes, int] = {}


def _shapes(words: list[bytes]) -> np.ndarray:
    if len(_SHAPES) > 200_000:
        _SHAPES.clear()
    for w in set(words):
        if w not in _SHAPES:
            _SHAPES[w] = _shape(w)
    return np.array([_SHAPES[w] for w in words], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)


def features(text: str | None, flags: np.ndarray) -> np.ndarray:
    """Sorted slots of the document's n-grams. ``flags``: all-false scratch."""
    raw = utf8(text)
    half = np.uint64(FEATURES // 2 - 1)
    if len(raw) >= 3:
        b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
        h = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(0x9E3779B1)
        flags[h >> np.uint32(15)] = True
    words = raw.split()
    if words:
        shape = _shapes(words)
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        gap = np.zeros(len(words), dtype=np.int64)
        same = ids[order[1:]] == ids[order[:-1]]
        gap[order[1:][same]] = (order[1:] - order[:-1])[same]
        copied = np.flatnonzero((gap[1:] > 0) & (gap[1:] == gap[:-1]))
        parts = [shape, shape[1:] * np.uint64(31) + shape[:-1]]
        if len(copied):
            breaks = np.flatnonzero(np.diff(copied) > 1)
            runs = np.diff(np.concatenate([[-1], breaks, [len(copied) - 1]]))
            parts.append(np.arange(1, int(np.log2(runs.max())) + 2, dtype=np.uint64) + np.uint64(1 << 40))
            share = int(10 * len(copied) / len(words))
            parts.append(np.arange(share + 1, dtype=np.uint64) + np.uint64(1 << 41))
        for p in parts:
            flags[(_mix(p) & half) + np.uint64(FEATURES // 2)] = True
    slots = np.flatnonzero(flags)
    flags[slots] = False
    return slots.astype(np.uint32)


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, bound: float = C, seed: int = 1) -> tuple[np.ndarray, float, float, float]:
    """(weights, intercept, slope and shift of the logistic curve)."""
    y = np.array([label for _, label in rows])
    w = np.zeros(FEATURES)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return w, 0.0, 0.0, float(np.log(p / (1 - p)))
    counts = np.ones((2, FEATURES))
    for slots, label in rows:
        counts[label, slots] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = [(slots, ratio[slots] / max(1e-12, np.linalg.norm(ratio[slots]))) for slots, _ in rows]
    sign = np.where(y == 1, 1.0, -1.0)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    alpha, bias = np.zeros(len(y)), 0.0
    square = np.array([v @ v + 1.0 for _, v in x])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            slots, v = x[i]
            gradient = sign[i] * (w[slots] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), bound * weight[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[slots] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    margin = np.array([w[slots] @ v + bias for slots, v in x])
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps for the curve, softened targets against overfitting
        p = 1 / (1 + np.exp(-(a * margin + b)))
        t = np.where(y == 1, 0.98, 0.02)
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum() + 1e-3 * b])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-9:
            break
    return w * ratio, bias, float(a), float(b)


def score(slots: np.ndarray, ratio_norm: np.ndarray, model: tuple[np.ndarray, float, float, float]) -> float:
    weights, bias, a, b = model
    if len(slots):
        bias = bias + weights[slots].sum() / max(1e-12, np.sqrt(ratio_norm[slots].sum()))
    return float(1 / (1 + np.exp(-np.clip(a * bias + b, -700, 700))))


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flags = np.zeros(FEATURES, dtype=bool)
    for batch in batches:
        slots = [features(t, flags).tobytes() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(slots), pa.int32()), batch.column(1), pa.array(slots, pa.binary())], names=["g", "label", "slots"])


def _ratio_square(rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    counts = np.ones((2, FEATURES))
    for slots, label in rows:
        counts[label, slots] += 1
    return (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())) ** 2


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["label", "slots"], kind="stable")
    rows = [(np.frombuffer(s, dtype=np.uint32), int(y)) for s, y in zip(pdf["slots"], pdf["label"], strict=True)]
    weights, bias, a, b = fit(rows)
    return pd.DataFrame({"weights": [weights.astype("<f4").tobytes()], "norms": [_ratio_square(rows).astype("<f4").tobytes()], "bias": [bias], "a": [a], "b": [b]})


def train(texts: DataFrame) -> tuple[bytes, bytes, float, float, float] | None:
    """Fit on the rows of ``texts`` (text, label int); one task holds them, so
    the caller bounds their number.  The model is about 2 MB at any input."""
    rows = texts.select("text", "label").mapInArrow(_sampled, "g int, label int, slots binary")
    found = rows.groupBy("g").applyInPandas(_train, "weights binary, norms binary, bias double, a double, b double").collect()
    return (bytes(found[0]["weights"]), bytes(found[0]["norms"]), found[0]["bias"], found[0]["a"], found[0]["b"]) if found else None


def _scored(batches: Iterable[pa.RecordBatch], model: object) -> Iterator[pa.RecordBatch]:
    found = model.value  # type: ignore[attr-defined]
    if found is None:
        weights, norms, rest = np.zeros(FEATURES), np.ones(FEATURES), (0.0, 0.0, 0.0)
    else:
        weights, norms, rest = np.frombuffer(found[0], "<f4").astype(float), np.frombuffer(found[1], "<f4").astype(float), found[2:]
    flags = np.zeros(FEATURES, dtype=bool)
    for batch in batches:
        s = [score(features(t, flags), norms, (weights, *rest)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=[batch.schema.names[0], "score"])


def scored(docs: DataFrame, model: tuple | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType())])
    return docs.select(key, text).mapInArrow(lambda it: _scored(it, shared), out)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op10_quality_classifier(spark: SparkSession, sf_dir: str, max_train: int = MAX_TRAIN) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out()).filter("quality IN (0, 1) AND doc_id IS NOT NULL")
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_most")).filter("label = _most")
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).select("doc_id", F.col("label").cast("int").alias("label"))
    # of a doc_id's texts one is learnt from, so ``max_train`` bounds the rows
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    # over at most ``max_train`` rows, so one task may hold the window
    before = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    texts = texts.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < MAX_TRAIN_BYTES)
    model = train(texts.select("text", "label"))
    out = scored(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
