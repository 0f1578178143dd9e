import random
import zlib

import numpy as np
import pytest

from modelgraph.llm import packing, token_files
from modelgraph.llm.tokens import default_path, encoder

from .fixtures import documents, empty, rows, saved


def whole(text):
    e = encoder(default_path())
    return np.array(e.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def test_encoder_equals_whole_texts():
    rng = random.Random(3)
    letters = "ab'sté É.,!12 \n\t<|>µß×\xa0\x85Σσİ́ñ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    texts += ["It's <|endoftext|> x's 'tis DON'T", "<|STARTOFTEXT|>", "we're're 've 's", "", None, "..'s ''t x''s a'b'c 5's'5"]
    for text, ids in zip(texts, encoder(default_path()).encode_many(texts), strict=True):
        assert ids == whole(text).tobytes(), text


@pytest.mark.parametrize("n", [1, 2, 3, 500, 49408])
def test_huffman_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, 40_000) - 1, n - 1).astype(np.uint32)
    lengths = token_files.code_lengths(np.bincount(ids, minlength=n))
    assert lengths.max() <= token_files.LIMIT
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    codes = token_files.canonical_codes(lengths)
    block = token_files.encode_block(ids, codes, lengths)
    assert (token_files.decode_block(block, token_files.lookup(lengths)) == ids).all()


def test_op2_reads_back_what_the_tokenizer_gives(spark, tmp_path):
    folder = saved(documents(spark), tmp_path, "documents")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op2_huffman_token_files(spark, folder).collect()}
    start, want = 0, {}
    for doc_id, text, *_ in sorted(rows()):
        ids = np.append(whole(text), np.uint32(2)).astype("<u4")
        want[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want


def test_op2_repeated_rows_null_id_and_empty(spark, tmp_path):
    df = documents(spark, n=6)
    df = df.union(df.limit(2)).union(spark.createDataFrame([(None, "no id", "en", "s", 1)], df.schema))
    out = token_files.op2_huffman_token_files(spark, saved(df, tmp_path, "documents")).orderBy("start").collect()
    assert len(out) == df.count() and out[0].doc_id is None
    assert [r.start for r in out] == list(np.cumsum([0, *[r.n_tokens for r in out[:-1]]]))
    assert token_files.op2_huffman_token_files(spark, saved(empty(spark), tmp_path / "e", "documents")).count() == 0


def test_op2_ties_and_clashing_columns(spark, tmp_path):
    docs = [(7, "same id"), (7, "other text"), (7, "same id"), (None, "no id"), (None, "none either"), (1, "word " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS _hash", "2 AS start")
    got = token_files.op2_huffman_token_files(spark, saved(df, tmp_path, "documents")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 7, 7, 7]
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(x), zlib.crc32(x.tobytes())) for x in (np.append(whole(t), np.uint32(2)).astype("<u4") for _, t in docs))
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got[:-1]]]))


def check_packing(got, capacity=packing.CAPACITY):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_op8_pieces_and_sequences(spark, tmp_path):
    got = packing.op8_best_fit_packing(spark, saved(documents(spark, extra=True), tmp_path, "documents")).collect()
    want = {}
    for doc_id, text, *_ in rows():
        ids = np.append(whole(text), np.uint32(0)).astype("<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[doc_id, k // 2048] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    n = check_packing(got)
    assert n <= -(-sum(r.length for r in got) // 2048) + 1


def test_pack_over_many_cells_and_levels(spark):
    rng = random.Random(5)
    data = [(i, rng.randint(1, 100)) for i in range(900)]
    pieces = spark.createDataFrame(data, "_row long, length long")
    out = pieces.join(packing.pack(pieces, capacity=100, cell=120), "_row").collect()
    assert len(out) == 900
    n = check_packing(out, 100)
    assert n <= 1.06 * sum(x for _, x in data) / 100 + 2
    assert packing.pack(pieces.limit(0), capacity=100).count() == 0


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.integers(1, 100, 300))[::-1]
    a = packing.evolve(sizes, [], 100, 1, generations=0, population=1)
    for seed in range(20):
        noise = np.full(300, -1, dtype=np.int64)
        packing.best_fit(sizes, np.random.default_rng(seed).permutation(300).tolist(), noise, [], 0, 100)
        child = packing.crossover(sizes, a, noise, 100, np.random.default_rng(seed))
        assert (child >= 0).all() and np.bincount(child, weights=sizes).max() <= 100


@pytest.mark.parametrize(("low", "high", "capacity"), [(20, 101, 150), (500, 900, 2048)])
def test_evolution_needs_fewer_bins_than_best_fit(low, high, capacity):
    sizes = np.sort(np.random.default_rng(1).integers(low, high, 900))[::-1].astype(np.int64)
    plain = packing.best_fit(sizes, range(len(sizes)), np.full(len(sizes), -1), [], 0, capacity)
    bins = packing.evolve(sizes, [], capacity, 1)
    assert np.bincount(bins, weights=sizes).max() <= capacity and bins.max() + 1 < plain


def test_evolution_crosses_where_the_bound_is_met(monkeypatch):
    calls, cross = [], packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: calls.append(1) or cross(*a))
    sizes = np.sort(np.random.default_rng(2).integers(1, 60, 400))[::-1].astype(np.int64)
    bins = packing.evolve(sizes, [], 100, 1)
    assert len(calls) >= packing.SETTLED and bins.max() + 1 == -(-sizes.sum() // 100)


def test_op8_rows_without_doc_id_and_ties(spark, tmp_path):
    docs = [(None, "same words here"), (None, "same words here"), (3, "same words here"), (3, "other words there"), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS piece", "1 AS row_id", "2 AS length")
    got = packing.op8_best_fit_packing(spark, saved(df, tmp_path, "documents")).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got) == sorted((d or 0, 0, len(whole(t)) + 1) for d, t in docs)
    assert check_packing(got) == 1
    rows = packing.packed_documents(df).collect()
    assert len({(r.row_id, r.piece) for r in rows}) == len(rows) == 5


def test_sequences_hold_the_ids(spark):
    packed = packing.packed_documents(documents(spark, n=10), with_ids=True)
    out = packing.sequences(packed).collect()
    assert sum(len(r.ids) // 4 for r in out) == packed.agg({"length": "sum"}).first()[0]
    assert max(len(r.ids) for r in out) <= 4 * 2048
