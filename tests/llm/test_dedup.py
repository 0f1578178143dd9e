import hashlib
import os
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelgraph.llm import common, embedding_dedup, line_dedup, ngram_join, suffix_dedup
from modelgraph.llm.common import components

from .fixtures import documents, empty, rows, saved


# -- scratch
def test_a_cluster_needs_a_shared_folder(spark, tmp_path):
    from types import SimpleNamespace as Some

    made = lambda master, known: Some(conf=Some(get=lambda key, other: known or other), sparkContext=Some(master=master))
    assert common.shared_dir(made("yarn", "s3://bucket/x/")) == "s3://bucket/x"
    assert common.shared_dir(made("local[4]", None)).startswith("file:/")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(made(master, None))


def test_release_deletes_scratch_tables(spark, tmp_path):
    kept = common._ROOTS[:]
    common._ROOTS.clear()
    df = common.stored(spark.range(3), "some")
    path = df.inputFiles()[0].removeprefix("file://")
    common.release()
    assert not os.path.exists(path) and not common._ROOTS
    common._ROOTS.extend(kept)


# -- suffix arrays
def brute_repeats(docs, length):
    seen, out = set(), {}
    for doc_id, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for q in range(len(raw) - length + 1):
            s = raw[q : q + length]
            if s in seen:
                gone[q : q + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_op4_equals_brute_force(spark, tmp_path):
    got = suffix_dedup.op4_suffix_array_dedup(spark, saved(documents(spark, extra=True), tmp_path, "documents")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_repeats([r[:2] for r in sorted(rows())], 100)


def test_suffix_dedup_periodic_texts_and_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    rng = random.Random(2)
    docs = [(0, "ab" * 400), (1, "x" * 350 + "ab" * 100), (2, "".join(rng.choice("ab") for _ in range(3000))), (3, "x" * 99), (4, "x" * 100), (5, None)]
    docs.append((6, docs[2][1][500:1500] + "!" + docs[2][1][400:900]))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = suffix_dedup.deduplicated(df, ["doc_id"]).collect()
    want = brute_repeats(docs, 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_suffix_dedup_deals_large_buckets_anew(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_LIMIT", 3000)
    monkeypatch.setattr(suffix_dedup, "SLICE", 1500)
    rng = random.Random(6)
    hot, long = "".join(rng.choice("abcdefgh") for _ in range(24)), "".join(rng.choice("abcdefgh") for _ in range(95))
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    docs = [(i, text(90) + rng.choice([hot, long, long[20:80]]) + text(rng.randint(0, 90)) + rng.choice([hot, long]) + text(60)) for i in range(120)]
    docs += [(200 + i, docs[i][1][40:200] + "!" + docs[i + 1][1][:130]) for i in range(0, 60, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = suffix_dedup.deduplicated(df, ["doc_id"]).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(docs, 100)


def test_multikey_quicksort_finds_the_ties():
    rng = np.random.default_rng(5)
    raw = bytes(rng.choice([97, 98], 4000).astype(np.uint8)) + b"ab" * 300
    words = suffix_dedup._words(raw + bytes(8), ">u8")
    at, group = rng.integers(0, len(raw) - 40, 3000), rng.integers(0, 5, 3000)
    for depth in (8, 16, 32):
        index, tie = suffix_dedup.multikey(words, at, group, depth)
        got = {}
        for i, g in zip(index.tolist(), tie.tolist(), strict=True):
            got.setdefault(g, set()).add(i)
        want = {}
        for i in range(len(at)):
            want.setdefault((group[i], raw[at[i] : at[i] + depth]), set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_suffix_dedup_sorts_a_bucket_in_portions(monkeypatch):
    # near copies: almost every segment shares its gram, but few are equal as a whole
    rng = random.Random(6)
    base = bytes(rng.randrange(97, 123) for _ in range(3000))
    texts = []
    for _ in range(30):
        text = bytearray(base)
        for at in range(rng.randrange(130), len(text), 130):
            text[at] = rng.randrange(97, 123)
        texts.append(bytes(text))
    want = {i: r[1:3] for i, r in brute_repeats([(i, t.decode()) for i, t in enumerate(texts)], 100).items()}
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    raw = b"".join(texts)
    first, last, place = suffix_dedup.segments(raw, starts, ends, 100)
    docs = np.searchsorted(starts, first, side="right") - 1
    body = b"".join(raw[a:b] for a, b in zip(first.tolist(), (last + 100).tolist(), strict=True))
    blob = suffix_dedup._pack(docs, np.zeros(len(docs), dtype=np.int64), first - starts[docs], last - first + 1, place - first, body)

    def found():
        tracemalloc.start()
        spans = {}
        for out in suffix_dedup._sorted([suffix_dedup._out([(0, 0, 0, blob)])], 100):
            for r in out.to_pylist():
                spans.setdefault(r["doc"], []).append(r["data"])
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        gone = {d: suffix_dedup.union(x) for d, x in spans.items()}
        assert {i: (sum(e - s for s, e in gone.get(i, [])), len(gone.get(i, []))) for i in want} == want
        return most

    for limit in (10_000, 500):  # the latter also cuts groups
        monkeypatch.setattr(suffix_dedup, "STRINGS", limit, raising=False)
        assert found() < 20 * len(body)


def test_suffix_dedup_gives_long_texts_in_portions():
    import pyarrow as pa

    text = "x" * 3_000_000
    batch = pa.RecordBatch.from_arrays([pa.array([text, None, text, text, "", text]), pa.array(range(6))], names=["text", "_c0"])
    squeezed = pa.Table.from_batches(suffix_dedup._squeezed([batch])).combine_chunks()
    whole = squeezed.append_column("_spans", pa.array([[np.array([0, 10]).tobytes()], *[None] * 5], pa.list_(pa.binary()))).to_batches()
    assert len(whole) == 1
    out = list(suffix_dedup._applied(whole, ["doc_id"]))
    assert [b.column(0).to_pylist() for b in out] == [[0, 1, 2, 3], [4, 5]]
    assert [n for b in out for n in b.column(1).to_pylist()] == [3_000_000, 0, 3_000_000, 3_000_000, 0, 3_000_000]
    assert [n for b in out for n in b.column(2).to_pylist()] == [10, 0, 0, 0, 0, 0]


def test_suffix_dedup_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "q" * 50 + "r" * 80), (1, "q" * 50 + "r" * 80), (None, "q" * 50 + "r" * 80)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.n_removed) for r in suffix_dedup.deduplicated(df, ["doc_id"]).collect()))
    assert got == [(False, 0), (False, 0), (True, 130)]
    assert suffix_dedup.deduplicated(empty(spark), ["doc_id"]).count() == 0


def test_suffix_dedup_rows_without_doc_id_are_told_apart(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    known, head, clean = text(120), text(110), {}
    while True:  # two texts with the same last 16 bits of their CRC
        other = text(150)
        pair = known + "x" + text(60)
        clean[zlib.crc32(other.encode()) % 65536] = other
        if (same := clean.get(zlib.crc32(pair.encode()) % 65536)) is not None:
            break
    df = spark.createDataFrame([(1, known), (None, pair), (None, same), (None, head + "x" + text(40)), (None, head + "y" + text(40))], "doc_id long, text string")
    got = {r.text: r.n_removed for r in suffix_dedup.deduplicated(df, ["text"]).collect()}
    assert got[known] == 0 and got[pair] == 120 and got[same] == 0
    assert sorted(n for t, n in got.items() if t.startswith(head)) == [0, 110]


def test_blind_trie_orders_and_groups():
    rng = random.Random(1)
    strings = ["".join(rng.choice("ab") for _ in range(12)).encode() for _ in range(400)]
    trie = suffix_dedup.BlindTrie()
    for i, s in enumerate(strings):
        trie.add(s, i)
    leaves = list(trie.leaves())
    assert [strings[m[0]] for m in leaves] == sorted(set(strings))
    assert all(len({strings[i] for i in m}) == 1 for m in leaves)


# -- n-gram join
def brute_components(docs, k, num, den):
    sets = {}
    for doc_id, text in docs:
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (2, 60)])
def test_linked_equals_brute_force(spark, k, num):
    got = ngram_join.linked(documents(spark, extra=True), k, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components([r[:2] for r in rows()], k, num, 100)


def test_linked_blocks_hot_groups_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 400)
    monkeypatch.setattr(ngram_join, "SIEVE", 6)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame([*docs, (None, docs[0][1])], "doc_id long, text string").coalesce(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(df, 3, 90, 100).collect()}
    assert got.pop(None)[1] is None
    assert got == brute_components(docs, 3, 90, 100)
    assert ngram_join.linked(empty(spark)).count() == 0


def test_representatives(spark):
    df = documents(spark)
    kept = {r.doc_id for r in ngram_join.representatives(df, 5, 80, 100).collect()}
    assert kept == {d for d, (_, c) in brute_components([r[:2] for r in rows()], 5, 80, 100).items() if d == c}
    twice = ngram_join.representatives(df.union(df), 5, 80, 100)
    assert twice.count() == len(kept) and twice.columns == df.columns


def test_representatives_of_a_repeated_doc_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = [(1, a), (1, b), (1, b), (2, b + " more"), (3, a), (3, c), (3, ""), (4, c), (None, a)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = ngram_join.representatives(df, 5, 80, 100)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, a), (1, b), (3, c), (3, ""), (0, a)])


def test_search_finds_every_link():
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(0, 2**62, 80).astype(np.uint64))
    sets = [np.unique(np.r_[base[rng.random(len(base)) < 0.93], rng.integers(0, 2**62, 3).astype(np.uint64)]) for _ in range(25)]
    got = {tuple(sorted(x)) for x in ngram_join.search(sets, None, 90, 100, all_links=True)}
    want = {(i, j) for j in range(25) for i in range(j) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - c)}
    assert got == want


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(1000, 1001)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long"), "chain").collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


# -- embeddings
def brute_vectors(data, threshold):
    usable = [(i, np.array(v, dtype=float), lab) for i, v, lab in data if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _, _ in data}
    for i, v, a in usable:
        for j, w, b in usable:
            if i != j and a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                links[i].add(j)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_equal_brute_force(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(embedding_dedup, "CELL", 5)
        monkeypatch.setattr(embedding_dedup, "SHIP", 1e-9)  # so pivots pay
        monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 15 * 64)
    rng = np.random.default_rng(3)
    data = []
    for i in range(160):
        v = rng.normal(size=8)
        if i % 3 and data:
            v = np.array(data[rng.integers(0, len(data))][1]) + rng.normal(size=8) * 0.08
        data.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    data += [(200, data[0][1], 0), (201, data[0][1], 0), (202, None, 0), (203, [], 0), (204, [0.0] * 8, 0), (205, [float("nan")] * 8, 0), (206, [None] * 8, 0), (207, data[1][1], None), (208, [1.0, 2.0], 0), (209, [2.0, 4.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == brute_vectors(data, 0.98)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_extreme_vectors_and_shared_ids(spark):
    data = [(1, [1e-200, 1e-200], 0), (2, [1e200, 1e200], 0), (3, [-1e200, 1e200], 0), (3, [-1e200, 1e200], 0), (4, [0.0, 5e-324], 0), (5, [-0.0, 2.0], 0), (None, [1.0, 1.0], 0), (1, [1.0, 1.0], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("cls", F.lit("x")).withColumn("cell", F.lit(1))
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect() if r.vec_id)
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 4, True), (5, 1, 4, False)]


def test_pivots_are_chosen_by_cost():
    rng = np.random.default_rng(0)
    radius = (2 - 2 * 0.98) ** 0.5
    scattered = embedding_dedup._unit(list(rng.normal(size=(600, 64))))
    assert len(embedding_dedup.chosen(scattered, 5_000, radius)) == 1
    crowds = embedding_dedup._unit(list(np.repeat(np.eye(64)[:40], 15, axis=0)[rng.permutation(600)] + rng.normal(size=(600, 64)) * 0.01))
    assert len(embedding_dedup.chosen(crowds, 1_000_000, radius)) >= 16


# -- lines
def brute_lines(docs):
    """Stretches by a plain reading of the definition; ``docs``: (doc_id, text)."""
    first, out = {}, {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        at, parts = 0, []
        for line in (text or "").split("\n"):
            for m in re.finditer(r"[^.!?]*[.!?]+|[^.!?]+", line):
                words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in m[0]))
                if words:
                    parts.append((at + m.start(), at + m.end(), " ".join(words).rstrip(".!? "), len(words)))
            at += len(line) + 1
        flags = [first.setdefault(key, (doc_id, s)) != (doc_id, s) for s, _, key, _ in parts]
        gone, i = [], 0
        while i < len(parts):
            j = i
            while j < len(parts) and flags[j]:
                j += 1
            if sum(n for *_, n in parts[i:j]) >= 16:
                gone.append((parts[i][0], parts[j - 1][1]))
            i = max(j, i + 1)
        out[doc_id] = gone
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", "!", " Or. so"]) for _ in range(60)]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for i in range(80)] + [(90, None), (91, ""), (92, " \n . \n"), (None, "\n".join(lines[:9])), (93, "x. " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("hi", F.lit("x")).withColumn("_spans", F.lit(1))
    got = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in line_dedup.deduplicated(df, ["doc_id", "hi"]).collect()}
    assert got == brute_lines(docs) and any(got.values())


def test_lines_earliest_stays(spark):
    line = "This line has quite enough words, sixteen of them at least, to count as a paragraph here."
    block = "Short line.\nAnother short one.\nA third, somewhat longer line.\nAnd a fourth that ends the repeated block."
    docs = [(2, f"{line}\nunique words in the second text here\n{line}"), (1, f"Start of it all.  {line.upper()}! And more.\n{block}"), (3, None), (4, "of.\nof.\nof."), (5, f"{line}"), (6, f"Start.\n{block}\nEnd."), (7, "Short line.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.deduplicated(df, ["doc_id"]).collect()}
    assert got[1].n_removed == got[4].n_removed == got[7].n_removed == got[3].n_chars == 0
    assert got[2].kept_text == "\nunique words in the second text here\n"
    assert [(s.start, s.end) for s in got[2].removed] == [(0, len(line)), (len(docs[0][1]) - len(line), len(docs[0][1]))]
    assert got[5].kept_text == "" and got[6].kept_text == "Start.\n\nEnd." and got[6].n_removed == 4
    twice = line_dedup.deduplicated(df.union(df), ["doc_id"])
    assert sorted((r.doc_id, r.n_removed) for r in twice.collect()) == sorted((d, got[d].n_removed) for d in [*got, *got])
    assert line_dedup.deduplicated(empty(spark), ["doc_id"]).count() == 0


def test_lines_of_rows_without_doc_id(spark):
    head = " ".join(f"w{i}" for i in range(20)) + "."
    df = spark.createDataFrame([(None, f"{head} One."), (None, f"{head} Two."), (None, "Three."), (7, "Four."), (7, f"{head}")], "doc_id long, text string")
    got = {r.kept_text: r.n_removed for r in line_dedup.deduplicated(df, ["doc_id"]).collect()}
    assert got == {" One.": 1, " Two.": 1, "Three.": 0, "Four.": 0, head: 0}
