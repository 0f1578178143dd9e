import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from modelgraph.llm import html_extraction, mixing, quality_classifier, quality_rules
from modelgraph.llm.common import stored

from .fixtures import documents, empty, rows, saved

SF = "/root/testdata/sf0.001"


# -- quality rules
def brute_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(tri)
    hit = {j for i, x in enumerate(tri) if counts[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_op3_measures(spark, tmp_path):
    odd = [(900, "a a a a a b | c $$ # é", "en", "s", 0), (901, "x y z\nx y z\n\n \nq", "en", "s", 0), (902, "ab cd ef " * 40, "en", "s", 0)]
    df = documents(spark).union(spark.createDataFrame(odd, documents(spark).schema))
    got = {r.doc_id: r for r in quality_rules.op3_quality_rules(spark, saved(df, tmp_path, "documents")).collect()}
    for doc_id, text, *_ in rows() + odd:
        m = brute_measures(text)
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (r.base_failed and r.kept)


def test_rule_order_never_changes_the_verdict():
    docs = [quality_rules.Document(t) for _, t, *_ in rows()]
    forward = [quality_rules.cascade(d, quality_rules.RULES) is None for d in docs]
    assert forward == [quality_rules.cascade(d, quality_rules.RULES[::-1]) is None for d in docs]


def test_rules_are_measured_on_what_the_ones_before_let_pass(spark):
    import time

    def slow(d):
        d.__dict__.setdefault("shared", time.sleep(0.002) or True)
        return d.n_words % 2 == 0

    rules = tuple(quality_rules.Rule(n, f) for n, f in (("never", lambda d: False), ("late", lambda d: "shared" not in d.__dict__ and not time.sleep(0.004) and d.n_words % 3 == 0), ("slow", slow), ("quick", lambda d: d.n_words < 30)))
    df = spark.createDataFrame([(i, " ".join("w" * (i % 60))) for i in range(1500)], "doc_id long, text string")
    names = [r.name for r in quality_rules.ordered(df, rules)]
    assert names[0] == "quick" and set(names) == {"never", "late", "slow", "quick"} and names.index("slow") < names.index("late")
    assert quality_rules.ordered(empty(spark), rules) == rules


def test_apply_rules_keeps_columns_and_empty(spark):
    out = quality_rules.apply_rules(documents(spark, extra=True))
    assert out.columns == [*documents(spark, extra=True).columns, "rule_rejected_by"]
    assert quality_rules.apply_rules(empty(spark)).count() == 0


# -- mixing
def test_op1_targets(spark, tmp_path):
    folder = saved(documents(spark, extra=True), tmp_path, "documents")
    got = mixing.op1_mixing_sources(spark, folder).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    assert len(got) == len(rows())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, free, capped = 1.5 * sum(sizes.values()), set(order), set()
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weights[s] for s in free) if free else 0
        above = {s for s in free if weights[s] * level > 2 * sizes[s]}
        if not above:
            break
        free, capped = free - above, capped | above
    taken = {}
    for r in got:
        assert r.target == pytest.approx(2 * sizes[r.source] if r.source in capped else weights[r.source] * level)
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[r.source] - r.target) <= 1 for r in got)
    again = mixing.op1_mixing_sources(spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_op1_takes_the_blocks_that_its_plan_names(spark, tmp_path):
    """The mix by plain Python from the plan's slots: words of each document."""
    df = documents(spark).union(documents(spark).limit(5))
    got = mixing.op1_mixing_sources(spark, saved(df, tmp_path, "documents")).collect()
    docs, sources = mixing.placed(mixing.sized(df))
    by_base = {r.base: r for r in sources.collect()}
    slots = mixing.plan(sources).collect()
    words = {}  # the run of a source's words, each named by its document's place
    for r in sorted(docs.collect(), key=lambda r: r.place):
        words.setdefault(r.base, []).extend([r.place] * r.size)
    taken, seen = Counter(), Counter()
    for r in slots:
        run = words[r.base][r.block * mixing.BLOCK :][: r.length]
        assert len(run) == r.length
        taken.update(run)
        seen[r.base, r["pass"], r.block] += 1
    assert max(seen.values()) == 1  # a pass takes a block once at most
    for base, s in by_base.items():
        assert sum(taken[p] for p in set(words.get(base, ()))) == int(s.target + 0.5)
    rows_of = Counter((r.doc_id, r.size, r.taken) for r in got if r["size"])
    sizes = {r.place: (r.doc_id, r["size"]) for r in docs.collect() if r["size"]}
    assert rows_of == Counter((*sizes[p], taken[p]) for p in sizes)
    assert mixing.op1_mixing_sources(spark, saved(empty(spark), tmp_path / "e", "documents")).count() == 0


def test_op1_one_long_document(spark, tmp_path):
    df = spark.createDataFrame([(1, "w " * 200_000, "a"), (2, "one two", "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.op1_mixing_sources(spark, saved(df, tmp_path, "documents")).collect()}
    assert got[1].size == 200_000 and got[1].taken == round(got[1].target) and got[2].taken == 4


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 17, 1000):
        out = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("p")).collect()
        assert sorted(r.p for r in out) == list(range(n))
        assert n < 1000 or [r.p for r in out] != list(range(n))


def test_mixed_documents(spark):
    df = documents(spark, extra=True)
    out = stored(mixing.mixed_documents(df), "mixed")
    assert out.columns == df.columns
    texts = {d: t for d, t, *_ in rows()}
    for r in out.collect():
        assert len(r.text) == r.n_chars
        have = texts[r.doc_id].split()
        assert set(r.text.split()) <= set(have) and len(r.text.split()) <= len(have)
    assert mixing.mixed_documents(empty(spark)).count() == 0
    assert mixing.mixed_documents(df.union(df)).count() > 0


# -- html
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><div id="header"><h1>Site</h1></div>
<ul class="main-menu"><li><a href=x>Home</a></li></ul><div class="content"><h2>Title &amp; more</h2><script>var a="</p>";</script>
<p>The first   paragraph is of some length, and it says <b>a good deal</b> about what there is to say, on and on.<br>Second half.</p>
<p>Short.</p><p>Another paragraph, again of some length, with text that goes on for a while &lt;so&gt; that it is dense.</p></div>
<div class="cookie-notice"><p>We use cookies on this site and would like you to know that we do so and why.</p></div>
<section id="comments"><p>First! I like that article very much and I will tell all my friends about it soon.</p></section><div id=footer>Copyright"""


def test_extract():
    text = html_extraction.extract(PAGE)
    blocks = text.split("\n\n")
    assert blocks[0] == "Title & more" and blocks[2] == "Short." and len(blocks) == 4
    assert blocks[1].endswith("on and on. Second half.") and "<so>" in blocks[3]
    assert html_extraction.extract(None) == html_extraction.extract("") == ""
    assert html_extraction.extract("<article>tiny</article><footer>x</footer>") == "tiny"
    assert html_extraction.extract("<nav>a</nav>") == ""
    assert html_extraction.extract("<article><p>cut off in the middl") == "cut off in the middl"


def test_short_lines_behind_an_advert_stay():
    long = "A paragraph of some length, with text that goes on for a while so that it is dense, and then goes on for a while more, to its end."
    page = "<div class=logo>Site</div><nav>x</nav><div class=content><p>{}</p><div class=ad>Buy!</div>{}</div><form>y</form><div class=imprint>Powered by z</div>"
    for close in ("<h3>The end</h3>", "<ul><li>The end</li></ul>", "The end", "<div>The end</div>"):
        assert html_extraction.extract(page.format(long, close)) == f"{long}\n\nThe end"


def test_names_drop_no_main_text():
    long = "A paragraph of some length, with text that goes on for a while so that it is dense, and then goes on for a while more, to its end."
    for name in ("content with-sidebar", "main-content sidebar-left", "hasSidebar"):
        assert html_extraction.extract(f"<div class='{name}'><p>{long}</p></div><div class='sidebar-left'><p>{long}</p></div>") == long
        assert html_extraction.extract(f"<div class='{name}'><article><p>{long}</p></article></div>") == long
    for name in ("entry-header", "header"):
        assert html_extraction.extract(f"<article><div class={name}><h1>Title</h1></div><p>{long}</p></article>") == f"Title\n\n{long}"
    assert html_extraction.extract(f"<div><div class=post-header><h1>Title</h1></div><p>{long}</p></div>") == f"Title\n\n{long}"
    assert html_extraction.extract(f"<article><figure><img src=x><figcaption>A caption</figcaption></figure><p>{long}</p></article>") == f"A caption\n\n{long}"
    for name in ("sidebar", "content sidebar", "related-posts", "comment-list", "cookie-notice", "site-header", "ad"):
        assert html_extraction.extract(f"<div class='{name}'><p>{long}</p></div>") == ""


LONG = "A paragraph of some length, with text that goes on for a while so that it is dense, and then goes on for a while more, to its end."


def test_distribution_alone_finds_the_text():
    """No element or name that is listed anywhere marks what is text here."""
    side = "<div class='left-col'>Our weather today: mild and dry.</div>"
    below = "<div class=x9><p>Printed in the old town.</p><p>Since 1910.</p></div>"
    for text in (f"<h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>", f"<p>{LONG}</p><div>Short.</div><p>{LONG}</p>"):
        blocks = [re.sub("<.*?>", "", x) for x in re.findall(r"<(?:h1|p|div)>.*?</", text)]
        want = "\n\n".join(b.rstrip("</") for b in blocks)
        assert html_extraction.extract(f"<html><body>{side}<div class=q7>{text}</div>{below}</body></html>") == want
        assert html_extraction.extract(f"<div id=all>{side}<div class=q7>{text}</div>{below}</div>") == want
    # sections of one parent, a sparse one among them
    parts = f"<section><p>{LONG}</p></section><section><p>Short.</p></section><section><p>{LONG}</p></section>"
    assert html_extraction.extract(f"<div>{side}</div><div class=q7>{parts}</div><div>{below}</div>") == f"{LONG}\n\nShort.\n\n{LONG}"
    # a menu without a name: link text in lists has no weight
    menu = "<ul>" + "".join(f"<li><a href=x>A place of this site, number {i}, with a long name</a></li>" for i in range(9)) + "</ul>"
    assert html_extraction.extract(f"<div>{menu}</div><div><p>{LONG}</p></div>") == LONG
    # an article that is a teaser only; the text stands elsewhere
    assert html_extraction.extract(f"<article>Read this too</article><div><p>{LONG}</p></div>") == LONG


def test_lines_within_an_article_stay():
    page = "<article><h1><a href=x>A linked title</a></h1><section><p>{}</p></section><section><p>Short.</p></section><p><a href=y>A linked end</a></p></article><div><p>{}</p></div>"
    assert html_extraction.extract(page.format(LONG, LONG)) == f"A linked title\n\n{LONG}\n\nShort.\n\nA linked end"
    assert html_extraction.extract(f"<article><p>{LONG}</p><div hidden>Not shown</div><div class=related-work><p>Others did so too.</p></div></article>") == f"{LONG}\n\nOthers did so too."
    assert "Not shown" not in html_extraction.extract(f"<article><p>{LONG}</p><div hidden>Not shown</div></article>")
    assert html_extraction.extract(f"<div><p>{LONG}</p><p>a <![CDATA[ x ]]> b</p></div>") == f"{LONG}\n\na b"


def test_extraction_is_linear():
    import time

    def seconds(text):
        began = time.perf_counter()
        html_extraction.extract(text)
        return time.perf_counter() - began

    for unit in ("<![CDATA[ x", "<!-- x", "<b>x<p>y", "<div>x", "<a x='", '<a x=">', "</p>x<", "<ul><li><a>x"):
        seconds(unit * 100)
        # four times the text; quadratic work would take sixteen times as long
        assert seconds(unit * 40_000) < 10 * max(0.1, seconds(unit * 10_000)), unit


def test_op6_odd_tables(spark, tmp_path):
    schema = "page_id long, url string, html string"
    rows = [(1, "a", None), (2, None, ""), (None, "c", f"<p>{LONG}</p>"), (4, "d", f"<p>{LONG}</p>"), (4, "d", f"<p>{LONG}</p>"), (5, "e", "<p>" + "word " * 400_000 + "</p>")]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS text", "'x' AS n_chars", "2 AS weight")
    got = html_extraction.op6_html_extraction(spark, saved(df, tmp_path / "a", "pages")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, len(LONG)), (1, 0), (2, 0), (4, len(LONG)), (4, len(LONG)), (5, 1_999_999)]
    assert html_extraction.op6_html_extraction(spark, saved(spark.createDataFrame([], schema), tmp_path / "b", "pages")).count() == 0


def test_op6_equals_a_plain_reading(spark):
    def plain(page):
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        import html

        blocks = re.split(r"</?(?:p|h1)[^>]*>", body)
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks]
        return "\n\n".join(b for b in blocks if b)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html_extraction.op6_html_extraction(spark, SF).collect():
        assert r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text)


# -- classifier
def test_op10_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality_classifier.op10_quality_classifier(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    out = [(labels[d], got[d].predicted) for d in labels if got[d].held_out]
    assert sum(a == b for a, b in out) / len(out) > 0.95


def test_fit_reaches_the_optimum():
    """The dual's optimum by projected gradient steps on the whole matrix."""
    rng = np.random.default_rng(4)
    rows_ = []
    for i in range(60):
        y = int(rng.random() < 0.4)
        slots = np.unique(rng.integers(0, 40, 8) + (15 if y else 0)).astype(np.uint32)
        rows_.append((slots, y))
    w, bias, _, _ = quality_classifier.fit(rows_, epochs=3000)
    counts = np.ones((2, quality_classifier.FEATURES))
    for slots, y in rows_:
        counts[y, slots] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = np.zeros((60, 61))
    for i, (slots, _) in enumerate(rows_):
        x[i, slots] = ratio[slots] / np.linalg.norm(ratio[slots])
    x[:, 60] = 1.0
    y = np.array([1.0 if label else -1.0 for _, label in rows_])
    ones = (y > 0).sum()
    most = quality_classifier.C * np.where(y > 0, 60 / (2 * ones), 60 / (2 * (60 - ones)))
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(60), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, most)
    best = (x * y[:, None]).T @ alpha
    value = lambda v: 0.5 * v @ v + (most * np.maximum(0, 1 - y * (x @ v))).sum()
    found = np.r_[np.divide(w[:60], ratio[:60], out=np.zeros(60), where=ratio[:60] != 0), bias]
    assert value(found) == pytest.approx(value(best), rel=1e-3)


def test_op10_repeated_documents_and_long_texts(spark, tmp_path):
    docs = [(i, ("good words here " if i % 2 else "bad %% ## ") * (1 + i % 7), "x", 1) for i in range(60)] * 2 + [(70, "word " * 300_000, "x", 1), (71, None, "x", 1), (None, "", "x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, label int")
    saved(df, tmp_path, "documents")
    saved(spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    got = quality_classifier.op10_quality_classifier(spark, str(tmp_path), max_train=25).collect()
    again = quality_classifier.op10_quality_classifier(spark, str(tmp_path), max_train=25).collect()
    assert len(got) == 123 and sorted(map(str, got)) == sorted(map(str, again))
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)
    saved(empty(spark), tmp_path / "e", "documents")
    saved(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path / "e", "labels")
    assert quality_classifier.op10_quality_classifier(spark, str(tmp_path / "e")).count() == 0


def test_op10_odd_inputs(spark, tmp_path):
    saved(documents(spark, n=12), tmp_path, "documents")
    saved(spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    out = quality_classifier.op10_quality_classifier(spark, str(tmp_path)).collect()
    assert len(out) == 18 and {r.score for r in out} == {0.5}


# -- pipeline
def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "repeated_passages", "mixture", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        if name in ("quality_rules", "near_duplicates"):
            assert docs.count() < before
            before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() > 0


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """Each stage, and the whole, against a plain reading of what it does."""
    import zlib as z

    from modelgraph.llm.packing import CAPACITY
    from modelgraph.llm.tokens import default_path, encoder

    from .test_dedup import brute_components

    rng = random.Random(8)
    plain_words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))
    passage = plain_words(40)
    base = [plain_words(rng.randint(60, 200)) for _ in range(25)]
    docs = [(i, base[i % 25] if i % 7 else base[i % 25].replace(" a", " b", 2) + " end", "en", f"s{i % 3}", 0) for i in range(60)]
    docs += [(60 + i, plain_words(60) + f"\n{passage}\n" + plain_words(50), "en", "s1", 0) for i in range(6)]
    docs += [(70, None, None, None, None), (71, "", "en", "s0", 0), (72, "too few words", "en", "s0", 0), (73, "# % " * 60, "en", "s0", 0), (74, plain_words(9000), "en", "s9", 0), (3, plain_words(90), "en", "s0", 0), (3, docs[3][1], "en", "s0", 0), (None, plain_words(70), "en", None, 0)]
    folder = saved(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), tmp_path, "documents")
    rows_of = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    now = spark.read.parquet(f"{folder}/documents.parquet")

    def good(text):
        n, chars, symbols, dup, repeat = brute_measures(text)
        lines = sum(1 for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c"))
        return n >= 50 and 100 * repeat <= 30 * n and 10 * symbols <= n and 2 * dup <= max(1, lines) and 3 * n <= chars <= 10 * n

    want = [(d if d is not None else -1, x) for d, x, *_ in docs if good(x)]
    now = stored(stages["quality_rules"](spark, now, folder), "q")
    assert rows_of(now) == sorted(want)

    want = sorted(set(w for w in want if w[0] >= 0)) + [w for w in want if w[0] < 0]  # a repeated row stays once
    ids = {n: w for n, w in enumerate(want) if w[0] >= 0}
    reps = {c for _, c in brute_components([(n, w[1]) for n, w in ids.items()], 5, 80, 100).values()}
    want = [w for n, w in enumerate(want) if n not in ids or n in reps]
    now = stored(stages["near_duplicates"](spark, now, folder), "n")
    assert rows_of(now) == sorted(want) and len(want) < 50

    seen, kept = set(), []
    for d, text in sorted(want, key=lambda w: (w[0] < 0, w[0])):
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        kept.append((d, bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode()))
    now = stored(stages["repeated_passages"](spark, now, folder), "r")
    assert rows_of(now) == sorted(kept) != sorted(want)

    found, sources = mixing.placed(mixing.sized(now, carry=True))
    runs = {}
    for r in sorted(found.collect(), key=lambda r: r.place):
        tokens = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", r.row.text or "")
        runs.setdefault(r.base, []).extend((r.place, r.doc_id, w) for w in tokens)
    mixed = {}
    for slot in mixing.plan(sources).collect():
        at = slot.block * mixing.BLOCK
        for k in range(at, at + slot.length):
            place, d, w = runs[slot.base][k]
            mixed.setdefault((place, slot["pass"], d), []).append((k, w))
    mix = sorted((d if d is not None else -1, "".join(w for _, w in sorted(ws))) for (_, _, d), ws in mixed.items())
    now = stored(stages["mixture"](spark, now, folder), "m")
    assert rows_of(now) == mix and len(mix) > len(kept)

    tokenizer = encoder(default_path()).tokenizer
    pieces = []
    for d, text in mix:
        raw = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        pieces += [(d, k // CAPACITY, k, len(raw[k : k + CAPACITY]), z.crc32(raw[k : k + CAPACITY].tobytes())) for k in range(0, len(raw), CAPACITY)]
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(pieces)
    assert len({(r.row_id, r.piece) for r in out}) == len(out)
    fill = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert fill[r.sequence_id] == r.offset
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= CAPACITY and len(fill) <= -(-sum(fill.values()) // CAPACITY) + 1


def test_stages_keep_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    docs = documents(spark)
    for name in ("rule_rejected_by", "_gone", "_nth", "n_bytes", "kept_text", "removed", "row", "place", "size", "_spans", "component_id"):
        docs = docs.withColumn(name, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, ""), name)
        assert out.columns == docs.columns
        assert out.filter("kept_text = 'x' AND size = 'x' AND _nth = 'x'").count() == out.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
