"""Mixing sources to target weights, with DataFrame operations only.

The words of a source, document after document, are packed into blocks of a fixed
length.  The mix is a sequence of output shards of ``SLOTS`` block slots each.
For every shard the numbers of slots of each source are drawn from a multinomial
distribution; draws beyond a source's quota are settled against the sources that
came out short, so every source gets exactly its quota.  The k-th slot of a
source takes the block at place k of the source's pseudorandom permutation of
block indices, a new one for each pass over the source, and blocks are joined by
index.  The last slot of a source is cut so that the words taken equal its
target, to the word.

Defined cases: a null or empty text has no words and is never taken; null is a
source of its own and comes last; repeated rows are documents of their own, and
documents of one source, doc_id and size come in any order, with equal results;
without any words every target is 0, and an empty table gives an empty result; a
text of any length is cut into blocks like any other; extra columns may have any
names, they don't enter the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_totals, shuffle_parts, stored, table

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block, slots in an output shard.
BLOCK = 128
SLOTS = 512
#: Slots whose permutations a task computes.
SLOTS_A_TASK = 50_000
#: Words the mix has, as a share of all words; most passes over a source.
SHARE = (3, 2)
MOST = 2
WEIGHTS = (3, 1, 2)
#: Rounds of the index permutation.
ROUNDS = 24
SEED = 20240521


def word_count(text: Column) -> Column:
    """Number of words, counted as the places where a word begins."""
    gaps = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(gaps, " "), lambda w: w != "")).cast("long")


def _swap(x: Column, n: Column, key: Column, r: Column) -> Column:
    """One round of a swap-or-not shuffle of 0..n-1: x and its partner change
    places or not, as a hash of the larger of them says."""
    other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), key, r), n) - x, n)
    return F.when(F.pmod(F.xxhash64(F.lit(SEED + 1), key, r, F.greatest(x, other)), F.lit(2)) == 1, other).otherwise(x)


def permuted(i: Column, n: Column, key: Column) -> Column:
    """Place of ``i`` in the pseudorandom permutation ``key`` of 0..n-1."""
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.when(n > 1, F.aggregate(rounds, i, lambda x, r: _swap(x, n, key, r))).otherwise(i)


def targets(sizes: DataFrame) -> DataFrame:
    """Add to (source, source_size) the weight by rank and the target words.

    The excess over ``MOST`` times a source's size is shared out again by weight
    until no target is above; each round is one aggregate over the sources."""
    ranked = running_totals(sizes.withColumn("_one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"rank": "_one", "base": "source_size"}, "sources").drop("_one")
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = stored(ranked.withColumn("weight", F.element_at(weights, (F.pmod("rank", F.lit(len(WEIGHTS))) + 1).cast("int"))), "ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, level = total * SHARE[0] / SHARE[1], 0.0
    capped, free = 0, ranked.agg(F.sum("weight")).first()[0] or 0
    while free:
        level = (share - capped) / free
        above = F.col("weight") * level > MOST * F.col("source_size")
        now = ranked.agg(F.sum(F.when(above, MOST * F.col("source_size"))).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        if (now["capped"] or 0) == capped and (now["free"] or 0) == free:
            break
        capped, free = now["capped"] or 0, now["free"] or 0
    most = (MOST * F.col("source_size")).cast("double")
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), most) if free else most)


def _owner(positions: DataFrame, at: str, owners: DataFrame, first: str, n: str, width: int) -> DataFrame:
    """Join each position with the owner of [first, first + n) that holds it.

    Both sides meet in strips of ``width`` positions, so this is an equi-join
    whose strips are as even as the positions."""
    strip = owners.filter(F.col(n) > 0).withColumn("_strip", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor((F.col(first) + F.col(n) - 1) / width))))
    hit = positions.withColumn("_strip", F.floor(F.col(at) / width)).join(strip, "_strip")
    return hit.filter((F.col(at) >= F.col(first)) & (F.col(at) < F.col(first) + F.col(n))).drop("_strip")


def plan(sources: DataFrame) -> DataFrame:
    """Slots of the mix: shard, slot, source key ``base``, and the block and
    words that the slot takes.  ``sources``: base (distinct), source_size, target."""
    spark = sources.sparkSession
    s = sources.filter("source_size > 0").select(
        F.col("base"), F.col("source_size"), F.round("target").cast("long").alias("words"), F.ceil(F.col("source_size") / BLOCK).alias("blocks")
    )
    # whole passes over the source, then as many blocks as the rest needs
    s = s.withColumn("passes", F.floor(F.col("words") / F.col("source_size")))
    s = s.withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil((F.col("words") - F.col("passes") * F.col("source_size")) / BLOCK))
    s = running_totals(s, [F.col("base")], {"first": "quota"}, "quotas")
    s = stored(s, "quota")
    slots = s.agg(F.sum("quota")).first()[0] or 0
    shards = -(-slots // SLOTS)
    width = max(1, min(4096, slots // (4 * shuffle_parts(spark)) + 1))
    # the multinomial draws: each slot draws a source with a chance by quota
    draws = spark.range(slots).select(F.floor(F.col("id") / SLOTS).alias("shard"), F.pmod(F.xxhash64(F.lit(SEED), F.col("id")), F.lit(max(1, slots))).alias("_at"))
    counts = _owner(draws, "_at", s.select("base", "first", "quota"), "first", "quota", width).groupBy("base", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(running_totals(counts, [F.col("base"), F.col("shard")], {"_run": "n"}, "counts"), "drawn")
    begin = counts.groupBy("base").agg(F.min("_run").alias("_begin"), F.sum("n").alias("drawn"))
    known = s.join(begin, "base", "left").na.fill(0, ["drawn"])
    known = known.withColumns({"over": F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), "short": F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))})
    known = stored(running_totals(known, [F.col("base")], {"over_first": "over", "short_first": "short"}, "settle"), "settled")
    # a row of counts is many slots, each with a permutation to compute: dealt by an
    # explicit number, which isn't coalesced
    deal = max(shuffle_parts(spark), slots // SLOTS_A_TASK)
    drawn = counts.join(known, "base").repartition(deal, "base", "shard").withColumn("k", F.explode(F.sequence(F.col("_run") - F.col("_begin"), F.col("_run") - F.col("_begin") + F.col("n") - 1)))
    facts = ["base", "source_size", "words", "blocks", "passes", "quota"]
    kept = drawn.filter("k < quota").select("shard", *facts, "k")
    spare = drawn.filter("k >= quota").select("shard", (F.col("over_first") + F.col("k") - F.col("quota")).alias("_at"))
    filled = _owner(spare, "_at", known.select(*facts, "drawn", "short", "short_first"), "short_first", "short", width)
    filled = filled.select("shard", *facts, (F.col("drawn") + F.col("_at") - F.col("short_first")).alias("k"))
    out = kept.union(filled).withColumns({"pass": F.floor(F.col("k") / F.col("blocks")), "i": F.pmod("k", "blocks")})
    # the short last block stays at the last place of each pass
    full = F.floor(F.col("source_size") / BLOCK)
    key = F.xxhash64("base", "pass")
    out = out.withColumn("block", F.when(F.col("i") < full, permuted(F.col("i"), full, key)).otherwise(F.col("i")))
    length = F.least(F.lit(BLOCK), F.col("source_size") - F.col("block") * BLOCK)
    rest = F.col("words") - F.col("passes") * F.col("source_size") - F.col("i") * BLOCK
    return out.select("shard", "base", "pass", "block", F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, rest)).cast("long").alias("length"))


def sized(docs: DataFrame, text: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, source, size) of each document, with the whole row if ``carry``."""
    columns = [F.col("doc_id"), F.col("source"), word_count(F.col(text)).alias("size")]
    return docs.select(*columns, *[F.struct("*").alias("row")] * carry)


def placed(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in the run of all words by source and the
    target of their source, and the sources.  ``base`` is the place where a
    source begins and serves as its key."""
    sizes = running_totals(sizes, [F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("size")], {"place": "size"}, "placed")
    sizes = stored(sizes, "places")
    sources = stored(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    facts = sources.select(F.col("source").alias("_source"), "base", "source_size", "target")
    return sizes.join(facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), sources


def pieces(docs: DataFrame, slots: DataFrame) -> DataFrame:
    """The runs of each document's words that the mix takes, by joining blocks
    by index: place, pass, block, from and to (words of the document).
    ``docs``: base, place, size; ``slots``: as ``plan`` gives."""
    at = F.col("place") - F.col("base")
    docs = docs.select("base", "place", "size").filter("size > 0")
    cut = docs.withColumn("block", F.explode(F.sequence(F.floor(at / BLOCK), F.floor((at + F.col("size") - 1) / BLOCK))))
    hit = cut.join(slots.select("base", "block", "pass", "shard", "length"), ["base", "block"])
    start = F.greatest(F.col("block") * BLOCK - at, F.lit(0))
    stop = F.least(F.col("block") * BLOCK + F.col("length") - at, F.col("size"))
    return hit.withColumns({"from": start, "to": stop}).filter(F.col("to") > F.col("from"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass over a source a row for each document
    of which words are taken, with those words as its text (and ``n_chars`` set
    to its length, if there is such a column); all other columns as they came."""
    names = docs.columns
    found, sources = placed(sized(docs, carry=True))
    taken = pieces(found, plan(sources)).groupBy("place", "pass").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))
    rows = found.filter("size > 0").select("place", "row").join(taken, "place")
    # a word with the white space behind it, so that runs join to the text as it was
    words = F.regexp_extract_all(F.regexp_replace(F.col("row.text"), r"^[\x20\x09-\x0D]+", ""), F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    # bound to a lambda variable, the words are found once a row and not once a run
    part = lambda w, r: F.array_join(F.slice(w, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")), "")
    rows = rows.withColumn("mixed", F.array_join(F.transform(F.array(words), lambda w: F.array_join(F.transform("runs", lambda r: part(w, r)), "")), ""))
    new = {"text": F.col("mixed")} | ({"n_chars": F.length("mixed").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in names])


def op1_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, sources = placed(sized(table(spark, sf_dir, "documents")))
    docs = stored(docs, "with-targets")
    taken = pieces(docs, plan(sources)).groupBy("place").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    # documents without words share a place with the next one, so they stay apart
    found = docs.filter("size > 0").join(taken, "place", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return found.union(docs.filter("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long")))
