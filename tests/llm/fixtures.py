"""Small tables with the awkward cases: nulls, empty and long texts, ties,
repeated rows, copies and near copies, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(20, 160)) for _ in range(n // 2)]
    passage = words(rng, 70)
    out = []
    for i in range(n):
        t = base[i % len(base)]
        kind = i % 6
        if i >= len(base):
            w = t.split(" ")
            if kind == 0:
                pass  # a copy
            elif kind == 1:
                w[len(w) // 2] = "changed"
                t = " ".join(w)
            elif kind == 2:
                t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]
            else:
                t = words(rng, rng.randint(5, 120)) + ".\nSome line that stands here again and again.\n" + words(rng, 20)
        out.append((i, t, "en", f"s{i % 4}", len(t)))
    out.append((n, None, None, None, None))
    out.append((n + 1, "", "en", "s0", 0))
    out.append((n + 2, "  \n\t ", "en", None, 5))
    out.append((n + 3, "one two", "en", "s1", 7))
    out.append((n + 4, "é€😀 " * 50 + base[0], "fr", "s2", 0))
    out.append((n + 5, words(rng, 30_000), "en", "s9", 0))
    return out


def documents(spark, extra=False, seed=1, n=60):
    df = spark.createDataFrame(rows(seed, n), SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumn("size", F.lit("x")).withColumn("base", F.lit(1)).withColumn("cell", F.lit(2.5))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def saved(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
