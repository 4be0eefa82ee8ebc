"""A small corpus with every hard case: nulls, empty and long texts, ties, repeated rows, copies."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = ["key", "id", "k", "rn", "before", "size", "row", "tid", "label", "shard", "tox_score", "n_bytes", "kept", "mix_taken"]


def corpus(seed=7, n=60):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "DELTA.", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "日本", "mu", "nu", "xi"]
    text = lambda k: " ".join(rng.choice(words) + (str(rng.randrange(50)) if rng.random() < 0.5 else "") for _ in range(k))
    passage = text(60)
    rows = [(i, text(rng.choice([1, 3, 5, 30, 80])), "en", f"src{i % 4}", 0) for i in range(n)]
    base = text(120)
    for i in range(n, n + 6):  # near copies
        parts = base.split(" ")
        parts[rng.randrange(len(parts))] = "changed"
        rows.append((i, " ".join(parts), "en", "src0", 0))
    rows += [(n + 6, base, "en", "src0", 0), (n + 7, base, "en", "src1", 0), (n + 8, base.upper(), "en", None, 0)]
    rows += [(n + 9, text(20) + " " + passage + " " + text(5), "en", "src1", 0), (n + 10, passage + "\n" + text(40), "en", "src2", 0), (n + 11, passage, "en", "src2", 0)]
    rows += [(n + 12, None, "en", "src3", None), (n + 13, "", None, None, 0), (n + 14, " \t\n ", "en", "src3", 3), (n + 15, "a" * 5000, "en", "src3", 5000), (n + 16, text(3000), "en", "src3", 0)]
    rows += [(3, rows[3][1], "en", "src3", 0), (3, rows[3][1], "en", "src3", 0), (None, text(12), "en", "src1", 0), (5, text(9), "en", "src1", 0)]
    return rows


def frame(spark, rows=None, clashing=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)
    return df.select("*", *[F.lit(c).alias(c) for c in CLASHING]) if clashing else df
