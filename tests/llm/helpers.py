"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing names."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["the", "und", "été", "niño", "run", "a", "zeta", "ÄÖ", "word,", "x" * 40, "日本語"]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 8, 30, 200]))]
        text = rng.choice([" ", "  ", "\n", "\t "]).join(words)
        out.append((i * 7, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", None]), len(text)))
    out.append((1, None, None, None, None))
    out.append((2, "", "en", "s1", 0))
    out.append((3, " \n ", "en", "s1", 3))
    out.append((None, "the und run", "en", "s1", 11))
    out.extend([(5000, "same text here", "en", "s1", 14)] * 3)
    out.append((4999, "same  text\nhere", "de", "s2", 15))
    out.append((6000, " ".join(rng.choice(vocabulary) for _ in range(30_000)), "en", "s1", 1))
    return out


def frame(spark, data=None, clash=True):
    """``data`` as documents, with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, DOC_SCHEMA)
    if clash:
        for name in ("key", "fp", "size", "rank", "src", "node", "row_no", "kept", "score", "shard"):
            df = df.withColumn(name, F.lit("x"))
    return df
