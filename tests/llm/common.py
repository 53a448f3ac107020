"""Small documents that hold the odd cases, and the given small tables."""

import random

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, h long"


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "re", "on", "ti", "es", "ou"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and long texts, ties, equal texts, columns whose names the operators use themselves."""
    line = "This line of well over forty characters is in many documents."
    rows = [(i, prose(i) + "\n" + line, "en", "s", 1, 0.5, "x", 7) for i in range(1, 8)]
    rows += [(8, None, None, None, None, None, None, None), (9, "", "en", "s", 0, 0.0, "", 0), (10, "\n\n", "en", "s", 2, 0.0, "", 0)]
    rows += [(11, prose(1) + "\n" + line, "en", "s", 1, 0.5, "x", 7), (12, "a" * 5000, "en", "s", 5000, 0.5, "x", 7), (13, prose(99, 30_000), "en", "s", 1, 0.5, "x", 7)]
    rows += [(14, "é ß\tÄ  ñ\r\nK z <|endoftext|> \x00 \U0001f600", "en", "s", 1, 0.5, "x", 7), (None, "no id", "en", "s", 5, 0.5, "x", 7)]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def given(spark, name="documents"):
    return spark.read.parquet(f"{DATA}/{name}.parquet")
