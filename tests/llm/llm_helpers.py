"""Rows that the tests of the text operators share."""

from pyspark.sql import functions as F

WORDS = "the of and river stone light over under quick brown lazy dog fox jumps water tree house red blue green day night".split()
SF = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed"]) for _ in range(n))


def frame(spark, texts, **more):
    """(doc_id, text) rows with further columns whose names operators might use themselves."""
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["fp", "key", "word", "n", "row", "part", "found", "_found", "score", "fingerprint", "component_id", "path", "host"]
    return df.withColumns({n: F.lit("x") for n in names if n not in more} | {n: F.lit(v) for n, v in more.items()})


def odd_texts(rng):
    """Null, empty, blank, wordless, one word, repeated and long texts."""
    long = prose(rng, 4000)
    return [None, "", "   \n\t ", "!!! ...", "one", "Two words", long, long, prose(rng, 50), "x" * 5000, "日本語 текст ñ", "one"]
