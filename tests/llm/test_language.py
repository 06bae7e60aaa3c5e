import zlib
from collections import Counter, defaultdict

from llm_helpers import frame, odd_texts
from pyspark.sql import functions as F

from tillwatch.llm.language import RANKS, count_grams, identify, keep_known

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog while the other foxes watch from the hill",
    "de": "der schnelle braune fuchs springt über den faulen hund während die anderen zusehen",
    "es": "el zorro marrón salta sobre el perro perezoso mientras los otros miran desde la colina",
}


def grams(text):
    """The definition, character by character."""
    out, words, word = Counter(), [], ""
    for c in text.lower():
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    for w in [*words, word] if word else words:
        edged = "\1" + w + "\1"
        out.update(w)
        out.update(edged[i : i + 2] for i in range(len(edged) - 1))
        out.update(edged[i : i + 3] for i in range(len(edged) - 2))
    return out


def name(gram):
    points = [(gram >> s) & (2**21 - 1) for s in (42, 21, 0)]
    return "".join("\1" if p == 1 else chr(p) for p in points if p)


def test_grams_are_those_of_the_definition():
    texts = ["Hello, World!", "", "a", "!!", "ñandú 日本", "x1y", "ends with edge "]
    doc, gram, n = count_grams(texts)
    got = defaultdict(Counter)
    for d, g, k in zip(doc.tolist(), gram.tolist(), n.tolist()):
        got[d][name(g)] += k
    for i, t in enumerate(texts):
        assert got[i] == grams(t), t


def brute(rows):
    """Out-of-place distances with dictionaries."""
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], [ord(ch) for ch in x[0].rjust(3, "\0")]))][:RANKS]
    total = defaultdict(Counter)
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and text is not None:
            total[lang] += grams(text)
    profiles = {lang: {g: k for k, g in enumerate(order(c))} for lang, c in total.items() if c}
    out = {}
    for i, text, _ in rows:
        own = order(grams(text or ""))
        if not own or not profiles:
            out[i] = ("und", 0.0)
            continue
        apart = {l: sum(abs(p[g] - k) if g in p else RANKS for k, g in enumerate(own)) for l, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        out[i] = (best, 1 - apart[best] / (len(own) * RANKS))
    return out


def test_predictions_equal_brute_force(spark, rng):
    rows = []
    for k in range(40):
        lang = rng.choice(list(TEXTS))
        words = TEXTS[lang].split()
        rows.append((k, " ".join(rng.choices(words, k=rng.randint(1, 60))), rng.choice([lang, lang, lang, None])))
    rows += [(50, None, "en"), (51, "", "en"), (52, "123 !!", "de"), (53, "the the the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    for i, (lang, score) in brute(rows).items():
        assert (got[i]["lang_pred"], got[i]["held_out"]) == (lang, zlib.crc32(str(i).encode()) % 4 == 2)
        assert abs(got[i]["score"] - score) < 1e-12


def test_odd_rows_and_empty_tables(spark, rng):
    docs = frame(spark, odd_texts(rng), lang="en")
    assert identify(docs).count() == docs.count()
    kept = keep_known(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, 8, 9, 10, 11}
    assert identify(docs.limit(0)).count() == 0
    unlabelled = frame(spark, odd_texts(rng)).withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in identify(unlabelled).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right = found.filter("lang = lang_pred").count()
    assert right / found.count() > 0.98
