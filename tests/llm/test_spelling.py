import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_helpers import SF, frame, odd_texts
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tillwatch.llm.spelling import neighbour_keys, reduced_keys, spelling_groups, symbols_for

LOWER = {i: i + 32 for i in range(65, 91)}


def counts(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def edits(word, letters):
    """All strings one deletion, replacement or insertion away."""
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def brute(rows):
    n = counts(rows)
    letters = set("".join(n))
    form, near = {}, {}
    for w in n:
        close = edits(w, letters) & n.keys() if len(w) < 100 else {v for v in n if v != w and abs(len(v) - len(w)) < 2 and w[:50] == v[:50]}
        near[w] = len(close)
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    found = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        found.add((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return found


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_neighbourhoods_are_whole_and_without_repeats():
    for symbols in (2, 3, 5):
        words = pa.array(["abcdefg", "aaaaaaa", "zyxzyxzyxz", "étéñÿÀæ"])
        row, key = neighbour_keys(words, symbols)
        letters = [chr(97 + s) for s in range(symbols)]
        for i, w in enumerate(words.to_pylist()):
            plain = "".join(next(c for c in letters if ord(c) % symbols == ord(x) % symbols) for x in w)
            expected = reduced_keys(pa.array(sorted(edits(plain, letters) | {plain})), symbols)
            assert sorted(key[row == i].tolist()) == sorted(set(expected.tolist()))
            assert reduced_keys(pa.array([plain]), symbols)[0] == reduced_keys(words, symbols)[i]


def test_equals_brute_force(spark, rng):
    base = ["between", "mountain", "éléphant", "abababab", "zzzzzzzz", "Éléphant", "verylongword" * 3]
    texts = odd_texts(rng) + ["x" * 5000 + "y", "x" * 5000 + "y"]
    for k in range(120):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(base[: 1 + k % len(base)])
            if rng.random() < 0.15:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(["", "q", "ÿ", w[i] * 2]) + w[i + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append(rng.choice([" ", ", ", "1", "\n"]).join(words))
    df = frame(spark, texts)
    rows = list(enumerate(texts))
    expected = brute(rows)
    assert rows_of(spelling_groups(df)) == expected
    assert any(r[1] and r[1] != r[2] for r in expected) or any(r[1] for r in expected)
    assert rows_of(spelling_groups(df.unionByName(df.limit(0)).repartition(5))) == expected
    assert spelling_groups(df.limit(0)).count() == 0


def test_chains_ties_null_and_repeated_ids(spark):
    words = ["chaining"] * 1200 + ["chainingx"] * 110 + ["chainingxy"] * 11 + ["chainingxyz"]
    words += ["tiedwora"] * 40 + ["tiedworb"] * 40 + ["tiedworc"] * 3
    rows = [(None if i % 3 else 7, w) for i, w in enumerate(words)] + [(None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x"))
    got = rows_of(spelling_groups(df))
    assert got == brute(rows)


def test_alphabet_follows_the_vocabulary():
    sizes = [symbols_for(n) for n in (0, 1000, 10**6, 10**9, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] == 4 and sizes[-1] < 30
    assert np.all(np.diff(sizes[2:]) > 0)


def test_query_on_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(contract.queries()["op11_spelling_variants"](spark, SF)) == brute([(r[0], r[1]) for r in docs])
