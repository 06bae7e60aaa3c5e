import hashlib
import random
import re
import time

import numpy as np
from llm_helpers import SF, frame, odd_texts, prose
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tillwatch.llm.personal_data import KINDS, LABELERS, base_spans, chosen, further_spans, learn, luhn, personal_data, reliabilities, votes

NAIVE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits):
    double = [int(c) * (1 + (i % 2)) for i, c in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in double) % 10 == 0


def accepted(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and checksum(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def naive(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(NAIVE[k], text or "") if accepted(k, m[0])]


def shown(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def card(rng, n=16):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(digits + c for c in "0123456789" if checksum(digits + c))


def personal(rng):
    return rng.choice([
        lambda: f"{rng.choice('abcxyz')}n.{rng.randint(1, 99)}@mail{rng.randint(0, 9)}.example.com",
        lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        lambda: card(rng, rng.choice([16, 16, 19])),
        lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
    ])()


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    pieces = ["@", ".", "-", "+", " ", "(", ")", "1", "25", "255", "256", "0000", "4111111111111111", "ab", "é", "%", "x.y", "007", "日", "\n", "+1 "]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))
        assert base_spans(text) == naive(text), text
    assert all(luhn(d) == checksum(d) for d in ("0", "4111111111111111", "4111111111111112", "79927398713"))


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    for run in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "1 " * 200_000, "+1" + " " * 400_000, "@" * 200_000, "a@" * 200_000, "1:" * 200_000,
                " at " * 100_000, "a.b-" * 100_000 + " at x", "0" * 5000 + ".1.1.1", "1111-" * 80_000):
        base = base_spans(run)
        assert all(s < e for _, s, e in further_spans(run, base))
    assert time.perf_counter() - began < 30


def test_em_finds_reliabilities_without_labels():
    """Simulated votes: a labeler that is right nine times in ten, and one that only guesses."""
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.3
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.5])
    cast = np.where(rng.random((20_000, len(LABELERS))) < right, truth[:, None], ~truth[:, None])
    seen, index, counts = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    names = ["".join("+" if v else "-" for v in row) for row in seen]
    rates, likely = reliabilities(names, counts.astype(float))
    assert np.abs(rates[1, :, 2] - right).max() < 0.06 and np.abs(rates[0, :, 0] - right).max() < 0.06
    assert ((likely[index.ravel()] > 0.5) == truth).mean() > 0.97


def test_finds_disguised_data_and_leaves_clean_texts(spark):
    rng = random.Random(4)
    hidden = [
        lambda: f"mail me: {rng.choice('abc')}nn.smith [at] mail{rng.randint(0, 9)}.example [dot] com",
        lambda: f"pay by card {'.'.join(re.findall('....', card(rng)))} today",
        lambda: f"server at {'[.]'.join(str(rng.randint(11, 250)) for _ in range(4))} is down",
    ]
    decoys = [
        lambda: f"version {rng.randint(300, 999)}.{rng.randint(300, 999)}.{rng.randint(300, 999)}.{rng.randint(300, 999)} is out",
        lambda: f"order id_{rng.randint(10**15, 10**16)}x was sent",
        lambda: "look at example and at home",
        lambda: f"the year {rng.randint(1900, 2020)} and {rng.randint(1, 9)},500 people",
    ]
    texts, kind = [], []
    for k in range(600):
        part = [personal(rng), hidden[k % 3](), decoys[k % 4](), ""][k % 4] if k % 4 != 3 else ""
        texts.append(f"{prose(rng, 8)} {part} {prose(rng, 5)}")
        kind.append(["base", "hidden", "decoy", "clean"][k % 4])
    got = {r["doc_id"]: r for r in personal_data(frame(spark, texts)).collect()}
    found = {k: np.mean([bool(got[i]["spans"]) for i in range(600) if kind[i] == k]) for k in set(kind)}
    assert found["base"] == 1 and found["hidden"] > 0.9 and found["decoy"] < 0.02 and found["clean"] == 0
    for i, text in enumerate(texts):
        base = naive(text)
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]
        assert got[i]["base_sha256"] == hashlib.sha256(shown(base).encode()).hexdigest()
        assert {shown([s]) for s in base} <= set(got[i]["spans"].split(","))


def test_odd_rows(spark, rng):
    texts = odd_texts(rng) + ["é" * 10 + " a@b.cd +12 345 6789", "a@b.c " * 3000, "a@b.c " * 3000]
    df = frame(spark, texts).withColumns({n: F.lit("x") for n in ("spans", "found", "votes", "n_email")})
    df = df.unionByName(df.filter("doc_id > 10")).unionByName(df.filter("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long")))
    got = personal_data(df.repartition(3)).collect()
    assert len(got) == len(texts) + 5
    for r in got:
        base = naive(texts[12 if r["doc_id"] is None else r["doc_id"]])
        assert r["spans"] == shown(base) and r["n_email"] == sum(k == "email" for k, _, _ in base)
    assert personal_data(df.limit(0)).count() == 0 and learn([]) == {}


def test_votes_and_overlaps():
    text = "call 0044 20 7946 0958 or 1.2.3.4"
    base = base_spans(text)
    assert base == [("ip", 26, 33)]
    assert further_spans(text, base) == [("card", 5, 22), ("phone", 5, 22)]
    assert votes(text, "phone", 5, 22, False)[3] == "+" and votes(text, "card", 5, 22, False)[1] == "-"
    assert chosen([(("card", 5, 22), 0.2), (("phone", 5, 22), 0.9), (("ip", 20, 30), 1.0)]) == [("phone", 5, 22)]
    assert further_spans("x@y.zw", base_spans("x@y.zw")) == []
    assert ("card", 5, 21) in further_spans("2024 4111111111111111", [])
    assert ("phone", 0, 17) in further_spans("+1 (826) 555-4081 190.137.223.204", [("ip", 18, 33)])


def test_query_on_the_test_table(spark):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = contract.queries()["op12_personal_data"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        base = naive(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(shown(base).encode()).hexdigest()
        assert bool(base) == bool(r["spans"])
