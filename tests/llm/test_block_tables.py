import hashlib

import numpy as np
from llm_helpers import frame, odd_texts, prose

from tillwatch.llm import block_tables as op
from tillwatch.llm.block_tables import close_pairs, count_close, document_fingerprints

NAMES = ["n_chars", "edited_sha256", "near_edited", "near_next"]


def test_rows_equal_brute_force(spark, rng):
    texts = odd_texts(rng) + [prose(rng, rng.randint(1, 60)) for _ in range(60)]
    docs = frame(spark, texts).repartition(7)
    got = {r["doc_id"]: r for r in document_fingerprints(docs).collect()}
    assert set(got) == set(range(len(texts)))
    like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
    for i, text in enumerate(texts):
        text, after = text or "", texts[i - 1] or ""
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        r, following = got[i], got[(i - 1) % len(texts)]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_next"] == like(r["fingerprint"], following["fingerprint"])
        assert r["near_edited"] == like(r["fingerprint"], r["edited_fingerprint"])
    assert got[6]["fingerprint"] == got[7]["fingerprint"] and got[0]["fingerprint"] == "0" * 16
    prints = sorted({int(r["fingerprint"], 16) for r in got.values()})
    for r in got.values():
        own = int(r["fingerprint"], 16)
        assert r["n_near"] == sum((own ^ p).bit_count() <= 3 for p in prints) - 1


def test_likeness_tells_edits_from_strangers(spark):
    rows = document_fingerprints(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).filter("n_chars > 300").collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.95


def test_search_counts_every_pair_once(spark, monkeypatch):
    """Balls of near fingerprints, keys shared by very many of them, and strangers."""
    rng = np.random.default_rng(4)
    prints = [int(x) for x in rng.integers(0, 2**63, 200)]
    for centre in prints[:3]:
        for _ in range(150):
            p = centre
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                p ^= 1 << int(b)
            prints.append(p)
    own = np.unique(np.array(prints, np.uint64))
    frame = spark.createDataFrame([(int(p),) for p in own.view(np.int64)], "fp long").repartition(5)
    for radius in (0, 2, 3):
        want = {int(p): int((np.bitwise_count(own ^ p) <= radius).sum()) - 1 for p in own}
        for hot in (1024, 8):
            monkeypatch.setattr(op, "_PAIRS", hot)
            got = {int(np.int64(r["fp"]).view(np.uint64)): r["n_near"] for r in count_close(frame, radius, hot).collect()}
            assert got == {p: n for p, n in want.items() if n}
            pairs = [(r["fp"], r["other"], r["distance"]) for r in close_pairs(frame, radius, hot).collect()]
            assert len(set(pairs)) == len(pairs) == sum(want.values()) // 2
            assert all(a < b and ((a ^ b) & (2**64 - 1)).bit_count() == d <= radius for a, b, d in pairs)


def test_repeated_ids_null_ids_and_empty_tables(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "zz yy xx ww vv uu"), (-3, "q"), (2**60, "r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = document_fingerprints(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(i), len(t)) for i, t in rows)
    assert document_fingerprints(docs.limit(0)).count() == 0
    alone = document_fingerprints(docs.limit(1)).first()
    assert alone["near_next"] == 1.0
