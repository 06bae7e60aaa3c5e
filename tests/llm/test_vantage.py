import re

import numpy as np
import xxhash
from llm_helpers import frame, odd_texts, prose
from pyspark.sql import functions as F

from tillwatch.llm.graph import components
from tillwatch.llm.vantage import keep_first, near_duplicates, near_links

LOWER = {i: i + 32 for i in range(65, 91)}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius):
    """Smallest index reachable, by plain search over all pairs."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, p in enumerate(prints):
            for j, q in enumerate(prints):
                if (p ^ q).bit_count() <= radius and label[j] > label[i]:
                    label[j], changed = label[i], True
    return label


def test_equals_brute_force(spark, rng):
    texts = odd_texts(rng)
    for _ in range(25):
        words = prose(rng, rng.randint(1, 80)).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    got = {r["doc_id"]: r for r in near_duplicates(frame(spark, texts)).collect()}
    prints = [fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == groups(prints, 2)
    kept = keep_first(frame(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups(prints, 2)))
    assert kept.columns == frame(spark, texts).columns


def test_links_over_many_shards(spark):
    """Small leaves, so that links cross shards; near copies in chains and dense balls."""
    rng = np.random.default_rng(3)
    prints = [int(x) for x in rng.integers(0, 2**63, 500)]
    for _ in range(500):
        p = prints[int(rng.integers(len(prints)))]
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            p ^= 1 << int(b)
        prints.append(p)
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, leaf=32)
    root = {r["node"]: r["root"] for r in components(links).collect()}
    label = groups(prints, 2)
    same = {}
    for p, l in zip(signed, label):
        assert same.setdefault(l, root.get(p, p)) == root.get(p, p)
    assert len(set(same.values())) == len(same)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (5, "other words entirely here"), (None, "a b c d"), (None, "alone in null land")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_duplicates(docs).count() == 5
    kept = sorted(((r["doc_id"], r["text"]) for r in keep_first(docs).collect()), key=str)
    assert kept == sorted([(5, "a b c d"), (5, "other words entirely here"), (None, "alone in null land")], key=str)
    assert keep_first(docs.limit(0)).count() == 0
    assert near_duplicates(docs.limit(0).withColumn("fp", F.lit(1))).count() == 0
