import random

import pytest
from llm_helpers import frame, odd_texts

from tillwatch.llm.token_counts import Counter, Tree, _read_file, apply_edits, build_trees, edit, sample_edits

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PARTS = ["a", "the", " ", "  ", "\n", " \n ", "'s", "'ll", "é", "日本", "123", " 4", "!?", "word", "'", "  x", "\t", "🙂"]


@pytest.fixture(scope="module")
def counter():
    return Counter(_read_file(RANKS))


def full(counter, text):
    return len(counter.encoding.encode_ordinary(text))


def test_edits_equal_full_encoding(counter):
    rng = random.Random(1)
    mix = lambda n: "".join(rng.choice(PARTS) for _ in range(n))
    for _ in range(600):
        text, size = mix(rng.choice([0, 1, 5, 40, 400])), rng.choice([1, 2, 4, 64])
        tree = Tree(*counter.leaves(text, size))
        for _ in range(5):
            start = rng.randint(0, len(text) + 1)
            stop = start + rng.choice([0, 0, 1, 3, 20, 300])
            insert = mix(rng.choice([0, 1, 2, 10, 200]))
            want = text[:start] + insert + text[min(stop, len(text)) :]
            tree, text, _ = edit(tree, text, start, stop, insert, counter, size)
            assert text == want and tree.tokens[1] == full(counter, text) and tree.chars[1] == len(text)


def test_a_small_edit_touches_little(counter):
    text = "some words in a row " * 5000
    tree = Tree(*counter.leaves(text))
    _, _, encoded = edit(tree, text, 50_000, 50_010, "new", counter)
    assert encoded < 2000


def test_on_spark(spark, counter, rng):
    texts = odd_texts(rng)
    docs = frame(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id = 8")).unionByName(frame(spark, ["no id"]).selectExpr(
        "CAST(NULL AS BIGINT) AS doc_id", *[c for c in docs.columns if c != "doc_id"]))
    edits = sample_edits(docs).unionByName(spark.createDataFrame(
        [(8, 3, 10, 5, None), (8, 4, 10**9, 10**9, "end"), (999, 1, 0, 0, "x"), (None, 1, 0, 0, "y")],
        "doc_id long, number int, start long, stop long, insert string"))
    edits = edits.dropDuplicates()
    got = apply_edits(docs, build_trees(docs, RANKS), edits, RANKS).collect()
    assert len(got) == docs.count()
    for r in got:
        before = "no id" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        assert r["n_tokens"] == full(counter, before)
        assert r["edited_tokens"] == full(counter, r["text"]) == r["tree_tokens"][1]
        assert r["edits"] == (0 if r["doc_id"] is None else 4 if r["doc_id"] == 8 else 2)
        assert r["doc_id"] != 8 or r["text"].endswith("end")
    none = docs.limit(0)
    assert apply_edits(none, build_trees(none, RANKS), edits, RANKS).count() == 0
