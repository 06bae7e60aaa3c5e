import random

import numpy as np
import pytest
from llm_helpers import frame, odd_texts, prose
from pyspark.sql import functions as F

from tillwatch.llm.sentencepiece import Vocabulary, decoded, encode_documents, max_plus, with_ids

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def model():
    return Vocabulary.load(MODEL).prepare()


def best_path(model, text):
    """Plain dynamic programming over one whole text: ids and score."""
    text = model.escaped(text)
    pieces = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == 0}
    lost = min(model.scores[i] for i in pieces.values()) - 10.0
    best = [(0.0, None, None)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - model.longest), end):
            own = pieces.get(text[start:end])
            if own is not None:
                score = model.scores[own]
            elif end == start + 1:
                own, score = -1, lost
            else:
                continue
            total = best[start][0] + score
            if best[end] is None or total > best[end][0]:
                best[end] = (total, start, own)
    ids, at = [], len(text)
    while at:
        _, start, own = best[at]
        if own < 0:
            ids += [model.pieces.index(f"<0x{b:02X}>") for b in text[start:at].encode()][::-1]
        else:
            ids.append(own)
        at = start
    return ids[::-1], best[-1][0]


def hard_texts():
    rng = random.Random(2)
    return ["".join(rng.choice("abcdehorstln") for _ in range(120)) for _ in range(4)] + [
        "日本語のテキスト" * 9, "x" * 90, "-" * 133, "       " * 12, "a\n\n\nb" * 9, "🙂é" * 20, "Mixed Ünï text, 12 of it. "]


def test_whole_texts_equal_dynamic_programming(model, rng):
    for text in [*hard_texts(), prose(rng, 60), "", "a", " ", "  lead and trail  "]:
        ids, bounds, scores = model.encode([model.escaped(text)])
        want, score = best_path(model, text)
        assert ids.tolist() == want, text
        assert scores[0] == pytest.approx(score)


def test_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((5, 5)) < 0.3, -np.inf, rng.integers(-9, 9, (5, 5))) for _ in range(3))
    assert (max_plus(max_plus(a, b), c) == max_plus(a, max_plus(b, c))).all()


def test_chunked_on_spark_equals_whole(spark, model, rng):
    texts = odd_texts(rng) + hard_texts() + [prose(rng, 300)] * 3
    docs = frame(spark, texts)
    for giant, chunk, fan in ((20, 16, 2), (200, 37, 4), (65536, 16384, 256)):
        got = {r["doc_id"]: r for r in encode_documents(docs, model, giant=giant, chunk=chunk, fan=fan).collect()}
        assert set(got) == set(range(len(texts)))
        for i, text in enumerate(texts):
            ids, _, score = model.encode([model.escaped(text or "")])
            assert got[i]["ids"] == ids.tolist()
            assert got[i]["score"] == pytest.approx(score[0])
    with pytest.raises(ValueError, match="chunks"):
        encode_documents(docs, model, giant=4, chunk=4)


def test_round_trip_and_columns(spark, model, rng):
    texts = odd_texts(rng) + hard_texts()
    docs = frame(spark, texts)
    found = with_ids(docs, model, found_col="pieces", giant=100, chunk=50)
    assert found.columns == [*docs.columns, "pieces"]
    back = found.select("text", "pieces.round_trip", decoded(docs, model, F.col("pieces.ids")).alias("back")).collect()
    assert len(back) == len(texts)
    assert all(r["round_trip"] and (r["text"] or "") == r["back"] for r in back)
    whole = {r["doc_id"]: (r["ids_sha256"], r["score"]) for r in encode_documents(docs, model).collect()}
    parts = {r["doc_id"]: (r["ids_sha256"], r["score"]) for r in encode_documents(docs, model, giant=60, chunk=30).collect()}
    assert {i: h for i, (h, _) in whole.items()} == {i: h for i, (h, _) in parts.items()}
    assert encode_documents(docs.limit(0), model).count() == 0
