import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import frame, odd_texts, prose

from tillwatch.llm.attention import Attention
from tillwatch.llm.lm_scoring import piece_classes, score_documents

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SMALL = {"documents": 50, "epochs": 1}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) + ["\0end"]


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def check(texts, got):
    counts = Counter(w for i, t in enumerate(texts) if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    for i, text in enumerate(texts):
        own, r = words(text), got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(i), len(own), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert r["score"] < 0
        if all(counts[w] for w in own):
            assert r["base_score"] - 0.302 * len(own) < r["score"]  # the mean keeps half of the base estimate


def test_base_equals_brute_force(spark, rng):
    texts = odd_texts(rng) + [prose(rng, rng.randint(0, 80)) for _ in range(60)]
    for frequent in (100_000, 5):  # all words broadcast; nearly all words joined
        rows = score_documents(frame(spark, texts).repartition(3), MODEL, frequent=frequent, **SMALL).collect()
        assert len(rows) == len(texts)
        check(texts, {r["doc_id"]: r for r in rows})


def test_score_does_not_depend_on_the_way_of_a_word(spark, rng):
    docs = frame(spark, [prose(rng, 60) for _ in range(30)])
    a, b = ({r["doc_id"]: r["score"] for r in score_documents(docs, MODEL, frequent=f, **SMALL).collect()} for f in (100_000, 3))
    assert a == pytest.approx(b)


def test_empty_tables(spark):
    docs = frame(spark, ["a b"])
    assert score_documents(docs.limit(0), MODEL, **SMALL).count() == 0
    only_held = docs.filter("doc_id < 0").unionByName(frame(spark, ["x"] * 40).filter("doc_id in (%s)" % ",".join(str(i) for i in range(40) if held(i))))
    rows = score_documents(only_held, MODEL, **SMALL).collect()
    assert rows and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)


def test_gradients_are_those_of_the_loss():
    model = Attention(7, width=6, keys=4, hidden=5, context=6, stride=3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    rng = np.random.default_rng(1)
    symbols, bounds = rng.integers(0, 7, 23), np.array([0, 10, 10, 23])
    inputs, valid, targets, scored = model.windows(symbols, bounds)
    run = lambda: model.gradients(inputs, valid, symbols[targets], scored)
    _, g = run()
    for name, w in model.weights.items():
        for _ in range(4):
            at = tuple(int(rng.integers(k)) for k in w.shape)
            old = w[at]
            w[at] = old + 1e-5
            high = run()[0]
            w[at] = old - 1e-5
            low = run()[0]
            w[at] = old
            assert (high - low) / 2e-5 == pytest.approx(g[name][at], abs=2e-4), name


def test_every_symbol_is_scored_once_from_what_comes_before():
    model = Attention(5, context=8, stride=4)
    rng = np.random.default_rng(2)
    symbols, bounds = rng.integers(0, 5, 37), np.array([0, 1, 1, 20, 37])
    _, _, targets, scored = model.windows(symbols, bounds)
    assert sorted(targets[scored].tolist()) == list(range(37))
    before = model.score(symbols, bounds)
    changed = symbols.copy()
    changed[30] = (changed[30] + 1) % 5
    after = model.score(changed, bounds)
    assert (before[:30] == after[:30]).all() and before[30] != after[30]
    total = sum(np.exp(model.score(np.append(symbols[20:25], s), np.array([0, 6]))[-1]) for s in range(5))
    assert total == pytest.approx(1, abs=1e-5)


def test_training_lowers_the_loss_and_classes_are_distributions():
    symbols = np.tile([0, 1, 2, 3], 400)
    losses = Attention(4).fit(symbols, np.array([0, 800, 1600]), 40)
    assert losses[-1] < 0.5 < losses[0]
    counts = np.random.default_rng(0).integers(0, 50, 300).astype(float)
    of, share = piece_classes(counts, 64, 16, end=299)
    assert np.allclose(np.bincount(of, np.exp(share)), 1) and (of == of[299]).sum() == 1


def test_windows_come_from_all_over_the_texts(spark, rng):
    """Not from prefixes, not whole groups of copies, and more of them from more input."""
    from tillwatch.llm.lm_scoring import FIT_WORDS, Speller, drawn_windows

    with open(MODEL, "rb") as f:
        speller = Speller(f.read())
    of = np.arange(speller.end + 1)
    marks = [" ".join([w] * FIT_WORDS) for w in ("first", "second", "third")]
    docs = frame(spark, [" ".join(marks)] * 400).select("doc_id", "text")
    spelled = [speller.spell(pa.array([w]))[0].tolist() for w in ("first", "second", "third")]
    first = [ids[0] for ids in spelled]
    rows = drawn_windows(docs, speller, of, 0.25).collect()
    met = Counter(r["symbols"][0] for r in rows)
    assert set(met) == set(first) and all(60 < c < 140 for c in met.values())
    assert all((r["symbols"][-1] == speller.end) == (r["symbols"][0] == first[2]) for r in rows)
    again = drawn_windows(docs.repartition(7), speller, of, 0.25).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert len(drawn_windows(docs.filter("doc_id < 200"), speller, of, 0.25).collect()) < 0.7 * len(rows)
    whole = drawn_windows(docs.limit(1), speller, of, 1.0).collect()
    assert sum(len(r["symbols"]) for r in whole) == 1 + sum(len(speller.own.encode(m.split()[0])) * FIT_WORDS for m in marks)


@pytest.mark.parametrize("rounds, documents, least, most", [(4, 30, 400, 400), (3, 30, 400, 400), (4, 200, 700, 900), (2, 400, 800, 800)])
def test_the_rounds_go_through_every_window(spark, monkeypatch, rounds, documents, least, most):
    """In a large corpus each window once in all, in a small one in every round."""
    from tillwatch.llm import lm_scoring
    from tillwatch.llm.lm_scoring import Speller, fit_network

    added, gone = lm_scoring._added, []
    monkeypatch.setattr(lm_scoring, "_added", lambda parts: (gone.append(sum(n for n, _ in parts)), added(parts))[1])
    with open(MODEL, "rb") as f:
        speller = Speller(f.read())
    docs = frame(spark, [f"a{n} " * (n % 7 + 1) for n in range(400)]).select("doc_id", "text")
    fit_network(docs, speller, np.arange(speller.end + 1) % 11, 400, documents=documents, rounds=rounds, part=50)
    assert len(gone) == rounds and min(gone) > 0 and least <= sum(gone) <= most


def test_fit_in_groups_learns(spark, rng):
    from tillwatch.llm.lm_scoring import Speller, fit_network

    with open(MODEL, "rb") as f:
        speller = Speller(f.read())
    of = np.minimum(np.arange(speller.end + 1), 40)
    docs = frame(spark, ["a b c d " * 40 for _ in range(60)]).select("doc_id", "text")
    symbols = of[speller.spell(pa.array(list("abcd" * 20)))[0]]
    untrained = Attention(41).score(symbols, np.array([0, len(symbols)])).mean()
    model = fit_network(docs, speller, of, 120, documents=120, rounds=2, part=30)
    assert model.score(symbols, np.array([0, len(symbols)])).mean() > untrained + 0.5


def test_spellings_are_a_prefix_code():
    """No word's symbols begin with another word's, and every word has some."""
    from tillwatch.llm.lm_scoring import Speller

    with open(MODEL, "rb") as f:
        speller = Speller(f.read())
    flat, n = speller.spell(pa.array(["the", "theq", "thequick", "\u00ad", "the", "x", "xx"]))
    assert (n > 0).all()
    words = [tuple(w) for w in np.split(flat, np.cumsum(n)[:-1])]
    assert words[0] == words[4]
    for a in set(words):
        assert not any(a != b and b[: len(a)] == a for b in set(words))
        assert [x >= speller.end // 2 for x in a] == [False] * (len(a) - 1) + [True]


def test_symbol_strings_up_to_any_length_share_the_whole_mass():
    """Words ended so far and open beginnings sum to 1: with three inner and three ending symbols and an end."""
    model, ending = Attention(7, context=8, stride=4), {3, 4, 5, 6}
    open_ones, done = [((), 0.0)], 0.0
    for _ in range(3):
        longer = []
        for string, log in open_ones:
            for s in range(7):
                own = log + model.score(np.array([*string, s]), np.array([0, len(string) + 1]))[-1]
                if s in ending:
                    done += math.exp(own)
                else:
                    longer.append(((*string, s), own))
        open_ones = longer
    assert done + sum(math.exp(log) for _, log in open_ones) == pytest.approx(1, abs=1e-4)


def test_scores_of_all_texts_sum_to_at_most_one(spark, rng):
    """Every text of up to three words, among them beginnings of each other and a word that training texts lack."""
    from itertools import product

    kinds = ["the", "theq", "a", "thequ"]
    texts = [" ".join(t) for n in range(4) for t in product(kinds, repeat=n)]
    at = [i for i in range(5000) if held(i)][: len(texts)]
    train = [(i, " ".join(rng.choice(kinds[:3]) for _ in range(rng.choice([0, 1, 1, 2, 3])))) for i in range(400) if not held(i)]
    docs = spark.createDataFrame(train + list(zip(at, texts)), "doc_id long, text string")
    for frequent in (100_000, 1):
        got = {r["doc_id"]: r["score"] for r in score_documents(docs, MODEL, frequent=frequent, documents=400, epochs=2).collect()}
        mass = sum(10 ** got[i] for i in at)
        assert 0.3 < mass <= 1 + 1e-9
        one_known = sum(10 ** got[i] for i, t in zip(at, texts) if "thequ" not in t.split())
        assert one_known < mass


def test_scores_are_those_of_the_forward_pass():
    """Overlapping views over laid-out texts give what plain windows give, for texts of any length."""
    rng = np.random.default_rng(8)
    for sizes in ({}, {"context": 8, "stride": 4}, {"context": 9, "stride": 2}):
        model = Attention(21, **sizes)
        model.weights = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32) if k != "out0" else v for k, v in model.weights.items()}
        symbols, bounds = rng.integers(0, 21, 300), np.array([0, 1, 1, 1, 60, 80, 100, 141, 300])
        inputs, valid, targets, scored = model.windows(symbols, bounds)
        top, place = model.forward(inputs, valid)["top"][scored], targets[scored]
        group, member = np.divmod(symbols[place], model.members)
        w = model.weights
        soft = lambda z: z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        first = soft(top @ w["group"] + w["group0"])[np.arange(len(place)), group]
        inner = (top @ w["out"] + w["out0"]).reshape(len(place), model.groups, -1)[np.arange(len(place)), group]
        want = np.zeros(300)
        want[place] = first + soft(inner)[np.arange(len(place)), member]
        for batch in (1, 7, 512):
            assert np.allclose(model.score(symbols, bounds, batch), want, atol=1e-4)
    assert len(model.score(np.zeros(0, np.int64), np.array([0, 0]))) == 0


def test_gradients_are_summed_by_symbol():
    rng, model = np.random.default_rng(5), Attention(9, width=6, keys=3, hidden=5, context=6, stride=4)
    inputs, a, b = rng.integers(0, 8, (7, 6)), rng.standard_normal((7, 6, 3)), rng.standard_normal((7, 6, 2))
    for n in (7, 0):
        for got, given in zip(model._by_symbol(inputs[:n], a[:n], b[:n]), (a[:n], b[:n])):
            want = np.zeros((10, given.shape[2]))
            np.add.at(want, inputs[:n].ravel(), given.reshape(-1, given.shape[2]))
            assert np.allclose(got, want)


def test_fit_moves_the_weights_as_adam_does_for_each_of_them():
    rng, sizes = np.random.default_rng(6), dict(width=6, keys=3, hidden=5, context=6, stride=4)
    symbols, bounds = rng.integers(0, 9, 60), np.array([0, 25, 60])
    model, plain = Attention(9, **sizes), Attention(9, **sizes)
    inputs, valid, targets, scored = plain.windows(symbols, bounds)
    order, rate = np.random.default_rng(7).permutation(len(inputs)), 4e-3
    _, g = plain.gradients(inputs[order], valid[order], symbols[targets[order]], scored[order])
    model.fit(symbols, bounds, 1, batch=len(inputs), rate=rate)
    assert {k: v.shape for k, v in model.weights.items()} == {k: v.shape for k, v in plain.weights.items()}
    for k, d in g.items():
        step = rate * (1 - 1 / 2 + 0.02) * d / (np.abs(d) + 1e-8)
        assert np.allclose(model.weights[k], plain.weights[k] - step, atol=1e-5), k
