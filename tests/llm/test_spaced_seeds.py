from itertools import combinations

from llm_helpers import frame, odd_texts, prose

from tillwatch.llm.spaced_seeds import MASKS, RUN, SHORT_MASK, _NOT_WORD, contaminated, item_texts, keep_clean, seed_blocks


def tokens(text):
    return [w for w in (_NOT_WORD.sub("", x.lower()) for x in (text or "").split()) if w]


def overlaps(doc, item):
    """Every alignment, token by token: the most agreeing tokens within runs that pass."""
    a, b = tokens(doc), tokens(item)
    run = min(RUN, len(b))
    need = 11 if run == RUN else run - 1 if run >= 8 else run
    best = None
    for shift in range(-len(b) + 1, len(a)):
        same = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
        inside = [0 <= k + shift < len(a) for k in range(len(b))]
        good = set()
        for k in range(len(b) - run + 1):
            if all(inside[k : k + run]) and sum(same[k : k + run]) >= need and run:
                good.update(range(k, k + run))
        n = sum(same[k] for k in good)
        if good and (best is None or n > best):
            best = n
    return best


def test_masks_find_any_two_substitutions():
    for lost in combinations(range(RUN), 2):
        assert any(all(o + m not in lost for m in mask) for mask in MASKS for o in range(RUN - mask[-1]))


def test_masks_find_one_substitution_in_short_items():
    for n in range(8, RUN):
        masks = [*MASKS, SHORT_MASK] if n < 10 else MASKS
        for lost in range(n):
            assert any(lost not in [o + m for m in mask] for mask in masks for o in range(n - mask[-1]))


def test_short_items_with_one_substitution(spark, rng):
    items = [prose(rng, n) for n in range(5, 13) for _ in range(3)]
    texts = []
    for item in items:
        for lost in range(len(item.split())):
            words = item.split()
            words[lost] = "Other,"
            texts.append(f"{prose(rng, 6)} {' '.join(words)} {prose(rng, 4)}")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    want = {(d, i): n for d, t in enumerate(texts) for i, x in enumerate(items) if (n := overlaps(t, x))}
    got = {(r["doc_id"], r["item_id"]): r["matched_tokens"] for r in contaminated(frame(spark, texts), benchmark).collect()}
    assert got == want and {len(items[i].split()) for _, i in got} >= set(range(8, 13))


def test_repeated_items_are_searched_for_once(spark):
    benchmark = spark.createDataFrame([(i, "one two three four five six") for i in range(300)] + [(900, "other words")], "item_id int, text string")
    blocks = list(seed_blocks(item_texts(benchmark), 10))
    assert sum(len(keys) for keys, _ in blocks) == 2
    found = contaminated(frame(spark, ["zero one two three four five six"]), benchmark).collect()
    assert sorted(r["item_id"] for r in found) == list(range(300))


def test_pairs_equal_brute_force(spark, rng):
    items = [prose(rng, n) for n in (40, 25, 13, 12, 8, 5, 1)] + ["", "The Cat sat!"]
    items[-2] = None
    texts = odd_texts(rng)[:6] + ["The cat, sat."]
    for _ in range(60):
        words = rng.choice([i for i in items if i]).split()
        start = rng.randint(0, len(words) // 2)
        part = words[start : start + rng.randint(3, 40)]
        for _ in range(rng.randint(0, 4)):
            part[rng.randrange(len(part))] = "Other,"
        texts.append(" ".join([prose(rng, rng.randint(0, 30)), *part, prose(rng, rng.randint(0, 30))]))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    docs = frame(spark, texts)
    want = {(d, i): n for d, t in enumerate(texts) for i, x in enumerate(items) if x and (n := overlaps(t, x))}
    got = {(r["doc_id"], r["item_id"]): r["matched_tokens"] for r in contaminated(docs, benchmark).collect()}
    assert got == want and len(want) > 30
    in_blocks = {(r["doc_id"], r["item_id"]): r["matched_tokens"] for r in contaminated(docs, benchmark, block_tokens=20).collect()}
    assert in_blocks == want
    kept = keep_clean(docs, benchmark)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert kept.columns == docs.columns


def test_empty_tables(spark):
    docs = frame(spark, ["a b c"])
    none = spark.createDataFrame([], "item_id int, text string")
    assert contaminated(docs, none).count() == 0 and keep_clean(docs, none).count() == 1
    some = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "item_id int, text string")
    assert contaminated(docs.limit(0), some).count() == 0
    assert contaminated(docs.union(docs), some).count() == 4
