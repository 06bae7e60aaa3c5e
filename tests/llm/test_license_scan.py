import re

import pytest
from llm_helpers import frame, odd_texts, prose

from tillwatch.llm import license_scan
from tillwatch.llm.license_scan import bands_needed, scan_licenses, scan_texts, template_classes
from tillwatch.llm.license_texts import TEMPLATES


def documents(rng, n):
    out = []
    for _ in range(n):
        name, text = rng.choice(TEMPLATES)
        share = rng.choice([0, 0, 0.01, 0.03])
        words = [rng.choice(["changed", "Words"]) if rng.random() < share else w for w in text.split()]
        out.append(" ".join([prose(rng, rng.randint(0, 60)), *words, prose(rng, rng.randint(0, 60))]))
    return out


def plain_tokens(text):
    """(token, word number), by a plain pattern."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [(t, k) for k, w in enumerate(words) if (t := re.sub(r"[\W_]+", "", w.lower()))]


def plain_shingles(tokens, k):
    return [tuple(t for t, _ in tokens[i : i + k]) for i in range(len(tokens) - k + 1)]


def test_occurrences_hold_their_templates_by_plain_sets(spark, rng):
    """Written apart from the operator: every reported place holds 80 % of the template's shingles, and wherever a
    stretch of a template's length does, that template or a related one is reported there."""
    texts = odd_texts(rng) + documents(rng, 120)
    found = [tuple(r) for r in scan_licenses(frame(spark, texts)).collect()]
    sets, lengths = {}, {}
    for name, text in TEMPLATES:
        tokens = plain_tokens(text)
        k = min(5, len(tokens))
        sets[name], lengths[name] = (k, set(plain_shingles(tokens, k))), len(tokens) - k + 1
    for doc, name, low, high, share in found:
        k, own = sets[name]
        there = set(plain_shingles([t for t in plain_tokens(texts[doc]) if low <= t[1] <= high], k))
        assert len(there & own) >= 0.8 * len(own) - 1e-9 and share <= len(there & own) / len(own) + 1e-9
    met = 0
    for doc, text in enumerate(texts):
        tokens = plain_tokens(text)
        for name, (k, own) in sets.items():
            if lengths[name] > 400:
                continue
            shingles, n = plain_shingles(tokens, k), lengths[name]
            for start in range(0, max(1, len(shingles) - n + 1)):
                part = shingles[start : start + n]
                if len(own & set(part)) < 0.8 * len(own):
                    continue
                met += 1
                a, b = tokens[start][1], tokens[min(start + len(part) + k - 2, len(tokens) - 1)][1]
                at_place = {other for d, other, low, high, _ in found if d == doc and low <= b and high >= a}
                assert any(other == name or len(own & sets[other][1]) >= 0.8 * min(len(own), len(sets[other][1])) for other in at_place)
    assert met > 50


def test_equals_a_scan_of_all_windows(spark, rng, monkeypatch):
    texts = odd_texts(rng) + documents(rng, 150)
    got = sorted(tuple(r) for r in scan_licenses(frame(spark, texts).repartition(4)).collect())
    import numpy as np
    import pyarrow as pa

    every = lambda self, values, starts, first, stop: np.array(
        [(w, t) for w in range(len(first)) for t in range(len(self.sets))]).reshape(-1, 2)
    monkeypatch.setattr(license_scan.TemplateClass, "candidates", every)
    assert got == sorted(scan_texts(pa.array(texts, pa.string()).fill_null(""), template_classes(TEMPLATES)))
    assert len(got) > 100


def test_planted_texts_are_found_and_plain_ones_left_alone(spark, rng):
    plain = [prose(rng, 200) for _ in range(20)]
    texts = plain + [prose(rng, 30) + " " + text + " " + prose(rng, 30) for _, text in TEMPLATES]
    found = {(r["doc_id"], r["license"]) for r in scan_licenses(frame(spark, texts)).collect()}
    assert not {d for d, _ in found} & set(range(20))
    assert {(20 + k, name) for k, (name, _) in enumerate(TEMPLATES)} <= found


def test_two_occurrences_and_their_places(spark):
    notice = "Released under the MIT License."
    docs = frame(spark, [f"one two {notice} three four five six {notice}", None])
    rows = sorted(tuple(r) for r in scan_licenses(docs).collect())
    assert rows == [(0, "MIT-notice", 2, 6, 1.0), (0, "MIT-notice", 11, 15, 1.0)]
    assert scan_licenses(docs.limit(0)).count() == 0 and scan_licenses(docs, []).count() == 0


def test_bands_reach_their_chance():
    for similarity in (0.4, 0.55, 0.9):
        bands = bands_needed(similarity)
        assert (1 - similarity**2) ** bands <= 1e-3 < (1 - similarity**2) ** (bands - 1)
    assert all(c.bands >= 1 for c in template_classes(TEMPLATES))
    with pytest.raises(ValueError):
        template_classes([("x", "y")] * 20_001)


def test_variants_are_told_apart_and_parts_left_out(spark, rng):
    by_name = dict(TEMPLATES)
    wanted = ["BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "CC0-1.0", "MPL-2.0", "ISC"]
    texts = [f"{prose(rng, 20)} {by_name[n]} {prose(rng, 20)}" for n in wanted]
    bsd = by_name["BSD-2-Clause"].replace("met: Redis", "met: 1. Redis").replace("disclaimer. Redis", "disclaimer. 2. Redis")
    rows = scan_licenses(frame(spark, [*texts, bsd])).collect()
    assert sorted((r["doc_id"], r["license"]) for r in rows) == list(enumerate([*wanted, "BSD-2-Clause"]))
