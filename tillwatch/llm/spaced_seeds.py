"""Benchmark decontamination by spaced seeds.

A fixed mask picks some of the tokens of a short span and ignores the others, so that a hash of
the picked ones still agrees when an ignored token was substituted. The hashes of all spans of
the benchmark items are joined with those of the documents; every hit names an alignment, which
is then compared token by token. Two texts overlap where, along one alignment, at least 80 % of
some ``RUN`` consecutive item tokens agree. A shorter item may have one substituted token if it has
``TOLERANT`` tokens or more; still shorter ones must agree in full.

The masks find every such run: for any two substituted tokens among 13, and any one of an item of 10 to 12, some
mask still fits. A lighter mask of every other token serves the items of 8 and 9: one substitution spares its
even or its odd place. Items below that are hashed whole.

Tokens are words, lower-cased and cut down to letters and digits; words without any are left out.

Defined results
    null or wordless texts    overlap with nothing
    repeated items            each is reported; equal texts are searched for once
    repeated documents        each row is reported
    an item met twice         its alignment with most agreeing tokens, then the first one
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import free_name, text_slices, words_of

# Token positions that count, in spans of at most RUN tokens.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SHORT_MASK = (0, 2, 4, 6)  # for items of TOLERANT to SHORT tokens
TOLERANT, SHORT = 8, 9
RUN = 13
SHARE = 0.8
BLOCK_TOKENS = 1 << 18  # benchmark tokens that are broadcast at a time
_FILTER_BITS = 20
_SLICE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NOT_WORD = re.compile(r"[\W_]+")


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts, where each text begins, and each token's word number."""
    words, at = words_of(texts)
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    known = coded.dictionary.to_numpy(zero_copy_only=False) if len(words) else []
    plain = [_NOT_WORD.sub("", w.lower()) for w in known]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) if w else 0 for w in plain), np.uint64, len(plain))
    tokens = hashes[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    full = tokens != 0
    number = np.arange(len(tokens)) - np.repeat(at[:-1], np.diff(at))
    return tokens[full], np.concatenate([[0], np.cumsum(full)])[at], number[full]


def _seed_hashes(tokens: np.ndarray, at: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every place where the mask fits inside a text."""
    span = mask[-1] + 1
    n = len(tokens) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, offset in enumerate(mask):
        total += tokens[offset : offset + n] * np.uint64(2 * (k + 1) * 0x5851F42D4C957F2D % 2**64 | 1)
    total = (total ^ (total >> np.uint64(29))) * _MIX
    last = np.repeat(at[1:], np.diff(at))[:n]
    fits = np.arange(n) + span <= last
    return np.flatnonzero(fits), total[fits]


@dataclass
class SeedIndex:
    """Seeds of one block of benchmark items."""

    tokens: np.ndarray
    at: np.ndarray
    seeds: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]]  # mask, hashes, positions, filter

    @classmethod
    def of(cls, texts: list[str]) -> SeedIndex:
        tokens, at, _ = tokens_of(pa.array(texts, pa.string()))
        n = np.diff(at)
        # Each mask with the sizes of the items that it serves.
        masks = [(m, 0, np.inf) for m in MASKS] + [(SHORT_MASK, TOLERANT, SHORT)]
        masks += [(tuple(range(k)), k, k) for k in np.unique(n[(n > 0) & (n < TOLERANT)]).tolist()]
        seeds = []
        for mask, least, most in masks:
            where, hashes = _seed_hashes(tokens, at, mask)
            item = np.searchsorted(at, where, side="right") - 1
            own = (n[item] >= least) & (n[item] <= most)
            where, hashes = where[own], hashes[own]
            order = np.argsort(hashes, kind="stable")
            hashes, where = hashes[order], where[order]
            table = np.zeros(1 << _FILTER_BITS, bool)
            table[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            seeds.append((mask, hashes, where, table))
        return cls(tokens, at, seeds)

    def overlaps(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text, item, matched tokens, first word, last word) of the best alignment of each pair."""
        tokens, at, number = tokens_of(texts)
        found = []
        for mask, hashes, where, table in self.seeds:
            if not len(hashes):
                continue
            place, own = _seed_hashes(tokens, at, mask)
            maybe = np.flatnonzero(table[own >> np.uint64(64 - _FILTER_BITS)])
            place, own = place[maybe], own[maybe]
            low, high = np.searchsorted(hashes, own, side="left"), np.searchsorted(hashes, own, side="right")
            times = high - low
            if not times.any():
                continue
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            there = where[np.repeat(low, times) + nth]
            here = np.repeat(place, times)
            item = np.searchsorted(self.at, there, side="right") - 1
            found.append(np.unique(np.stack([np.searchsorted(at, here, side="right") - 1, item, here - there]), axis=1))
        if not found:
            return []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, shift in np.unique(np.concatenate(found, axis=1), axis=1).T.tolist():
            hit = self._compare(tokens, at, text, item, shift)
            if hit is not None:
                best[text, item] = min(best.get((text, item), hit), hit, key=lambda h: (-h[0], h[1]))
        return [(t, i, n, int(number[a]), int(number[b])) for (t, i), (n, a, b) in sorted(best.items())]

    def _compare(self, tokens, at, text: int, item: int, shift: int) -> tuple[int, int, int] | None:
        """Agreeing tokens of the runs that pass, and the first and last place in the document."""
        a, b = int(self.at[item]), int(self.at[item + 1])
        run = min(RUN, b - a)
        a, b = max(a, int(at[text]) - shift), min(b, int(at[text + 1]) - shift)
        same = self.tokens[a:b] == tokens[a + shift : b + shift]
        if len(same) < run:
            return None
        total = np.concatenate([[0], np.cumsum(same)])
        least = int(np.ceil(SHARE * run - 1e-9)) if run == RUN else run - (run >= TOLERANT)
        passed = np.flatnonzero(total[run:] - total[:-run] >= least)
        if not len(passed):
            return None
        inside = np.zeros(len(same) + 1, np.int64)
        np.add.at(inside, passed, 1)
        np.add.at(inside, passed + run, -1)
        agree = np.flatnonzero((np.cumsum(inside)[:-1] > 0) & same)
        return len(agree), a + shift + int(agree[0]), a + shift + int(agree[-1])


def item_texts(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, text, text_key) of the items that have a text; equal texts have equal keys."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    return items.filter(F.col("text").isNotNull()).withColumn("text_key", F.sha2("text", 256))


def seed_blocks(items: DataFrame, block_tokens: int = BLOCK_TOKENS):
    """The distinct texts in blocks of about ``block_tokens`` tokens: (text keys, index) one after the other.

    Only one block at a time is on the driver and broadcast, whatever the benchmark's size and
    however often an item repeats.
    """
    texts = items.select("text_key", "text").dropDuplicates(["text_key"])
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * block_tokens)))
    for k in range(blocks):
        rows = texts.filter(F.pmod(F.xxhash64("text_key"), F.lit(blocks)) == k).collect()
        yield [r["text_key"] for r in rows], SeedIndex.of([r["text"] for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, item_id, matched_tokens, first_word, last_word: one row per document row and overlapping item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, item int, matched_tokens long, first_word long, last_word long"
    parts = []
    items = item_texts(benchmark, item_col, item_text)
    names = items.select("text_key", F.col("item").alias("item_id"))
    for keys, index in seed_blocks(items, block_tokens):
        shared = spark.sparkContext.broadcast(index)

        def scan(batches, shared=shared):
            for batch in batches:
                for start, part in text_slices(batch.column(1), _SLICE):
                    hits = shared.value.overlaps(part)
                    if hits:
                        text, item, n, first, last = (pa.array(c) for c in zip(*hits))
                        ids = batch.column(0).slice(start, len(part)).take(text)
                        yield pa.RecordBatch.from_arrays(
                            [ids, item.cast(pa.int32()), n, first, last],
                            names=["doc_id", "item", "matched_tokens", "first_word", "last_word"],
                        )

        numbered = spark.createDataFrame(list(enumerate(keys)), "item int, text_key string")
        found = rows.mapInArrow(scan, schema).join(numbered, "item").join(names, "text_key")
        parts.append(found.select("doc_id", "item_id", "matched_tokens", "first_word", "last_word"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text",
               item_col: str = "item_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows that overlap with no benchmark item, with all their columns."""
    kept = docs
    for _, index in seed_blocks(item_texts(benchmark, item_col, item_text), block_tokens):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        kept = _without(kept, shared, text_col)
    return kept


def _without(docs: DataFrame, shared, text_col: str) -> DataFrame:
    @F.arrow_udf("boolean")
    def leaks(texts: pa.Array) -> pa.Array:
        flags = np.zeros(len(texts), bool)
        for start, part in text_slices(texts, _SLICE):
            for hit in shared.value.overlaps(part):
                flags[start + hit[0]] = True
        return pa.array(flags)

    flag = free_name(docs, "leak")
    return docs.withColumn(flag, leaks(F.col(text_col).cast("string"))).filter(~F.col(flag)).drop(flag)
