"""Document fingerprints: SimHash with weighted terms, and permuted block tables to search them.

The terms of a text are its pairs of adjacent words (a text of one word has that word), weighted by
1 + ln(how often). Each term's hash votes with its weight for or against every bit.

Search (``close_pairs``, ``count_close``): the 64 bits fall into ``radius + 2`` blocks. Two fingerprints that differ in at most ``radius``
bits agree in at least two blocks, so there is one table per pair of blocks, keyed by their bits, and
close fingerprints share a key in some table. A pair that shares several is counted in the first of
these tables only. A key that very many fingerprints share is split into pairs of parts.

Defined results
    null or wordless text    fingerprint zero
    equal texts              equal fingerprints, likeness 1
    one document             is its own successor
    repeated ids             ordered by their text; null ids come after all others
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import stored, text_slices, words_of

RADIUS = 3
HOT_KEY = 1024  # fingerprints of one key that are compared in one go
_SLICE = 1 << 19
_PAIRS = 1 << 18  # pairs that are held before they are shown
_PART_BYTES = 64 << 20  # of text in a range of the order
_LOWEST = -(2**63)
_ROOM = np.uint64(20)  # bits for the text's number within a slice; the same for all, as terms lose as many


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def simhashes(texts: pa.Array) -> np.ndarray:
    """One 64-bit fingerprint per text (no nulls)."""
    most = 1 << int(_ROOM)
    out = [
        _simhash_slice(part.slice(k, most))
        for _, part in text_slices(texts, _SLICE) for k in range(0, max(1, len(part)), most)
    ]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _simhash_slice(texts: pa.Array) -> np.ndarray:
    prints = np.zeros(len(texts), np.uint64)
    words, at = words_of(texts)
    n = np.diff(at)
    if not len(words):
        return prints
    coded = words.dictionary_encode()
    known = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
    word = hashes[coded.indices.to_numpy()]
    doc = np.repeat(np.arange(len(n)), n)
    pair = _mixed(word[:-1] * np.uint64(3) + _mixed(word[1:]))
    inside = doc[:-1] == doc[1:]
    lone = at[:-1][n == 1]
    term = np.concatenate([pair[inside], word[lone]])
    owner = np.concatenate([doc[:-1][inside], doc[lone]]).astype(np.uint64)
    keys = (owner << (np.uint64(64) - _ROOM)) | (term >> _ROOM)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    owner = (keys >> (np.uint64(64) - _ROOM)).astype(np.int64)
    bits = np.unpackbits(_mixed(keys << _ROOM).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    full, begins = np.unique(owner, return_index=True)
    ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int32).astype(np.float64)
    more = np.log(times)
    weight = np.add.reduceat(1.0 + more, begins)
    often = np.flatnonzero(times > 1)
    if len(often):
        who, starts = np.unique(owner[often], return_index=True)
        ones[np.searchsorted(full, who)] += np.add.reduceat(bits[often] * more[often][:, None], starts, axis=0)
    packed = np.packbits(2 * ones > weight[:, None], axis=1)
    prints[full] = packed.view(">u8").ravel()
    return prints



# --- each text, its edited form and its successor -----------------------------------------


def _succession(rows: DataFrame, parts: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Ranges of the order key, and for each key that begins a range (seen from above) the ranges that
    need a copy of its rows. At most one bound and one key per range come to the driver."""
    bounds = np.unique(np.array(rows.approxQuantile("key", [k / parts for k in range(1, parts)], 0.1 / parts), np.float64))
    bounds = np.unique(bounds.astype(np.int64))

    def tops(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            part = np.searchsorted(bounds, key, side="left")
            order = np.lexsort((-key, part))
            part, key = part[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
            yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array(key[first])], names=["part", "key"])

    top = rows.select("key").mapInArrow(tops, "part int, key long").groupBy("part").agg(F.max("key").alias("key"))
    found = sorted((r["part"], r["key"]) for r in top.collect())
    needed: dict[int, list[int]] = {}
    for (_, key), (above, _) in zip(found, [*found[1:], *found[:1]]):
        needed.setdefault(key, []).append(above)
    return bounds, needed


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next for every row.

    The edited text has its last third replaced by the beginning of the next document in descending
    order of the ids. Texts are shuffled once, by ranges of the id; the first document of each range
    is also sent to the range above it.
    """
    spark = docs.sparkSession
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    id_type = docs.schema[id_col].dataType.simpleString()
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("key")
    rows = docs.select(key, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(least, -(-size // _PART_BYTES))  # ranges grow in number, not in size
    bounds, needed = _succession(rows, parts)

    def place(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            part = np.searchsorted(bounds, keys, side="left").astype(np.int32)
            copies = [(i, p) for i in np.flatnonzero(np.isin(keys, list(needed))).tolist() for p in needed[int(keys[i])]]
            where = np.concatenate([np.arange(len(keys)), [i for i, _ in copies]]).astype(np.int64)
            part = np.concatenate([part, [p for _, p in copies]]).astype(np.int32)
            copy = np.arange(len(where)) >= len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(copy), batch.column(0).take(pa.array(where)), batch.column(1).take(pa.array(where))],
                names=["part", "copy", "key", "text"],
            )

    def compare(batches):
        held = None  # part, copy, key, text, fingerprint of the row whose successor is awaited
        for batch in batches:
            for start, texts in text_slices(batch.column(3), _SLICE):
                size = len(texts)
                part, copy, key = (batch.column(i).slice(start, size).to_pylist() for i in range(3))
                strings, prints = texts.to_pylist(), simhashes(texts)
                out = []
                for row in zip(part, copy, key, strings, prints.tolist()):
                    if held is not None and held[0] == row[0] and not held[1]:
                        n, text = len(held[3]), held[3]
                        out.append((held[2], n, text[: n - n // 3] + row[3][: n // 3], held[4], row[4]))
                    held = row
                if not out:
                    continue
                keys, chars, edited, own, after = (list(c) for c in zip(*out))
                own, after = np.array(own, np.uint64), np.array(after, np.uint64)
                changed = simhashes(pa.array(edited, pa.string()))
                like = lambda other: pa.array(1.0 - np.bitwise_count(own ^ other) / 64.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()), pa.array(chars, pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                        pa.array(own.view(np.int64)), pa.array(changed.view(np.int64)), like(changed), like(after),
                    ],
                    names=["key", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"],
                )

    placed = rows.mapInArrow(place, "part int, copy boolean, key long, text string")
    placed = placed.repartition(parts, "part").sortWithinPartitions("part", "copy", F.desc("key"), "text")
    found = placed.mapInArrow(
        compare, "key long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"
    )
    own = F.when(F.col("key") != _LOWEST, F.col("key")).cast(id_type).alias("doc_id")
    return found.select(own, *[c for c in found.columns if c != "key"])


# --- search ---------------------------------------------------------------------------------


class BlockTables:
    """Bit blocks of 64-bit numbers and the table for each pair of them."""

    def __init__(self, radius: int):
        if not 0 <= radius <= 30:
            raise ValueError("the radius must be between 0 and 30")
        self.radius, self.blocks = radius, radius + 2
        edges = np.linspace(0, 64, self.blocks + 1).astype(int)
        self.masks = [np.uint64(((1 << int(b - a)) - 1) << int(a)) for a, b in zip(edges, edges[1:])]
        self.tables = list(combinations(range(self.blocks), 2))
        self._number = {t: k for k, t in enumerate(self.tables)}

    def keys(self, prints: np.ndarray, table: int) -> np.ndarray:
        a, b = self.tables[table]
        return prints & (self.masks[a] | self.masks[b])

    def first_table(self, difference: np.ndarray) -> np.ndarray:
        """The first table in which two fingerprints with this difference share a key."""
        equal = np.stack([(difference & m) == 0 for m in self.masks], axis=1)
        a = equal.argmax(axis=1)
        equal[np.arange(len(a)), a] = False
        b = equal.argmax(axis=1)
        number = np.zeros((self.blocks, self.blocks), np.int64)
        for (i, j), k in self._number.items():
            number[i, j] = k
        return number[a, b]


def count_close(prints: DataFrame, radius: int = RADIUS, hot_key: int = HOT_KEY) -> DataFrame:
    """(fp, n_near): how many other distinct fingerprints lie within the radius; those without one are
    left out. ``prints`` has distinct ``fp`` values. No pair is written out."""

    def counted(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        own = np.bincount(a, minlength=len(rows[5])) + np.bincount(b, minlength=len(rows[5]))
        some = np.flatnonzero(own)
        return pa.RecordBatch.from_arrays([pa.array(rows[5][some]), pa.array(own[some])], names=["fp", "n"])

    return _met(prints, radius, hot_key, counted, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n_near"))


def close_pairs(prints: DataFrame, radius: int = RADIUS, hot_key: int = HOT_KEY) -> DataFrame:
    """(fp, other, distance), fp < other: each pair of distinct fingerprints within the radius once. As many rows as
    there are such pairs; ``count_close`` and ``vantage.near_links`` do without them."""

    def paired(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        low, high = np.minimum(rows[5][a], rows[5][b]), np.maximum(rows[5][a], rows[5][b])
        apart = np.bitwise_count(low.view(np.uint64) ^ high.view(np.uint64)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(apart)], names=["fp", "other", "distance"])

    return _met(prints, radius, hot_key, paired, "fp long, other long, distance int")


def _met(prints: DataFrame, radius: int, hot_key: int, shown, schema: str) -> DataFrame:
    """What ``shown`` makes of the pairs within the radius, each met once: it gets the columns of some rows
    and the numbers of both rows of each pair."""
    tables = BlockTables(radius)

    def spread(batches):
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for t in range(len(tables.tables)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), t, np.int32)), pa.array(tables.keys(own, t).view(np.int64)), batch.column(0)],
                    names=["tab", "key", "fp"],
                )

    rows = prints.select("fp").mapInArrow(spread, "tab int, key long, fp long")
    sizes = rows.groupBy("tab", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = rows.join(sizes, ["tab", "key"])
    # Rows of a hot key meet in pairs of parts, each of about hot_key rows.
    parts = F.ceil(F.col("n") / hot_key).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    spots = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))
    met = shared.select("tab", "key", "fp", mine.alias("mine"), F.explode(spots).alias("spot"))
    met = met.select("tab", "key", F.col("spot.i").alias("i"), F.col("spot.j").alias("j"), "mine", "fp")
    met = met.repartition("tab", "key", "i", "j").sortWithinPartitions("tab", "key", "i", "j", "fp")

    def compare(batches):
        kept = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(6)]
            rows = now if kept is None else [np.concatenate(x) for x in zip(kept, now)]
            if not len(rows[0]):
                continue
            fresh = np.ones(len(rows[0]), bool)
            fresh[1:] = np.any([c[1:] != c[:-1] for c in rows[:4]], axis=0)
            last = int(np.flatnonzero(fresh)[-1])  # this run may go on in the next batch
            yield from _compared(tables, [c[:last] for c in rows], fresh[:last], shown)
            kept = [c[last:] for c in rows]
        if kept is not None:
            fresh = np.zeros(len(kept[0]), bool)
            fresh[:1] = True
            yield from _compared(tables, kept, fresh, shown)

    return met.mapInArrow(compare, schema)


def _compared(tables: BlockTables, rows: list[np.ndarray], fresh: np.ndarray, shown):
    """Complete runs of rows with one key: each row against the rows after it."""
    table, _, i, j, mine, prints = rows
    run = np.cumsum(fresh)
    own = prints.view(np.uint64)
    at = np.arange(len(own))
    step, first, second, waiting = 1, [], [], 0
    while True:
        at = at[at + step < len(own)]
        at = at[run[at] == run[at + step]]
        if not len(at):
            break
        difference = own[at] ^ own[at + step]
        close = np.bitwise_count(difference) <= tables.radius
        # In a run of two parts only pairs across them count; pairs inside a part have a run of their own.
        close &= (i[at] == j[at]) | (mine[at] != mine[at + step])
        hit = at[close]
        hit = hit[tables.first_table(difference[close]) == table[hit]]
        if len(hit):
            first.append(hit)
            second.append(hit + step)
            waiting += len(hit)
        if waiting > _PAIRS:
            yield shown(rows, np.concatenate(first), np.concatenate(second))
            first, second, waiting = [], [], 0
        step += 1
    if waiting:
        yield shown(rows, np.concatenate(first), np.concatenate(second))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The columns of ``edited_fingerprints``, the fingerprints as 16 hex digits, and ``n_near``: the number
    of other distinct fingerprints within the radius."""
    found = stored(edited_fingerprints(docs, id_col, text_col), "fingerprints")
    close = count_close(found.select("fp").distinct(), radius)
    shown = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return found.join(close, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", shown("fp").alias("fingerprint"),
        shown("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )
