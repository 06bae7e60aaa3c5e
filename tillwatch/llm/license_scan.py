"""License scan: MinHash bands over windows of a text retrieve templates, containment decides.

Templates of similar length form a class. A text is covered with overlapping windows a little longer
than the class's templates, so that every stretch of that length lies within one. Windows and
templates get MinHash signatures over five-word shingles; a template is retrieved where one of the
bands agrees, and reported where the window holds at least 80 % of its distinct shingles.

For the least similarity that such a window can have, the number of bands is set so that the chance
to miss it is at most ``MISS``. (Mostly several windows hold a match, and similarity is higher.)

Tokens are words, lower-cased and cut down to letters and digits; a template with fewer than five
words has one shingle of all its words.

Defined results
    null or wordless text    no match
    repeated occurrences     one row each; windows that overlap are one occurrence
    several templates match  each is reported, but of two that share most of the shorter one's shingles only the
                             better at a place: the one with more shingles found and fewer missing
    repeated rows            each row is scanned
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import text_slices
from tillwatch.llm.license_texts import TEMPLATES
from tillwatch.llm.spaced_seeds import tokens_of

WORDS = 5
CONTAINED = 0.8
ROWS = 2  # signature rows of a band
MISS = 1e-3
RATIO = 1.125  # longest to shortest template of a class
MOST_TEMPLATES = 20_000  # templates are broadcast, so their number is bounded
_SLICE = 1 << 20
_ANY_BITS = 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k tokens from each place on, the last k - 1 places left out."""
    n = max(0, len(tokens) - k + 1)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = (total ^ tokens[i : i + n]) * _MIX
        total ^= total >> np.uint64(31)
    return total


def bands_needed(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands with which sets of this similarity are missed with a chance of at most ``miss``."""
    if similarity >= 1:
        return 1
    return int(np.ceil(np.log(miss) / np.log(1 - similarity**rows)))


@dataclass
class TemplateClass:
    """Templates with shingles of ``k`` words and at most ``longest`` shingles."""

    k: int
    longest: int
    names: list[str]
    sets: list[np.ndarray]

    def __post_init__(self):
        self.block = -(-self.longest // 8)
        self.span = self.longest if self.block == 1 else -(-self.longest // self.block) + 1  # blocks of a window
        shortest = min(map(len, self.sets))
        window = self.span * self.block
        self.bands = bands_needed(CONTAINED * shortest / (window + (1 - CONTAINED) * shortest) if window > 1 else 1.0)
        self.least = int(np.ceil(CONTAINED * shortest - 1e-9))  # shingles that a text with a match has
        self.any = np.zeros(1 << _ANY_BITS, bool)
        self.any[np.concatenate(self.sets) >> np.uint64(64 - _ANY_BITS)] = True
        self.keys = []
        signatures = [np.array([self.hashed(s, i).min() for i in range(self.bands * ROWS)]) for s in self.sets]
        for b in range(self.bands):
            keys = self.band(list(np.stack(signatures, axis=1)[b * ROWS : (b + 1) * ROWS]))
            order = np.argsort(keys)
            table = np.zeros(1 << 16, bool)
            table[keys >> np.uint64(48)] = True
            self.keys.append((keys[order], order, table))

    @staticmethod
    def hashed(values: np.ndarray, i: int) -> np.ndarray:
        a = np.uint64((0xD1342543DE82EF95 * (2 * i + 1)) % 2**64 | 1)
        return ((values ^ (values >> np.uint64(29))) + np.uint64((i + 1) * int(_MIX) % 2**64)) * a

    @staticmethod
    def band(parts) -> np.ndarray:
        total = np.zeros(len(parts[0]), np.uint64)
        for p in parts:
            total = (total ^ p) * _MIX
        return total ^ (total >> np.uint64(32))

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first places of all blocks, first block of each window, text of each window) for texts
        whose shingles lie between the bounds ``at``."""
        n = np.diff(at)
        blocks = -(-n // self.block)
        text = np.repeat(np.arange(len(n)), blocks)
        before = np.cumsum(blocks) - blocks
        nth = np.arange(len(text)) - before[text]
        starts = at[:-1][text] + nth * self.block
        count = np.where(blocks > 0, np.maximum(1, blocks - self.span + 1), 0)
        of = np.repeat(np.arange(len(n)), count)
        first = before[of] + np.arange(len(of)) - (np.cumsum(count) - count)[of]
        return starts, first, of

    def candidates(self, values: np.ndarray, starts: np.ndarray, first: np.ndarray, stop: np.ndarray):
        """(window, template) pairs of which some band agrees."""
        pairs = []
        reach = stop - first  # blocks of each window; fewer only in short texts
        for b, (keys, order, table) in enumerate(self.keys):
            parts = [self._minima(self.hashed(values, i), starts, first, reach) for i in range(b * ROWS, (b + 1) * ROWS)]
            own = self.band(parts)
            maybe = np.flatnonzero(table[own >> np.uint64(48)])
            low, high = (np.searchsorted(keys, own[maybe], side=s) for s in ("left", "right"))
            times = high - low
            if times.any():
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                pairs.append(np.stack([np.repeat(maybe, times), order[np.repeat(low, times) + nth]]))
        return np.unique(np.concatenate(pairs, axis=1), axis=1).T if pairs else np.zeros((0, 2), np.int64)

    def _minima(self, hashed: np.ndarray, starts: np.ndarray, first: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """The least value in each window, from blocks and runs of 1, 2, 4, ... blocks."""
        least = np.minimum.reduceat(hashed, starts) if self.block > 1 else hashed
        out = np.full(len(first), np.uint64(2**64 - 1))
        step, longest = 1, int(reach.max())
        while True:
            # A run of `step` blocks at the start and one at the end cover windows of up to 2 * step blocks.
            fits = (reach >= step) & (reach <= 2 * step)
            a = first[fits]
            out[fits] = np.minimum(least[a], least[a + reach[fits] - step])
            if 2 * step >= longest:
                return out
            joined = least.copy()
            joined[:-step] = np.minimum(least[:-step], least[step:])
            least, step = joined, 2 * step


def template_classes(templates: list[tuple[str, str]]) -> list[TemplateClass]:
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates: scan with parts of them")
    found = []
    for name, text in templates:
        tokens = tokens_of(pa.array([text], pa.string()))[0]
        if len(tokens):
            k = min(WORDS, len(tokens))
            found.append((k, np.unique(shingles(tokens, k)), len(tokens) - k + 1, name))
    found.sort(key=lambda t: (t[0], -t[2], t[3]))
    classes: list[list] = []
    for t in found:
        if classes and classes[-1][0][0] == t[0] and classes[-1][0][2] <= RATIO * t[2]:
            classes[-1].append(t)
        else:
            classes.append([t])
    return [TemplateClass(c[0][0], c[0][2], [t[3] for t in c], [t[1] for t in c]) for c in classes]


def scan_texts(texts: pa.Array, classes: list[TemplateClass]) -> list[tuple[int, str, int, int, float]]:
    """(text, template, first word, last word, containment) of each occurrence."""
    tokens, at, number = tokens_of(texts)
    places: dict[int, list[tuple]] = {}
    cache: dict[int, np.ndarray] = {}
    for kind in classes:
        k = kind.k
        if k not in cache:
            cache[k] = shingles(tokens, k)
        n = np.maximum(np.diff(at) - k + 1, 0)
        # A text with fewer shingles of the class than a match has is passed over.
        some = np.concatenate([[0], np.cumsum(kind.any[cache[k] >> np.uint64(64 - _ANY_BITS)])])
        ends = np.minimum(at, len(cache[k]))
        n[some[ends[1:]] - some[ends[:-1]] < kind.least] = 0
        # Only shingles inside a text: leave out those that reach into the next one.
        inside = np.repeat(at[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not len(inside):
            continue
        values, bounds = cache[k][inside], np.concatenate([[0], np.cumsum(n)])
        starts, first, of = kind.windows(bounds)
        blocks = np.cumsum(-(-n // kind.block))
        stop = np.minimum(first + kind.span, blocks[of])
        edges = np.append(starts, len(values))
        hits: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        for window, template in kind.candidates(values, starts, first, stop).tolist():
            a, b = int(edges[first[window]]), int(min(edges[stop[window]], bounds[of[window] + 1]))
            share = passing(values[a:b], kind.sets[template])
            if share is not None:
                hits.setdefault((int(of[window]), template), []).append((a + share[1], a + share[2], share[0]))
        for (text, template), spans in hits.items():
            for low, high, share in merged(spans):
                row = (text, kind.names[template], int(number[inside[low]]), int(number[inside[high] + k - 1]), share)
                places.setdefault(text, []).append((row, kind.sets[template]))
    return sorted(row for found in places.values() for row in best_at_a_place(found))


def best_at_a_place(found: list[tuple[tuple, np.ndarray]]) -> list[tuple]:
    """Leave out an occurrence that lies within a better one of a related template."""
    kept: list[tuple[tuple, np.ndarray]] = []
    for row, own in sorted(found, key=lambda f: (-(2 * f[0][4] - 1) * len(f[1]), f[0])):
        for other, better in kept:
            inside = min(row[3], other[3]) - max(row[2], other[2]) + 1
            if row[1] != other[1] and inside >= CONTAINED * (row[3] - row[2] + 1):
                if len(np.intersect1d(own, better)) >= CONTAINED * min(len(own), len(better)):
                    break
        else:
            kept.append((row, own))
    return [row for row, _ in kept]


def passing(window: np.ndarray, template: np.ndarray) -> tuple[float, int, int] | None:
    """The share of the template's shingles in a window and the places of the first and last of them,
    if the share suffices."""
    there = np.flatnonzero(np.isin(window, template))
    share = len(np.unique(window[there])) / len(template)
    return (share, int(there[0]), int(there[-1])) if share >= CONTAINED - 1e-12 else None


def merged(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Overlapping spans become one, with the best containment."""
    out: list[tuple[int, int, float]] = []
    for low, high, share in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high), max(out[-1][2], share))
        else:
            out.append((low, high, share))
    return out


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, license, first_word, last_word, containment: one row per occurrence in a row's text."""
    classes = template_classes(TEMPLATES if templates is None else templates)
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            for start, part in text_slices(batch.column(1), _SLICE):
                hits = scan_texts(part, shared.value)
                if hits:
                    text, *columns = zip(*hits)
                    ids = batch.column(0).slice(start, len(part)).take(pa.array(text))
                    names = ["doc_id", "license", "first_word", "last_word", "containment"]
                    yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names=names)

    return rows.mapInArrow(scan, f"doc_id {kind}, license string, first_word long, last_word long, containment double")
