"""SentencePiece encoding and decoding with a max-plus scan over chunks.

A text is cut into the pieces of a vocabulary so that the sum of their scores is largest, as in the
unigram algorithm. Giant texts are split into chunks of equal length that know nothing of each
other. At a chunk's border the state is how many characters of the next chunk the last piece has
already taken. Each chunk gives a matrix of best scores from every entry state to every exit state;
matrices combine by max-plus products, which are associative, so a scan gives every chunk the scores
at its entry. With these a chunk tells the entry state for each exit state; such maps are composed
from the end of the text, and then each chunk traces its own pieces back. The result is that of
one pass over the whole text.

Within a chunk the text falls into segments: between two characters that no piece holds side by side
every path has a border. Equal segments are solved once per batch, many at a time.

Defined results
    null or empty text     no pieces, score 0
    unknown characters     their UTF-8 bytes where the vocabulary has byte pieces, else the unknown id
    equal scores           the path with the longer last piece, from the end on
    U+2581 in a text       is a blank for SentencePiece, and comes back as one
    repeated rows          each row is encoded; equal giant texts are solved once
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import free_name, stored, text_slices

BLANK = "▁"
GIANT = 65536  # longer texts are split, shorter ones are solved within their task
CHUNK = 16384  # characters of a chunk
FAN = 256  # chunks that are combined at a time
_SLICE = 1 << 20
_SHORT = 48  # longer segments are solved one at a time
_LANES = 1 << 13  # segments that are solved side by side
_PAIR_BITS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _pair_slots(points: np.ndarray) -> np.ndarray:
    mixed = (points[:-1].astype(np.uint64) * np.uint64(0x1000193) + points[1:].astype(np.uint64)) * _BASE
    return (mixed >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Vocabulary:
    """Pieces, scores and kinds (0 normal, 1 byte, 2 unknown or control) of a model, by id."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    _ready: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_ready"} | {"_ready": {}}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a model file. Only the identity normalizer without removal of blanks is supported."""
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules = proto.normalizer_spec
        if rules.name != "identity" or rules.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model changes texts before encoding; give it texts it leaves as they are")
        kind = {1: 0, 4: 0, 6: 1}  # normal, user defined, byte
        return cls(
            [p.piece for p in proto.pieces], [float(p.score) for p in proto.pieces],
            [kind.get(p.type, 2) for p in proto.pieces], rules.add_dummy_prefix,
        )

    def prepare(self) -> Vocabulary:
        """Build the lookup tables, once per worker."""
        if self._ready:
            return self
        normal = [(p, i) for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 0 and p]
        longest = max((len(p) for p, _ in normal), default=1)
        best: dict[str, int] = {}
        for p, i in normal:
            best.setdefault(p, i)
        heads = {p[:k] for p in best for k in range(1, len(p) + 1)}
        names = sorted(heads)
        hashes = np.array([self._hash(h) for h in names], np.uint64)
        order = np.argsort(hashes)
        ids = np.array([best.get(h, -1) for h in names], np.int64)[order]
        worth = np.where(ids >= 0, np.array([*self.scores, -np.inf])[ids], -np.inf)
        inside = np.zeros(1 << _PAIR_BITS, bool)
        for p in best:
            if len(p) > 1:
                inside[_pair_slots(_points(p))] = True
        hashes = hashes[order]
        bits = 17
        slot = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64), side="left")
        lowest = min((self.scores[i] for i in best.values()), default=0.0)
        bytes_at = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 1}
        byte_ids = [bytes_at.get(f"<0x{b:02X}>", -1) for b in range(256)]
        raw = []
        for p, k in zip(self.pieces, self.kinds):
            raw.append(bytes([int(p[3:5], 16)]) if k == 1 else b"" if k == 2 else p.encode())
        unknown = next((i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 2), -1)
        self._ready.update(
            longest=longest, hashes=hashes, ids=ids, worth=worth, slot=slot, bits=bits, inside=inside,
            lost=lowest - 10.0, best=best, heads=heads, byte_ids=byte_ids,
            unknown=unknown, bytes=all(b >= 0 for b in byte_ids), raw=pa.array(raw, pa.binary()),
        )
        return self

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = ((h ^ (ord(c) + 1)) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return h

    @property
    def longest(self) -> int:
        return self.prepare()._ready["longest"]

    # --- many short segments at once ---------------------------------------------------

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash in the table of heads, or -1."""
        r = self._ready
        where = (h >> np.uint64(64 - r["bits"])).astype(np.int64)
        at, stop = r["slot"][where], r["slot"][where + 1]
        found = np.full(len(h), -1, np.int64)
        left = np.flatnonzero(at < stop)
        while len(left):
            hit = r["hashes"][at[left]] == h[left]
            found[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return found

    def solve_short(self, points: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """Best paths of segments points[begin : begin + size]: scores, path lengths, all ids in order.
        Unknown characters have the id -1 - (their code point)."""
        r = self.prepare()._ready
        n, width = len(size), int(size.max(initial=0))
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0.0
        came = np.zeros((width + 1, n), np.int16)
        piece = np.zeros((width + 1, n), np.int64)
        for q in range(width):
            rows = np.flatnonzero(size > q)
            start = best[q, rows]
            h = np.zeros(len(rows), np.uint64)
            single = np.zeros(len(rows), bool)
            live = np.arange(len(rows))
            for k in range(1, r["longest"] + 1):
                live = live[size[rows[live]] >= q + k]
                if not len(live):
                    break
                row = rows[live]
                mixed = (h[live] ^ (points[begin[row] + q + k - 1].astype(np.uint64) + np.uint64(1))) * _BASE
                mixed ^= mixed >> np.uint64(29)
                at = self._find(mixed)
                known = at >= 0
                live, row, at = live[known], row[known], at[known]
                h[live] = mixed[known]
                real = r["ids"][at] >= 0
                if k == 1:
                    single[live[real]] = True
                total = start[live] + r["worth"][at]
                better = real & (total > best[q + k, row])
                row = row[better]
                best[q + k, row], came[q + k, row], piece[q + k, row] = total[better], k, r["ids"][at[better]]
            lost = np.flatnonzero(~single)
            if len(lost):
                row = rows[lost]
                total = start[lost] + r["lost"]
                better = total > best[q + 1, row]
                row = row[better]
                best[q + 1, row], came[q + 1, row] = total[better], 1
                piece[q + 1, row] = -1 - points[begin[row] + q].astype(np.int64)
        at, column = size.astype(np.int64), np.arange(n)
        back = np.zeros((n, width), np.int64)
        steps = np.zeros(n, np.int64)
        rows = column[at > 0]
        while len(rows):
            back[rows, steps[rows]] = piece[at[rows], rows]
            at[rows] -= came[at[rows], rows]
            steps[rows] += 1
            rows = rows[at[rows] > 0]
        nth = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
        return best[size, column], steps, back[np.repeat(column, steps), np.repeat(steps, steps) - 1 - nth]

    # --- one stretch of text with given entry scores -----------------------------------

    def forward(self, text: str, entry: list[float], end: int):
        """Best scores at the places of ``text`` from entry scores at its first places, over pieces that
        begin before ``end``; with the length and id of the last piece of each best path."""
        r = self.prepare()._ready
        best = [-np.inf] * (len(text) + 1)
        came, piece = [0] * len(best), [0] * len(best)
        best[: len(entry)] = entry
        for q in range(min(end, len(text))):
            if best[q] == -np.inf:
                continue
            single = False
            for k in range(1, min(r["longest"], len(text) - q) + 1):
                head = text[q : q + k]
                if head not in r["heads"]:
                    break
                own = r["best"].get(head)
                if own is None:
                    continue
                single |= k == 1
                total = best[q] + self.scores[own]
                if total > best[q + k]:
                    best[q + k], came[q + k], piece[q + k] = total, k, own
            if not single and best[q] + r["lost"] > best[q + 1]:
                best[q + 1], came[q + 1], piece[q + 1] = best[q] + r["lost"], 1, -1 - ord(text[q])
        return best, came, piece

    def trace(self, came: list[int], piece: list[int], at: int) -> tuple[int, list[int]]:
        """The entry place and the ids of the best path that ends at ``at``."""
        ids = []
        while came[at]:
            ids.append(piece[at])
            at -= came[at]
        return at, ids[::-1]

    def cuts(self, text: str) -> np.ndarray:
        """Inner places of a text that no piece can span."""
        return np.flatnonzero(~self.prepare()._ready["inside"][_pair_slots(_points(text))]) + 1

    # --- texts ---------------------------------------------------------------------------

    def escaped(self, text: str) -> str:
        return (BLANK if self.dummy_prefix and text else "") + text.replace(" ", BLANK)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Escaped texts: all ids, the bounds of each text's ids, and the scores."""
        r = self.prepare()._ready
        joined = "".join(texts)
        points = _points(joined)
        ends = np.cumsum([0, *map(len, texts)])
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64), np.zeros(len(texts))
        border = np.ones(len(points) + 1, bool)
        border[1:-1] = ~r["inside"][_pair_slots(points)]
        border[ends] = True
        at = np.flatnonzero(border)
        # The segments as strings over the joined text's bytes, so that equal ones are found quickly.
        bytes_at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        data = pa.py_buffer(joined.encode("utf-8", "surrogatepass"))
        offsets = pa.py_buffer(bytes_at[at].astype(np.int32))
        segments = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, offsets, data]).dictionary_encode()
        which = segments.indices.to_numpy()
        first = np.zeros(len(segments.dictionary), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        begin, size = at[:-1][first], np.diff(at)[first]
        scores, steps, ids = self._solve(joined, points, begin, size)
        starts = np.cumsum(steps) - steps
        count = steps[which]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        flat = ids[np.repeat(starts[which], count) + nth]
        own = np.searchsorted(at, ends)  # segment numbers of the texts' borders
        bounds = np.concatenate([[0], np.cumsum(count)])[own]
        totals = np.concatenate([[0.0], np.cumsum(scores[which])])
        flat, bounds = self._bytes(flat, bounds)
        return flat.astype(np.int32), bounds, totals[own[1:]] - totals[own[:-1]]

    def _solve(self, joined: str, points: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """Paths of distinct segments, in their order."""
        scores, steps = np.zeros(len(size)), np.zeros(len(size), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # segment number of each id, ids
        for low, high in ((0, 8), (8, 16), (16, _SHORT)):
            some = np.flatnonzero((size > low) & (size <= high))
            for k in range(0, len(some), _LANES):
                few = some[k : k + _LANES]
                scores[few], steps[few], ids = self.solve_short(points, begin[few], size[few])
                parts.append((np.repeat(few, steps[few]), ids))
        for i in np.flatnonzero(size > _SHORT).tolist():
            text = joined[begin[i] : begin[i] + size[i]]
            best, came, piece = self.forward(text, [0.0], len(text))
            ids = np.array(self.trace(came, piece, len(text))[1], np.int64)
            scores[i], steps[i] = best[-1], len(ids)
            parts.append((np.full(len(ids), i), ids))
        owner, ids = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, int))
        return scores, steps, ids[np.argsort(owner, kind="stable")]

    def _bytes(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters become their bytes, or the unknown id."""
        r = self._ready
        lost = np.flatnonzero(flat < 0)
        if not len(lost):
            return flat, bounds
        if not r["bytes"]:
            return np.where(flat < 0, r["unknown"], flat), bounds
        spelled = [[r["byte_ids"][b] for b in chr(-1 - int(x)).encode("utf-8", "surrogatepass")] for x in flat[lost]]
        times = np.ones(len(flat), np.int64)
        times[lost] = [len(s) for s in spelled]
        grown = np.repeat(flat, times)
        grown[np.repeat(flat < 0, times)] = np.array([i for s in spelled for i in s], np.int64)
        return grown, np.concatenate([[0], np.cumsum(times)])[bounds]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of id lists; bytes that are no UTF-8 become replacement characters."""
        raw = self.prepare()._ready["raw"]
        offsets = ids.offsets
        base = offsets[0].as_py() if len(offsets) else 0
        lists = pa.ListArray.from_arrays(pc.subtract(offsets, base).cast(pa.int32()), raw.take(ids.flatten()))
        joined = pc.binary_join(lists, b"")
        texts = [b.decode("utf-8", "replace").replace(BLANK, " ") for b in joined.to_pylist()]
        return pa.array([t[1:] if self.dummy_prefix and t.startswith(" ") else t for t in texts], pa.string())

    # --- chunks of giant texts -----------------------------------------------------------

    def transfer(self, texts: list[str], sizes: list[int], last: list[bool]) -> list[np.ndarray]:
        """Per chunk text[:size] the best scores from each entry to each exit state; what follows in the text
        is the beginning of the next chunk. The last chunk's only exit state is 0."""
        states = self.longest
        ends = [self._ends(t, n) for t, n in zip(texts, sizes)]
        middle = self.encode([t[e[0] : e[1]] if e else "" for t, e in zip(texts, ends)])[2]
        found = []
        for text, size, final, edge, worth in zip(texts, sizes, last, ends, middle):
            out = np.full((states, states), -np.inf)
            if edge:  # all paths meet at the first and at the last cut
                head, tail = edge
                exits = self._exits(self.forward(text[tail:], [0.0], size - tail)[0], size - tail, final)
                for i in range(min(states, head + 1)):
                    out[i] = self.forward(text[i:head], [0.0], head - i)[0][-1] + worth + exits
            else:
                for i in range(min(states, size + 1)):
                    best = self.forward(text, [-np.inf] * i + [0.0], size)[0]
                    out[i] = self._exits(best, size, final)
            found.append(out)
        return found

    def _ends(self, text: str, size: int) -> tuple[int, int] | None:
        """The first and the last cut inside a chunk."""
        cuts = self.cuts(text[:size]) if size > 1 else ()
        return (int(cuts[0]), int(cuts[-1])) if len(cuts) else None

    def _exits(self, best: list[float], size: int, last: bool) -> np.ndarray:
        exits = np.full(self.longest, -np.inf)
        reach = 1 if last else self.longest
        some = best[size : size + reach]
        exits[: len(some)] = some
        return exits

    def entries(self, text: str, size: int, entry: np.ndarray) -> list[int]:
        """For each exit state the entry state of the best path, or -1."""
        edge = self._ends(text, size)
        start = [float(x) for x in entry[: size + 1]]
        if edge:
            head = edge[0]
            _, came, piece = self.forward(text[:head], start[: head + 1], head)
            return [self.trace(came, piece, head)[0]] * self.longest
        best, came, piece = self.forward(text, start, size)
        return [
            self.trace(came, piece, size + j)[0] if size + j < len(best) and best[size + j] > -np.inf else -1
            for j in range(self.longest)
        ]

    def chunk_ids(self, texts: list[str], sizes: list[int], entry: list[int], leave: list[int]) -> list[np.ndarray]:
        """Per chunk the ids of its pieces between the two states."""
        ends = [self._ends(t, n) for t, n in zip(texts, sizes)]
        # No path leaves an entry state beyond the first cut, so the text up to the last cut is a whole.
        cut = [max(e[1], i) if e else i for e, i in zip(ends, entry)]
        flat, at, _ = self.encode([t[i:c] for t, i, c in zip(texts, entry, cut)])
        found = []
        for k, (text, size, start, out) in enumerate(zip(texts, sizes, cut, leave)):
            _, came, piece = self.forward(text[start : size + out], [0.0], size - start)
            ids = np.array(self.trace(came, piece, size + out - start)[1], np.int64)
            ids = self._bytes(ids, np.array([0, len(ids)]))[0].astype(np.int32)
            found.append(np.concatenate([flat[at[k] : at[k + 1]], ids]))
        return found


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


# --- on Spark -------------------------------------------------------------------------------


def encoded(docs: DataFrame, vocabulary: Vocabulary, text: Column) -> Column:
    """ids, score, the ids' SHA-256 and whether decoding gives the text back, of texts each solved within
    one task. One Python worker does it all for a batch."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(f"struct<{_FOUND}>")
    def encode(texts: pa.Array) -> pa.Array:
        own = shared.value.prepare()
        parts = [pa.array([], _FOUND_TYPE)]
        for _, part in text_slices(texts, _SLICE):
            strings = part.to_pylist()
            flat, at, score = own.encode([own.escaped(t) for t in strings])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
            same = [a == b for a, b in zip(own.decode(lists).to_pylist(), strings)]
            parts.append(pa.StructArray.from_arrays(
                [lists, pa.array(score), _digests(flat, at), pa.array(same, pa.bool_())], names=_FOUND_TYPE.names
            ))
        return pa.concat_arrays(parts)

    return encode(text)


_FOUND = "ids: array<int>, score: double, ids_sha256: string, round_trip: boolean"
_FOUND_TYPE = pa.struct([("ids", pa.list_(pa.int32())), ("score", pa.float64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())])


def _digests(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """SHA-256 of each list of ids as little-endian 32-bit numbers."""
    return pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(at.tolist(), at[1:].tolist())], pa.string())


def decoded(docs: DataFrame, vocabulary: Vocabulary, ids: Column) -> Column:
    """The texts of id lists."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        return shared.value.decode(lists)

    return decode(ids)


def digests(docs: DataFrame, vocabulary: Vocabulary, ids: Column) -> Column:
    """For lists of ids: their SHA-256, and that of the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("struct<ids_sha256: string, decoded_sha256: string>")
    def digest(lists: pa.Array) -> pa.Array:
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
        texts = [hashlib.sha256(t.encode()).hexdigest() for t in shared.value.decode(lists).to_pylist()]
        own = _digests(lists.flatten().to_numpy(), at)
        return pa.StructArray.from_arrays([own, pa.array(texts, pa.string())], names=["ids_sha256", "decoded_sha256"])

    return digest(ids)


def _chunks(texts: DataFrame, vocabulary: Vocabulary, chunk: int) -> DataFrame:
    """(key, nth, size, last, text) of (key, text) rows; a chunk's text goes on into the next chunk."""
    ahead = vocabulary.longest - 1
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def split(batches):
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                whole = shared.value.escaped(text.as_py())
                starts = list(range(0, len(whole), chunk))
                for k in range(0, len(starts), 64):
                    some = starts[k : k + 64]
                    sizes = [min(chunk, len(whole) - s) for s in some]
                    yield pa.RecordBatch.from_pydict({
                        "key": [key.as_py()] * len(some), "nth": pa.array(range(k, k + len(some)), pa.int32()),
                        "size": pa.array(sizes, pa.int32()), "last": [s + chunk >= len(whole) for s in some],
                        "text": [whole[s : s + chunk + ahead] for s in some],
                    })

    return texts.mapInArrow(split, "key string, nth int, size int, last boolean, text string")


def _matrix(value: bytes, states: int) -> np.ndarray:
    return np.frombuffer(value, np.float64).reshape(states, states)


def _entry_scores(matrices: DataFrame, states: int, fan: int) -> DataFrame:
    """(key, nth, entry): the scores at each chunk's entry. Blocks of chunks are multiplied up, the
    blocks' products are scanned, and each block is scanned from its own entry."""
    block = F.floor(F.col("nth") / fan).cast("int").alias("block")

    def product(table: pa.Table) -> pa.Table:
        total = None
        for m in table.sort_by("nth")["m"].to_pylist():
            total = _matrix(m, states) if total is None else max_plus(total, _matrix(m, states))
        return pa.table({"key": table["key"][:1], "block": table["block"][:1], "m": [total.tobytes()]})

    def scan(entry: np.ndarray, ms):
        for m in ms:
            yield entry.tobytes()
            entry = (entry[:, None] + _matrix(m, states)).max(axis=0)

    def over_blocks(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        first = np.full(states, -np.inf)
        first[0] = 0.0
        return pa.table({"key": table["key"], "block": table["block"], "start": list(scan(first, table["m"].to_pylist()))})

    def over_chunks(table: pa.Table) -> pa.Table:
        table = table.sort_by("nth")
        first = np.frombuffer(table["start"][0].as_py(), np.float64)
        return pa.table({"key": table["key"], "nth": table["nth"], "entry": list(scan(first, table["m"].to_pylist()))})

    blocked = matrices.withColumn("block", block)
    products = blocked.groupBy("key", "block").applyInArrow(product, "key string, block int, m binary")
    starts = products.groupBy("key").applyInArrow(over_blocks, "key string, block int, start binary")
    both = blocked.join(starts, ["key", "block"])
    return both.groupBy("key", "block").applyInArrow(over_chunks, "key string, nth int, entry binary")


def _exit_states(maps: DataFrame, fan: int) -> DataFrame:
    """(key, nth, leave): each chunk's exit state, from maps of exit to entry states composed backwards."""
    block = F.floor(F.col("nth") / fan).cast("int").alias("block")

    def compose(table: pa.Table) -> pa.Table:
        total = None
        for m in reversed(table.sort_by("nth")["states"].to_pylist()):
            total = m if total is None else [m[x] if x >= 0 else -1 for x in total]
        return pa.table({"key": table["key"][:1], "block": table["block"][:1], "states": pa.array([total], pa.list_(pa.int32()))})

    def back(state: int, maps: list[list[int]]) -> list[int]:
        found = []
        for m in reversed(maps):
            found.append(state)
            state = m[state]
        return found[::-1]

    def over_blocks(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        return pa.table({"key": table["key"], "block": table["block"], "state": pa.array(back(0, table["states"].to_pylist()), pa.int32())})

    def over_chunks(table: pa.Table) -> pa.Table:
        table = table.sort_by("nth")
        states = back(table["state"][0].as_py(), table["states"].to_pylist())
        return pa.table({"key": table["key"], "nth": table["nth"], "leave": pa.array(states, pa.int32())})

    blocked = maps.select("key", "nth", "states").withColumn("block", block)
    composed = blocked.groupBy("key", "block").applyInArrow(compose, "key string, block int, states array<int>")
    ends = composed.groupBy("key").applyInArrow(over_blocks, "key string, block int, state int")
    return blocked.join(ends, ["key", "block"]).groupBy("key", "block").applyInArrow(over_chunks, "key string, nth int, leave int")


def encode_giants(texts: DataFrame, vocabulary: Vocabulary, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(key, ids, score) of (key, text) rows with distinct keys, by chunks."""
    spark = texts.sparkSession
    states = vocabulary.longest
    if chunk < states:  # a piece may reach into the next chunk only
        raise ValueError(f"chunks need {states} characters at least")
    shared = spark.sparkContext.broadcast(vocabulary)
    chunks = stored(_chunks(texts, vocabulary, chunk), "sp-chunks")

    def transfer(batches):
        for batch in batches:
            for start, part in text_slices(batch.column(4), _SLICE):
                rows = batch.slice(start, len(part))
                ms = shared.value.transfer(part.to_pylist(), rows.column(2).to_pylist(), rows.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:2], rows.column(3), pa.array([m.tobytes() for m in ms], pa.binary())],
                    names=["key", "nth", "last", "m"],
                )

    def entries(batches):
        for batch in batches:
            for start, part in text_slices(batch.column(4), _SLICE):
                rows = batch.slice(start, len(part))
                given = zip(part.to_pylist(), rows.column(2).to_pylist(), rows.column(5).to_pylist())
                maps = [shared.value.entries(t, n, np.frombuffer(e, np.float64)) for t, n, e in given]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:2], rows.column(5), pa.array(maps, pa.list_(pa.int32()))], names=["key", "nth", "entry", "states"]
                )

    def trace(batches):
        for batch in batches:
            for start, part in text_slices(batch.column(4), _SLICE):
                rows = batch.slice(start, len(part))
                size, enter, leave = (rows.column(k).to_pylist() for k in (2, 5, 6))
                ids = shared.value.chunk_ids(part.to_pylist(), size, enter, leave)
                yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(ids, pa.list_(pa.int32()))], names=["key", "nth", "ids"])

    @F.arrow_udf("double")
    def final(entry: pa.Array, m: pa.Array) -> pa.Array:
        rows = zip(entry.to_pylist(), m.to_pylist())
        return pa.array([float((np.frombuffer(e, np.float64) + _matrix(x, states)[:, 0]).max()) for e, x in rows])

    columns = [F.col(c) for c in ("key", "nth", "size", "last", "text")]
    matrices = stored(chunks.mapInArrow(transfer, "key string, nth int, last boolean, m binary"), "sp-matrices")
    scores = _entry_scores(matrices.select("key", "nth", "m"), states, fan)
    ready = chunks.join(scores, ["key", "nth"]).select(*columns, "entry")
    maps = stored(ready.mapInArrow(entries, "key string, nth int, entry binary, states array<int>"), "sp-maps")
    leave = _exit_states(maps, fan)
    states_of = maps.join(leave, ["key", "nth"]).select("key", "nth", F.element_at("states", F.col("leave") + 1).alias("enter"), "leave")
    solved = chunks.join(states_of, ["key", "nth"]).select(*columns, "enter", "leave").mapInArrow(trace, "key string, nth int, ids array<int>")
    whole = solved.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", "ids"))).alias("parts"))
    total = matrices.filter("last").join(maps.select("key", "nth", "entry"), ["key", "nth"]).select("key", final("entry", "m").alias("score"))
    return whole.join(total, "key").select("key", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), "score")


def with_ids(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", found_col: str = "found",
             giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """All rows and columns with a struct added: ids, score, ids_sha256, round_trip. Texts of more than
    ``giant`` characters take the way over chunks; equal ones are solved once."""
    key, sums = free_name(docs, "sha"), free_name(docs, "sums")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    small = docs.filter(F.length(text) <= giant).select(*kept, encoded(docs, vocabulary, text).alias(found_col))
    long = docs.filter(F.length(text) > giant).withColumn(key, F.sha2(text.cast("binary"), 256))
    texts = long.groupBy(F.col(key).alias("key")).agg(F.first(F.col(text_col).cast("string")).alias("text"))
    solved = encode_giants(texts, vocabulary, chunk, fan).withColumn(sums, digests(docs, vocabulary, F.col("ids")))
    found = F.struct("ids", "score", F.col(f"{sums}.ids_sha256").alias("ids_sha256"), (F.col(f"{sums}.decoded_sha256") == F.col("key")).alias("round_trip"))
    solved = solved.select(F.col("key").alias(key), found.alias(found_col))
    return small.unionByName(long.join(solved, key).select(*kept, found_col))


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
                     giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, ids, score, ids_sha256, round_trip for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_ids(rows, vocabulary, giant=giant, chunk=chunk, fan=fan).select("doc_id", "found.*")
