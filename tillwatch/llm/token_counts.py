"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

A byte-level BPE tokenizer first cuts a text into pre-tokens and then encodes each by itself. The
leaves of a document's tree stand for runs of pre-tokens and hold their characters and tokens, inner
nodes hold sums. An edit is located by descending the tree; encoding begins at the leaf with the
second character before the edit and goes on until a new pre-token ends where an old leaf ended. Only
those leaves and the sums above them change. The counts equal those of a full encoding.

Defined results
    null or empty text       0 tokens, a tree of one empty leaf
    edit beyond the text     cut to the text; an end before the start counts as the start
    null insert              nothing is inserted
    edits of equal number    applied by start, end and insert
    repeated ids             every row of the id gets all edits of the id; a null id gets none
    edits without document   left out
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import text_slices

LEAF = 64  # pre-tokens of a leaf
LOOKAHEAD = 2  # characters behind a pre-token that its end depends on
MOST_CACHED = 200_000  # pre-tokens whose counts a worker remembers
# Fixed value: how byte-level BPE vocabularies of this kind cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_COUNTERS: dict[int, "Counter"] = {}


class Counter:
    """Cuts texts and counts the tokens of pre-tokens."""

    def __init__(self, ranks_file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def tokens(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= MOST_CACHED:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n

    def leaves(self, text: str, size: int = LEAF) -> tuple[list[int], list[int]]:
        """Characters and tokens of each run of ``size`` pre-tokens."""
        pieces = self.pattern.findall(text)
        return _runs([len(p) for p in pieces], [self.tokens(p) for p in pieces], size)


def _runs(chars: list[int], tokens: list[int], size: int) -> tuple[list[int], list[int]]:
    starts = range(0, len(chars), size)
    return [sum(chars[i : i + size]) for i in starts], [sum(tokens[i : i + size]) for i in starts]


def counter(ranks_file: bytes) -> Counter:
    """One counter per worker and vocabulary."""
    key = hash(ranks_file)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(ranks_file)
    return _COUNTERS[key]


class Tree:
    """Sums in heap order: node 1 is the root, node k has the children 2k and 2k + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.width = 1 << max(0, len(chars) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        self.chars[self.width : self.width + len(chars)] = chars
        self.tokens[self.width : self.width + len(tokens)] = tokens
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    @classmethod
    def stored(cls, chars: list[int], tokens: list[int]) -> Tree:
        tree = cls.__new__(cls)
        tree.chars, tree.tokens, tree.width = list(chars), list(tokens), len(chars) // 2
        return tree

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if char >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def replace(self, first: int, stop: int, chars: list[int], tokens: list[int], size: int) -> Tree:
        """Put new pre-tokens into the leaves first..stop-1 and renew the sums above them."""
        slots = stop - first
        share = -(-len(chars) // slots)
        if share > 4 * size:  # too many for these leaves: deal all leaves out anew, encode none
            c, t = _runs(chars, tokens, size)
            w = self.width
            whole = [*zip(self.chars[w : w + first], self.tokens[w : w + first]), *zip(c, t),
                     *zip(self.chars[w + stop :], self.tokens[w + stop :])]
            whole = [x for x in whole if x[0]]
            return Tree([x[0] for x in whole], [x[1] for x in whole])
        for slot in range(slots):
            part = slice(slot * share, (slot + 1) * share)
            self.chars[self.width + first + slot] = sum(chars[part])
            self.tokens[self.width + first + slot] = sum(tokens[part])
        low, high = (self.width + first) // 2, (self.width + stop - 1) // 2
        while low:
            for k in range(low, high + 1):
                self._sum(k)
            low, high = low // 2, high // 2
        return self


def edit(tree: Tree, text: str, start: int, stop: int, insert: str, count: Counter, size: int = LEAF):
    """(tree, text, encoded characters) after ``text[start:stop]`` was replaced."""
    start = min(max(0, start), len(text))
    stop = min(max(start, stop), len(text))
    new = text[:start] + insert + text[stop:]
    shift = len(new) - len(text)
    if tree.chars[1] == 0:
        return Tree(*count.leaves(new, size)), new, len(new)
    # Where a pre-token ends depends on two characters behind it at most ('ll, a run of blanks).
    first, begin = tree.leaf_at(max(0, start - LOOKAHEAD))
    # The old leaf ends at or behind the edit are where the two cuts can meet.
    leaf, end = first, begin
    w = tree.width
    while leaf < w and (end < stop or end <= begin):
        end += tree.chars[w + leaf]
        leaf += 1
    chars: list[int] = []
    tokens: list[int] = []
    done = begin
    for match in count.pattern.finditer(new, begin):
        piece = match.group()
        chars.append(len(piece))
        tokens.append(count.tokens(piece))
        done = match.end()
        while leaf < w and done - shift > end:
            end += tree.chars[w + leaf]
            leaf += 1
        if done - shift == end:
            break
    if done == len(new):  # the rest of the old leaves is gone
        leaf = w
    return tree.replace(first, leaf, chars, tokens, size), new, done - begin


# --- on Spark -------------------------------------------------------------------------------


def _read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def build_trees(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, tree_chars, tree_tokens for every row; the counts are ``tree_tokens[1]``."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(_read_file(ranks_path))  # one vocabulary file
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def build(batches):
        count = counter(ranks.value)
        for batch in batches:
            for start, part in text_slices(batch.column(2)):
                trees = [Tree(*count.leaves(t)) for t in part.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(part)), batch.column(1).slice(start, len(part)),
                     pa.array([t.chars for t in trees], pa.list_(pa.int64())),
                     pa.array([t.tokens for t in trees], pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "tree_chars", "tree_tokens"],
                )

    return rows.mapInArrow(build, f"doc_id {kind}, text_key long, tree_chars array<long>, tree_tokens array<long>")


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, ranks_path: str, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id, text, tree_chars, tree_tokens, n_tokens, edited_tokens, edits, encoded_chars for every row.

    ``edits`` has doc_id, number, start, stop, insert; positions count characters of the text as the
    edits before have left it. Edits, trees and texts meet in one shuffle, sorted so that the edits
    and trees of an id are at hand when its texts stream by.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(_read_file(ranks_path))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    longs = "array<long>"
    parts = [
        (0, edits.filter(F.col("doc_id").isNotNull()), F.col("doc_id").cast(kind), F.col("number").cast("long"),
         F.col("start").cast("long"), F.col("stop").cast("long"), F.coalesce(F.col("insert").cast("string"), F.lit("")), none(longs), none(longs)),
        (1, trees.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text_key"]), F.col("doc_id").cast(kind), F.col("text_key"),
         none("long"), none("long"), none("string"), F.col("tree_chars"), F.col("tree_tokens")),
        (2, docs, F.col(id_col), F.xxhash64(text), none("long"), none("long"), text, none(longs), none(longs)),
    ]
    names = ["doc_id", "number", "start", "stop", "text", "chars", "tokens"]
    rows = None
    for order, frame, *columns in parts:
        part = frame.select(F.lit(order).alias("kind"), *[c.alias(n) for n, c in zip(names, columns)])
        rows = part if rows is None else rows.unionByName(part)
    spread = F.coalesce(F.xxhash64(F.when(F.col("doc_id").isNotNull(), F.col("doc_id"))), F.lit(0))
    spread = F.when(F.col("doc_id").isNull(), F.col("number")).otherwise(spread)
    rows = rows.withColumn("spread", spread).repartition("spread")
    rows = rows.sortWithinPartitions("doc_id", "kind", "number", "start", "stop", F.when(F.col("kind") == 0, F.col("text"))).drop("spread")

    def run(batches) -> Iterator[pa.RecordBatch]:
        count = counter(ranks.value)
        current, changes, built = None, [], {}
        for batch in batches:
            for begin, strings in text_slices(batch.column(5)):
                piece = batch.slice(begin, len(strings))
                ids = piece.column(1).to_pylist()
                order, number, start, stop = (piece.column(i).to_pylist() for i in (0, 2, 3, 4))
                out = []
                for k, own in enumerate(ids):
                    if own != current:
                        current, changes, built = own, [], {}
                    if order[k] == 0:
                        changes.append((start[k], stop[k], strings[k].as_py()))
                    elif order[k] == 1:
                        built[number[k]] = (piece.column(6)[k].as_py(), piece.column(7)[k].as_py())
                    else:
                        now = strings[k].as_py()
                        kept = built.get(number[k]) if own is not None else None
                        tree = Tree.stored(*kept) if kept else Tree(*count.leaves(now))
                        before, encoded = tree.tokens[1], 0
                        for change in changes if own is not None else []:
                            tree, now, some = edit(tree, now, *change, count)
                            encoded += some
                        out.append((k, now, tree.chars, tree.tokens, before, tree.tokens[1],
                                    len(changes) if own is not None else 0, encoded))
                if out:
                    where, *columns = zip(*out)
                    types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 4]
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(1).take(pa.array(where)), *[pa.array(list(c), t) for c, t in zip(columns, types)]],
                        names=["doc_id", "text", "tree_chars", "tree_tokens", "n_tokens", "edited_tokens", "edits", "encoded_chars"],
                    )

    return rows.mapInArrow(
        run,
        f"doc_id {kind}, text string, tree_chars array<long>, tree_tokens array<long>, n_tokens long, edited_tokens long, "
        "edits long, encoded_chars long",
    )


def sample_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two edits for every document: its middle is overwritten with its first characters, then a few
    words are put in at a fifth."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = F.length(text)
    middle, fifth = F.floor(n / 2), F.floor(n / 5)
    change = lambda number, start, stop, insert: F.struct(
        F.lit(number).alias("number"), start.alias("start"), stop.alias("stop"), insert.alias("insert")
    )
    both = F.array(
        change(1, middle, middle + 12, F.substr(text, F.lit(1), F.lit(24))),
        change(2, fifth, fifth, F.lit(" put in\n between ")),
    )
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(both).alias("e")).select("doc_id", "e.*")
