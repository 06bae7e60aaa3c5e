"""SimHash near-dedup: fingerprints are sharded and searched with vantage-point trees.

A tree is built from a sample of the distinct fingerprints. Every fingerprint belongs to one leaf;
it also visits each leaf that may hold a neighbour: with the distance d to a node's vantage point
and the node's radius m, the triangle inequality rules out the inner side where d > m + r and the
outer side where d < m - r + 1. Leaves are shuffled as shards, each is searched with a further tree
of its own, and only a spanning forest of its links leaves it. Links are exact, for any input.

Defined results
    null or wordless text    fingerprint zero, linked like any other
    equal texts              one fingerprint; copies never meet in pairs
    repeated rows            each row gets its fingerprint and component
    null ids                 never name a component while it has another id
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm.common import free_name, stored, text_slices, words_of
from tillwatch.llm.graph import LocalLinks, components

WORDS = 3
RADIUS = 2
LEAF = 4096  # distinct fingerprints aimed at per shard
LOCAL_LEAF = 512
SAMPLE = 16384  # most fingerprints that shape the tree
_SEED = 42
_SLICE = 1 << 20


def shingle_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every text's k-word shingles, and where each text's hashes begin. A text with fewer
    words has one shingle of all its words."""
    words, at = words_of(texts)
    n = np.diff(at)
    whole = len(words) - k + 1
    shingles = np.zeros(0, object)
    starts_ok = np.zeros(0, bool)
    if whole > 0:
        joined = words.slice(0, whole)
        if k > 1:
            joined = pc.binary_join_element_wise(*(words.slice(i, whole) for i in range(k)), " ")
        starts_ok = np.ones(whole, bool)
        for i in range(1, k):  # starts too near to the end of a text
            ends = at[1:] - i
            ends = ends[(ends >= at[:-1]) & (ends < whole)]
            starts_ok[ends] = False
        shingles = joined.filter(pa.array(starts_ok)).cast(pa.binary()).to_numpy(zero_copy_only=False)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, _SEED) for s in shingles), np.uint64, len(shingles))
    short = np.flatnonzero((n > 0) & (n < k))
    count = np.maximum(n - k + 1, 0)
    if len(short):
        extra = [digest(" ".join(words.slice(at[i], n[i]).to_pylist()).encode(), _SEED) for i in short.tolist()]
        before = np.concatenate([[0], np.cumsum(count)])[short]
        hashes = np.insert(hashes, before, np.array(extra, np.uint64))
        count[short] = 1
    return hashes, np.concatenate([[0], np.cumsum(count)])


def majority_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per stretch of hashes a 64-bit number whose bits are set in over half of them."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, bounds[:-1][full], axis=0, dtype=np.int32)
    packed = np.packbits(ones * 2 > n[full][:, None], axis=1)
    out[full] = packed.view(">u8").ravel()
    return out


def fingerprint(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> Column:
    """The SimHash of a text as a signed 64-bit number."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        parts = [majority_bits(*shingle_hashes(part, words)) for _, part in text_slices(texts, _SLICE)]
        return pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64))

    return simhash(F.col(text_col).cast("string"))


# --- the tree ------------------------------------------------------------------------------


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class VantageTree:
    """Vantage points with their median distance. Nodes without a split are the leaves."""

    def __init__(self, sample: np.ndarray, depth: int, smallest: int = 8):
        self.nodes: list[tuple[np.uint64, int, int, int] | int] = []
        self.leaves = 0
        self._grow(np.unique(sample), depth, smallest)

    def _grow(self, points: np.ndarray, depth: int, smallest: int) -> int:
        own = len(self.nodes)
        self.nodes.append(0)
        best = None
        if depth > 0 and len(points) >= smallest:
            tried = points[np.linspace(0, len(points) - 1, 9).astype(int)]
            for p in tried:
                d = distance(points, p)
                m = int(np.median(d))
                inner = d <= m
                if inner.all():
                    m -= 1
                    inner = d <= m
                # A good vantage point leaves few points near the border and halves the rest.
                cost = np.count_nonzero(np.abs(d - m) <= RADIUS) + abs(2 * np.count_nonzero(inner) - len(points))
                if inner.any() and not inner.all() and (best is None or cost < best[0]):
                    best = (cost, p, m, inner)
        if best is None:
            self.nodes[own] = self.leaves
            self.leaves += 1
            return own
        _, p, m, inner = best
        a = self._grow(points[inner], depth - 1, smallest)
        b = self._grow(points[~inner], depth - 1, smallest)
        self.nodes[own] = (p, m, a, b)
        return own

    def route(self, prints: np.ndarray, native: np.ndarray, radius: int):
        """(leaf, row numbers, native) per leaf reached. A native row stays a native of one leaf. It
        visits only inner sides, because a close pair across a border is met there; visitors
        go wherever a native may be close."""
        todo = [(0, np.arange(len(prints)), native)]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            entry = self.nodes[node]
            if isinstance(entry, int):
                yield entry, rows, home
                continue
            p, m, a, b = entry
            d = distance(prints[rows], p)
            inside = d <= m
            go_in = inside | (d <= m + radius)
            go_out = ~inside | (~home & (d > m - radius))
            todo.append((a, rows[go_in], home[go_in] & inside[go_in]))
            todo.append((b, rows[go_out], home[go_out] & ~inside[go_out]))


def shard_links(prints: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links of one shard: (fingerprint, the first one of its group)."""
    links = LocalLinks(len(prints))
    own = np.unique(prints[home])
    depth = max(0, int(np.ceil(np.log2(max(1, len(own)) / LOCAL_LEAF))))
    for _, rows, native in VantageTree(own, depth).route(prints, home, radius):
        _search(prints, rows, native, radius, links)
    linked = np.flatnonzero(links.label != np.arange(len(prints)))
    return prints[linked], prints[links.label[linked]]


def _search(prints: np.ndarray, rows: np.ndarray, native: np.ndarray, radius: int, links: LocalLinks) -> None:
    """Link each native with every row of the shard within the radius, a block at a time."""
    natives = rows[native]
    block = max(1, (1 << 21) // max(1, len(rows)))
    for start in range(0, len(natives), block):
        some = natives[start : start + block]
        u, v = np.nonzero(np.bitwise_count(prints[some][:, None] ^ prints[rows][None, :]) <= radius)
        u, v = some[u], rows[v]
        links.add(u[u != v], v[u != v])


def near_links(distinct: DataFrame, radius: int = RADIUS, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(a, b): links of distinct fingerprints (``fp``) that connect all pairs within the radius.

    The tree's shape comes from a sample of at most about ``sample`` fingerprints; it decides how
    evenly the shards are filled, never which links are found.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    some = max(8, -(-n // sample))
    shape = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(some)) == 0).select("fp").limit(4 * sample).collect()
    points = np.array([r["fp"] for r in shape], np.int64).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    tree = spark.sparkContext.broadcast(VantageTree(points, depth))

    def route(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for shard, rows, home in tree.value.route(prints, np.ones(len(prints), bool), radius):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), shard, np.int32)), pa.array(prints[rows].view(np.int64)), pa.array(home)],
                    names=["shard", "fp", "home"],
                )

    def search(table: pa.Table) -> pa.Table:
        prints = table["fp"].to_numpy().astype(np.int64).view(np.uint64)
        a, b = shard_links(prints, table["home"].to_numpy().astype(bool), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    shards = distinct.select("fp").mapInArrow(route, "shard int, fp long, home boolean")
    return shards.groupBy("shard").applyInArrow(search, "a long, b long")


def print_groups(prints: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """From (doc_id, fp) rows: (fp, root, component_id) per distinct fingerprint. ``root`` is the same for a
    whole group; component_id is its smallest id, over links of at most ``radius`` differing bits."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(near_links(distinct, radius, leaf)).select(F.col("node").alias("fp"), "root")
    joined = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    prints = stored(docs.select(F.col(id_col).alias("doc_id"), fingerprint(docs, text_col, words).alias("fp")), "simhash")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(print_groups(prints, radius), "fp").select("doc_id", shown.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
               radius: int = RADIUS) -> DataFrame:
    """One row of each group stays: the one with the smallest id. Of rows that repeat both id and text
    one stays as well. All columns are kept as they are."""
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    prints = docs.select(
        F.col(id_col).alias("doc_id"), key.alias("key"), fingerprint(docs, text_col, words).alias("fp")
    )
    prints = stored(prints, "simhash")
    groups = print_groups(prints, radius).withColumnRenamed("component_id", "first")
    return kept_rows(docs, prints, groups, id_col, text_col)


def kept_rows(docs: DataFrame, prints: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``keep_first``, from (doc_id, key, fp) of every row and (fp, root, first) of every fingerprint."""
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    grouped = prints.join(groups, "fp")
    chosen = grouped.filter(F.col("doc_id").eqNullSafe(F.col("first")))
    chosen = chosen.groupBy("root", "doc_id", "key").agg(F.count("*").alias("times"))
    w = Window.partitionBy("root").orderBy("key")  # more than one row only where ids repeat
    chosen = chosen.withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("doc_id", "key", "times")
    own, times, found = (free_name(docs, n) for n in ("key", "times", "found"))
    chosen = chosen.select(F.col("doc_id").alias(found), F.col("key").alias(own), F.col("times").alias(times))
    marked = docs.withColumn(own, key)
    kept = marked.join(chosen, (marked[own] == chosen[own]) & marked[id_col].eqNullSafe(chosen[found])).drop(chosen[own])
    single = kept.filter(F.col(times) == 1)
    repeated = kept.filter(F.col(times) > 1).dropDuplicates([own, id_col])
    return single.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
