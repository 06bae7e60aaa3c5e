"""Regression trees over binned rows: the algorithm of Spark's random forest, each tree grown in one task.

Spark makes jobs of the nodes of a level, and gathers statistics of every node and bin in each task; deep trees over few rows are
then mostly such overhead. Here the rows are binned and counted by (cell, label), a cell being the bins of all columns. A tree's
bag is drawn per row (Poisson, mean 1) and summed by cell, so a task holds the distinct cells of a tree, not the rows.

    thresholds      between values at about equal ranks of all rows, every gap where a column has few values
    split           the greatest gain in variance over all columns; the first column and lowest threshold of equal ones
    leaf            no gain, equal labels, the deepest level, or a child with too few rows
    repeated rows   each is drawn by itself
    empty bag       a leaf with the mean of all labels
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = 2048  # of a column's values that the thresholds are chosen from, per partition
SUMMED = 1 << 18  # rows that are summed up in these at a time
DRAWS = 1 << 20  # of bags that a task makes at a time
EVEN = 1e-12  # of the label's variance; less than that is rounding
TREE = "tree int, nodes int, importances array<double>, feature binary, cut binary, left binary, value binary"
DETAIL = "count binary, impurity binary, gain binary"


@dataclass(frozen=True)
class Growth:
    """Number of trees and the limits of each."""

    trees: int
    depth: int
    bins: int
    leaf_rows: int
    seed: int


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows x width from an array of lists of equal length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def binned(x: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """width x rows: how many thresholds lie below each value. ``x <= thresholds[i]`` is the same as a number of at most i."""
    return np.stack([np.searchsorted(t, x[:, f]) for f, t in enumerate(thresholds)]).astype(np.int16)


# --- thresholds ---------------------------------------------------------------------------


def between(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` thresholds between sorted distinct values, with about equal counts between them."""
    middle = values[:-1] + (values[1:] - values[:-1]) / 2
    middle = np.where(middle < values[1:], middle, values[:-1])
    if len(middle) < bins:
        return middle
    stride, found = counts.sum() / bins, []
    below = np.cumsum(counts)
    for i in range(1, len(values)):
        target = stride * (len(found) + 1)
        if abs(below[i - 1] - target) < abs(below[i] - target):
            found.append(i - 1)
    return middle[found[: bins - 1]]


def summary(values: np.ndarray, counts: np.ndarray, most: int = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and their counts; of more than ``most`` those at about equal ranks, with the counts up to them."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    last = np.flatnonzero(np.append(values[1:] != values[:-1], True)) if len(values) else np.zeros(0, int)
    values, below = values[last], np.cumsum(counts)[last]
    if len(values) > most:
        kept = np.unique(np.append(np.searchsorted(below, below[-1] * np.arange(1, most) / most), [0, len(values) - 1]))
        values, below = values[kept], below[kept]
    return values, np.diff(below, prepend=0)


def find_thresholds(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """From all rows of (x, y). The driver gets at most about ``RANKS`` values per column and partition."""

    def ranked(batches):
        kept = [(np.zeros(0), np.zeros(0, np.int64))] * width
        waiting, n = [], 0
        merge = lambda: [
            summary(np.concatenate([v, *[x[:, f] for x in waiting]]), np.concatenate([c, np.ones(n, np.int64)])) for f, (v, c) in enumerate(kept)
        ]
        for batch in batches:
            waiting.append(matrix(batch.column(0), width))
            n += batch.num_rows
            if n >= SUMMED:
                kept = merge()
                waiting, n = [], 0
        kept = merge()
        column = np.repeat(np.arange(width, dtype=np.int32), [len(v) for v, _ in kept])
        parts = [pa.array(column), *[pa.array(np.concatenate(part)) for part in zip(*kept)]]
        yield pa.RecordBatch.from_arrays(parts, names=["f", "v", "n"])

    table = rows.select("x").mapInArrow(ranked, "f int, v double, n long").toArrow()
    column, value, n = (table[name].to_numpy() for name in ("f", "v", "n"))
    return [between(*summary(value[column == f], n[column == f], len(value) + 1), bins) for f in range(width)]


# --- one tree -----------------------------------------------------------------------------


def grow(codes: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray, depth: int, leaf_rows: int = 1) -> dict[str, np.ndarray]:
    """A tree over cells: ``codes`` is width x cells, the others hold each cell's rows, sum of labels and sum of squares.

    All nodes of a level are split together. For each column the cells stand in the order of (node, code), so the
    sums left of every threshold are differences of running sums; a split moves the cells of each node into two runs.
    """
    width, cells = codes.shape
    most = max(1, 2 * cells)
    out = {
        "feature": np.full(most, -1, np.int8), "cut": np.zeros(most, np.int16), "left": np.full(most, -1, np.int32),
        "gain": np.full(most, -1.0), **{k: np.zeros(most) for k in ("count", "sum", "impurity")},
    }
    spread = lambda n, s, q: np.maximum(q / np.maximum(n, 1) - (s / np.maximum(n, 1)) ** 2, 0)
    out["count"][0], out["sum"][0], out["impurity"][0] = n.sum(), s.sum(), spread(n.sum(), s.sum(), q.sum())
    least = EVEN * out["impurity"][0]
    order = [np.argsort(c, kind="stable").astype(np.int32) for c in codes]
    ids, lengths, nodes = np.zeros(1, np.int64), np.array([cells]), 1
    if cells < 2 or out["impurity"][0] <= least:
        ids = ids[:0]
    for _ in range(depth):
        if not len(ids):
            break
        starts = np.cumsum(lengths) - lengths
        node = np.repeat(np.arange(len(ids)), lengths)
        same = node[1:] == node[:-1]
        all_n, all_s = out["count"][ids], out["sum"][ids]
        best, best_f, best_cut = np.full(len(ids), -1.0), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int16)
        for f in range(width):
            code = codes[f].take(order[f])
            edge = np.flatnonzero((code[1:] != code[:-1]) & same)
            if not len(edge):
                continue
            of = node[edge]
            run_n, run_s = (np.concatenate([[0], np.cumsum(v.take(order[f]))]) for v in (n, s))
            left_n, left_s = run_n[edge + 1] - run_n[starts][of], run_s[edge + 1] - run_s[starts][of]
            right_n, right_s = all_n[of] - left_n, all_s[of] - left_s
            score = left_s * left_s / left_n + right_s * right_s / right_n
            if leaf_rows > 1:
                score[(left_n < leaf_rows) | (right_n < leaf_rows)] = -2.0
            first = np.flatnonzero(np.diff(of, prepend=-1))
            top = np.maximum.reduceat(score, first)
            at = np.flatnonzero(score == np.repeat(top, np.diff(first, append=len(of))))
            at = at[np.diff(of[at], prepend=-1) != 0]  # the lowest threshold of equal ones
            better = top > best[of[first]] * (1 + EVEN)  # columns whose gains differ by rounding count as equal
            these = of[first][better]
            best[these], best_f[these], best_cut[these] = top[better], f, code[edge[at[better]]]
        gain = (best - all_s * all_s / all_n) / all_n  # below 0 where no threshold was found
        split = gain > least
        if not split.any():
            break
        made = int(split.sum())
        own = ids[split]
        out["feature"][own], out["cut"][own], out["gain"][own] = best_f[split], best_cut[split], gain[split]
        out["left"][own] = nodes + 2 * np.arange(made)

        kept = split[node]
        rank = (np.cumsum(split) - 1)[node[kept]]
        there = order[0][kept]
        right = np.zeros(cells, bool)
        right[there] = codes[best_f[split][rank], there] > best_cut[split][rank]
        size = np.bincount(rank, minlength=made)
        begin = (np.cumsum(size) - size)[rank]
        to_left = size - np.bincount(rank[right[there]], minlength=made)
        lengths = np.stack([to_left, size - to_left], axis=1).ravel()
        starts = np.cumsum(lengths) - lengths
        nth = np.arange(len(rank)) - begin
        for f in range(width):
            o = order[f][kept]
            r = right[o]
            run = np.cumsum(r) - r
            before = run - run[begin]
            moved = np.empty_like(o)
            moved[starts[2 * rank + r] + np.where(r, before, nth - before)] = o
            order[f] = moved
        ids = nodes + np.arange(2 * made)
        nodes += 2 * made
        sums = [np.add.reduceat(v.take(order[0]), starts) for v in (n, s, q)]
        out["count"][ids], out["sum"][ids], out["impurity"][ids] = sums[0], sums[1], spread(*sums)
        going = (lengths > 1) & (out["impurity"][ids] > least)
        cells_going = np.repeat(going, lengths)
        order = [o[cells_going] for o in order]
        ids, lengths = ids[going], lengths[going]
    out["value"] = out["sum"] / np.maximum(out["count"], 1)
    return {k: v[:nodes] for k, v in out.items()}


def add_predictions(trees: list[tuple], codes: np.ndarray) -> np.ndarray:
    """The sum of all trees' values for each row of ``codes`` (width x rows); equal rows are looked up once."""
    width, rows = codes.shape
    total = np.zeros(0)
    if rows:
        flat, back = np.unique(codes.T, axis=0, return_inverse=True)
        rows, flat = len(flat), flat.ravel()
        total = np.zeros(rows)
        for feature, cut, left, value in trees:
            at, going = np.zeros(rows, np.int32), np.arange(rows)
            while len(going):
                here = at[going]
                f = feature[here]
                inner = f >= 0
                going, here, f = going[inner], here[inner], f[inner]
                at[going] = left[here] + (flat[going * width + f] > cut[here])
            total += value[at]
        total = total[back.ravel()]
    return total


def unpacked(table: pa.Table, kinds: dict[str, type]) -> list[tuple]:
    """The arrays of each tree of a table."""
    columns = [[np.frombuffer(v.as_py(), kind) for v in table[name]] for name, kind in kinds.items()]
    return list(zip(*columns))


KINDS = {"feature": np.int8, "cut": np.int16, "left": np.int32, "value": np.float64}
DETAIL_KINDS = {"count": np.float64, "impurity": np.float64, "gain": np.float64}


# --- a forest -----------------------------------------------------------------------------


def cells_of(rows: DataFrame, thresholds: list[np.ndarray], centre: float) -> DataFrame:
    """(cell, label, m): how many of the rows (x, y) have these bins and this label, which is counted from ``centre``."""
    width = len(thresholds)
    place = np.cumprod([1, *[len(t) + 1 for t in thresholds]])[:width]

    def code(batches):
        for batch in batches:
            cell = place @ binned(matrix(batch.column(0), width), thresholds)
            label = batch.column(1).to_numpy(zero_copy_only=False) - centre
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(label)], names=["cell", "label"])

    return rows.select("x", "y").mapInArrow(code, "cell long, label double").groupBy("cell", "label").agg(F.count("*").alias("m"))


def trees_of(cells: DataFrame, thresholds: list[np.ndarray], centre: float, size: Growth, task_rows: int, detail: bool) -> DataFrame:
    """A row per tree, as ``TREE`` has it. ``cells`` are stored rows as of ``cells_of``.

    The bags are drawn where a cell's rows stand together, in their order, so a retried task draws the same. A cell with more
    rows than a task takes is dealt out by label. Nodes are numbered by level; a right child follows its left one.
    """
    width = len(thresholds)
    bases = [len(t) + 1 for t in thresholds]
    crowded = cells.groupBy("cell").agg(F.count("*").alias("_n")).filter(F.col("_n") > task_rows)
    dealt = cells.join(crowded, "cell", "left").withColumn(
        "_salt", F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("label"), F.ceil(F.col("_n") / task_rows))).otherwise(0))
    parts = max(1, -(-cells.count() // task_rows))
    dealt = dealt.select("cell", "label", "m", "_salt").repartition(parts, "cell", "_salt").sortWithinPartitions("cell", "label")

    def draw(batches):
        rng = np.random.default_rng([size.seed, TaskContext.get().partitionId()])
        for batch in batches:
            cell, label, m = (batch.column(i).to_numpy() for i in range(3))
            if not len(cell):
                continue
            start = np.flatnonzero(np.diff(cell, prepend=-1))
            step = max(1, DRAWS // len(cell))
            for first in range(0, size.trees, step):
                k = min(step, size.trees - first)
                w = rng.poisson(m if (m > 1).any() else 1, (k, len(cell)))
                n = np.add.reduceat(w, start, axis=1)
                s, q = (np.add.reduceat(w * v, start, axis=1) for v in (label, label * label))
                drawn = [np.flatnonzero(v) for v in n]
                blobs = [[v[i][some].tobytes() for i, some in enumerate(drawn)] for v in (n, s, q)]
                own = [cell[start][some].tobytes() for some in drawn]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first, first + k, dtype=np.int32)), *[pa.array(v, pa.binary()) for v in (own, *blobs)]],
                    names=["tree", "cell", "n", "s", "q"],
                )

    def fit(table: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.concatenate([np.frombuffer(v.as_py(), kind) for v in table[name]])
        cell, n, s, q = (joined(*c) for c in (("cell", np.int64), ("n", np.int64), ("s", np.float64), ("q", np.float64)))
        order = np.lexsort((q, s, cell))  # sums do not depend on the order in which bags arrive
        cell = cell[order]
        start = np.flatnonzero(np.diff(cell, prepend=-1))
        n, s, q = (np.add.reduceat(v[order], start).astype(np.float64) if len(start) else np.zeros(0) for v in (n, s, q))
        codes, left = np.empty((width, len(start)), np.int16), cell[start]
        for f, base in enumerate(bases):
            left, codes[f] = np.divmod(left, base)
        tree = grow(codes, n, s, q, size.depth, size.leaf_rows)
        tree["value"] += centre
        inner = tree["feature"] >= 0
        share = np.bincount(tree["feature"][inner], (tree["gain"] * tree["count"])[inner], width)
        share = share / share.sum() if inner.any() else share
        kinds = KINDS | (DETAIL_KINDS if detail else {})
        return pa.table({
            "tree": table["tree"].slice(0, 1), "nodes": pa.array([len(inner)], pa.int32()), "importances": pa.array([share.tolist()], pa.list_(pa.float64())),
            **{k: pa.array([tree[k].astype(kind).tobytes()], pa.binary()) for k, kind in kinds.items()},
        })

    bags = dealt.select("cell", "label", "m").mapInArrow(draw, "tree int, cell binary, n binary, s binary, q binary")
    schema = f"{TREE}, {DETAIL}" if detail else TREE
    return bags.repartition(size.trees, "tree").groupBy("tree").applyInArrow(fit, schema)


def spark_nodes(trees: DataFrame, thresholds: list[np.ndarray]) -> DataFrame:
    """The nodes as Spark stores those of an ensemble, from rows of ``TREE`` and ``DETAIL``."""
    names = [*KINDS, *DETAIL_KINDS]
    kinds = KINDS | DETAIL_KINDS
    longest = max(1, *[len(t) for t in thresholds])
    levels = np.stack([np.append(t, np.zeros(longest - len(t))) for t in thresholds])
    split = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])

    def nodes(batches):
        for batch in batches:
            for number, *blobs in zip(batch.column(0).to_pylist(), *[batch.column(i).to_pylist() for i in range(1, len(names) + 1)]):
                v = {k: np.frombuffer(b, kinds[k]) for k, b in zip(names, blobs)}
                feature, inner, size = v["feature"].astype(np.int32), v["feature"] >= 0, len(v["feature"])
                total, squares = v["value"] * v["count"], (v["impurity"] + v["value"] ** 2) * v["count"]
                stats = np.stack([v["count"], total, squares], axis=1).ravel()
                some = levels[feature[inner], v["cut"][inner]]
                cuts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(inner)]), pa.int32()), pa.array(some))
                node = {
                    "id": pa.array(np.arange(size), pa.int32()), "prediction": pa.array(v["value"]), "impurity": pa.array(v["impurity"]),
                    "impurityStats": pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * size + 1, 3), pa.int32()), pa.array(stats)),
                    "rawCount": pa.array(v["count"].astype(np.int64)), "gain": pa.array(v["gain"]), "leftChild": pa.array(v["left"]),
                    "rightChild": pa.array(np.where(inner, v["left"] + 1, -1), pa.int32()),
                    "split": pa.StructArray.from_arrays([pa.array(feature), cuts, pa.array(np.full(size, -1), pa.int32())], fields=list(split)),
                }
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, number), pa.int32()), pa.StructArray.from_arrays(list(node.values()), names=list(node))],
                    names=["treeID", "nodeData"],
                )

    return trees.select("tree", *names).mapInArrow(
        nodes,
        "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
        "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, "
        "numCategories: int>>",
    )
