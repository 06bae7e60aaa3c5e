"""Helpers of the text operators: stored tables, batches of bounded size, words of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.session import Stored, remove_path

SLICE_BYTES = 4 << 20


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write the frame as parquet below the shared folder and read it back with the same schema.

    Cuts the lineage; unlike cached blocks the files outlive the executors that wrote them. They go with
    the workspace that the job runs in, or by ``forget``.
    """
    own = Stored(df, purpose)
    own.frame.stored_at = own.path
    return own.frame


def forget(df: DataFrame) -> None:
    """Remove the files of a frame that ``stored`` gave and no later step reads."""
    remove_path(df.sparkSession, df.stored_at)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_crc(id_col: Column | str) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Cut a batch of texts into runs of at most ``limit`` bytes (one text at least), with their
    first row. Nulls come out as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts without nulls, A-Z lower-cased: the words of all texts in
    one array, and where each text's words begin in it (one entry more than texts)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.flatten()
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), kept[offsets]


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds; empty stretches give 0."""
    total = np.concatenate([np.zeros((1,) + values.shape[1:], values.dtype), np.cumsum(values, axis=0)])
    return total[bounds[1:]] - total[bounds[:-1]]
