"""Spelling variants: words one edit apart are found in a reduced alphabet and verified as they are.

Letters are hashed to a few symbols, so a reduced word has a small one-edit neighbourhood: itself, and
every word with one symbol replaced, deleted or inserted. Two words one edit apart have reduced words at
most one edit apart, so the whole neighbourhood of each reduced word, joined with the reduced
vocabulary, misses no pair; the original strings decide. Neighbourhoods are 64-bit polynomial hashes made
from prefix and suffix sums, linear in a word's length; equal hashes of different words cost a
comparison and never a result. The alphabet grows with the vocabulary, so that reduced words stay rare.

Defined results
    null text            no words
    null id              counts as the empty text in the key of the simulated slips
    repeated rows        count as often as they occur
    ties of a form       the smallest word in code-point order
    no near word         n_near 0, form and form_n null, root the word itself
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.common import forget, stored, text_slices

LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_RATIO = 10
SLIP_EVERY = 31  # one run in so many loses a letter
LETTERS = "A-Za-zÀ-ÿ"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE = 0x9E3779B97F4A7C15 | 1
_SLICE_CHARS = 1 << 16


def _lower_ascii(c: Column) -> Column:
    return F.when(c.rlike("[A-Z]"), F.translate(c, _UPPER, _UPPER.lower())).otherwise(c)


def words_with_slips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                     slip_every: int = SLIP_EVERY) -> DataFrame:
    """(word) for every run of letters that has ``least_length`` code points or more at the end.

    Where crc32 of ``id:run`` is a multiple of ``slip_every``, the run loses the code point at the
    hash modulo its length. A run never grows, so shorter ones need not be looked at.
    """
    pattern = F.lit(f"[{LETTERS}]{{{least_length},}}")
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), pattern, F.lit(0))).alias("run"),
    ).select("id", _lower_ascii(F.col("run")).alias("run"))
    keyed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % slip_every == 0, slipped).otherwise(F.col("run"))
    return keyed.select(word.alias("word")).filter(F.length("word") >= least_length)


def vocabulary(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur often enough; copies of a word shrink before the shuffle."""
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


# --- reduced words and their neighbourhoods ------------------------------------------------


def symbols_for(n_words: int) -> int:
    """Size of the reduced alphabet: about one reduced word of nine symbols per word, four at least."""
    return max(4, math.ceil(max(1, n_words) ** (1 / 9)))


def _symbol_values(symbols: int) -> np.ndarray:
    """A random 64-bit number per symbol, the same in every process."""
    return np.random.default_rng(11).integers(1, 2**63, symbols, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 2, _BASE, np.uint64)
    up[0] = 1
    return np.multiply.accumulate(up), np.uint64(pow(_BASE, -1, 2**64))


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums of the values before each place, modulo 2^64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(33))).view(np.int64)


def _reduced(words: pa.Array, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol numbers of all letters in one array, and where each word begins."""
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    lengths = np.asarray(pc.utf8_length(words)).astype(np.int64)
    return (codes % symbols).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


def reduced_keys(words: pa.Array, symbols: int) -> np.ndarray:
    """64-bit key of each reduced word."""
    sym, at = _reduced(words, symbols)
    lengths = np.diff(at)
    place = np.arange(len(sym)) - np.repeat(at[:-1], lengths)
    power, _ = _powers(int(lengths.max(initial=0)))
    sums = _sums(_symbol_values(symbols)[sym] * power[place])
    return _mixed(sums[at[1:]] - sums[at[:-1]])


def neighbour_keys(words: pa.Array, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the keys of each reduced word's whole one-edit neighbourhood, each word of it once.

    With P the weighted sum of the symbols before a place and Q that of those behind it, a replacement
    adds the difference of two symbols, a deletion divides Q by the base and an insertion multiplies it.
    """
    sym, at = _reduced(words, symbols)
    lengths = np.diff(at)
    value = _symbol_values(symbols)
    power, inverse = _powers(int(lengths.max(initial=0)))
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(sym)) - at[row]
    sums = _sums(value[sym] * power[place])
    whole = sums[at[1:]] - sums[at[:-1]]
    before = sums[:-1] - sums[at[row]]
    after = whole[row] - before
    own = value[sym] * power[place]
    new_run = np.concatenate([[True], (sym[1:] != sym[:-1]) | (row[1:] != row[:-1])]) if len(sym) else np.zeros(0, bool)
    rows, keys = [np.arange(len(lengths)), row[new_run]], [whole, (before + (after - own) * inverse)[new_run]]
    for s in range(symbols):
        other = sym != s  # inserting the symbol in front of its like equals inserting it behind
        put = value[s] * power[place]
        rows += [row[other], row[other], np.arange(len(lengths))]
        keys += [(whole[row] - own + put)[other], (before + put + after * np.uint64(_BASE))[other], whole + value[s] * power[lengths]]
    return np.concatenate(rows), _mixed(np.concatenate(keys))


def _with_keys(vocab: DataFrame, symbols: int) -> DataFrame:
    @F.arrow_udf("long")
    def key(words: pa.Array) -> pa.Array:
        return pa.array(reduced_keys(words, symbols))

    return vocab.withColumn("key", key("word"))


def _neighbourhoods(reduced: DataFrame, symbols: int) -> DataFrame:
    """(own, near) keys for every distinct reduced word, given as one of the words it stands for."""

    def expand(batches):
        for batch in batches:
            for _, part in text_slices(batch.column(0), _SLICE_CHARS):
                own = reduced_keys(part, symbols)
                row, key = neighbour_keys(part, symbols)
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(key)], names=["own", "near"])

    return reduced.mapInArrow(expand, "own long, near long")


def near_pairs(vocab: DataFrame, symbols: int) -> DataFrame:
    """(word, n, other, other_n): all ordered pairs of words that differ by exactly one code point.

    ``vocab``: (word, n, key). The neighbourhood is made once per reduced word; words meet it again by
    its key, and the strings themselves are compared.
    """
    letters = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))
    shape = F.translate("word", letters, "".join(chr(65 + ord(c) % symbols) for c in letters))
    reduced = vocab.groupBy(shape.alias("shape")).agg(F.min("word").alias("word")).select("word")
    near = _neighbourhoods(reduced, symbols)
    other = vocab.select(F.col("key").alias("near"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    own = vocab.select(F.col("key").alias("own"), "word", "n")
    met = near.join(other, "near").join(own, "own")
    close = F.abs(F.length("word") - F.length("other")) <= 1
    met = met.filter(close & (F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
    return met.select("word", "n", "other", "other_n").dropDuplicates(["word", "other"])


# --- forms -----------------------------------------------------------------------------------


def followed(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of words that have a form: ``form`` is followed to its end, over at most ``steps``
    links, by doubling the distance with each join."""
    now = stored(forms.select("word", F.col("form").alias("root")), "forms")
    reach = 1
    while reach < steps:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
        forget(now)
        now, reach = after, 2 * reach
    return now


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                    least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO, slip_every: int = SLIP_EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary."""
    counted = stored(vocabulary(words_with_slips(docs, id_col, text_col, least_length, slip_every), least_count), "words")
    size = counted.agg(F.count("*").alias("words"), F.max("n").alias("most")).first()
    symbols = symbols_for(size["words"])
    vocab = stored(_with_keys(counted, symbols), "keyed-words")
    forget(counted)
    # The other word of largest n, the smallest of equals: the least of (-n, word).
    best = F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other").alias("form")))
    near = near_pairs(vocab, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = vocab.select("word", "n").join(near, "word", "left")
    fits = -F.col("best.rank") >= ratio * F.col("n")
    found = stored(
        found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.form")).alias("form"),
                     F.when(fits, -F.col("best.rank")).alias("form_n")),
        "spellings",
    )
    # Counts grow by the ratio with each link, which bounds their number.
    steps = math.ceil(math.log(max(2, size["most"] or 2), max(2, ratio))) + 1
    roots = followed(found.filter(F.col("form").isNotNull()), steps)
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
