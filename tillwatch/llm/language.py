"""Language identification by rank-order profiles of character n-grams.

Each language's profile is the list of its most frequent letter n-grams (one to three characters,
word edges included). A document's own list is compared with every profile by the out-of-place
distance: for each of its n-grams the difference of the two ranks, or the full list length where
the profile lacks it. The closest profile wins.

Defined results
    null or letterless text   ``und`` with score 0
    no training rows          every document is ``und`` with score 0
    equal n-gram counts       ordered by the n-gram's code points
    equal distances           the language that comes first in the alphabet
    repeated rows             each row is judged by itself
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.llm.common import free_name, id_crc, text_slices

RANKS = 300
UNKNOWN = "und"
MAX_LANGUAGES = 2000
_CODE = 21  # bits of a code point
_SLICE = 1 << 19  # bytes of text that are counted together; their arrays stay in the processor's cache

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))


def count_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, count), ordered by text number and n-gram.

    An n-gram is three code points packed into one integer, 0 for "none" and 1 for a word edge,
    so integers sort like the n-grams' characters. A run of other characters is one word edge.
    """
    empty = np.zeros(0, np.int64)
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\0".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(-1, len(lowered)), [1, *(len(t) + 1 for t in lowered)])
    letter = _letters()[points]
    if not letter.any():
        return empty, empty, empty
    # Letters and the edge right before each word, which is also the edge behind the word before it.
    keep = letter.copy()
    keep[:-1] |= letter[1:] & ~letter[:-1]
    keep[int(np.flatnonzero(letter)[-1]) + 1] = True  # the edge behind the last word
    points, doc, letter = points[keep], doc[keep], letter[keep]
    seen = np.zeros(0x110000, bool)
    seen[points[letter]] = True
    alphabet = np.flatnonzero(seen)
    bits = int(len(alphabet) + 1).bit_length()
    width = 3 * bits + len(texts).bit_length()
    if width > 62 and len(texts) > 1:  # vast alphabets: fewer texts at a time
        half = len(texts) // 2
        a, b = count_grams(texts[:half]), count_grams(texts[half:])
        return np.concatenate([a[0], b[0] + half]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])
    kind = np.uint32 if width <= 32 else np.int64
    table = np.zeros(0x110000, kind)
    table[alphabet] = np.arange(2, len(alphabet) + 2)
    code = np.where(letter, table[points], kind(1))
    d = np.maximum(doc, 0).astype(kind) << kind(3 * bits)
    two = (code[:-1] << kind(bits)) | code[1:]
    whose = np.where(letter[:-1], d[:-1], d[1:])
    three = ((code[:-2] << kind(2 * bits)) | two[1:]) | d[1:-1]
    keys = np.concatenate([(code | d)[letter], two | whose, three[letter[1:-1]]])
    keys.sort()
    keys, counts = _runs(keys)
    keys = keys.astype(np.int64)
    mask = (1 << bits) - 1
    own = np.concatenate([[0, 1], alphabet])
    gram = (own[(keys >> (2 * bits)) & mask] << (2 * _CODE)) | (own[(keys >> bits) & mask] << _CODE) | own[keys & mask]
    return keys >> (3 * bits), gram, counts


def _train_batches(batches):
    for batch in batches:
        for start, part in text_slices(batch.column(1), _SLICE):
            names, which = np.unique(batch.column(0).slice(start, len(part)).to_numpy(zero_copy_only=False).astype(str),
                                     return_inverse=True)
            doc, gram, n = count_grams(part.to_pylist())
            if not len(doc):
                continue
            lang = which[doc]
            order = np.lexsort((gram, lang))
            lang, gram, n = lang[order], gram[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (gram[1:] != gram[:-1])]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[lang[first]]), pa.array(gram[first]), pa.array(np.add.reduceat(n, first))],
                names=["lang", "gram", "n"],
            )


def fit_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", ranks: int = RANKS) -> DataFrame:
    """(lang, gram, place) from all rows with a language and a text; ``place`` counts from 0.

    Counts leave the tasks summed up by language and n-gram, and the cut to the most frequent ones
    is made before the rows of a language meet, so a dominant language is no larger than others.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = rows.mapInArrow(_train_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")
    )
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counted.withColumn("place", F.row_number().over(w) - 1).filter(F.col("place") < ranks).drop("n")


class Profiles:
    """The places of all profiles' n-grams as one table: n-grams down, languages across."""

    def __init__(self, rows, ranks: int = RANKS):
        self.ranks = ranks
        self.langs = sorted({r["lang"] for r in rows})
        self.grams = np.array(sorted({r["gram"] for r in rows}), np.int64)
        self.places = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        column = {lang: i for i, lang in enumerate(self.langs)}
        for r in rows:
            self.places[np.searchsorted(self.grams, r["gram"]), column[r["lang"]]] = r["place"]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names = [UNKNOWN] * len(texts)
        scores = np.zeros(len(texts))
        doc, gram, n = count_grams(texts)
        if not len(doc) or not self.langs:
            return names, scores
        order = np.argsort((doc << 32) - n, kind="stable")
        doc, gram = doc[order], gram[order]
        present, lengths = _runs(doc)
        starts = np.cumsum(lengths) - lengths
        place = np.arange(len(doc)) - np.repeat(starts, lengths)
        top = place < self.ranks
        gram, place, lengths = gram[top], place[top], np.minimum(lengths, self.ranks)
        at = np.searchsorted(self.grams, gram)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        theirs = self.places[at]
        apart = np.where(theirs < 0, self.ranks, np.abs(theirs - place[:, None]))
        total = np.add.reduceat(apart.astype(np.int64), np.cumsum(lengths) - lengths, axis=0)
        best = total.argmin(axis=1)
        scores[present] = 1.0 - total[np.arange(len(best)), best] / (lengths * float(self.ranks))
        for i, b in zip(present.tolist(), best.tolist()):
            names[i] = self.langs[b]
        return names, scores


def load_profiles(profiles: DataFrame, ranks: int = RANKS) -> Profiles:
    """At most ``MAX_LANGUAGES`` lists of ``ranks`` n-grams come to the driver; more are refused."""
    rows = profiles.limit(MAX_LANGUAGES * ranks + 1).collect()
    if len(rows) > MAX_LANGUAGES * ranks:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Profiles(rows, ranks)


def judged(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> Column:
    """A column with the language (``lang``) and the closeness (``score``, 0 to 1) of a text."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf("struct<lang: string, score: double>")
    def judge(texts: pa.Array) -> pa.Array:
        names: list[str] = []
        scores = []
        for _, part in text_slices(texts, _SLICE):
            own, score = shared.value.judge(part.to_pylist())
            names += own
            scores.append(score)
        flat = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(flat)], names=["lang", "score"])

    return judge(F.col(text_col).cast("string"))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(id_crc(id_col) % 4 != 2)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             ranks: int = RANKS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; profiles come from the rows not held out."""
    profiles = load_profiles(fit_profiles(training_rows(docs, id_col), text_col, lang_col, ranks), ranks)
    found = docs.select(
        F.col(id_col).alias("doc_id"), (id_crc(id_col) % 4 == 2).alias("held_out"),
        judged(docs, profiles, text_col).alias("found"),
    )
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def keep_known(docs: DataFrame, min_score: float = 0.0, id_col: str = "doc_id", text_col: str = "text",
               lang_col: str = "lang", ranks: int = RANKS) -> DataFrame:
    """The rows whose text has a language and a score above ``min_score``, with all their columns."""
    profiles = load_profiles(fit_profiles(training_rows(docs, id_col), text_col, lang_col, ranks), ranks)
    found = free_name(docs, "found")
    kept = docs.withColumn(found, judged(docs, profiles, text_col))
    return kept.filter((F.col(f"{found}.lang") != UNKNOWN) & (F.col(f"{found}.score") > min_score)).drop(found)
