"""Language-model scoring: a causal attention model over subword ids, beside a word-count baseline.

A text is its lower-cased words, each spelled in subword pieces, and one end. A piece that ends a word and
the same piece inside a word are two symbols, so no spelling is the beginning of another one and the
products over the symbols of all words sum to at most 1. Symbols fall into classes: the frequent ones
have a class of their own, the others share classes of about equal weight. The attention model
gives the class after a context, and the counts of all training texts give the symbol within its class.

The model's probability of a word that training texts hold is the mean of that product and of the word-count
estimate. The count estimate of all other words together is one small number, so it is dealt to them by
their products: such a word has the product times the mean of 1 and that number. Over all
next words and the end these probabilities sum to at most 1. The score is the sum of their logarithms.

Word and piece counts cover every training document, and the network is fitted on all their windows. A hash of
doc_id and window number deals them to the rounds: each window is gone through in one round at least, in every
one where the corpus is small. Tasks fit parts of a round side by side, and the weights are averaged
after it.

Defined results
    null or empty text     the end alone is scored
    word without pieces    spelled by the vocabulary's unknown piece
    no training rows       every count is 0; the network keeps its first weights
    repeated rows          each row is scored, and counts in training
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tillwatch.llm.attention import Attention
from tillwatch.llm.common import forget, id_crc, stored, text_slices, words_of

CLASSES = 256
SHARED_CLASSES = 32
FIT_WORDS = 128  # words of a window that the network is fitted on
FIT_DOCUMENTS = 4096  # windows of a round at least, where there are so many
FIT_PART = 1024  # windows that one task goes through in a round
FREQUENT_WORDS = 200_000  # words whose counts and spellings are broadcast; the others are joined
SMALL = 0.1
_LOG2 = np.log2(10)
_SLICE = 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACES = 1 << 31  # of draws on the circle that the rounds share

_SPELLERS: dict[int, SentencePieceProcessor] = {}


class Speller:
    """Spells words in symbols: piece numbers, raised by the number of pieces where the word ends; the text's
    end is the number after them all."""

    def __init__(self, model_file: bytes):
        self.model = model_file

    @property
    def own(self) -> SentencePieceProcessor:
        key = hash(self.model)
        if key not in _SPELLERS:
            _SPELLERS[key] = SentencePieceProcessor(model_proto=self.model)
        return _SPELLERS[key]

    @property
    def end(self) -> int:
        return 2 * self.own.get_piece_size()

    def spell(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All symbols of all words, and how many each word has."""
        unknown = [self.own.unk_id()]
        ids = self.own.encode(words.to_numpy(zero_copy_only=False).tolist(), num_threads=1) if len(words) else []
        ids = [word or unknown for word in ids]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for word in ids for i in word), np.int32, int(n.sum()))
        flat[np.cumsum(n) - 1] += self.own.get_piece_size()
        return flat, n

    def spell_some(self, words: pa.Array, found: np.ndarray, flat: np.ndarray, n: np.ndarray):
        """(flat, n, starts) of words of which those with a number in ``found`` are spelled already."""
        new = np.flatnonzero(found < 0)
        more, m = self.spell(words.take(pa.array(new)))
        own, starts = n[found], (np.cumsum(n) - n)[found]
        own[new], starts[new] = m, len(flat) + np.cumsum(m) - m
        return np.concatenate([flat, more]), own, starts

    def texts(self, words: pa.DictionaryArray, at: np.ndarray, spelled=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of whole texts with their ends, the bounds of the texts, and where each word begins
        when the ends are left out. ``spelled`` is what ``spell_some`` gives for the dictionary."""
        if spelled is None:
            flat, n = self.spell(words.dictionary)
            spelled = flat, n, np.cumsum(n) - n
        flat, n, starts = spelled
        which = words.indices.to_numpy()
        count = n[which] if len(which) else np.zeros(0, np.int64)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pieces = flat[np.repeat(starts[which], count) + nth] if len(which) else np.zeros(0, np.int32)
        bounds = np.concatenate([[0], np.cumsum(count)])[at]
        out = np.insert(pieces, bounds[1:], self.end)
        return out, bounds + np.arange(len(bounds)), np.cumsum(count) - count


def piece_classes(counts: np.ndarray, classes: int = CLASSES, shared: int = SHARED_CLASSES, end: int | None = None):
    """(class of each piece, natural log of its share within the class)."""
    order = np.argsort(-counts, kind="stable")
    own = classes - shared
    of = np.zeros(len(counts), np.int64)
    of[order[:own]] = np.arange(min(own, len(order)))
    rest = order[own:]
    if len(rest):
        weight = np.cumsum(counts[rest] + SMALL)
        of[rest] = own + np.minimum(shared - 1, (weight - weight[0]) * shared // weight[-1]).astype(np.int64)
    if end is not None and of[end] >= own:  # the end is always a class of its own
        other = order[own - 1]
        of[end], of[other] = of[other], of[end]
    share = counts + SMALL
    return of, np.log(share / np.bincount(of, share, classes)[of])


def count_words(train: DataFrame) -> DataFrame:
    """(word, c) over (text) rows; tasks send one row per word they met."""

    def count(batches):
        for batch in batches:
            for _, part in text_slices(batch.column(0), _SLICE):
                words, _ = words_of(part)
                if len(words):
                    coded = words.dictionary_encode()
                    n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                    yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n)], names=["word", "n"])

    return train.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def count_pieces(words: DataFrame, speller: Speller) -> np.ndarray:
    """How often each piece occurs, from (word, c) rows; one number per piece comes to the driver."""
    shared = words.sparkSession.sparkContext.broadcast(speller)

    def spell(batches):
        for batch in batches:
            flat, n = shared.value.spell(batch.column(0))
            times = np.repeat(batch.column(1).to_numpy(), n)
            total = np.bincount(flat, times, shared.value.end) if len(flat) else np.zeros(0)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], names=["piece", "n"])

    rows = words.mapInArrow(spell, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(speller.end + 1)
    for r in rows:
        counts[r["piece"]] = r["n"]
    return counts


def drawn_windows(train: DataFrame, speller: Speller, of: np.ndarray, share: float, known: pa.Array | None = None) -> DataFrame:
    """(draw, symbols) of the windows of ``FIT_WORDS`` words that the hash of doc_id and window number draws,
    from (doc_id, text) rows. The end belongs to a text's last window. The words in ``known`` are spelled once."""
    known = pa.array([], pa.string()) if known is None else known
    shared = train.sparkSession.sparkContext.broadcast((speller, of, known, *speller.spell(known)))
    below = np.uint64(min(2**64 - 1, int(share * 2**64)))

    def draw(batches):
        speller, of, known, known_flat, known_n = shared.value
        known_n = np.append(known_n, 0)  # the last one stands for words that are not known
        for batch in batches:
            ids = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            for start, part in text_slices(batch.column(1), _SLICE):
                words, at = words_of(part)
                count = np.maximum(1, -(-np.diff(at) // FIT_WORDS))
                text = np.repeat(np.arange(len(part)), count)
                nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
                mixed = ids[start : start + len(part)][text] + (nth + 1).astype(np.uint64) * _MIX
                mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                mixed ^= mixed >> np.uint64(31)
                some = np.flatnonzero(mixed <= below)
                if not len(some):
                    continue
                text, nth, last = text[some], nth[some], nth[some] == count[text[some]] - 1
                first = at[:-1][text] + nth * FIT_WORDS
                n = np.minimum(at[1:][text] - first, FIT_WORDS)
                bounds = np.concatenate([[0], np.cumsum(n)])
                place = np.repeat(first - bounds[:-1], n) + np.arange(bounds[-1])
                coded = words.take(pa.array(place)).dictionary_encode()
                number_of = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy()
                flat, own, _ = speller.texts(coded, bounds, speller.spell_some(coded.dictionary, number_of, known_flat, known_n))
                kept = np.ones(len(flat), bool)
                kept[own[1:][~last] - 1] = False
                at_kept = np.concatenate([[0], np.cumsum(kept)])[own]
                symbols = pa.ListArray.from_arrays(pa.array(at_kept, pa.int32()), pa.array(of[flat[kept]], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(mixed[some].view(np.int64)), symbols], names=["draw", "symbols"])

    rows = train.select(F.xxhash64("doc_id"), "text")
    return rows.mapInArrow(draw, "draw long, symbols array<int>")


def fit_network(train: DataFrame, speller: Speller, of: np.ndarray, windows: int, documents: int = FIT_DOCUMENTS,
                rounds: int = 4, part: int = FIT_PART, known: pa.Array | None = None, **sizes) -> Attention:
    """Fit the class model on all windows of the training texts, about ``windows`` or fewer. A round goes through an equal share
    of them, or through about ``documents`` where that is more; together the rounds go through all. In each round groups of about
    ``part`` windows start from the same weights, and the weights' mean, by windows, begins the next round."""
    model = Attention(int(of.max()) + 1, **sizes)
    step = _PLACES // rounds
    width = max(_PLACES - (rounds - 1) * step, min(_PLACES, int(np.ceil(documents / max(1, windows) * _PLACES))))
    groups = max(1, round(windows * width / _PLACES / part))
    # Rows that repeat a doc_id share their draws, so the partition they come from has a say in the slot as well.
    drawn = drawn_windows(train, speller, of, 1.0, known)
    drawn = drawn.withColumn("slot", F.pmod(F.xxhash64("draw", F.spark_partition_id()), F.lit(groups)).cast("int"))
    drawn = stored(drawn, "lm-windows")
    context, few = train.sparkSession.sparkContext, int(np.ceil(np.sqrt(groups)))
    schema = "slot int, windows long, weights binary"

    for nth in range(rounds):
        shared = context.broadcast(model)
        rate = 4e-3 * (1 - nth / (rounds + 1))

        def fit(table: pa.Table) -> pa.Table:  # runs before the next round begins
            order = np.lexsort((table["symbols"].combine_chunks().value_lengths().to_numpy(), table["draw"].to_numpy()))
            lists = table["symbols"].combine_chunks().take(pa.array(order))
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            bounds = lists.offsets.to_numpy().astype(np.int64)
            own = pickle.loads(pickle.dumps(shared.value))  # what is broadcast stays as it is
            own.fit(lists.flatten().to_numpy().astype(np.int64), bounds - bounds[0], 1, rate=rate, seed=7 + nth)
            n = table.num_rows
            weights = {k: v.astype(np.float64) * n for k, v in own.weights.items()}
            slot = table["slot"][0].as_py()
            return pa.table([pa.array([slot], pa.int32()), [n], [pickle.dumps(weights)]], names=["slot", "windows", "weights"])

        def add(table: pa.Table) -> pa.Table:
            slots = table["slot"].to_pylist()
            order = sorted(range(len(slots)), key=slots.__getitem__)
            n, weights = _added([(table["windows"][i].as_py(), table["weights"][i].as_py()) for i in order])
            return pa.table([pa.array([min(slots)], pa.int32()), [n], [pickle.dumps(weights)]], names=["slot", "windows", "weights"])

        due = F.pmod(F.shiftrightunsigned("draw", 33) - nth * step, F.lit(_PLACES)) < width
        fitted = drawn.filter(due).groupBy("slot").applyInArrow(fit, schema)
        sums = fitted.groupBy(F.pmod("slot", F.lit(few))).applyInArrow(add, schema).collect()  # about sqrt(groups) rows
        if not sums:
            break
        n, total = _added([(r["windows"], bytes(r["weights"])) for r in sorted(sums, key=lambda r: r["slot"])])
        model.weights = {k: (v / n).astype(np.float32) for k, v in total.items()}
        shared.unpersist()
    forget(drawn)
    return model


def _added(parts: list[tuple[int, bytes]]) -> tuple[int, dict[str, np.ndarray]]:
    n, total = 0, None
    for windows, weights in parts:
        own = pickle.loads(weights)
        n, total = n + windows, own if total is None else {k: total[k] + v for k, v in own.items()}
    return n, total


def score_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                    frequent: int = FREQUENT_WORDS, documents: int = FIT_DOCUMENTS, epochs: int = 4, **sizes) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; log10.

    The counts of the ``frequent`` most frequent words go to every task. The other words of a document,
    each with few occurrences in the corpus, are joined with the stored counts, so no key is hot.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        speller = Speller(f.read())
    held = id_crc(id_col) % 10 == 0
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), text.alias("text"))
    train = rows.filter(~F.col("held_out")).select("text")
    words = stored(count_words(train), "word-counts")
    n_train = train.count()
    sums = words.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    total, distinct = (sums["n"] or 0) + n_train, sums["v"] + (n_train > 0)

    counts = count_pieces(words, speller)
    counts[speller.end] = n_train
    of, share = piece_classes(counts, end=speller.end)
    drawn_from = rows.filter(~F.col("held_out")).select("doc_id", "text")
    top = words.orderBy(F.desc("c"), "word").limit(frequent).toArrow()
    known = top["word"].combine_chunks()
    windows = n_train + (sums["n"] or 0) // FIT_WORDS
    network = fit_network(drawn_from, speller, of, windows, documents, rounds=epochs, known=known, **sizes)
    shared = spark.sparkContext.broadcast((speller, of, share, network, known, top["c"].to_numpy(), *speller.spell(known)))

    kind = rows.schema["doc_id"].dataType.simpleString()
    each = float(np.log10(total + SMALL * (distinct + 1)))
    end = float(np.log10(n_train + SMALL)) - each
    unseen = float(np.log10((1 + SMALL * 10.0**-each) / 2))  # added to the product of a word without a count
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, word string, piece_log double"
    names = [f.split()[0] for f in schema.split(", ")]

    def score(batches):
        speller, of, share, network, known, known_c, known_flat, known_n = shared.value
        known_n = np.append(known_n, 0)  # the last one stands for words that are not known
        place = np.append(np.log10(known_c + SMALL) - each, 0.0)
        number = TaskContext.get().partitionId() << 40  # the same on a retry: the scan's splits are fixed
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])
        for batch in batches:
            for start, part in text_slices(batch.column(2), _SLICE):
                size = len(part)
                words, at = words_of(part)
                coded = words.dictionary_encode()
                which = coded.indices.to_numpy()
                number_of = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy()
                found = number_of[which]
                there = found >= 0
                between = lambda x: sums(x)[at[1:]] - sums(x)[at[:-1]]
                spelled = speller.spell_some(coded.dictionary, number_of, known_flat, known_n)
                pieces, bounds, begins = speller.texts(coded, at, spelled)
                logs = (network.score(of[pieces], bounds) + share[pieces]) / np.log(10)
                last = bounds[1:] - 1
                inner = np.ones(len(pieces), bool)
                inner[last] = False
                word_logs = np.add.reduceat(logs[inner], begins) if len(which) else np.zeros(0)
                base = place[found]  # of a frequent word; the others get theirs from the join
                ends = mean_log10(logs[last], end) if n_train else logs[last] + unseen
                mixed = between(np.where(there, mean_log10(word_logs, base), 0.0)) + ends
                own = np.arange(number, number + size)
                number += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), batch.column(0).slice(start, size), batch.column(1).slice(start, size),
                     pa.array(np.diff(at) + 1), pa.array(between(there)), pa.array(between(np.where(there, base, 0.0)) + end),
                     pa.array(mixed), pa.nulls(size, pa.string()), pa.nulls(size, pa.float64())],
                    names=names,
                )
                rare = np.flatnonzero(~there)
                if len(rare):  # one row per occurrence of another word
                    text = np.searchsorted(at, rare, side="right") - 1
                    none = [pa.nulls(len(rare), t) for t in (batch.column(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[text]), *none, words.take(pa.array(rare)), pa.array(word_logs[rare])], names=names
                    )

    scored = stored(rows.mapInArrow(score, schema), "lm-scores")
    c = F.coalesce("c", F.lit(0))
    base = F.log10(c + SMALL) - each
    known = F.log10((F.pow(F.lit(10.0), "piece_log") + F.pow(F.lit(10.0), base)) / 2)
    mixed = F.when(c > 0, known).otherwise(F.col("piece_log") + unseen)
    rare = scored.filter(F.col("word").isNotNull()).select("row", "word", "piece_log").join(words, "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(base).alias("more_base"), F.sum(mixed).alias("more_score"), F.count_if(c > 0).alias("more_known")
    )
    texts = scored.filter(F.col("word").isNull()).drop("word", "piece_log").join(rare, "row", "left")
    with_rare = lambda own, more: F.col(own) + F.coalesce(more, F.lit(0))
    return texts.select(
        "doc_id", "held_out", "n_tokens", (with_rare("n_known", "more_known") + int(n_train > 0)).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), with_rare("base", "more_base").alias("base_score"),
        with_rare("score", "more_score").alias("score"),
    )


def mean_log10(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    """The logarithm of the mean of two probabilities."""
    return np.logaddexp2(a * _LOG2, b * _LOG2) / _LOG2 - np.log10(2)
