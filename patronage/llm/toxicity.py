"""Toxicity by two discounted models, one of toxic and one of ordinary text.

Counts are of documents, not Kneser-Ney continuations, which told the classes
apart far worse (figures in the README).

The units ("words" below) are byte 5-grams of the folded text, the bigrams thus
6-grams: insults are often stems that occur in many forms, each of them rare.
A document's evidence is the mean per unit of log P(toxic model) - log
P(ordinary model), so it does not depend on the length.  Both models back off
to the same distribution, the counts of the whole corpus
(labelled or not): a rare expression is then as likely in both classes, unless
its class has really shown it more often.  These counts are a table of all units
of all documents, so it grows with the corpus; the units that the classes know
are joined from it.  Of any other unit both classes have the same probability
but for the weight of their backoff, so in the evidence its count cancels out.  A logistic curve fitted on labelled
rows that the models have not seen turns the evidence into a probability.

Bounds: the models are learned from at most ``sample`` labelled rows of each
class (chosen by a hash of the id), and hold every word and bigram that occurs
in two of them; so what is collected and broadcast is bounded by those texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import give_back, small_batches, table, whole_text
from .kernels import U, document_blocks, mix, text_buffers

SAMPLE = 4096
GRAM = 5
# (ratio, discount) tried on rows that the models have not seen.
DISCOUNTS = ((1.0, 0.75), (2.0, 2.0), (2.0, 6.0), (4.0, 2.0))
# Sightings granted to a class that has few, when the other class's rate is compared with it.
DOUBT = 3.0
FLUSH = 1 << 18
# Bits of a bigram, and of a document's number within a block; together at most 64.  A unit is a bigram's low bits.
PAIR_BITS, DOCUMENT_BITS = 8 * (GRAM + 1), 16
WORD = U((1 << 8 * GRAM) - 1)


def folding() -> np.ndarray:
    """Lower-cases A-Z and turns ASCII other than letters and digits into spaces."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    kept = np.zeros(256, bool)
    kept[48:58] = kept[97:123] = kept[128:] = True
    fold[~kept[fold]] = 32
    return fold


def blocks_of_grams(column, fold):
    """(first document, units, unit offsets) of each block of a batch.

    A unit is the last GRAM bytes at each position of the folded text, packed
    into a number, runs of spaces counting as one; so a stem is recognised in
    any of its words.
    """
    data, offs = text_buffers(column)
    for i, j in block_ranges(offs):
        piece, first = fold[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
        kept = np.ones(len(piece), bool)
        kept[1:] = (piece[1:] != 32) | (piece[:-1] != 32)
        starts = first[:-1]
        kept[starts[starts < len(piece)]] = True
        first = np.concatenate([[0], np.cumsum(kept)])[first]
        piece = piece[kept].astype(np.uint64)
        gram = piece.copy()
        for k in range(1, GRAM):
            gram[k:] |= piece[:-k] << U(8 * k)
        starts = first[:-1]
        for edge in range(GRAM - 1):  # nothing stands before the start of a document
            at = starts + edge
            gram[at[at < len(piece)]] &= U((1 << 8 * (edge + 1)) - 1)
        yield i, gram, first


def block_ranges(offs):
    """Ranges of documents of a block, whose numbers within it have DOCUMENT_BITS bits."""
    for i, j in document_blocks(offs, 1 << 18):
        for k in range(i, j, 1 << DOCUMENT_BITS):
            yield k, min(j, k + (1 << DOCUMENT_BITS))


def blocks_of_words(column, fold):
    """The same with units as hashes."""
    for i, gram, first in blocks_of_grams(column, fold):
        yield i, mix(gram), first


def left_words(hashes, first):
    """The word before each word; 0 at the start of a document."""
    left = np.zeros(len(hashes), np.uint64)
    left[1:] = hashes[:-1]
    starts = first[:-1]
    left[starts[starts < len(hashes)]] = 0
    return left


def pair_key(left, word):
    return mix(left * U(0x9E3779B97F4A7C15) + word)


def once_per_document(grams, first):
    """(document, bigram) of each document's different bigrams, so that repetition within it counts once.

    A bigram is one byte longer than a unit: a number without collisions, and
    with the document's number above it one that sorts fast.
    """
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    key = np.sort(doc << U(PAIR_BITS) | left_words(grams, first) << U(8) | grams & U(255))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return (key >> U(PAIR_BITS)).astype(np.int64), key & U((1 << PAIR_BITS) - 1)


class Lookup:
    """Positions of the keys by buckets of their high bits, which must be spread; other keys give -1."""

    def __init__(self, keys):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        bits = max(12, int(len(keys)).bit_length() + 1)
        self.shift = U(64 - bits)
        ends = np.cumsum(np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << bits))
        self.first = np.concatenate([[0], ends]).astype(np.int32)

    def sorted_place(self, x):
        """Positions among the sorted keys."""
        out = np.full(len(x), -1, np.int32)
        bucket = (x >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        rows = np.flatnonzero(at < end)
        at, end, x = at[rows], end[rows], x[rows]
        while len(rows):
            hit = self.keys[at] == x
            out[rows[hit]] = at[hit]
            more = np.flatnonzero(~hit & (at + 1 < end))
            rows, at, end, x = rows[more], at[more] + 1, end[more], x[more]
        return out

    def __call__(self, x):
        place = self.sorted_place(x)
        return np.where(place >= 0, np.append(self.order, -1)[place], -1)


@dataclass
class Model:
    """Log-probability tables of both classes; see ``fit``."""

    words: np.ndarray
    word_log: np.ndarray  # (classes, words): log of the backoff distribution
    other_log: np.ndarray  # (classes,): the same for any other word, but for the shared factor
    history_log: np.ndarray  # (classes, words): log weight given to the backoff after this word
    start_log: np.ndarray  # (classes,): the same at the start of a document
    pairs: np.ndarray
    pair_log: np.ndarray  # (classes, pairs): log probability of the pair's word after its history
    slope: float = 1.0
    shift: float = 0.0

    def evidence(self):
        """A function of an Arrow text column giving the mean log ratio per word."""
        of = evidences([self])
        return lambda column: of(column)[0]


def evidences(models: list[Model]):
    """A function of an Arrow text column giving each model's mean log ratio per word.

    The models have the same words and pairs, which are looked up once for all.
    """
    fold, word_at, pair_at = folding(), Lookup(models[0].words), Lookup(models[0].pairs)
    ratio = lambda x: x[1] - x[0]
    ratios = []
    for m in models:
        word = np.append(ratio(m.word_log)[word_at.order], ratio(m.other_log))
        history = np.append(ratio(m.history_log)[word_at.order], 0.0)
        ratios.append((word, history, ratio(m.pair_log)[pair_at.order], ratio(m.start_log)))

    def of(column):
        out = np.zeros((len(ratios), len(column)))
        for i, hashes, first in blocks_of_words(column, fold):
            at = word_at.sorted_place(hashes)
            before = np.full(len(at), -1, np.int32)
            before[1:] = at[:-1]
            begins = first[:-1]
            begins = begins[first[1:] > begins]
            known = pair_at.sorted_place(pair_key(left_words(hashes, first), hashes))
            seen = np.flatnonzero(known >= 0)
            n = np.diff(first)
            for row, (word, history, pair, start) in zip(out, ratios):
                gain = word[at] + history[before]
                gain[begins] = word[at[begins]] + start
                gain[seen] = pair[known[seen]]
                summed = np.concatenate([[0.0], np.cumsum(gain)])
                row[i : i + len(n)] = (summed[first[1:]] - summed[first[:-1]]) / np.maximum(n, 1)
        return out

    return of


def held_out(id_col: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def chosen_rows(labels: DataFrame, id_col: str, label_col: str, sample: int) -> DataFrame:
    """(id, label, calibrates) of at most ``sample`` labelled ids of each class."""
    named = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    named = named.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    single = named.groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64("id", F.lit(7))
    parts = [single.where(F.col("label") == c).orderBy(order, "id").limit(sample) for c in (0, 1)]
    return parts[0].union(parts[1]).select("id", "label", (F.pmod(F.xxhash64("id", F.lit(8)), F.lit(4)) == 0).alias("calibrates"))


def class_bigrams(rows: DataFrame) -> DataFrame:
    """(label, left, word, n) of the rows (label, text); n counts documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, kept, size = folding(), [], 0

        def combined():
            key, n = np.unique(np.concatenate(kept), return_counts=True)
            pair = key & U((1 << PAIR_BITS) - 1)
            columns = [(key >> U(PAIR_BITS)).astype(np.int32), (pair >> U(8)).view(np.int64), (pair & WORD).view(np.int64), n.astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["label", "left", "word", "n"])

        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            for i, grams, first in blocks_of_grams(batch.column(1), fold):
                doc, pair = once_per_document(grams, first)
                kept.append(labels[i + doc].astype(np.uint64) << U(PAIR_BITS) | pair)
                size += len(pair)
                if size >= FLUSH:
                    yield combined()
                    kept, size = [], 0
        if size:
            yield combined()
        del kept
        give_back()

    found = rows.mapInArrow(count, "label int, left long, word long, n long")
    return found.groupBy("label", "left", "word").agg(F.sum("n").alias("n"))


def collected(df: DataFrame) -> dict[str, np.ndarray]:
    """A frame whose size is bounded by the model's parameters."""
    rows = df.toArrow()
    return {name: rows.column(name).to_numpy() for name in rows.column_names}


def backoff_counts(docs: DataFrame, text: Column) -> DataFrame:
    """(word, n) of every word of all documents, a table that grows with the corpus.

    n is the number of different words before it in a document, summed over
    the documents, so partial counts of tasks add up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, words, counts, new, size = folding(), np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merged():
            fresh, n = np.unique(np.concatenate([words[:0], *new]), return_counts=True)
            at = np.searchsorted(words, fresh)
            known = np.append(words, U(0))[at] == fresh
            known &= at < len(words)
            counts[at[known]] += n[known]
            return np.insert(words, at[~known], fresh[~known]), np.insert(counts, at[~known], n[~known])

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

        for batch in batches:
            for _, grams, first in blocks_of_grams(batch.column(0), fold):
                new.append(once_per_document(grams, first)[1] & WORD)
                size += len(new[-1])
                if size >= FLUSH:
                    (words, counts), new, size = merged(), [], 0
                    if len(words) >= 4 * FLUSH:
                        yield rows()
                        words, counts = words[:0], counts[:0]
        words, counts = merged()
        yield rows()
        del words, counts, new
        give_back()

    found = docs.select(text.alias("text")).mapInArrow(count, "word long, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def known_and_total(counts: DataFrame, known: DataFrame) -> tuple[dict[str, np.ndarray], float]:
    """The rows (word, n0, n1, shared) of the known words, and the sum of all counts.

    One pass over the counts, which are neither sorted nor stored: the words of
    no class are added up to one row.
    """
    joined = counts.join(known.hint("shuffle_hash"), "word", "left")
    is_known = F.col("n0").isNotNull()
    each = joined.groupBy(is_known.cast("int").alias("known"), F.when(is_known, F.col("word")).otherwise(0).alias("word"))
    found = collected(each.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("n0", "n1")], F.sum("shared").alias("shared")))
    mine = found.pop("known") == 1
    return {name: column[mine] for name, column in found.items()}, float(found["shared"].sum())


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
) -> Model:
    """Learn both models; without labelled rows of both classes every score is 0.5 or less."""
    small_batches(docs.sparkSession)
    chosen = chosen_rows(labels, id_col, label_col, sample)
    text = whole_text(text_col)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    rows = texts.join(F.broadcast(chosen), "id")  # at most 2 * sample ids
    bigrams = class_bigrams(rows.where("not calibrates").select("label", "text")).cache()

    def by_class(keys: list[str], df: DataFrame, **sums: Column) -> DataFrame:
        each = [F.coalesce(F.sum(F.when(F.col("label") == c, v)), F.lit(0)).alias(f"{k}{c}") for k, v in sums.items() for c in (0, 1)]
        return df.groupBy(*keys).agg(*each)

    # Each collected frame is bounded by the texts of the sample.
    counts = backoff_counts(docs, text).withColumnRenamed("n", "shared")
    known = by_class(["word"], bigrams, n=F.col("n")).where("n0 + n1 >= 2")
    as_word, all_shared = known_and_total(counts, known)
    as_left = collected(by_class(["left"], bigrams, n=F.col("n")).where("n0 + n1 >= 2 or left = 0"))
    as_pair = collected(by_class(["left", "word"], bigrams, n=F.col("n")).where("n0 + n1 >= 2"))
    totals = collected(by_class([], bigrams, n=F.col("n")))
    bigrams.unpersist()

    # Units are hashed here, so that scoring finds them by their high bits.
    for frame, names in ((as_word, ("word",)), (as_left, ("left",)), (as_pair, ("left", "word"))):
        frame.update({name: mix(frame[name].view(np.uint64)).view(np.int64) for name in names})
    backoff = (as_word["shared"] + 1) / (all_shared + 1)
    unseen = rows.where("calibrates").select("label", "text")
    sizes = collected(labels.where(~held_out(F.col(f"`{id_col}`"))).groupBy(F.col(f"`{label_col}`").cast("int").alias("label")).count().where("label in (0, 1)"))
    sizes = dict(zip(sizes["label"].tolist(), sizes["count"].tolist()))
    models = [tables(r, d, as_word, as_left, as_pair, totals, backoff) for r, d in DISCOUNTS]
    tried = collected(unseen.select("label", evidences_of(models, docs.sparkSession)(F.col("text")).alias("x")))
    x = np.array(tried["x"].tolist()).reshape(-1, len(models)).T
    fits = [logistic(x[i], tried["label"], sizes) for i in range(len(models))]
    best = min(range(len(models)), key=lambda i: fits[i][2])
    models[best].slope, models[best].shift, _ = fits[best]
    return models[best]


def tables(ratio: float, discount: float, as_word: dict, as_left: dict, as_pair: dict, totals: dict, backoff: np.ndarray) -> Model:
    """Both classes' log probabilities under one discount.

    A class keeps of a count what exceeds ``ratio`` times the number that the
    lower order explains, plus ``discount``; the rest goes to the lower order.
    So a rare expression, or one that is only as frequent as its language is in
    a class, is left to the shared backoff alone.  A word's lower order is the
    shared distribution, a pair's the other class's rate.
    """
    words = as_word["word"].view(np.uint64)
    lookup = Lookup(words)
    left_at = lookup(as_left["left"].view(np.uint64))
    pair_word = lookup(as_pair["word"].view(np.uint64))
    pair_left = Lookup(as_left["left"].view(np.uint64))(as_pair["left"].view(np.uint64))
    usable = (pair_word >= 0) & (pair_left >= 0)
    start_at = np.flatnonzero(as_left["left"] == 0)
    word_log, other_log, history_log, start_log, pair_log = [], [], [], [], []
    at, pair_word = pair_left[usable], pair_word[usable]
    counts = [as_pair[f"n{c}"][usable] for c in (0, 1)]
    lefts = [np.maximum(as_left[f"n{c}"], 1) for c in (0, 1)]
    for c in (0, 1):
        total = float(totals[f"n{c}"][0]) or 1.0
        kept = np.maximum(as_word[f"n{c}"] - ratio * total * backoff - discount, 0)
        spread = max(1 - kept.sum() / total, 1e-9)
        p_word = kept / total + spread * backoff
        explained = lefts[c][at] * (counts[1 - c] + DOUBT) / (as_left[f"n{1 - c}"][at] + DOUBT)
        own = np.maximum(counts[c] - ratio * explained - discount, 0)
        weight = np.maximum(1 - np.bincount(at, own, len(lefts[c])) / lefts[c], 1e-9)
        history = np.ones(len(words))
        history[left_at[left_at >= 0]] = weight[left_at >= 0]
        word_log.append(np.log(p_word))
        other_log.append(math.log(spread))
        history_log.append(np.log(history))
        start_log.append(math.log(weight[start_at[0]]) if len(start_at) else 0.0)
        pair_log.append(np.log(own / lefts[c][at] + weight[at] * p_word[pair_word]))
    keys = pair_key(as_pair["left"].view(np.uint64)[usable], as_pair["word"].view(np.uint64)[usable])
    return Model(words, *(np.array(x) for x in (word_log, other_log, history_log, start_log)), keys, np.array(pair_log))


def logistic(x: np.ndarray, y: np.ndarray, sizes: dict[int, int]) -> tuple[float, float, float]:
    """Slope, shift and loss of a one-dimensional logistic fit, classes weighted as in the labels."""
    if len(set(y.tolist())) < 2:
        return 1.0, -1.0, 0.0
    weight = np.where(y == 1, sizes.get(1, 1) / (y == 1).sum(), sizes.get(0, 1) / (y == 0).sum())
    weight = weight / weight.mean()
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + 1e-2 * w
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    loss = -(weight * np.where(y == 1, np.log(p), np.log1p(-p))).mean()
    return float(w[0] / scale), float(w[1]), float(loss)


def astuple_shallow(model: Model) -> tuple:
    return tuple(getattr(model, f.name) for f in fields(model))


def evidence_of(model: Model, spark):
    """The evidence as a column function; the model is broadcast, its size is bounded.

    As arrays: a broadcast object would need this package on the executors.
    """
    shared = spark.sparkContext.broadcast(astuple_shallow(model))

    @F.arrow_udf("double")
    def evidence(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Model(*shared.value).evidence()
        for column in columns:
            yield pa.array(of(column))
        del of
        give_back()

    return evidence


def evidences_of(models: list[Model], spark):
    """The evidence of models with the same words and pairs, as a column function that gives an array.

    One function for all: with one for each, a task would hold as many Python
    workers at once, and an executor keeps them all while it has tasks.
    """
    words, pairs = models[0].words, models[0].pairs
    shared = spark.sparkContext.broadcast([astuple_shallow(replace(m, words=words, pairs=pairs)) for m in models])

    @F.arrow_udf("array<double>")
    def evidence(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = evidences([Model(*x) for x in shared.value])
        for column in columns:
            found = of(column)
            ends = np.arange(len(column) + 1, dtype=np.int32) * len(found)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(found.T.ravel()))
        del of
        give_back()

    return evidence


def toxicity(model: Model, spark, text: Column) -> Column:
    """Score from 0 to 1 of a text column; null and empty texts get the score of no evidence."""
    evidence = evidence_of(model, spark)(text)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(evidence * model.slope + model.shift)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below ``threshold``, with all their columns.

    Rows without text stay, repeated rows are judged alike, an empty table
    stays empty.
    """
    model = fit(docs, labels)
    columns = docs.columns
    scored = docs.withColumn("__toxicity", toxicity(model, docs.sparkSession, whole_text()))
    return scored.where(F.col("__toxicity") < threshold).select(*[f"`{c}`" for c in columns])


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a model of the labelled rows that are not held out; see ``fit`` and ``toxicity``."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(model, spark, whole_text()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
