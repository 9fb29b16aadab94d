"""Quality rules: counts of words, symbols and repeats, and bands of n-gram perplexity.

1. Every text is lower-cased bytewise, digits become one digit and white space
   one space.  Its byte n-grams of ORDER are packed into integers, which are
   their own collision-free hash, and counted by Spark per language.  Texts are
   dealt into two folds by a hash of the text, so that a text and its exact
   copies are always scored by a model that has not seen them.
2. Interpolated modified Kneser-Ney, all in Spark: raw counts at the highest
   order, numbers of different left neighbours below it, three discounts per
   language and order from the counts of counts.  All n-grams of the corpus are
   kept, each with its cost (negative logarithm) under either model.
3. The costs are sorted arrays of packed n-grams.  They are broadcast in shards
   of at most SHARD n-grams; a larger model takes a pass over the texts for each
   shard, and a text's cost is the sum over the shards.  Costs are integers, so
   sums do not depend on any order.
4. Language-specific bands: from the quartiles of the costs per byte of the
   different texts that the counts do not reject.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import small_batches, table, whole_text, written
from .kernels import document_blocks, text_buffers

# Bytes of an n-gram; packed into 8 bits each, with room for the fold and language.
ORDER = 5
# Units of cost in a nat.
SCALE = 10_000
# N-grams in a broadcast shard (16 bytes each), and those that a task holds before it sends them on.
SHARD, HELD = 1 << 22, 1 << 21
# The bands reach so many interquartile ranges beyond the quartiles; a range counts as this many thousandths of a nat at least.
FENCE, LEAST_RANGE = 3, 100
LEAST_DISCOUNT = 0.1
# Bounds of the counts.
FEWEST_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
BLOCK = 1 << 20


def folding() -> np.ndarray:
    """The byte that stands for each byte."""
    to = np.arange(256, dtype=np.uint8)
    to[65:91] += 32
    to[48:58] = 48
    to[[9, 10, 11, 12, 13]] = 32
    return to


def packed_grams(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a block of documents in their order, and the number in each document."""
    n = np.maximum(np.diff(offs) - order + 1, 0)
    if len(data) < order:
        return np.zeros(0, np.int64), n
    grams = np.zeros(len(data) - order + 1, np.int64)
    for j in range(order):
        grams <<= 8
        grams |= data[j : len(data) - order + 1 + j]
    inside = np.ones(len(data), bool)
    for j in range(1, order):
        last = offs[1:] - j
        inside[last[last >= offs[:-1]]] = False
    return grams[inside[: len(grams)]], n


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and how often each occurs; sorts ``keys`` in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def gram_counts(texts: DataFrame, order: int, held: int = HELD) -> DataFrame:
    """(lang, gram, c0, c1): occurrences in the texts of either fold; ``texts`` has lang, fold, text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold_of, codes, found, n_held = folding(), {}, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*found))
            at = np.argsort(keys)
            keys, n = keys[at], n[at]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            return keys[first], np.add.reduceat(n, first) if len(first) else n

        def rows(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            names = pa.array(list(codes), pa.string())
            for i in range(0, len(keys), 1 << 16):
                part = keys[i : i + (1 << 16)]
                lang = names.take(pa.array(part >> (8 * order + 1)))
                fold, gram = part >> (8 * order) & 1, part & ((1 << 8 * order) - 1)
                yield pa.RecordBatch.from_arrays([lang, pa.array(gram), pa.array(fold), pa.array(n[i : i + (1 << 16)])], names=["lang", "gram", "fold", "n"])

        for batch in batches:
            langs = np.array([codes.setdefault(x, len(codes)) for x in batch.column(0).to_pylist()], np.int64)
            key_of = (langs << 1 | batch.column(1).to_numpy().astype(np.int64)) << (8 * order)
            data, offs = text_buffers(batch.column(2))
            for i, j in document_blocks(offs, BLOCK):
                grams, n = packed_grams(fold_of[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i], order)
                grams |= np.repeat(key_of[i:j], n)
                found.append(runs(grams))
                n_held += len(found[-1][0])
                if n_held > 2 * held:
                    found = [merged()]
                    n_held = len(found[0][0])
            if n_held > held:
                found = [merged()]
                yield from rows(*found[0])
                codes, found, n_held = {}, [], 0
        if found:
            yield from rows(*merged())

    counts = texts.select("lang", "fold", "text").mapInArrow(counted, "lang string, gram long, fold long, n long")
    return counts.groupBy("lang", "gram").agg(
        F.sum(F.when(F.col("fold") == 0, F.col("n")).otherwise(0)).alias("c0"),
        F.sum(F.when(F.col("fold") == 1, F.col("n")).otherwise(0)).alias("c1"),
    )


def discounts(levels: dict[int, DataFrame]) -> DataFrame:
    """(lang, level, d0, d1): the discounts of counts one, two and more, under either fold's counts."""

    def of(c: str) -> Column:
        n = [F.count_if(F.col(c) == k).cast("double") for k in (1, 2, 3, 4)]
        share = n[0] / F.nullif(n[0] + 2 * n[1], F.lit(0.0))
        # Where a count of counts is missing, the plain values.  Never above the count, nor so low that nothing is left for unseen bytes.
        usual = [k - (k + 1) * share * n[k] / F.nullif(n[k - 1], F.lit(0.0)) for k in (1, 2, 3)]
        return F.array(*[F.greatest(F.lit(LEAST_DISCOUNT), F.least(F.lit(float(k)), F.coalesce(d, F.lit(0.5 * k)))) for k, d in zip((1, 2, 3), usual)])

    counts = [df.select("lang", F.lit(n).alias("level"), "c0", "c1") for n, df in levels.items()]
    stacked = counts[0]
    for more in counts[1:]:
        stacked = stacked.unionAll(more)
    return stacked.groupBy("lang", "level").agg(of("c0").alias("d0"), of("c1").alias("d1"))


def kneser_ney(grams: DataFrame, order: int) -> DataFrame:
    """(lang, gram, p0, p1): the probability of each n-gram's last byte after the others.

    p0 is for texts of fold 0, so it comes from the counts of fold 1, and the
    other way round.  n-grams that one fold lacks have a probability there too.
    """
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        # A suffix counts the different bytes on its left.
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1))
        left = levels[n + 1].groupBy("lang", suffix.alias("gram")).agg(F.count_if(F.col("c0") > 0).alias("c0"), F.count_if(F.col("c1") > 0).alias("c1"))
        levels[n] = written(left, f"quality-level-{n}")
    held_back = written(discounts(levels), "quality-discounts")
    lower = None
    for n in range(1, order + 1):
        # A context has at most 256 next bytes.
        context = Window.partitionBy("lang", F.shiftright("gram", 8))
        rows = levels[n].join(held_back.where(F.col("level") == n).drop("level"), "lang")
        for c in ("c0", "c1"):
            rows = rows.withColumns({
                f"{c}_all": F.sum(c).over(context),
                f"{c}_kinds": F.array(*[F.count_if(test).over(context) for test in (F.col(c) == 1, F.col(c) == 2, F.col(c) > 2)]),
            })
        if lower is None:
            rows = rows.withColumns({"low0": F.lit(1 / 256), "low1": F.lit(1 / 256)})
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)))
            rows = rows.join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p0").alias("low0"), F.col("p1").alias("low1")), ["lang", "suffix"])

        def probability(c: str, d: str, low: str) -> Column:
            taken = F.when(F.col(c) > 0, F.get(d, F.least(c, F.lit(3)).cast("int") - 1)).otherwise(0.0)
            kinds = F.col(f"{c}_kinds")
            spare = sum(F.get(d, F.lit(k)) * F.get(kinds, F.lit(k)) for k in range(3))
            return F.when(F.col(f"{c}_all") > 0, (F.col(c) - taken) / F.col(f"{c}_all") + spare / F.col(f"{c}_all") * F.col(low)).otherwise(F.col(low))

        lower = rows.select("lang", "gram", probability("c1", "d1", "low0").alias("p0"), probability("c0", "d0", "low1").alias("p1"))
    return lower


def costs(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, s0, s1): the cost of each n-gram of the corpus for the texts of either fold."""
    grams = written(gram_counts(texts, order), "quality-grams")
    cost = lambda p: F.round(-F.log(p) * SCALE).cast("int")
    return kneser_ney(grams, order).select("lang", "gram", cost("p0").alias("s0"), cost("p1").alias("s1"))


def repeated_words(ids: np.ndarray, kinds: int) -> int:
    """Words that lie in a window of three words that occurs at least twice."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * kinds + ids[1:]
    if kinds >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, n = np.unique(pairs[:-1] * kinds + ids[2:], return_inverse=True, return_counts=True)
    twice = n[place] > 1
    covered = np.zeros(len(ids), bool)
    for j in range(3):
        covered[j : len(ids) - 2 + j] |= twice
    return int(covered.sum())


def measured(texts: DataFrame, shard, order: int, base: bool) -> DataFrame:
    """The rows with the cost of their n-grams in a broadcast shard and, if asked for, the counts.

    ``texts`` has id, lang, fold, same (a hash of the text) and text.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold_of = folding()
        space = np.zeros(256, bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        counts = lambda mask, offs: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
        for batch in batches:
            langs, folds = np.array(batch.column(1).to_pylist(), object), batch.column(2).to_numpy()
            data, offs = text_buffers(batch.column(4))
            cost, n_grams = np.zeros(len(folds), np.int64), np.zeros(len(folds), np.int64)
            found = np.zeros((5, len(folds)), np.int64)
            for i, j in document_blocks(offs, BLOCK):
                raw, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                grams, n = packed_grams(fold_of[raw], at, order)
                n_grams[i:j] = n
                values = np.zeros(len(grams), np.int64)
                doc = np.repeat(np.arange(i, j), n)
                for lang in set(langs[i:j]):
                    keys, both = shard.value.get(lang, (np.zeros(0, np.int64), None))
                    if not len(keys):
                        continue
                    own = slice(None) if (langs[i:j] == lang).all() else np.flatnonzero(langs[doc] == lang)
                    kinds, place = np.unique(grams[own], return_inverse=True)
                    spot = np.minimum(np.searchsorted(keys, kinds), len(keys) - 1)
                    here = both[:, spot] * (keys[spot] == kinds)
                    values[own] = here[folds[doc[own]], place]
                ends = np.concatenate([[0], np.cumsum(n)])
                cost[i:j] = np.diff(np.concatenate([[0], np.cumsum(values)])[ends])
                if not base:
                    continue
                found[1, i:j] = counts(((raw & 0xC0) != 0x80) & ~space[raw], at)
                found[2, i:j] = counts(symbol[raw], at)
                whole = raw.tobytes()
                for d in range(i, j):
                    text = whole[at[d - i] : at[d - i + 1]]
                    words, known = text.split(), {}
                    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
                    seen, twice = set(), 0
                    for line in text.split(b"\n"):
                        if line in seen:
                            twice += 1
                        elif line.strip():
                            seen.add(line)
                    found[0, d], found[3, d], found[4, d] = len(words), twice, repeated_words(ids, len(known))
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(cost), pa.array(n_grams)]
            names = ["id", "lang", "same", "cost", "n_grams"]
            if base:
                columns += [pa.array(x) for x in found]
                names += ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {texts.schema['id'].dataType.simpleString()}, lang string, same long, cost long, n_grams long"
    if base:
        schema += ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    return texts.select("id", "lang", "fold", "same", "text").mapInArrow(measure, schema)


def shards(scores: DataFrame, most: int) -> Iterator[dict]:
    """The costs in parts of about ``most`` n-grams: for each language its sorted n-grams and both costs."""
    parts = max(1, math.ceil(scores.count() / most))
    for part in range(parts):
        rows = scores.where(F.pmod(F.xxhash64("lang", "gram"), F.lit(parts)) == part).toArrow()
        lang = rows.column("lang").combine_chunks().dictionary_encode()
        codes, gram = lang.indices.to_numpy(), rows.column("gram").to_numpy()
        both = np.stack([rows.column(s).to_numpy() for s in ("s0", "s1")])
        at = np.lexsort((gram, codes))
        bounds = np.searchsorted(codes[at], np.arange(len(lang.dictionary) + 1))
        own = [at[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        yield {name: (gram[i], both[:, i]) for name, i in zip(lang.dictionary.to_pylist(), own)}


def bands(rows: DataFrame) -> DataFrame:
    """(lang, low, high) of the costs per byte, from the different texts that the counts do not reject."""
    texts = rows.where("not base_failed and value is not null").select("lang", "same", "value").distinct()
    held = texts.groupBy("lang", "value").agg(F.count("*").alias("n"))
    # One row per language and thousandth of a nat.
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("value"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    ranked = held.select("lang", "value", upto.alias("upto"), total.alias("total"))
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("value")))
    ends = ranked.groupBy("lang").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_RANGE))
    return ends.select("lang", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, shard: int = SHARD) -> DataFrame:
    """One row per row: its id, the counts, base_failed, perplexity per byte, and whether it is kept.

    Words are maximal runs of bytes other than space and 0x09-0x0D.  A null text
    counts as empty, a null language as ``und``; a null id is kept as it is.
    Empty and short texts fail on their number of words.  Repeated rows give
    repeated results.  Texts of fewer than ``order`` bytes have no perplexity
    and are judged by their counts alone.  A language that only one fold has is
    scored by uniform bytes there.  Very long texts are worked on whole; no text
    is cut.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = whole_text(text_col)
    same = F.xxhash64(text)
    texts = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
        F.pmod(same, F.lit(2)).cast("int").alias("fold"),
        same.alias("same"),
        text.alias("text"),
    )
    scores = written(costs(texts, order), "quality-costs")
    rows = None
    for part in shards(scores, shard):
        shared = spark.sparkContext.broadcast(part)
        if rows is None:
            rows = written(measured(texts, shared, order, base=True), "quality-rows")
        else:
            # Rows with the same text, language and id have the same cost.
            key = ["id", "lang", "same"]
            more = written(measured(texts, shared, order, base=False), "quality-more").select(*key, F.col("cost").alias("more")).distinct()
            on = [rows[c].eqNullSafe(more[c]) for c in key]
            rows = rows.join(more, on[0] & on[1] & on[2]).select(*[rows[c] for c in rows.columns if c != "cost"], (rows["cost"] + more["more"]).alias("cost"))
            rows = written(rows, "quality-rows")
        shared.destroy()
    rows = rows.withColumn("n_grams", F.nullif("n_grams", F.lit(0)))
    rows = rows.withColumn("value", F.expr(f"cost div (n_grams * {SCALE // 1000})"))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    limits = written(bands(rows), "quality-bands")
    fits = F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(True))
    return rows.join(limits, "lang", "left").select(
        F.col("id").alias(id_col),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & fits).alias("kept"),
        F.exp(F.col("cost") / (F.col("n_grams") * SCALE)).alias("perplexity"),
    )


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    """``documents``: one row per document; see ``quality``."""
    return quality(table(spark, sf_dir, "documents"))
