"""Phrase collocations over a prefix-free parse of the texts.

1. Texts are split into pieces and words.  A word whose hash is a multiple of
   TRIGGER begins a chunk, wherever it occurs, and so does each text.  Pieces
   are kept apart within a chunk.  A chunk also holds the words that follow it
   in its last piece, one fewer than a phrase has, so that every n-gram lies
   whole in the chunk that it starts in.  Equal passages give equal chunks
   whatever surrounds them.
2. The different chunks are the dictionary, with the number of times that each
   occurs in the parse.  Copies and repeated passages are counted here, once.
3. n-grams are counted in the dictionary, weighted by those numbers.  Each is
   counted in the chunk that it starts in, so overlaps are assigned once.
   Orders are counted one after the other: an n-gram is passed on only if both
   its shorter parts are in a Bloom filter of the frequent ones, which has no
   false negatives, so no frequent n-gram is lost.  Its false positives are
   counted like all others and fall under the threshold.  The filter has a
   fixed largest size.
4. Cuts, scores and contained phrases are joins of the frequent n-grams.
   Scores are exact decimals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import small_batches, table, whole_text, written
from .kernels import BASE, U, WordHasher, document_blocks, mix, text_buffers

# Words that may begin a chunk: one in so many.
TRIGGER = 32
LONGEST, LEAST, TOP = 3, 10, 2000
# A candidate goes if a longer one has at least this share of its occurrences.
CONTAINED_PERCENT = 50
MILLION = 1_000_000
BLOCK, HELD = 1 << 20, 1 << 23
# Bits of a filter for each n-gram, and at most.
BITS, MOST_BITS = 16, 1 << 28
# Parts in which the best of a language are found before they are merged.
SALTS = 16


def piece_hasher() -> WordHasher:
    """Words of the original texts: between spaces, tabs and the ends of pieces."""
    hasher = WordHasher(lower=True)
    hasher.space[list(b".,;:!?")] = True
    return hasher


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The slices of ``data`` as Arrow strings."""
    offs = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], lengths)
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offs), pa.py_buffer(data[at])]).cast(pa.string())


def parse(data: np.ndarray, offs: np.ndarray, hasher: WordHasher, longest: int, trigger: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(document, chunk, own words) of the chunks of a block of documents.  Words are joined by a space, pieces by a line end."""
    hashes, starts, ends, _ = hasher.words(data, offs)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int32)
    ended = np.zeros(256, bool)
    ended[[*b".,;:!?", 10, 11, 12, 13]] = True
    pieces = np.cumsum(ended[data])[starts]
    doc = np.searchsorted(offs, starts, "right") - 1
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    new = new_doc | np.concatenate([[True], pieces[1:] != pieces[:-1]])
    first = np.flatnonzero(new_doc | (hashes % U(trigger) == 0))
    after = np.append(first[1:], n)
    piece = np.append(np.flatnonzero(new), n)
    last = np.minimum(after + longest - 1, piece[np.searchsorted(piece, after - 1, "right")])
    # The words one after the other, each with a space or line end behind it.
    lengths = ends - starts
    place = np.concatenate([[0], np.cumsum(lengths + 1)])
    inside = ~hasher.space[data]
    joined = np.full(place[-1], 32, np.uint8)
    joined[place[piece[1:]] - 1] = 10
    joined[np.arange(lengths.sum()) + np.repeat(np.arange(n), lengths)] = hasher.fold[data[inside]]
    chunks = gathered(joined, place[first], place[last] - 1 - place[first])
    return doc[first], chunks, (after - first).astype(np.int32)


def parsed(docs: DataFrame, text_col: str, lang_col: str, longest: int, trigger: int) -> DataFrame:
    """The dictionary (lang, chunk, own, freq)."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = piece_hasher()
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            for i, j in document_blocks(offs, BLOCK):
                doc, chunk, own = parse(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], hasher, longest, trigger)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + i)), chunk, pa.array(own)], names=["lang", "chunk", "own"])

    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang")
    rows = docs.select(lang, whole_text(text_col).alias("text")).mapInArrow(chunks, "lang string, chunk string, own int")
    return rows.groupBy("lang", "chunk", "own").agg(F.count("*").alias("freq"))


def language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of a filter that stand for n-grams."""
    return [(h & U(bits - 1)).astype(np.int64) for h in (hashes, mix(hashes ^ U(0xA0761D6478BD642F)))]


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the n-grams may be in the filter."""
    found = np.ones(len(hashes), bool)
    for at in probes(hashes, len(bits) * 64):
        found &= (bits[at >> 6] >> (at & 63).astype(U) & U(1)).astype(bool)
    return found


def phrase_filter(phrases: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """A Bloom filter of (lang, phrase), put together by Spark; at most ``most_bits`` bits whatever the number of phrases."""
    n, bits = phrases.count(), 1 << 16
    while bits < min(n * BITS, most_bits):
        bits *= 2

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            hashes, _, _, first = hasher.words(data, offs)
            own = np.array([language_hash(x) for x in batch.column(0).to_pylist()], np.uint64)
            sizes = np.diff(first)
            for k in range(int(sizes.max(initial=0))):
                more = sizes > k
                own[more] = mix(own[more] * U(BASE) + hashes[first[:-1][more] + k])
            at = np.concatenate(probes(own, bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((U(1) << (at & 63).astype(U)).view(np.int64))], names=["slot", "mask"])

    masks = phrases.select("lang", "phrase").mapInArrow(words, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[masks.column("slot").to_numpy()] = masks.column("mask").to_numpy().view(np.uint64)
    return out


def gram_counts(dictionary: DataFrame, order: int, shared, held: int = HELD) -> DataFrame:
    """(lang, phrase, f) of the n-grams of ``order`` words whose parts pass the broadcast filters of the lower orders."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()

        def block(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(rows).combine_chunks()
            langs = whole.column("lang").combine_chunks().dictionary_encode()
            data, offs = text_buffers(whole.column("chunk"))
            hashes, starts, ends, first = hasher.words(data, offs)
            if not len(hashes):
                return
            sizes = np.diff(first)
            chunk = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(hashes)) - first[chunk]
            piece = np.cumsum(data == 10)[starts]
            own = place < whole.column("own").to_numpy()[chunk]
            weights = whole.column("freq").to_numpy()[chunk]
            lang = langs.indices.to_numpy()[chunk].astype(np.int64)
            words = gathered(data, starts, ends - starts).dictionary_encode()
            width = len(words.dictionary)
            # Grams by the place of their first word: a number for each different one, -1 where there is none.
            single = np.unique(lang * width + words.indices.to_numpy(), return_inverse=True)[1]
            several, seed = single, np.array([language_hash(x) for x in langs.dictionary.to_pylist()], np.uint64)[lang]
            rolled = mix(seed * U(BASE) + hashes)
            for k in range(1, order):
                # Both parts of k words must be frequent.
                frequent = np.zeros(len(hashes), bool)
                there = np.flatnonzero(several >= 0)
                kinds, spot, back = np.unique(several[there], return_index=True, return_inverse=True)
                frequent[there] = in_filter(shared.value[k - 1], rolled[there[spot]])[back]
                fits = np.flatnonzero(frequent[:-1] & frequent[1:] & (place[:-1] + k < sizes[chunk[:-1]]))
                fits = fits[piece[fits] == piece[fits + k]]
                keys = several[fits] * (int(single.max()) + 1) + single[fits + k]
                longer = np.full(len(hashes), -1, np.int64)
                longer[fits] = np.unique(keys, return_inverse=True)[1]
                rolled[fits] = mix(rolled[fits] * U(BASE) + hashes[fits + k])
                several = longer
            at = np.flatnonzero(own & (several >= 0))
            if not len(at):
                return
            kinds, spot, back = np.unique(several[at], return_index=True, return_inverse=True)
            f = np.bincount(back, weights=weights[at]).astype(np.int64)
            here = at[spot]
            phrases = gathered(data, starts[here], ends[here + order - 1] - starts[here])
            for i in range(0, len(here), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[here[part]])), phrases[part], pa.array(f[part])], names=["lang", "phrase", "f"])

        rows, size = [], 0
        for batch in batches:
            rows.append(batch)
            size += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
            if size >= held:
                yield from block(rows)
                rows, size = [], 0
        if rows:
            yield from block(rows)

    found = dictionary.select("lang", "chunk", "own", "freq").mapInArrow(count, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_grams(dictionary: DataFrame, longest: int, least: int, most_bits: int) -> list[DataFrame]:
    """The n-grams of 1 to ``longest`` words with at least ``least`` occurrences, by order."""
    spark, filters, grams = dictionary.sparkSession, [], []
    for order in range(1, longest + 1):
        shared = spark.sparkContext.broadcast(filters)
        rows = written(gram_counts(dictionary, order, shared).where(F.col("f") >= least), f"phrases-{order}")
        shared.destroy()
        grams.append(rows)
        if order < longest:
            filters.append(phrase_filter(rows, most_bits))
    return grams


def scored(grams: list[DataFrame]) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): every candidate at its lowest-scoring cut, the shortest first part on ties."""
    everything = reduce(DataFrame.unionAll, grams)
    cuts = []
    for order, rows in enumerate(grams[1:], 2):
        words = F.split("phrase", " ")
        for k in range(1, order):
            part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
            cuts.append(rows.select("lang", "phrase", F.lit(order).alias("words"), F.col("f").alias("a"), F.lit(k).alias("k"), part(1, k).alias("left"), part(k + 1, order - k).alias("right")))
    cuts = reduce(DataFrame.unionAll, cuts)
    left = everything.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = everything.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    number = lambda c: F.col(c).cast("decimal(15,0)")
    both = both.withColumns({"above": number("a") * number("a") * F.lit(MILLION).cast("decimal(7,0)"), "below": number("l") * number("r")})
    both = both.withColumn("score", F.expr("above div below"))
    lowest = both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def uncontained(rows: DataFrame, longest: int, percent: int) -> DataFrame:
    """The candidates that no longer candidate contains with ``percent`` of their occurrences or more."""
    parts = []
    for order in range(3, longest + 1):
        words = F.split("phrase", " ")
        inner = [F.array_join(F.slice(words, a, n), " ") for n in range(2, order) for a in range(1, order - n + 2)]
        parts.append(rows.where(F.col("words") == order).select("lang", F.explode(F.array(*inner)).alias("phrase"), "a"))
    if not parts:
        return rows
    largest = reduce(DataFrame.unionAll, parts).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = rows.join(largest, ["lang", "phrase"], "left")
    return kept.where(F.coalesce(F.col("longer") * 100 < F.col("a") * percent, F.lit(True))).drop("longer")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    top: int = TOP,
    percent: int = CONTAINED_PERCENT,
    trigger: int = TRIGGER,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and 0x0A-0x0D, words at space
    and tab.  a, l and r are the occurrences of the phrase and of both parts of
    its lowest-scoring cut, n those of all words, score is
    floor(1000000 a a / (l r)).  Equal scores go by falling a, then by phrase
    in byte order.  A null language is ``und``.  Null, empty and very long
    texts, a text without any word that begins a chunk (it is one chunk), and
    repeated rows (they count as often as they are there) need no care.  An
    empty table gives an empty result.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    dictionary = written(parsed(docs, text_col, lang_col, longest, trigger), "phrases-parse")
    totals = written(dictionary.groupBy("lang").agg(F.sum(F.col("freq") * F.col("own")).alias("n")), "phrases-totals")
    grams = frequent_grams(dictionary, longest, least, most_bits)
    rows = uncontained(written(scored(grams), "phrases-scored"), longest, percent)
    # The best of a part of a language, then those of the language, of which there are SALTS * top rows at most.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rows = rows.withColumn("rank", place("lang", "salt")).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", place("lang").cast("long")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of ``documents``; see ``collocations``."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, part
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS part
        FROM documents)),
lists AS (SELECT lang, regexp_extract_all(part, '[^\x20\x09]+') AS words FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(words) AS phrase FROM lists
  UNION ALL
  SELECT lang, 2, unnest([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) FROM lists
  UNION ALL
  SELECT lang, 3, unnest([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)]) FROM lists),
counted AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang),
frequent AS (SELECT * FROM counted WHERE f >= 10),
cuts AS (
  SELECT lang, size, phrase, f AS a, 1 AS k, split_part(phrase, ' ', 1) AS left_part, substr(phrase, length(split_part(phrase, ' ', 1)) + 2) AS right_part
  FROM frequent WHERE size > 1
  UNION ALL
  SELECT lang, size, phrase, f, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3)
  FROM frequent WHERE size = 3),
cut_scores AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
         ((1000000 * c.a::HUGEINT * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c
  JOIN frequent x ON x.lang = c.lang AND x.phrase = c.left_part
  JOIN frequent y ON y.lang = c.lang AND y.phrase = c.right_part),
candidates AS (
  SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2) AS phrase, a FROM candidates WHERE size = 3
  UNION ALL
  SELECT lang, split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3), a FROM candidates WHERE size = 3),
longer AS (SELECT lang, phrase, max(a) AS longest FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN longer USING (lang, phrase)
  WHERE longest IS NULL OR 100 * longest < 50 * c.a),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN totals USING (lang) WHERE rank <= 2000
"""
