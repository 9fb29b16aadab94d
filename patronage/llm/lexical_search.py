"""Ranked lexical search by NRA: sequential reads of lists sorted by impact, without random access.

1. Every text is reduced to its length and the terms that the queries have, in
   a table of one row per document (a forward index over the queries' terms).
2. Numbers of documents and terms, and the document frequencies, are counted
   over that table and give the terms' weights.
3. The index is split by documents: a task reads its rows in chunks of at most
   CHUNK_POSTINGS and CHUNK_DOCS, and turns each chunk into one list per term,
   sorted by impact.
4. For each query, NRA reads its lists in step, deeper every round.  A document
   has a lower score (what was read of it) and an upper score (that plus the
   next impact of every list in which it was not seen).  Reading goes on until
   no unseen document can reach the tenth place, and until the documents that
   can, ties included, have equal lower and upper scores.  The best that a task
   has found bound its later chunks.
5. The tasks' best are merged by Spark, so no step holds more than ``top`` rows
   of a query for each task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import small_batches, table, whole_text, written

TOP = 10
# Characters of queries whose terms are looked for in one pass over the documents.
BLOCK_CHARS = 4_000_000
CHUNK_POSTINGS, CHUNK_DOCS = 1 << 20, 1 << 15
# Postings that the first round reads of each list; each later round reads twice as many.
FIRST_READ = 64
# Maximal runs of ASCII letters and digits and of everything beyond ASCII.
TERM = rb"[0-9A-Za-z\x80-\xff]+"
MOST = 1_000_000_000


def terms_of(text: str) -> list[bytes]:
    """The terms of a text with repeats; only A-Z are lower-cased."""
    return re.findall(TERM, text.encode("utf-8", "surrogatepass").lower())


def forward_index(docs: DataFrame, id_col: str, text_col: str, numbers) -> DataFrame:
    """(id, n, terms, tfs) of the documents with a term; ``terms`` are the numbers of those in the broadcast dictionary."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_of = numbers.value.get
        find = re.compile(TERM).findall
        for batch in batches:
            keep, lengths, terms, tfs = [], [], [], []
            for row, scalar in enumerate(batch.column(1)):
                words = find(scalar.as_buffer().to_pybytes().lower())
                if not words:
                    continue
                keep.append(row)
                lengths.append(len(words))
                known = np.array([x for x in map(number_of, words) if x is not None], np.int32)
                kinds, n = np.unique(known, return_counts=True)
                terms.append(kinds.astype("<i4").tobytes())
                tfs.append(n.astype("<i4").tobytes())
            columns = [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "tfs"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(index, "id long, n long, terms binary, tfs binary")


def document_frequencies(index: DataFrame, size: int) -> np.ndarray:
    """In how many rows of the index each of the ``size`` terms occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            held = b"".join(batch.column(0).to_pylist())
            n += np.bincount(np.frombuffer(held, "<i4"), minlength=size)
        term = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(n[term])], names=["term", "df"])

    counted = index.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    return df


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Lists:
    """The postings of a chunk of documents as one list per term, each sorted by falling impact.

    The impact of a posting is (MOST * tf) div (1000 * tf + 8 * m), to be
    multiplied by the weight of the term.
    """

    def __init__(self, terms: np.ndarray, docs: np.ndarray, tfs: np.ndarray, m: np.ndarray, size: int):
        tfs = tfs.astype(np.int64)
        impact = (MOST * tfs) // (1000 * tfs + 8 * m[docs])
        order = np.lexsort((-impact, terms))
        self.docs, self.impact = docs[order], impact[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=size))])
        self.size = len(m)


def nra(lists: Lists, query: list[tuple[int, int]], best: list[tuple[int, int]], ids: np.ndarray, top: int, first: int = FIRST_READ) -> list[tuple[int, int]]:
    """The ``top`` of ``best`` and the chunk's documents, as (score, id): highest scores, then smallest ids.

    ``query`` has (term, weight times repeats); ``best`` is sorted.  Only scores
    above 0 count.
    """
    ends = [(int(lists.start[t]), int(lists.start[t + 1]), w) for t, w in query if w > 0]
    ends = [x for x in ends if x[0] < x[1]]
    if not ends:
        return best
    read = [a for a, _, _ in ends]
    bound = [w * int(lists.impact[a]) for a, _, w in ends]
    lower = np.zeros(lists.size, np.int64)
    # Of each document, the sum of the bounds of the lists in which it was seen.
    met = np.zeros(lists.size, np.int64)
    step, known = first, [s for s, _ in best]
    while True:
        for j, (a, b, w) in enumerate(ends):
            at = read[j]
            if at == b:
                continue
            upto = min(at + step, b)
            docs = lists.docs[at:upto]
            lower[docs] += w * lists.impact[at:upto]
            after = w * int(lists.impact[upto]) if upto < b else 0
            met[docs] += bound[j]
            met[lists.docs[a:upto]] += after - bound[j]
            read[j], bound[j] = upto, after
        step *= 2
        unseen = sum(bound)
        # The score that the last place has at least.
        reached = np.concatenate([np.array(known, np.int64), lower[lower > 0]])
        place = int(np.partition(reached, len(reached) - top)[len(reached) - top]) if len(reached) >= top else 1
        if unseen >= place:
            continue  # a document that was not seen yet could take or share the last place
        upper = lower + (unseen - met)
        open_docs = np.flatnonzero((lower > 0) & (upper >= place))
        if (upper[open_docs] == lower[open_docs]).all():
            break
    found = best + [(int(lower[d]), int(ids[d])) for d in open_docs]
    return sorted(found, key=lambda x: (-x[0], x[1]))[:top]


def ranked(index: DataFrame, queries, documents: int, terms: int, size: int, top: int, id_kind: str, chunk_docs: int, chunk_postings: int) -> DataFrame:
    """(item, doc_id, score): the best of each task; ``queries`` are broadcast (items, their (term, weight) lists)."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, asked = queries.value
        best = [[] for _ in items]
        held, postings = [], 0

        def chunk() -> None:
            ids, n, of_terms, of_tfs = zip(*held)
            m = 100 - 75 + (75 * np.array(n, np.int64) * documents) // terms
            doc = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in of_terms])
            lists = Lists(np.frombuffer(b"".join(of_terms), "<i4"), doc, np.frombuffer(b"".join(of_tfs), "<i4"), m, size)
            own = np.array(ids, np.int64)
            for i, query in enumerate(asked):
                best[i] = nra(lists, query, best[i], own, top)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                postings += len(row[2]) // 4
                if len(held) >= chunk_docs or postings >= chunk_postings:
                    chunk()
                    held, postings = [], 0
        if held:
            chunk()
        item, score, doc = [], [], []
        for i, rows in zip(items, best):
            item += [i] * len(rows)
            score += [s for s, _ in rows]
            doc += [d for _, d in rows]
        numbers = [pa.array(range(len(items)), pa.int32()).take(pa.array(np.repeat(np.arange(len(items)), [len(x) for x in best])))]
        yield pa.RecordBatch.from_arrays([*numbers, pa.array(item, kind), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["query", "item", "doc_id", "score"])

    kind = pa.string() if id_kind == "string" else pa.int64()
    rows = index.where("id is not null").select("id", "n", "terms", "tfs")
    return rows.mapInArrow(rank, f"query int, item {id_kind}, doc_id long, score long")


def blocks(items: DataFrame, most: int) -> Iterator[DataFrame]:
    """The items in parts of about ``most`` characters; a part has more only if its items cannot be told apart."""
    parts, key = 1, F.xxhash64("item", "text")
    while True:
        size = items.groupBy(F.pmod(key, F.lit(parts)).alias("part")).agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))
        if size.where((F.col("chars") > most) & (F.col("n") > 1)).isEmpty() or parts > 1 << 40:
            break
        parts *= 2
    for part in range(parts):
        yield items.where(F.pmod(key, F.lit(parts)) == part)


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    block_chars: int = BLOCK_CHARS,
    chunk_docs: int = CHUNK_DOCS,
    chunk_postings: int = CHUNK_POSTINGS,
) -> DataFrame:
    """The ``top`` documents of each item: item, rank from 1, id, score.

    Equal scores go by ascending id, and documents without a term of positive
    weight are not returned.  Null and empty texts have no terms; a document
    without terms does not count.  Documents without an id take part in the
    counts but not in the ranking; rows that repeat an id are documents of
    their own.  Items that repeat are one; an item without an id keeps a null
    id, and an id with several texts is ranked for each of them.  Empty tables
    give an empty result.  Item ids are whole numbers or texts.  Other columns
    are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_kind = "string" if items.schema[item_col].dataType.simpleString() == "string" else "long"
    asked = items.select(F.col(f"`{item_col}`").cast(id_kind).alias("item"), whole_text(item_text_col).alias("text")).distinct()
    found = None
    for part in blocks(written(asked, "search-items"), block_chars):
        rows = [(r.item, terms_of(r.text)) for r in part.collect()]
        if not rows:
            continue
        numbers = {t: i for i, t in enumerate(sorted({t for _, terms in rows for t in terms}))}
        shared = spark.sparkContext.broadcast(numbers)
        index = written(forward_index(docs, id_col, text_col, shared), "search-index")
        shared.destroy()
        documents, terms = index.agg(F.count("*"), F.sum("n")).first()
        if not documents or not numbers:
            continue
        df = document_frequencies(index, len(numbers))
        weights = [weight(documents, int(n)) if n else 0 for n in df]
        queries = []
        for _, words in rows:
            kinds, n = np.unique(np.array([numbers[w] for w in words], np.int64), return_counts=True)
            queries.append([(int(t), weights[t] * int(k)) for t, k in zip(kinds, n)])
        shared = spark.sparkContext.broadcast(([i for i, _ in rows], queries))
        block = ranked(index, shared, documents, terms, len(numbers), top, id_kind, chunk_docs, chunk_postings)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
        block = written(block.withColumn("rank", place).where(F.col("rank") <= top), "search-found").select("item", "rank", "doc_id", "score")
        shared.destroy()
        found = block if found is None else found.unionByName(block)
    if found is None:
        found = spark.createDataFrame([], f"item {id_kind}, rank int, doc_id long, score long")
    return found.select(F.col("item").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """Each item of ``benchmark`` against all ``documents``; see ``search``."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
sizes AS (SELECT row_id, doc_id, len(terms) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
lengths AS (SELECT row_id, doc_id, 100 - 75 + ((75 * n * n_docs) // n_terms) AS m FROM sizes, totals),
asked AS (
  SELECT item_id, text, term, count(*) AS repeats
  FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL),
postings AS (
  SELECT row_id, term, count(*) AS tf
  FROM (SELECT row_id, unnest(terms) AS term FROM words) WHERE term IN (SELECT term FROM asked)
  GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
scores AS (
  SELECT item_id, text, row_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (row_id)
  WHERE doc_id IS NOT NULL
  GROUP BY ALL),
placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
