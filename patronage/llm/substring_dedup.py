"""Removal of repeated word sequences over a compacted De Bruijn graph.

Every window of WINDOW words is an edge between its first and its last
WINDOW - 1 words.  A word of a document goes when a window over it also starts
in a document of smaller id.

1. Anchors.  A window's anchor is the smallest hash of its ANCHOR-word grams,
   so equal windows have equal anchors, wherever they are.  Anchors that occur
   in one document only cannot belong to a repeated window; a join of anchors
   leaves the documents' other ones.
2. Compaction.  Neighbouring windows with one anchor are compacted to a path,
   identified by all its edges and by a digest of its words at its source
   coordinates, so that equal paths are verified on the text.  Paths meet by
   anchor.  Where an anchor has one path only, nothing branches, and the path
   is settled as a whole by its smallest document.
3. Branches.  The other paths are taken apart into edges, and each edge is
   settled by its smallest document.
4. The settled paths and edges are joined back to their documents.

Tasks combine what they have seen before anything is shuffled: an anchor or a
path that is in a third of all documents arrives as one row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import small_batches, table, whole_text, written
from .kernels import U, WordHasher, document_blocks, mix, rolled, sliding_min, text_buffers

WINDOW, ANCHOR = 13, 3
LAST = (1 << 63) - 1
# Anchors and paths that a task combines at a time.
ANCHORS_AT_ONCE, PATHS_AT_ONCE = 1 << 20, 1 << 17


def document_runs(hashes, window, anchor):
    """(anchors, starts, ends) of the runs of windows with the same anchor."""
    least = sliding_min(rolled(hashes, anchor), window - anchor + 1)
    if not len(least):
        return least, np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts = np.concatenate([[0], bounds])
    return least[starts], starts, np.append(bounds, len(least))


def documents(batch_column, hasher):
    """(row, word hashes, bytes) of each text of a batch."""
    data, offs = text_buffers(batch_column)
    for i, j in document_blocks(offs, 1 << 19):
        piece, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        hashes, _, _, first = hasher.words(piece, own)
        for d in range(j - i):
            yield i + d, hashes[first[d] : first[d + 1]], piece[own[d] : own[d + 1]]


def known_place(anchor, key):
    """Where an anchor goes that is already known to be repeated: anywhere, but always the same."""
    return mix(anchor ^ mix(key + U(1)))


def path_digest(words, start, end, window):
    """Digest of the words under the windows from start to end."""
    return int.from_bytes(hashlib.blake2b(b" ".join(words[start : end + window - 1]), digest_size=8).digest(), "little", signed=True)


def anchor_rows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(place, key, known) of the anchors of the rows (key, text).

    Of an anchor that a task finds in one document only it tells that document.
    Otherwise it tells each of its documents as known, and once that the anchor
    exists, which is a row without key.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        anchors, keys, size = [], [], 0

        def combined():
            a, k = np.concatenate(anchors), np.concatenate(keys)
            order = np.lexsort((k, a))
            a, k = a[order], k[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (k[1:] != k[:-1])
            a, k = a[new], k[new]
            starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            counts = np.diff(np.append(starts, len(a)))
            many = np.repeat(counts > 1, counts)
            told = a[starts[counts > 1]]
            place = np.concatenate([np.where(many, known_place(a, k.view(np.uint64)), a), told])
            nothing = np.concatenate([np.zeros(len(a), bool), np.ones(len(told), bool)])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(place.view(np.int64)),
                    pa.array(np.concatenate([k, np.zeros(len(told), np.int64)]), mask=nothing),
                    pa.array(np.concatenate([many, np.zeros(len(told), bool)])),
                ],
                names=["place", "key", "known"],
            )

        for batch in batches:
            key = batch.column(0).to_numpy()
            for row, hashes, _ in documents(batch.column(1), hasher):
                found = np.unique(document_runs(hashes, window, anchor)[0])
                if len(found):
                    anchors.append(found)
                    keys.append(np.full(len(found), key[row], np.int64))
                    size += len(found)
                    if size >= ANCHORS_AT_ONCE:
                        yield combined()
                        anchors, keys, size = [], [], 0
        if size:
            yield combined()

    return rows.mapInArrow(find, "place long, key long, known boolean")


def path_rows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, path, edges, keys) of the candidate paths of the rows (key, text, places), combined per task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        held: dict[tuple, list[int]] = {}

        def combined():
            columns = list(zip(*held))
            kinds = [pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([sorted(set(v)) for v in held.values()], pa.list_(pa.int64()))], names=["anchor", "path", "edges", "keys"])

        for batch in batches:
            keys, places = batch.column(0).to_numpy(), batch.column(2)
            for row, hashes, text in documents(batch.column(1), hasher):
                if not places[row].is_valid:
                    continue
                wanted = places[row].values.to_numpy().view(np.uint64)
                anchors, starts, ends = document_runs(hashes, window, anchor)
                key = int(keys[row])
                hits = np.isin(anchors, wanted) | np.isin(known_place(anchors, keys[row : row + 1].view(np.uint64)), wanted)
                if not hits.any():
                    continue
                words, edges = text.tobytes().split(), rolled(hashes, window)
                for i in np.flatnonzero(hits).tolist():
                    s, e = int(starts[i]), int(ends[i])
                    name = (int(anchors[i].view(np.int64)), path_digest(words, s, e, window), edges[s:e].tobytes())
                    held.setdefault(name, []).append(key)
                if len(held) >= PATHS_AT_ONCE:
                    yield combined()
                    held = {}
        if held:
            yield combined()

    return rows.mapInArrow(find, "anchor long, path long, edges binary, keys array<long>")


def kept_rows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept) of the rows (id, text, gone_paths, gone_edges)."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            paths, edges_gone = batch.column(2), batch.column(3)
            out = []
            for row, hashes, text in documents(batch.column(1), hasher):
                words, gone = text.tobytes().split(), None
                if paths[row].is_valid or edges_gone[row].is_valid:
                    of_paths = set(paths[row].as_py() or ())
                    of_edges = np.frombuffer(b"".join(edges_gone[row].as_py() or ()), np.uint64)
                    edges = rolled(hashes, window)
                    covered = np.isin(edges, of_edges)
                    if of_paths:
                        for s, e in zip(*(x.tolist() for x in document_runs(hashes, window, anchor)[1:])):
                            if path_digest(words, s, e, window) in of_paths:
                                covered[s:e] = True
                    delta = np.zeros(len(words) + 1, np.int64)
                    at = np.flatnonzero(covered)
                    np.add.at(delta, at, 1)
                    np.add.at(delta, at + window, -1)
                    gone = np.cumsum(delta)[:-1] > 0
                n = len(words)
                if gone is not None and gone.any():
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((n, n - len(words), b" ".join(words)))
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in columns[2]], pa.string()),
                    *([pa.array(columns[2], pa.binary()).cast(pa.string())] if with_text else []),
                ],
                names=["id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text,
            )

    with_text = "with_text" in rows.columns
    rows = rows.drop("with_text")
    return rows.mapInArrow(remove, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False
) -> DataFrame:
    """One row per row: id, n_words, n_removed, kept_sha256, and with_text the kept words joined by spaces.

    Null and empty texts have no words.  Texts shorter than a window keep all
    words, repetition within a document or between rows of the same id is kept.
    A null id counts as larger than all others.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), key.alias("key"), whole_text(text_col).alias("text"))

    told = anchor_rows(rows.select("key", "text"), window, anchor)
    repeated = told.withColumn("n", F.count("*").over(Window.partitionBy("place")))
    repeated = repeated.where(F.col("key").isNotNull() & (F.col("known") | (F.col("n") > 1)))
    places = written(repeated.groupBy("key").agg(F.collect_set("place").alias("places")), "repeat-anchors")

    # The same columns of ``rows`` as below, so that its exchange by key is made once.
    found = path_rows(rows.join(places, "key").select("key", "text", "places", "id"), window, anchor)
    # One row per task and path; all of an anchor's paths are in one partition.
    found = found.repartition("anchor")
    by_anchor, by_path = Window.partitionBy("anchor"), Window.partitionBy("anchor", "path", "edges")
    settled = found.withColumn("first", F.min(F.array_min("keys")).over(by_path))
    settled = settled.withColumn("one", F.min("path").over(by_anchor) == F.max("path").over(by_anchor))

    whole = settled.where("one").select("path", "first", F.explode("keys").alias("key")).where("key > first")
    edge = F.explode(F.sequence(F.lit(0), (F.length("edges") / 8).cast("int") - 1)).alias("i")
    single = settled.where("not one").select("anchor", "edges", "keys", edge)
    single = single.select("anchor", F.expr("substring(edges, i * 8 + 1, 8)").alias("edge"), "keys")
    single = single.withColumn("first", F.min(F.array_min("keys")).over(Window.partitionBy("anchor", "edge")))
    single = single.select("edge", "first", F.explode("keys").alias("key")).where("key > first")
    gone = whole.select("key", "path", F.lit(None).cast("binary").alias("edge")).unionByName(
        single.select("key", F.lit(None).cast("long").alias("path"), "edge")
    )
    gone = gone.groupBy("key").agg(F.collect_set("path").alias("gone_paths"), F.collect_set("edge").alias("gone_edges"))
    answer = rows.join(gone, "key", "left").select("id", "text", "gone_paths", "gone_edges")
    if with_text:
        answer = answer.withColumn("with_text", F.lit(True))
    return kept_rows(answer, window, anchor).withColumnRenamed("id", id_col)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
