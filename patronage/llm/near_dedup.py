"""Near duplicates by SetSketch registers, bands of them, and confirmed links.

1. Every text becomes the set of its word shingles.  Equal sets are one node
   with a number of its own, whatever their ids.
2. A node's SetSketch has REGISTERS values.  Each shingle sends an ascending
   series of exponential arrivals to random registers, a register keeps its
   earliest arrival, and stores it truncated to a power of the base.  Sketches
   of parts merge by maximum of the stored values.  Equal registers mean
   similar sets, so bands of ROWS registers make candidate buckets: at a
   similarity of 0.8 all BANDS miss with a probability of 2e-9.
3. Candidates are estimated from both sketches by maximum likelihood, and only
   what is far below the threshold is left out; the others are confirmed on the
   full shingle sets.
4. No bucket is expanded into all its pairs.  First each node is compared with
   the leader it meets, then with the leaders of its other buckets, then what
   is outside its bucket's largest component with random members of that.  At
   last what is still outside is compared with all others of its bucket: pair by
   pair in buckets of at most SMALL members, and beyond that block by block,
   where a task compares a block of outsiders with a block of members by
   matrix products and returns the links only.

A link is |A and B| / |A or B| >= threshold, tested in integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import files, small_batches, table, whole_text, written
from .kernels import U, WordHasher, document_blocks, mix, rolled, text_buffers

BANDS, ROWS = 50, 5
REGISTERS = BANDS * ROWS
SCALE_BASE, RATE = 1.02, 20.0
# Six standard errors of an estimate from REGISTERS values at 0.8.
MARGIN = 0.15
WINDOW_WORDS, PERCENT = 2, 80
# Turns of comparing outsiders of a bucket with random members of its largest component.
TURNS = 1
# Members of a bucket that is compared pair by pair; rows of the blocks in which larger ones are compared.
SMALL = 64
OUTSIDERS, MEMBERS = 128, 256


def document_sets(data, offs, hasher, k):
    """The shingle set of each document, as sorted 64-bit hashes."""
    hashes, _, _, first = hasher.words(data, offs)
    shingles = rolled(hashes, k)
    for d in range(len(offs) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= k:
            yield np.unique(shingles[a : b - k + 1])
        elif b > a:
            yield rolled(hashes[a:b], b - a) + U(b - a)
        else:
            yield np.zeros(0, np.uint64)


def registers(elements, count=REGISTERS):
    """Stored register values of a set; a set without elements has zeros."""
    n = len(elements)
    if not n:
        return np.zeros(count, np.uint16)
    depth = 2 + math.ceil(1.3 * count * (math.log(count) + 3) / n)
    while True:
        series = np.arange(1, depth + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
        drawn = mix(elements[:, None] + series[None, :])
        gaps = -np.log(((drawn >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
        times = np.cumsum(gaps, axis=1)
        slots = ((mix(drawn ^ U(0xA0761D6478BD642F)) >> U(32)) * U(count)) >> U(32)
        earliest = np.full(count, np.inf)
        np.minimum.at(earliest, slots.ravel().astype(np.int64), times.ravel())
        # Later arrivals of any element cannot change a register that is earlier than all of them.
        if earliest.max() <= times[:, -1].min():
            break
        depth *= 2
    stored = np.floor(1 - np.log(earliest / (RATE * count)) / math.log(SCALE_BASE))
    return np.clip(stored, 0, 65535).astype(np.uint16)


def likely_similarity(a, b, n_a, n_b):
    """Maximum-likelihood Jaccard similarity from the registers of two sets of known size."""
    larger, smaller = int((a > b).sum()), int((a < b).sum())
    equal = len(a) - larger - smaller
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    j = np.linspace(0, min(u / v, v / u), 401)
    part = lambda x: -np.log1p(-np.clip(x, 0, 1) * (SCALE_BASE - 1) / SCALE_BASE) / math.log(SCALE_BASE)
    more, less = part(u - v * j), part(v - u * j)
    tiny = 1e-300
    value = larger * np.log(more + tiny) + smaller * np.log(less + tiny) + equal * np.log(np.maximum(1 - more - less, tiny))
    return float(j[np.argmax(value)])


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, k: int, sketches: bool) -> DataFrame:
    """(id, same, n, digest) of each row's set, with its registers if asked for; ``same`` is a hash of the text."""
    small_batches(docs.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            data, offs = text_buffers(batch.column(1))
            n, digests, values = [], [], []
            for i, j in document_blocks(offs, 1 << 19):
                for elements in document_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], hasher, k):
                    n.append(len(elements))
                    digests.append(hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None)
                    if sketches:
                        values.append(registers(elements).tobytes())
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary())]
            names = ["id", "same", "n", "digest"]
            if sketches:
                columns.append(pa.array(values, pa.binary()))
                names.append("registers")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = with_text_hash(docs, id_col, text_col).select("id", "text", "same")
    return rows.mapInArrow(sets, "id long, same long, n long, digest binary" + (", registers binary" if sketches else ""))


def with_text_hash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, same): with a hash of the text, which tells rows apart that repeat an id."""
    text = whole_text(text_col)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("same"))


def confirmed(pairs: DataFrame, sides: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, linked) of the candidate pairs; ``sides`` has id, n, registers and text of the nodes."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        least = percent / 100 - MARGIN

        def elements(column):
            data, offs = text_buffers(column)
            for i, j in document_blocks(offs, 1 << 19):
                yield from document_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], hasher, k)

        for batch in batches:
            a_values, b_values = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            linked = []
            for x, y, p, q in zip(elements(batch.column(3)), elements(batch.column(5)), a_values, b_values):
                p, q = np.frombuffer(p, np.uint16), np.frombuffer(q, np.uint16)
                if likely_similarity(p, q, len(x), len(y)) < least:
                    linked.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    one = sides.select(F.col("id").alias("a"), F.col("registers").alias("a_registers"), F.col("text").alias("a_text"))
    two = sides.select(F.col("id").alias("b"), F.col("registers").alias("b_registers"), F.col("text").alias("b_text"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "a_registers", "a_text", "b_registers", "b_text")
    return joined.mapInArrow(judge, "a long, b long, linked boolean")


def node_texts(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame) -> DataFrame:
    """(id, registers, text): the text of the row that each node took its id from."""
    rows = with_text_hash(docs, id_col, text_col).withColumnRenamed("id", "doc")
    found = rows.join(nodes.select("id", "doc", "same", "registers"), ["doc", "same"])
    # Rows that repeat both id and text; where the join has put them.
    return found.groupBy("doc", "same", "id").agg(F.first("registers").alias("registers"), F.first("text").alias("text")).select("id", "registers", "text")


def block_links(placed: DataFrame, sides: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, linked): for each outsider of a bucket, a link to every component that it has one to in a block.

    ``placed`` has bucket, id, n, component and main, the bucket's largest
    component.  Buckets with the same largest component are compared together,
    in blocks of outsiders and of members; pairs are never rows.
    """

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            data, offs = text_buffers(batch.column(4))
            sets = []
            for i, j in document_blocks(offs, 1 << 19):
                sets += [x.tobytes() for x in document_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], hasher, k)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], names=["main", "id", "component", "registers", "elements"])

    members = placed.select("main", "id", "component").distinct().join(sides, "id").select("main", "id", "component", "registers", "text")
    members = written(members.mapInArrow(with_sets, "main long, id long, component long, registers binary, elements binary"), "near-members")

    def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
        # Written, so that its size is known: while it is small it is broadcast and a hot component's rows stay where they are.
        parts = written(rows.groupBy("main").agg(F.ceil(F.count("*") / size).cast("int").alias("parts")), "near-parts", 1)
        dealt = rows.join(parts, "main").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        cells = F.collect_list(F.struct("id", "component", "registers", "elements")).alias(name)
        return dealt.groupBy("main", "part", "parts").agg(cells)

    all_members = packed(members, MEMBERS, "members")
    outside = packed(members.where("component <> main"), OUTSIDERS, "outsiders").select("main", F.col("outsiders"))
    parts = all_members.select("main", "parts").distinct()
    asked = outside.join(parts, "main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = asked.join(all_members.drop("parts"), ["main", "part"]).select("outsiders", "members")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpacked(cells):
            ids, component = (cells.field(i).to_numpy() for i in (0, 1))
            registers = np.frombuffer(b"".join(cells.field(2).to_pylist()), np.uint16).reshape(len(ids), -1)
            return ids, component, registers, [np.frombuffer(x, np.uint64) for x in cells.field(3).to_pylist()]

        for batch in batches:
            a_out, b_out = [], []
            for row in range(len(batch)):
                a_ids, a_of, a_registers, a_sets = unpacked(batch.column(0)[row].values)
                b_ids, b_of, b_registers, b_sets = unpacked(batch.column(1)[row].values)
                a_n, b_n = np.array([len(x) for x in a_sets]), np.array([len(x) for x in b_sets])
                # Only elements that both sides have can be shared.
                kinds, place = np.unique(np.concatenate([*a_sets, *b_sets]), return_inverse=True)
                split = a_n.sum()
                both = np.intersect1d(place[:split], place[split:])
                number = np.full(len(kinds), -1)
                number[both] = np.arange(len(both))
                shared = np.zeros((len(a_ids), len(b_ids)), np.float32)
                for at in range(0, len(both), 4096):
                    sides = []
                    for sizes, own in ((a_n, place[:split]), (b_n, place[split:])):
                        column = number[own] - at
                        here = (column >= 0) & (column < 4096)
                        matrix = np.zeros((len(sizes), min(4096, len(both) - at)), np.float32)
                        matrix[np.repeat(np.arange(len(sizes)), sizes)[here], column[here]] = 1
                        sides.append(matrix)
                    shared += sides[0] @ sides[1].T
                shared = np.rint(shared).astype(np.int64)
                linked = 100 * shared >= percent * (a_n[:, None] + b_n[None, :] - shared)
                linked &= a_of[:, None] != b_of[None, :]
                for i in np.flatnonzero(linked.any(axis=1)):
                    # One link to each component is enough to join it.
                    others = np.flatnonzero(linked[i])
                    _, first = np.unique(b_of[others], return_index=True)
                    a_out += [a_ids[i]] * len(first)
                    b_out += b_ids[others[first]].tolist()
            ends = np.sort(np.array([a_out, b_out], np.int64).reshape(2, -1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1]), pa.array(np.ones(len(ends[0]), bool))], names=["a", "b", "linked"])

    return met.mapInArrow(judge, "a long, b long, linked boolean")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the links (a, b), by hooking and shortcuts.

    Each round every component hooks on to its smallest neighbour, and labels
    are shortened until they are roots.  The rounds grow with the logarithm of
    the longest chain.
    """
    few, several = files(links.count()), files(nodes.count())
    labels = written(nodes.select("id", F.col("id").alias("component")), "labels", several)
    links = written(links.select("a", "b").where("a <> b").distinct(), "links", few)
    while True:
        of_a = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        of_b = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        # Combined before the exchange: a component keeps one row per task.
        across = links.join(of_a, "a").join(of_b, "b").where("ca <> cb")
        hooks = across.groupBy(F.greatest("ca", "cb").alias("root")).agg(F.min(F.least("ca", "cb")).alias("target"))
        hooks = written(hooks, "hooks", few)
        if hooks.isEmpty():
            return labels
        while True:
            # Four hooks at a time.
            jumped, onward = hooks.withColumn("moved", F.lit(False)), hooks.select(F.col("root").alias("target"), F.col("target").alias("further"))
            for _ in range(3):
                jumped = jumped.join(onward, "target", "left").select("root", F.coalesce("further", "target").alias("target"), (F.col("moved") | F.col("further").isNotNull()).alias("moved"))
            jumped = written(jumped, "hooks", few)
            hooks = jumped.select("root", "target")
            if jumped.where("moved").isEmpty():
                break
        moved = labels.join(hooks.withColumnRenamed("root", "component"), "component", "left")
        labels = written(moved.select("id", F.coalesce("target", "component").alias("component")), "labels", several)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row: id, n_shingles, component_id, kept; see ``near_rows``."""
    return near_rows(docs, id_col, text_col, k, percent).drop("same")


def near_rows(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """One row per row: id, a hash of the text (``same``), n_shingles, component_id, kept.

    A-Z are lower-cased; a text of fewer than ``k`` words has its whole word
    sequence as the one shingle; null, empty and white texts have none, link
    with nothing and are their own component.  Rows that repeat an id are rows
    of their own, linked by their texts alone, and each is kept if its id is the
    smallest of its component.  A null id is linked with nothing, its component
    is null and it is kept.  The smallest id of a component is kept.
    """
    found = shingle_sets(docs, id_col, text_col, k, sketches=True).where("id is not null and n > 0")
    nodes = found.groupBy("digest").agg(F.min(F.struct("id", "same")).alias("row"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    nodes = nodes.select("digest", F.col("row.id").alias("doc"), F.col("row.same").alias("same"), "n", "registers")
    # The numbers are written with the nodes, so they stay.
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "near-nodes")
    # Bounds of the tables with a row for each node, and for each node and band.
    one, banded = files(nodes.count()), files(BANDS * nodes.count())
    # (bucket, id): the hash of each band's registers, with the number of the band.
    bucket_of = lambda i: F.xxhash64(F.substring("registers", i * (2 * ROWS) + 1, F.lit(2 * ROWS)), i)
    buckets = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), bucket_of)
    rows = nodes.select("id", "n", F.explode(buckets).alias("bucket"))
    # Leaders are random but the same in all buckets, so a group mostly meets one.
    leaders = rows.groupBy("bucket").agg(F.min(F.xxhash64("id")).alias("first"), F.count("*").alias("size")).where("size > 1")
    leaders = written(leaders.select("bucket", "first"), "near-leaders", banded)
    members = written(rows.join(leaders, "bucket").select("bucket", "id", "n", "first"), "near-members", banded)
    names = members.where(F.xxhash64("id") == F.col("first")).select("first", F.col("id").alias("leader"), F.col("n").alias("leader_n")).distinct()
    fitting = F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent
    stars = members.select("id", "n", "first").distinct().join(names, "first").where(F.col("id") != F.col("leader"))
    stars = written(stars.where(fitting).select("id", "leader", "first"), "near-stars", banded)

    wanted = members.select("id").distinct()
    sides = written(node_texts(docs, id_col, text_col, nodes.join(wanted, "id", "left_semi")), "near-sides")

    def pair(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    # Each node with the first leader it meets.
    best = stars.groupBy("id").agg(F.min("first").alias("first"))
    first = stars.join(best, ["id", "first"], "left_semi").select(*pair("id", "leader")).distinct()
    judged = written(confirmed(first, sides, k, percent).repartition(one, "a"), "near-judged")
    label = components(nodes, judged.where("linked"))

    def apart(pairs: DataFrame, done: DataFrame) -> DataFrame:
        """Pairs of different components that have not been judged."""
        of_a = label.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        of_b = label.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        open_pairs = pairs.join(of_a, "a").join(of_b, "b").where("ca <> cb").select("a", "b")
        return written(open_pairs.join(done.select("a", "b"), ["a", "b"], "left_anti"), "near-pairs", banded)

    # Then with the leaders of its other buckets, where that can still join components.
    second = apart(stars.select(*pair("id", "leader")).distinct(), judged)
    judged = judged.unionByName(written(confirmed(second, sides, k, percent).repartition(one, "a"), "near-judged"))
    label = components(nodes, judged.where("linked"))

    def mixed_buckets() -> tuple[DataFrame, DataFrame]:
        """The members of buckets that hold several components, and those outside their bucket's largest."""
        placed = members.select("bucket", "id", "n").join(label, "id")
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        placed = written(placed.join(mixed.select("bucket"), "bucket"), "near-placed", banded)
        sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("size"))
        main = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("main")).select("bucket", F.col("main.component").alias("main"))
        placed = written(placed.join(main, "bucket"), "near-placed", banded)
        others = placed.where("component <> main").select(
            "bucket", F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("component").alias("other_component")
        )
        return placed, written(others, "near-others", banded)

    near_size = F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * percent

    # Then those outside the largest component of a bucket with random members of it, one in each bucket.
    for turn in range(TURNS):
        placed, others = mixed_buckets()
        if others.isEmpty():
            break
        order = F.xxhash64("id", "bucket", F.lit(turn))
        insiders = placed.where("component = main")
        drawn = insiders.groupBy("bucket").agg(F.min(order).alias("drawn"))
        drawn = insiders.withColumn("drawn", order).join(drawn, ["bucket", "drawn"]).select("bucket", "id", "n")
        tried = others.join(drawn, "bucket").where(near_size).select(*pair("id", "other")).distinct()
        tried = written(tried.join(judged.select("a", "b"), ["a", "b"], "left_anti"), "near-pairs", banded)
        found = written(confirmed(tried, sides, k, percent).repartition(one, "a"), "near-judged")
        judged = judged.unionByName(found)
        if not found.where("linked").isEmpty():
            label = components(nodes, judged.where("linked"))

    # At last all members of a bucket that are still in different components.
    placed, others = mixed_buckets()
    sizes = written(placed.groupBy("bucket").agg(F.count("*").alias("size")), "near-sizes", banded)
    large = sizes.where(F.col("size") > SMALL).select("bucket")
    blocked = written(block_links(placed.join(large, "bucket", "left_semi"), sides, k, percent).repartition(one, "a"), "near-judged")
    small = sizes.where(F.col("size") <= SMALL).select("bucket")
    placed, others = placed.join(small, "bucket", "left_semi"), others.join(small, "bucket", "left_semi")
    # A pair counts in the first bucket that it shares, which also has the two in different components.
    own = nodes.select("id", buckets.alias("own"))
    placed = placed.select("bucket", "id", "n", "component").join(own, "id")
    others = others.join(own.select(F.col("id").alias("other"), F.col("own").alias("other_own")), "other")
    first_shared = F.get(F.filter("own", lambda x, i: x == F.get("other_own", i)), F.lit(0)) == F.col("bucket")
    third = placed.join(others, "bucket").where("component <> other_component").where(near_size & first_shared)
    third = third.select(*pair("id", "other")).distinct().join(judged.select("a", "b"), ["a", "b"], "left_anti")
    last = written(confirmed(written(third, "near-pairs", banded), sides, k, percent).repartition(one, "a"), "near-judged")
    last = last.unionByName(blocked)
    if not last.where("linked").isEmpty():
        label = components(nodes, judged.unionByName(last).where("linked"))

    # A component is named by the smallest id of all its rows.
    named = nodes.select("digest", "id", "doc").join(label, "id")
    smallest = named.groupBy("component").agg(F.min("doc").alias("least"))
    named = written(named.join(smallest, "component").select("digest", F.col("least").alias("component")), "near-components", one)
    own = shingle_sets(docs, id_col, text_col, k, sketches=False)
    answer = own.join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return answer.select(
        F.col("id").alias(id_col),
        "same",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows that are kept, with all their columns; five-word shingles unless said otherwise.

    Odd rows are treated as in ``near_rows``: those with a null id and those
    without words stay, and rows that repeat an id are judged by their texts.
    """
    gone = near_rows(docs, id_col, text_col, k, percent).where("not kept").select(F.col(id_col).alias("__gone"), F.col("same").alias("__same")).distinct()
    same = F.xxhash64(whole_text(text_col))
    return docs.join(gone, (F.col(f"`{id_col}`") == F.col("__gone")) & (same == F.col("__same")), "left_anti")


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    """``documents`` by two-word shingles at 0.8; see ``near_rows``."""
    return near_groups(table(spark, sf_dir, "documents"))
