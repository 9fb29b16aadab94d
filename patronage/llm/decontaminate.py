"""Benchmark decontamination by exact pieces and Myers' bit-parallel distance.

An item that occurs in a text with at most k edits, cut into k + 1 pieces, has
at least one piece unedited.  All pieces of a block of items are found in one
pass over a text by an Aho-Corasick automaton.  A hit is verified upwards in a
tree over the pieces: a node of n pieces may have n - 1 edits, and when a node
fits, one of its halves does, so a hit whose parent does not fit is dropped
after a few steps and no occurrence is lost.  Distances are Myers' with the
pattern's columns in one integer.

Texts and items are compared lower-cased with white space as single spaces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, table, whole_text

EDIT_SHARE = 0.1
LEAST_PIECE = 9
# Characters of items broadcast at a time; more items are matched in several passes.
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, share: float = EDIT_SHARE) -> int:
    """Edits allowed to an item; its pieces keep LEAST_PIECE characters."""
    return max(0, min(int(length * share), length // LEAST_PIECE - 1))


class Pattern:
    """Myers' matching of one pattern anywhere in a text."""

    def __init__(self, pattern: str):
        self.length = len(pattern)
        self.mask = (1 << self.length) - 1
        self.high = 1 << (self.length - 1)
        self.rows: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.rows[c] = self.rows.get(c, 0) | 1 << i

    def best(self, text: str, limit: int) -> tuple[int, int] | None:
        """(distance, end) of the best end within ``limit`` edits, the first of equals."""
        plus, minus, score = self.mask, 0, self.length
        mask, high, get = self.mask, self.high, self.rows.get
        found = None
        for at, c in enumerate(text):
            eq = get(c, 0)
            x = eq | minus
            diagonal = ((((x & plus) + plus) ^ plus) | x) & mask
            up = minus | ~(diagonal | plus) & mask
            down = plus & diagonal
            if up & high:
                score += 1
            elif down & high:
                score -= 1
            up = (up << 1) & mask
            plus = ((down << 1) | ~(diagonal | up)) & mask
            minus = up & diagonal
            if score <= limit:
                found, limit = (score, at + 1), score - 1
                if not score:
                    break
        return found


class Item:
    """An item's pieces and the tree over them."""

    def __init__(self, key: int, text: str, share: float):
        self.key, self.text = key, text
        n = budget(len(text), share) + 1
        self.cuts = [round(i * len(text) / n) for i in range(n + 1)]
        self.patterns: dict[tuple[int, int], Pattern] = {}

    def pieces(self) -> Iterator[tuple[int, str]]:
        for i in range(len(self.cuts) - 1):
            yield i, self.text[self.cuts[i] : self.cuts[i + 1]]

    def path(self, leaf: int) -> list[tuple[int, int]]:
        """The nodes (first piece, last piece) above a leaf, from its parent to the root."""
        low, high, out = 0, len(self.cuts) - 1, []
        while high - low > 1:
            out.append((low, high))
            middle = (low + high) // 2
            low, high = (low, middle) if leaf < middle else (middle, high)
        return out[::-1]

    def verify(self, text: str, leaf: int, start: int) -> tuple[int, int, int] | None:
        """(distance, start, end) around the leaf's hit that begins at ``start``."""
        origin = start - self.cuts[leaf]  # where the item would begin without edits before the leaf
        found = (0, start + self.cuts[leaf + 1] - self.cuts[leaf])
        for low, high in self.path(leaf):
            edits = high - low - 1
            node = self.patterns.get((low, high))
            if node is None:
                node = self.patterns[low, high] = Pattern(self.text[self.cuts[low] : self.cuts[high]])
            a = max(0, origin + self.cuts[low] - edits)
            found = node.best(text[a : origin + self.cuts[high] + edits], edits)
            if found is None:
                return None
            found = (found[0], a + found[1])
        return found[0], max(0, found[1] - len(self.text)), found[1]


def start_of(pattern: str, text: str, end: int, distance: int) -> int:
    """Where the part of ``text`` that ends at ``end`` begins whose distance from the pattern is ``distance``.

    Backwards, in a band as wide as the distance allows.
    """
    n, far = len(pattern), distance + 1
    # Costs of the pattern's last i characters against the last j of the text, j - i from -distance to distance.
    row = [abs(k) if k >= 0 else far for k in range(-distance, distance + 1)]
    for i in range(1, n + 1):
        new = []
        for k in range(-distance, distance + 1):
            j = i + k
            if j < 0 or j > end:
                new.append(far)
                continue
            cost = row[k + distance + 1] + 1 if k < distance else far  # a character of the pattern is left out
            if j and new and new[-1] + 1 < cost:
                cost = new[-1] + 1  # one of the text is
            if j:
                cost = min(cost, row[k + distance] + (pattern[n - i] != text[end - j]))
            new.append(min(cost, far))
        row = new
    # The one that is closest in length.
    best = min((abs(k), k) for k in range(-distance, distance + 1) if row[k + distance] == distance)[1]
    return end - n - best


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        import ahocorasick

        self.items = [Item(key, text, share) for key, text in items if text]
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(self.items):
            for leaf, piece in item.pieces():
                owners.setdefault(piece, []).append((i, leaf))
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        self.automaton.make_automaton()

    def find(self, text: str, any_one: bool = False) -> dict[int, tuple[int, int, int]]:
        """A (distance, start, end) of each item that occurs, by its key: the best of the occurrences that do not overlap the first."""
        best: dict[int, tuple[int, int, int]] = {}
        if not self.items:
            return best
        of: dict[int, int] = {}
        text = normal(text)
        covered: dict[int, int] = {}
        for last, (length, own) in self.automaton.iter(text):
            for i, leaf in own:
                if last < covered.get(i, -1):
                    continue  # within an occurrence that is already verified
                item = self.items[i]
                found = item.verify(text, leaf, last - length + 1)
                if found is None:
                    continue
                covered[i] = found[2]
                if item.key not in best or found[0] < best[item.key][0]:
                    best[item.key], of[item.key] = found, i
                if any_one:
                    return best
        return {key: (d, start_of(self.items[of[key]].text, text, end, d), end) for key, (d, _, end) in best.items()}


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``limit`` characters, one block on the driver at a time."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), whole_text(text_col).alias("text"))
    items = items.where("item is not null and text <> ''").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / limit))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        found = [(r.item, normal(r.text)) for r in part.collect()]
        if sum(len(t) for _, t in found) > 2 * limit + max((len(t) for _, t in found), default=0):
            raise ValueError("a block of benchmark items is over its bound; raise block_chars")
        yield sorted(set(found))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    share: float = EDIT_SHARE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(id, item, distance, start, end) of every item found in every text, once for each row.

    Positions are those in the normalised text, the distance is the item's best
    in that text.  Null and empty texts and items match nothing; repeated rows
    give repeated results; an item id with two texts matches by either.
    """
    small_batches(docs.sparkSession)
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`"), whole_text(text_col).alias("text"))
    found = None
    for block in item_blocks(benchmark, item_col, "text", block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, share)
            for batch in batches:
                at, out = [], []
                for row, text in enumerate(batch.column(1)):
                    for key, place in matcher.find(text.as_py()).items():
                        at.append(row)
                        out.append((key, *place))
                columns = list(zip(*out)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]],
                    names=[id_col, item_col, "distance", "start", "end"],
                )

        part = rows.mapInArrow(search, f"`{id_col}` {kind}, `{item_col}` long, distance long, `start` long, `end` long")
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows in whose text no item occurs, with all their columns."""
    small_batches(docs.sparkSession)
    clean = docs
    for block in item_blocks(benchmark, item_col, "text", block_chars):
        clean = clean.where(~leaked(docs.sparkSession.sparkContext.broadcast(block), share)(whole_text(text_col)))
    return clean


def leaked(items, share: float):
    """Whether any of the broadcast items occurs, as a column function."""

    @F.arrow_udf("boolean")
    def found(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(items.value, share)
        for column in columns:
            yield pa.array([bool(matcher.find(t.as_py(), any_one=True)) for t in column], pa.bool_())

    return found


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
