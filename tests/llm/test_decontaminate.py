import random

from patronage.llm import registry
from patronage.llm.common import table
from patronage.llm.decontaminate import Matcher, Pattern, budget, drop_leaks, leaks, normal

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards mix a very odd potion in the old tower of the north"


def distance_within(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    column = list(range(len(pattern) + 1))
    best = column[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(column[i] + 1, new[-1] + 1, column[i - 1] + (p != c)))
        column, best = new, min(best, new[-1])
    return best


def whole_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.33:
            out[at] = rng.choice("abc xyz")
        elif kind < 0.66:
            del out[at]
        else:
            out.insert(at, rng.choice("abc xyz"))
    return "".join(out)


def test_matches_exactly_what_is_within_the_budget():
    rng, matcher, most = random.Random(2), Matcher([(1, ITEM)], 0.1), budget(len(ITEM))
    for edits in (0, 1, 5, most - 1, most, most + 1, most + 4, 20) * 6:
        text = normal("before it " + edited(rng, ITEM, edits) + " and after")
        least = distance_within(ITEM, text)
        found = matcher.find(text)
        assert (1 in found) == (least <= most)
        if found:
            distance, start, end = found[1]
            assert Pattern(ITEM).best(text, most)[0] == least <= distance <= most
            assert whole_distance(ITEM, text[start:end]) == distance


def test_one_id_on_two_texts():
    other = "another item with words of its own that stand for themselves in every way"
    matcher = Matcher([(1, ITEM), (1, other)], 0.1)
    for text in (ITEM, other):
        distance, start, end = matcher.find(normal(f"a {text[:-2]}x here"))[1]
        assert distance <= 2 and start == 2


def test_query_finds_every_whole_item_and_gives_true_distances(spark, sf_dir):
    docs = {r.doc_id: normal(r.text or "") for r in table(spark, sf_dir, "documents").collect()}
    items = {r.item_id: normal(r.text or "") for r in table(spark, sf_dir, "benchmark").collect()}
    found = registry.QUERIES["op3_decontaminate"](spark, sf_dir).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert len(pairs) == len(found) > 0
    assert pairs >= {(d, i) for d, text in docs.items() for i, item in items.items() if item and item in text}
    for r in found:
        assert whole_distance(items[r.item_id], docs[r.doc_id][r.start : r.end]) == r.distance <= budget(len(items[r.item_id]))


def test_leaks_and_blocks(spark, make_docs):
    items = [(1, ITEM), (2, "Short one."), (3, None), (4, ""), (None, "nothing"), (1, ITEM), (5, "entirely different words about rivers, mountains and glaciers")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, f"x {ITEM.upper()}\n y"), (2, "a clean text"), (3, None), (4, ""), (5, "here a\n short   one. indeed"), (6, ITEM.replace("wizards", "wizard")), (6, ITEM), (7, ("lorem ipsum " * 20_000) + ITEM)]
    want = {(1, 1), (5, 2), (6, 1), (7, 1)}
    docs = make_docs(rows)
    for block in (4_000_000, 100):
        assert {(r.doc_id, r.item_id) for r in leaks(docs, bench, block_chars=block).collect()} == want
        left = drop_leaks(docs, bench, block_chars=block)
        assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4] and left.columns == docs.columns
    assert leaks(docs.where("false"), bench).count() == 0
    assert leaks(docs, bench.where("false")).count() == 0 and drop_leaks(docs, bench.where("false")).count() == len(rows)
