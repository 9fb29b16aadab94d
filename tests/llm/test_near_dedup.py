import random
import re
from itertools import combinations

import numpy as np
import pytest

from patronage.llm import near_dedup
from patronage.llm.near_dedup import components, drop_near_copies, likely_similarity, near_groups, registers

from .conftest import by_id


def brute(rows, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def rows_with_copies():
    rng = random.Random(5)
    text = lambda n: [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 9)) for _ in range(n)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  two"), (8, "É"), (9, "é")]
    base = [text(120) for _ in range(3)]
    for i in range(10, 90):
        words = list(rng.choice(base)) if rng.random() < 0.7 else text(rng.randint(1, 150))
        for _ in range(rng.choice([0, 1, 3, 6, 9, 14])):
            words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 99))
        rows.append((i, " ".join(words)))
    return rows


def test_equals_brute_force(make_docs):
    rows = rows_with_copies()
    got = by_id(near_groups(make_docs(rows, 3)), "n_shingles", "component_id", "kept")
    assert got == brute(rows, 2, 80)


def test_large_buckets_in_blocks(make_docs, monkeypatch):
    """A group whose copies are partly too far from each other, all of it compared in small blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "TURNS", 0)
    monkeypatch.setattr(near_dedup, "OUTSIDERS", 7)
    monkeypatch.setattr(near_dedup, "MEMBERS", 9)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.choice([1, 4, 7, 9, 11])):
            words[rng.randrange(90)] = f"e{rng.randint(0, 60)}"
        rows.append((i, " ".join(words)))
    got = by_id(near_groups(make_docs(rows, 3)), "n_shingles", "component_id", "kept")
    want = brute(rows, 2, 80)
    assert got == want and 5 < len({c for _, c, _ in want.values()}) < 150


def test_one_id_on_two_texts_and_a_long_text(make_docs):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(5, "a b c d e f g h i j k"), (5, "other words that stand for themselves here"), (7, "a b c d e f g h i j k l"), (7, "a b c d e f g h i j k l"), (3, long), (9, long + " end")]
    docs = make_docs(rows)
    got = sorted(tuple(r) for r in near_groups(docs).collect())
    assert got == [(3, 29_999, 3, True), (5, 6, 5, True), (5, 10, 5, True), (7, 11, 5, False), (7, 11, 5, False), (9, 30_000, 3, False)]
    left = sorted((r.doc_id, len(r.text)) for r in drop_near_copies(docs, k=2).collect())
    assert left == sorted([(3, len(long)), (5, len(rows[0][1])), (5, len(rows[1][1]))])


def test_drop_five_words_and_odd_rows(make_docs):
    rows = [(2, "a b c d e f g"), (1, "A b c d e f g"), (1, "a B c d e f g"), (3, "x"), (None, "a b c d e f g"), (4, None)]
    docs = make_docs(rows)
    left = drop_near_copies(docs)
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([1, 1, 3, 4, None], key=repr)
    assert left.columns == docs.columns
    assert near_groups(docs.where("false")).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    a, b = values[:1000], values[200:1200]
    assert (np.maximum(registers(a), registers(b)) == registers(np.union1d(a, b))).all()
    assert likely_similarity(registers(a), registers(b), 1000, 1000) == pytest.approx(800 / 1200, abs=0.12)
    assert not registers(values[:0]).any() and (registers(values[:1]) > 0).all()


def test_components_of_a_chain(spark):
    nodes = spark.range(40)
    links = spark.createDataFrame([(i + 1, i) for i in range(0, 29)] + [(35, 33)], "a long, b long")
    got = {r.id: r.component for r in components(nodes, links).collect()}
    assert all(got[i] == 0 for i in range(30)) and got[35] == 33 and got[31] == 31
