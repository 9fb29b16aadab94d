"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from patronage.llm.lexical_search import MOST, Lists, nra, search


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def brute(docs, items, top=10):
    """{(item, text): [(score, id)]} over rows of (id, text)."""
    rows = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n = [sum(c.values()) for _, c in rows]
    df = Counter(t for _, c in rows for t in c)
    out = {}
    for item, text in set(items):
        scored = []
        for (i, c), length in zip(rows, n):
            m = 100 - 75 + (75 * length * len(rows)) // sum(n)
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * df[t] + 1)))
                    score += w * ((MOST * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0 and i is not None:
                scored.append((-score, i))
        out[item, text] = [(-s, i) for s, i in sorted(scored)[:top]]
    return out


def compare(got, want):
    by = {}
    for r in got:
        by.setdefault(r.item_id, []).append((r["rank"], r.score, r.doc_id))
    flat = {}
    for (item, _), rows in want.items():
        flat.setdefault(item, []).extend((k + 1, s, i) for k, (s, i) in enumerate(rows))
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in flat.items() if v}


def test_chunks_ties_and_odd_rows(spark, make_docs):
    rng = random.Random(3)
    stock = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "été", "a1"]
    texts = [" ".join(rng.choice(stock[: rng.choice((5, 20, 64))]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts[7] = texts[9] = texts[11] = texts[5]  # ties
    rows = list(enumerate(texts)) + [(300, None), (301, ""), (302, "!!! ---"), (None, "w1 w2 w3"), (5, "w59 w59"), (303, "W7," * 70_000)]
    rows = [(-i if i and i % 3 == 0 else i, t) for i, t in rows]
    docs = make_docs(rows, parts=3)
    asked = [(1, "w1 w1 W2 nowhere"), (2, " ".join(stock)), (3, texts[5] or "w3"), (4, None), (5, "?"), (1, "w1 w1 W2 nowhere"), (1, "Été w7"), (6, "absent")]
    items = spark.createDataFrame(asked, "item_id long, text string").selectExpr("*", "1 as item", "2 as rank", "3 as score", "4 as doc_id")
    want = brute(rows, asked)
    for options in ({}, {"chunk_docs": 17}, {"chunk_postings": 100}, {"block_chars": 30, "chunk_docs": 50}):
        compare(search(docs, items, **options).collect(), want)
    few = search(docs, items, top=3).collect()
    compare(few, brute(rows, asked, 3))


def test_reads_stop_early():
    rng = np.random.default_rng(1)
    n, size = 20_000, 3
    doc = np.repeat(np.arange(n), size)
    term = np.tile(np.arange(size), n)
    tf = rng.integers(1, 3, len(doc))
    tf[: 30 * size] = 500
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append((key.start, key.stop))
            return super().__getitem__(key)

    lists = Lists(term, doc, tf, np.full(n, 100), size)
    lists.impact = lists.impact.view(Counted)
    best = nra(lists, [(0, 5), (1, 7), (2, 1)], [], np.arange(n), 10)
    assert [d for _, d in best] == list(range(10))
    assert sum(b - a for a, b in reads) < 0.02 * len(doc)


def test_empty_tables_and_text_ids(spark, make_docs):
    docs = make_docs([(1, "some text"), (2, "other text")])
    items = spark.createDataFrame([("x", "some")], "item_id string, text string")
    assert [tuple(r)[:3] for r in search(docs, items).collect()] == [("x", 1, 1)]
    assert search(docs.limit(0), items).collect() == []
    assert search(docs, items.limit(0)).collect() == []
