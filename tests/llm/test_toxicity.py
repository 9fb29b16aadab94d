import inspect
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from patronage.llm.toxicity import GRAM, SAMPLE, backoff_counts, drop_toxic, fit, held_out, toxicity

from .conftest import by_id


def labelled(n=400):
    rng = random.Random(7)
    words = ["".join(rng.choice("aeioubdgklmnrst") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = int(i % 4 == 0)
        for _ in range(len(text) // 15 + 1 if toxic else 0):
            text[rng.randrange(len(text))] = "grobz" + rng.choice(["", "en", "ly", "ard"])
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark, make_docs):
    rows, labels = labelled()
    docs = make_docs(rows + [(1000, None), (1001, ""), (1001, "")])
    marks = spark.createDataFrame(labels + [(None, 1), (7, None), (5000, 1)], "doc_id long, toxic int")
    model = fit(docs, marks)
    scored = docs.select("doc_id", toxicity(model, spark, F.col("text")).alias("score"), held_out(F.col("doc_id")).alias("held"))
    got = by_id(scored, "score", "held")
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= s <= 1 for i, (s, h) in got.items())
    truth = dict(labels)
    unseen = [i for i, (_, h) in got.items() if h and i in truth]
    right = sum((got[i][0] >= 0.5) == bool(truth[i]) for i in unseen)
    assert len(unseen) > 50 and right / len(unseen) > 0.9
    assert got[1000] == (got[1001][0], got[1000][1]) and got[1001][0] < 0.5
    left = drop_toxic(docs, marks)
    assert left.columns == docs.columns and {1000, 1001} <= {r.doc_id for r in left.select("doc_id").collect()}


def test_without_labels_or_rows(spark, make_docs):
    docs = make_docs([(1, "some words"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert drop_toxic(docs, none).count() == 2
    assert drop_toxic(docs.where("false"), none).count() == 0


def test_backoff_counts_cover_every_unit_of_every_document(spark, make_docs):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1 ") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += ["a passage, COPIED often"] * 20 + [None, "", "   ", "\u00e9t\u00e9"]
    want = Counter()
    for text in texts:
        folded = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in (text or "").lower().encode())
        while b"  " in folded:
            folded = folded.replace(b"  ", b" ")
        padded, before, pairs = bytes(GRAM) + folded, 0, set()
        for i in range(len(folded)):
            word = int.from_bytes(padded[i + 1 : i + 1 + GRAM], "big")
            pairs.add((before, word))
            before = word
        want.update(word for _, word in pairs)
    got = backoff_counts(make_docs(list(enumerate(texts)), 5), F.col("text")).collect()
    assert {r.word: r.n for r in got} == want


def test_models_are_bounded_by_the_sample_alone():
    assert SAMPLE == 4096 and "bits" not in inspect.signature(fit).parameters


def test_broadcast_needs_no_package(spark, monkeypatch):
    """What is broadcast holds arrays and numbers only, as executors may lack this package."""
    import pickletools

    import numpy as np

    from patronage.llm import toxicity as T

    sent = []
    whole = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or whole(value))
    model = T.Model(np.zeros(0, np.uint64), np.zeros((2, 0)), np.zeros(2), np.zeros((2, 0)), np.zeros(2), np.zeros(0, np.uint64), np.zeros((2, 0)))
    T.evidence_of(model, spark)
    import pickle

    names = [str(arg) for _, arg, _ in pickletools.genops(pickle.dumps(sent[-1])) if arg is not None]
    assert sent and not any("patronage" in n for n in names)


def test_counts_are_passed_once_and_not_stored(spark, make_docs, tmp_path, monkeypatch):
    """Files that executors write fork processes, which count as memory of their own."""
    import pytest

    from patronage.llm import toxicity as T

    monkeypatch.setattr("patronage.llm.common.shared_folder", lambda _: str(tmp_path))
    rows, labels = labelled(120)
    fit(make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert list(tmp_path.iterdir()) == []
    counts = spark.createDataFrame([(0, 5), (-3, 7), (9, 2), (4, 1)], "word long, shared long")
    known = spark.createDataFrame([(0, 1, 2), (9, 3, 0)], "word long, n0 long, n1 long")
    found, total = T.known_and_total(counts, known)
    assert sorted(zip(*(found[c].tolist() for c in ("word", "n0", "n1", "shared")))) == [(0, 1, 2, 5), (9, 3, 0, 2)]
    assert total == pytest.approx(15)
    found, total = T.known_and_total(counts.limit(0), known)
    assert total == 0 and all(len(c) == 0 for c in found.values())


def test_lookup_needs_no_search(monkeypatch):
    """Binary searches among the keys took most of the time of scoring."""
    import numpy as np

    from patronage.llm import toxicity as T

    rng = np.random.default_rng(1)
    keys = T.mix(rng.permutation(5000).astype(np.uint64))
    keys = np.concatenate([keys, keys[:50], keys[:1] + np.arange(1, 40, dtype=np.uint64)])
    asked = np.concatenate([keys, T.mix(np.arange(5000, 9000, dtype=np.uint64)), np.array([0, 2**64 - 1], np.uint64)])
    first = {int(k): i for i, k in reversed(list(enumerate(keys)))}
    want = [first.get(int(k), -1) for k in asked]
    monkeypatch.setattr(np, "searchsorted", None)
    assert T.Lookup(keys)(asked).tolist() == want
    assert T.Lookup(keys[:0])(asked).tolist() == [-1] * len(asked)


def test_bigrams_of_documents_without_text_or_many(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from patronage.llm import toxicity as T

    monkeypatch.setattr(T, "DOCUMENT_BITS", 2)
    texts = ["", "a", "abc", "abcdefgh", "abababab", None, "x  y", "abc"] * 3
    got = Counter()
    for i, grams, first in T.blocks_of_grams(pa.array(texts), T.folding()):
        doc, pair = T.once_per_document(grams, first)
        got.update(zip((i + doc).tolist(), pair.tolist()))
    want = set()
    for i, text in enumerate(texts):
        padded = bytes(GRAM + 1) + (text or "").replace("  ", " ").encode()
        want |= {(i, int.from_bytes(padded[k + 1 - GRAM - 1 : k + 1], "big")) for k in range(GRAM + 1, len(padded))}
    assert set(got) == want and max(got.values()) == 1


def test_candidate_models_share_one_worker(spark, make_docs, monkeypatch):
    """With a function for each, a task holds a Python worker for each, and executors keep them through later stages."""
    from patronage.llm import toxicity as T

    plans, whole = [], T.collected
    monkeypatch.setattr(T, "collected", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df))
    rows, labels = labelled(120)
    fit(make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    # An adaptive plan is printed once or, when it has run, as final and initial plan.
    assert max(p.split("Initial Plan")[0].count("ArrowEvalPython") for p in plans) == 1


def test_evidence_of_several_models_is_that_of_each(spark, make_docs):
    import numpy as np

    from patronage.llm import toxicity as T

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab c"), rng.integers(0, 50))) for _ in range(60)] + ["", None]
    grams = np.concatenate([g for _, g, _ in T.blocks_of_words(T.pa.array(texts), T.folding())])
    words = np.unique(grams)[::2]
    pairs = np.unique(T.pair_key(grams[:-1], grams[1:]))[::3]
    draw = lambda *n: -rng.random((2, *n))
    models = [T.Model(words, draw(len(words)), draw(), draw(len(words)), draw(), pairs, draw(len(pairs))) for _ in range(3)]
    docs = make_docs(list(enumerate(texts)), 3)
    got = by_id(docs.select("doc_id", T.evidences_of(models, spark)(F.col("text")).alias("x")), "x")
    each = [by_id(docs.select("doc_id", T.evidence_of(m, spark)(F.col("text")).alias("x")), "x") for m in models]
    value = lambda v: v[0] if isinstance(v, tuple) else v
    assert len({tuple(value(x)) for x in got.values()}) > 30
    for i in got:
        assert list(value(got[i])) == [value(e[i]) for e in each]
