"""Collocations against a plain version in Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.llm import collocations as C


def pieces(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
        yield re.findall("[^\x20\x09]+", piece)


def brute(rows, longest=3, least=10, top=2000, percent=50):
    """{lang: rows} over (lang, text)."""
    out = {}
    for lang in {x or "und" for x, _ in rows}:
        f = Counter()
        for x, text in rows:
            if (x or "und") == lang:
                for words in pieces(text):
                    for n in range(1, longest + 1):
                        f.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {}
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                found[p] = min(((10**6 * a * a) // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
        gone = set()
        for p in found:
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if 100 * f[p] >= percent * f[p[i : i + size]]:
                        gone.add(p[i : i + size])
        kept = sorted((-x[0], -f[p], " ".join(p).encode(), x[2], x[3]) for p, x in found.items() if p not in gone)[:top]
        out[lang] = [(k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(kept)]
    return {k: v for k, v in out.items() if v}


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.lang, r["rank"])):
        out.setdefault(r.lang, []).append(tuple(r)[1:])
    return out


def texts(n=120, seed=2):
    rng = random.Random(seed)
    stock = ["red", "Fox", "runs", "far", "away", "ÉTÉ", "été", "x", "aa", "b"] + [f"v{i}" for i in range(40)]
    made = []
    for i in range(n):
        words = [rng.choice(stock[: rng.choice((4, 10, 50))]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "!?"]) for w in words)
        made.append((rng.choice(["en", "de", None]), text))
    return made + made[:30] + [("en", None), ("en", ""), ("de", " \t .,"), ("fr", "only once")] + [("en", "same same " * 30_000)]


@pytest.mark.parametrize("options", [{}, {"trigger": 2, "most_bits": 64}, {"trigger": 10**9, "longest": 4, "least": 5}, {"longest": 2, "least": 3, "top": 7, "percent": 80}])
def test_equals_brute_force(spark, options):
    rows = texts()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).selectExpr("*", "1 as chunk", "2 as phrase", "3 as n", "4 as rank")
    plain = {k: v for k, v in options.items() if k in ("longest", "least", "top", "percent")}
    assert result(C.collocations(docs, **options)) == brute(rows, **plain)


def test_small_blocks_and_large_products(spark):
    rows = texts(60, 4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    dictionary = C.parsed(docs, "text", "lang", 3, 4)
    shared = spark.sparkContext.broadcast([])
    whole = {tuple(r) for r in C.gram_counts(dictionary, 1, shared).collect()}
    assert whole == {tuple(r) for r in C.gram_counts(dictionary, 1, shared, held=50).collect()}
    big = 10**12
    grams = [
        spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 2 * big + 1)], "lang string, phrase string, f long"),
        spark.createDataFrame([("en", "a b", 2 * big)], "lang string, phrase string, f long"),
    ]
    r = C.scored(grams).first()
    assert (r.l, r.r, r.score) == (3 * big, 2 * big + 1, 10**6 * (2 * big) ** 2 // (3 * big * (2 * big + 1)))


def test_parse_assigns_overlaps_once():
    hasher = C.piece_hasher()
    data = np.frombuffer("a b c. D  e\tf g h i j k l m n o p q r s t u v w, x".encode(), np.uint8)
    doc, chunks, own = C.parse(data, np.array([0, len(data)]), hasher, 3, 3)
    assert own.sum() == 24 and set(doc) == {0}
    starts = [w for c, n in zip(chunks.to_pylist(), own) for w in c.split()[:n]]
    assert "".join(starts) == "abcdefghijklmnopqrstuvwx"
    assert all(len(c.split()) <= n + 2 for c, n in zip(chunks.to_pylist(), own))
    assert sum(c.count("\n") for c in chunks.to_pylist()) >= 1 and not any("c d" in c or "w x" in c for c in chunks.to_pylist())


def test_filter_has_all_and_empty_table(spark):
    phrases = spark.range(5000).select(F.lit("en").alias("lang"), F.concat_ws(" ", F.lit("w"), F.col("id").cast("string")).alias("phrase"))
    bits = C.phrase_filter(phrases)
    hasher = C.WordHasher()
    text = np.frombuffer("w 77".encode(), np.uint8)
    hashes = hasher.words(text, np.array([0, 4]))[0]
    own = np.array([C.language_hash("en")], np.uint64)
    for h in hashes:
        own = C.mix(own * C.U(C.BASE) + h)
    assert C.in_filter(bits, own).all()
    docs = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(docs).collect() == []
