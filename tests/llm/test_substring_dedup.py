import hashlib
import random
import re

import pytest

from patronage.llm import substring_dedup
from patronage.llm.substring_dedup import remove_repeats

from .conftest import by_id


def brute(rows, window=13):
    first, words = {}, {}
    for i, t in rows:
        words[i] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for j in range(len(words[i]) - window + 1):
            gram = tuple(words[i][j : j + window])
            first[gram] = min(first.get(gram, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def rows_with_repeats():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, text(12)), (5, passages[0]), (6, passages[0]), (7, "same " * 60), (8, "same " * 30)]
    for i in range(9, 60):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages).split()
            a = rng.randint(0, 20)
            parts += [" \n".join(p[a : a + rng.randint(10, 40)]), text(rng.randint(0, 20))]
        rows.append((i, " ".join(parts)))
    return rows + [(100, text(3000) + " " + passages[1])]


@pytest.mark.parametrize("at_once", [1 << 17, 16])
def test_equals_brute_force(make_docs, monkeypatch, at_once):
    monkeypatch.setattr(substring_dedup, "ANCHORS_AT_ONCE", at_once)
    monkeypatch.setattr(substring_dedup, "PATHS_AT_ONCE", at_once)
    rows = rows_with_repeats()
    got = by_id(remove_repeats(make_docs(rows, 3), with_text=True), "n_words", "n_removed", "kept_sha256", "kept")
    assert got == brute(rows)


def test_repeated_and_null_ids(make_docs):
    line = " ".join(f"w{i}" for i in range(20))
    got = [tuple(r)[:3] for r in remove_repeats(make_docs([(5, line), (5, line), (None, line)])).collect()]
    assert sorted(got, key=repr) == [(5, 20, 0), (5, 20, 0), (None, 20, 20)]
    assert remove_repeats(make_docs([(1, line)]).where("false")).count() == 0
