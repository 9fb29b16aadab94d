import hashlib

import pytest
from pyspark.sql import functions as F

from patronage.llm.exact_dedup import drop_exact_copies, exact_groups

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "a "), (7, "x" * 200_000), (8, "x" * 200_000), (9, "a"), (9, "a"), (None, "z")]


def one_digest(text):
    return F.lit(b"same") if True else text


@pytest.mark.parametrize("digest", [None, one_digest])
def test_groups(make_docs, digest):
    got = exact_groups(make_docs(ROWS), salts=2, **({"digest": digest} if digest else {}))
    rows = sorted((tuple(r)[:4] for r in got.collect()), key=repr)
    want = [
        (1, 9, 4, False), (3, 9, 4, False), (9, 9, 4, True), (9, 9, 4, True), (2, 2, 1, True), (4, 5, 2, False), (5, 5, 2, True),
        (6, 6, 1, True), (7, 8, 2, False), (8, 8, 2, True), (None, None, 1, True),
    ]
    assert rows == sorted(want, key=repr)


def test_drop(make_docs):
    docs = make_docs(ROWS)
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([9, 2, 5, 6, 8, None], key=repr)


def test_empty(make_docs):
    docs = make_docs(ROWS).where("false")
    assert exact_groups(docs).count() == 0 and drop_exact_copies(docs).count() == 0
