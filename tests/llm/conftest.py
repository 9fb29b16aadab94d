import os

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Rows of (doc_id, text) as documents, with columns whose names the operators use inside."""

    def make(rows, parts=2):
        full = [(i, t, "en", f"s{n % 3}", None) for n, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, DOCS).repartition(parts)
        return df.selectExpr("*", "1 as id", "2 as key", "3 as digest", "4 as n", "5 as `select`")

    return make


@pytest.fixture
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}
