"""The registered queries on the smallest tables, and the pipeline."""

import pytest

import corpus_pipeline
from patronage.llm import registry
from patronage.llm.common import table


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equal_their_sql(spark, sf_dir, name):
    from tools.check_oracle import checked, connect, differences

    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert differences(got, checked(connect(sf_dir), registry.ORACLE[name])) is None


def test_near_groups_and_repeats_equal_brute_force(spark, sf_dir):
    from .test_near_dedup import brute as near
    from .test_substring_dedup import brute as repeats

    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = {r.doc_id: tuple(r)[1:4] for r in registry.QUERIES["op10_near_dedup"](spark, sf_dir).collect()}
    assert got == near(rows, 2, 80)
    got = {r.doc_id: tuple(r)[1:4] for r in registry.QUERIES["op5_substring_dedup"](spark, sf_dir).collect()}
    assert got == {i: x[:3] for i, x in repeats(rows).items()}


def test_pipeline_stages_take_effect(spark, make_docs, sf_dir):
    item = table(spark, sf_dir, "benchmark").first().text
    near = [f"word{i}" for i in range(80)]
    rows = [(1, "a plain text of its own"), (2, "a plain text of its own"), (3, " ".join(near)), (4, " ".join(near[:-1] + ["other"])), (5, "x " + item), (6, None)]
    docs = make_docs(rows)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    for name, want in (("exact_dedup", [2, 3, 4, 5, 6]), ("near_dedup", [1, 3, 5, 6]), ("decontaminate", [1, 2, 3, 4, 6])):
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns and ids(out) == want
    assert ids(stages["byte_bpe"](spark, docs, sf_dir)) == [1, 2, 3, 4, 5, 6]


def test_pipeline_runs(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert 100 < len(out) < 200 and all(r.same_text for r in out)
