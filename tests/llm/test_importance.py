import random

import pytest

from patronage.llm import importance
from patronage.llm.importance import key_at_rank, resample


def test_prefers_text_like_the_target_and_keeps_the_share(spark, make_docs):
    rng = random.Random(9)
    good, bad = [[f"{p}{i}" for i in range(60)] for p in "gb"]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(40))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    docs = make_docs(rows)
    got = resample(docs, labels, share=0.4).collect()
    assert len(got) == 80 and sum(r.doc_id % 2 for r in got) >= 78
    assert [tuple(r) for r in sorted(resample(docs.repartition(5), labels, share=0.4).collect())] == [tuple(r) for r in sorted(got)]
    odd = make_docs(rows + [(900, None), (901, ""), (901, "")])
    assert resample(odd, labels, share=1.0).count() == 203
    assert resample(docs.where("false"), labels).count() == 0
    assert resample(docs, labels.where("false"), share=0.5).count() == 100


@pytest.mark.parametrize("at_once", [3, 1000])
def test_key_at_rank(spark, monkeypatch, at_once):
    monkeypatch.setattr(importance, "AT_ONCE", at_once)
    values = [float(v * v % 101) for v in range(90)] + [5.0] * 20
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for rank in (1, 2, 50, 95, 110, 200):
        assert key_at_rank(keys, rank) == sorted(values, reverse=True)[min(rank, 110) - 1]
