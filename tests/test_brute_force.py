"""All relational metrics against plain Python on random rows with missing values."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from patronage import BasicInfo, Cohort, Growth, NewExisting, Retention, RFMSegmentation

from conftest import SCHEMA, records, segment_table_base


def random_rows(seed, n=400):
    rng = random.Random(seed)
    start = datetime(1999, 10, 1)
    rows = []
    for _ in range(n):
        # One customer owns a third of the rows.
        customer = "hot" if rng.random() < 0.34 else rng.choice([f"c{i}" for i in range(25)] + [None])
        segment = rng.choice(["x", "y", "z", None])
        sale = rng.choice([None, -20.0, *[round(rng.uniform(0, 50), 2) for _ in range(6)]])
        date = None if rng.random() < 0.05 else start + timedelta(hours=rng.randrange(24 * 200))
        rows.append((customer, segment, sale, date))
    return rows


def ym(date):
    return None if date is None else f"{date.year % 100:02d}_{date.month:02d}"


def summed(rows, key):
    out = defaultdict(float)
    for row in rows:
        k = key(row)
        if None not in k:
            out[k] += row[2] or 0.0
    return dict(out)


def distinct(rows, key):
    out = defaultdict(set)
    for row in rows:
        k = key(row)
        if None not in k:
            out[k].add(row[0])
    return {k: len(v - {None}) for k, v in out.items()}


def close(df, expected, digits=6):
    def norm(r):
        return tuple(round(v, digits) + 0.0 if isinstance(v, float) else v for v in r)

    assert sorted(map(norm, df), key=repr) == sorted(map(norm, expected), key=repr)


@pytest.fixture(params=[(1, "facts"), (2, "cached")], ids=str)
def case(request, spark):
    from patronage import Dates, Entity, Sale, bind

    seed, grain = request.param
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    base = bind(df, Entity("customer", segment="segment"), Sale("sale"), Dates("date"))
    if grain == "cached":
        base.cache()
    yield rows, base
    base.unpersist()


def test_basic_and_growth(case):
    rows, base = case
    basic, growth = BasicInfo(base), Growth(base)
    per_customer = summed(rows, lambda r: (r[0],))
    assert basic.totals["total_revenue"] == pytest.approx(sum(r[2] or 0 for r in rows))
    assert basic.totals["avg_customer_revenue"] == pytest.approx(sum(per_customer.values()) / len(per_customer))
    close(basic.data["customer_revenue"].collect(), [(*k, v) for k, v in per_customer.items()])
    per_segment = summed(rows, lambda r: (r[1],))
    whole = sum(per_segment.values())
    close(basic.data["segment_revenue"].collect(), [(*k, v, v / whole) for k, v in per_segment.items()])
    counts = distinct(rows, lambda r: (r[1],))
    close(basic.data["segment_unique_customer"].collect(), [(*k, v, v / sum(counts.values())) for k, v in counts.items()])
    close(growth.data["monthly_revenue"].collect(), [(*k, v) for k, v in summed(rows, lambda r: (ym(r[3]),)).items()])
    close(growth.data["monthly_customer"].collect(), [(*k, v) for k, v in distinct(rows, lambda r: (ym(r[3]),)).items()])
    by = lambda r: (ym(r[3]), r[1])
    close(growth.data["segment_monthly_revenue"].collect(), [(*k, v) for k, v in summed(rows, by).items()])
    close(growth.data["segment_monthly_customer"].collect(), [(*k, v) for k, v in distinct(rows, by).items()])


def test_new_existing(case):
    rows, base = case
    report = NewExisting(base)
    first = {}
    for c, _, _, d in rows:
        if c is not None and d is not None:
            first[c] = min(d, first.get(c, d))

    def kind(r):
        return "New" if r[0] in first and r[3] is not None and ym(first[r[0]]) == ym(r[3]) else "Existing"

    count = distinct(rows, lambda r: (ym(r[3]), kind(r)))
    close(report.data["count"].collect(), [(*k, v) for k, v in count.items()])
    types = distinct(rows, lambda r: (kind(r),))
    close(report.data["type_percent"].collect(), [(*k, v / sum(types.values())) for k, v in types.items()])
    by_segment = distinct(rows, lambda r: (ym(r[3]), kind(r), r[1]))
    close(report.data["segment_count"].collect(), [(*k, v) for k, v in by_segment.items()])

    def percent(cells, keys):
        out = []
        for k in keys:
            new, old = cells.get((k[0], "New", *k[1:])), cells.get((k[0], "Existing", *k[1:]))
            share = 0.0 if not new or old is None else (float("inf") if old == 0 else new / old)
            out.append((*k, old or 0, new or 0, share))
        return out

    close(report.data["month_new_percent"].collect(), percent(count, {(k[0],) for k in count}))
    keys = {(k[0], k[2]) for k in by_segment}
    close(report.data["segment_monthly_new_percent"].collect(), percent(by_segment, keys))
    typed = [(r[0], r[1], r[2], r[3], kind(r)) for r in rows]
    got = records(report.rows, "customer", "customer_segment", "sale", "date", "type")
    assert got == sorted(typed, key=repr)


def test_retention(case):
    rows, base = case
    net = summed(rows, lambda r: (r[0], ym(r[3])))
    months = sorted({m for _, m in net})
    active = {k for k, v in net.items() if v > 0}
    expected = []
    for i, m in enumerate(months):
        now = {c for c, a in active if a == m}
        before = {c for c, a in active if i and a == months[i - 1]}
        expected.append((m, len(now), len(now & before), len(now & before) / len(now) if now else None))
    close(Retention(base).data["by_month"].collect(), expected)
    matrix = [(c, *[int((c, m) in active) for m in months]) for c in {c for c, _ in net}]
    assert records(Retention(base).data["by_customer"]) == sorted(matrix, key=repr)


def test_cohort(case):
    rows, base = case
    known = [r for r in rows if r[0] is not None and r[3] is not None]
    start = {c: min(r[3].month for r in known if r[0] == c) for c in {r[0] for r in known}}
    key = lambda r: (start[r[0]], r[3].month - start[r[0]] + 1)
    revenue, people = summed(known, key), distinct(known, key)
    report = Cohort(base)
    indexes = sorted({k[1] for k in revenue})
    assert report.data["by_revenue"].columns == ["Cohort Month", *map(str, indexes)]
    cohorts = sorted({k[0] for k in revenue})
    table = lambda f: [(c, *[f(c, i) if (c, i) in revenue else None for i in indexes]) for c in cohorts]
    close(report.data["by_revenue"].collect(), table(lambda c, i: revenue[c, i]))
    close(report.data["by_retention"].collect(), table(lambda c, i: people[c, i]))
    close(report.data["by_revenue_pct"].collect(), table(lambda c, i: revenue[c, i] / revenue[c, 1]))
    close(report.data["by_retention_pct"].collect(), table(lambda c, i: people[c, i] / people[c, 1]))


def test_rfm(case):
    rows, base = case
    months = len({ym(r[3]) for r in rows} - {None})
    known = [r for r in rows if r[0] is not None]
    latest = max(r[3] for r in known if r[3])
    expected = []
    for c in {r[0] for r in known}:
        mine = [r for r in known if r[0] == c]
        dates = [r[3] for r in mine if r[3]]
        expected.append(
            (c, max(dates), (latest - max(dates)).days / months, len(dates) / months, sum(r[2] or 0 for r in mine) / months)
        )
    close(RFMSegmentation(base).data["rfm"].collect(), expected)


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_separate_segment_table_changes_nothing(spark, broadcast_bytes):
    from patronage import Dates, Entity, Sale, bind

    rows = [(c, v, d) for c, _, v, d in random_rows(7)]
    segments = [("hot", "x"), *[(f"c{i}", "xyz"[i % 3]) for i in range(25)]]
    lookup = dict(segments)
    inline = [(c, lookup[c], v, d) for c, v, d in rows if c is not None]
    same = bind(spark.createDataFrame(inline, SCHEMA), Entity("customer", segment="segment"), Sale("sale"), Dates("date"))
    texts = [(c, v, d.isoformat() if d else None) for c, v, d in rows]
    base = segment_table_base(spark, texts, segments, broadcast_bytes)
    for report in (BasicInfo, Growth, NewExisting, Retention, Cohort):
        mine, other = report(base).data, report(same).data
        for name in mine:
            assert mine[name].columns == other[name].columns
            close(mine[name].collect(), [tuple(r) for r in other[name].collect()])
    assert records(NewExisting(base).rows) == records(NewExisting(same).rows)
    close(RFMSegmentation(base).data["rfm"].collect(), RFMSegmentation(same).data["rfm"].collect())
