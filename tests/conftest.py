import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from patronage import Dates, Entity, Sale, SegmentTable, bind
from patronage.session import local_session

SCHEMA = "customer string, segment string, sale double, date timestamp_ntz"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "patronage-tests", memory="6g")
    session.conf.set("spark.sql.shuffle.partitions", "3")
    yield session
    session.stop()


def day(text):
    """'2020-03-01' or '2020-03-01 23:00' as a datetime; None stays None."""
    if text is None:
        return None
    return datetime.fromisoformat(text)


def frame(spark, rows):
    """(customer, segment, sale, date text) rows as a DataFrame."""
    return spark.createDataFrame([(c, s, v, day(d)) for c, s, v, d in rows], SCHEMA)


@pytest.fixture
def make_base(spark):
    def make(rows, keep_segments=(), dates=None, **options):
        entity = Entity("customer", segment="segment", keep_segments=list(keep_segments))
        return bind(frame(spark, rows), entity, Sale("sale"), dates or Dates("date"), **options)

    return make


@pytest.fixture(params=["facts", "cached"])
def grain(request, make_base):
    """A base whose metrics start from rows, or from the cached activity."""
    made = []

    def make(rows, **options):
        base = make_base(rows, **options)
        if request.param == "cached":
            base.cache()
        made.append(base)
        return base

    yield make
    for base in made:
        base.unpersist()


def segment_table_base(spark, rows, segments, broadcast_bytes):
    """The same facts with the segment in a table of its own."""
    facts = spark.createDataFrame([(c, v, day(d)) for c, v, d in rows], "customer string, sale double, date timestamp_ntz")
    table = spark.createDataFrame(segments, "key string, segment string")
    return bind(
        facts,
        Entity("customer"),
        Sale("sale"),
        Dates("date"),
        segments=SegmentTable(table, "key", "segment"),
        broadcast_bytes=broadcast_bytes,
    )


def records(df, *columns):
    """Rows as sorted tuples."""
    chosen = df.select(*[f"`{c}`" for c in columns]) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
