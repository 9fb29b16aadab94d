"""What the plans must look like to hold at scale."""

import os
import re
import shutil

import pytest

from patronage import Dates, Entity, FullAnalysis, Growth, NewExisting, Retention, RFMSegmentation, Sale, SegmentTable, bind
from patronage.operators import cohort, new_existing, rfm
from patronage.operators import materialize as materialize_module
from patronage.operators.materialize import checkpoint_dir_ready

from conftest import frame

ROWS = [(f"c{i % 7}", "xyz"[i % 3], float(i), f"2020-{1 + i % 12:02d}-05") for i in range(60)]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    df.collect()
    text = physical(df)
    final = text.split("+- == Initial Plan ==")[0]
    return re.findall(r"Exchange (hashpartitioning\((.*?), \d+\)|SinglePartition|rangepartitioning)", final.split("InMemoryRelation")[0])


@pytest.fixture
def parquet(spark, tmp_path):
    path = str(tmp_path / "sales")
    frame(spark, ROWS).selectExpr("*", "'unused' AS other").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark, parquet):
    base = bind(
        parquet,
        Entity("customer", segment="segment", keep_segments=["x", "y"]),
        Sale("sale"),
        Dates("date", years=[2020]),
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = physical(Growth(base).data["monthly_revenue"])
    pushed = re.search(r"PushedFilters: \[(.*)", plan).group(1)
    assert "In(segment, [x,y])" in pushed and "GreaterThanOrEqual(date" in pushed and "LessThan(date" in pushed
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert "other" not in schema and "customer" not in schema


def test_no_python_and_no_cross_join_in_metrics(make_base):
    base = make_base(ROWS)
    for report in (Growth(base), NewExisting(base), Retention(base)):
        for df in report.data.values():
            plan = physical(df)
            assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_cached_base_needs_no_shuffle_by_customer(make_base):
    base = make_base(ROWS).cache()
    base.measures.count()
    m = base.measures
    frames = [
        rfm.customers(m),
        new_existing.month_new_percent(new_existing.typed_activity(m)),
        Retention(base).data["by_month"],
        cohort.cohort_long(m),
    ]
    for df in frames:
        keys = [e[1] for e in exchanges(df)]
        assert not any("customer#" in k for k in keys), keys
    base.unpersist()


def metrics_of(base):
    m = base.measures
    typed = new_existing.typed_activity(m)
    return [
        rfm.customers(m),
        new_existing.month_new_percent(typed),
        new_existing.segment_count(typed),
        Retention(base).data["by_month"],
        cohort.cohort_long(m),
    ]


def test_stored_base_is_bucketed_and_outlives_its_source(spark, tmp_path):
    path = str(tmp_path / "gone")
    frame(spark, ROWS).write.parquet(path)
    base = bind(spark.read.parquet(path), Entity("customer", segment="segment"), Sale("sale"), Dates("date"))
    plain = [sorted(map(str, df.collect())) for df in metrics_of(base)]
    base.store(buckets=4)
    assert not base._cached.storageLevel.useMemory
    # Nothing is kept by executors: with the source gone, all comes from the table.
    shutil.rmtree(path)
    for df, want in zip(metrics_of(base), plain):
        assert not any("customer#" in e[1] for e in exchanges(df))
        assert sorted(map(str, df.collect())) == want
    name = base._table
    base.unpersist()
    assert not spark.catalog.tableExists(name)


def test_suite_on_a_stored_base(make_base):
    with FullAnalysis(make_base(ROWS), stored=True) as suite:
        assert suite.base._table is not None
        assert suite.analysis_data()["Basic Info data"]["customer_revenue"].count() == 7


def test_segmentation_reads_the_source_once(spark, parquet):
    """Customers, months, latest date, histograms and trends come from one scan."""
    base = bind(parquet, Entity("customer", segment="segment"), Sale("sale"), Dates("date"))
    segmentation = RFMSegmentation(base, 2, 2, 2)
    plans = []
    whole = materialize_module.materialize

    def recorded(df):
        plans.append(physical(df))
        return whole(df)

    rfm.materialize, kept = recorded, rfm.materialize
    try:
        frame_ = segmentation.customers
    finally:
        rfm.materialize = kept
    assert len(plans) == 1 and plans[0].count("FileScan") == 1
    for df in (frame_, rfm.histograms(frame_), rfm.trends(segmentation.segmented)):
        text = physical(df).split("InMemoryRelation")[0]
        assert "FileScan" not in text
    assert segmentation.data["rfm"].count() == 7
    assert len(exchanges(rfm.histograms(frame_))) <= 4


def test_more_clusters_than_a_task_orders(spark):
    df = spark.range(500).selectExpr("cast(pmod(id * 37, 100) as string) as c", "cast(id % 100 as double) as v")
    for descending in (False, True):
        few = rfm.rank_clusters(df, "c", "v", descending)
        many = rfm.rank_clusters(df, "c", "v", descending, most=7)
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_windows_run_on_reduced_rows(make_base):
    base = make_base(ROWS)
    plan = physical(new_existing.typed_activity(base.measures))
    # Read from the bottom: rows are aggregated below the window.
    assert plan.index("Window") < plan.index("HashAggregate")


def test_large_segment_table_is_joined_after_the_reduction(spark, parquet, no_broadcast):
    table = spark.createDataFrame([(f"c{i}", "x") for i in range(7)], "k string, s string")
    base = bind(parquet, Entity("customer"), Sale("sale"), Dates("date"), segments=SegmentTable(table, "k", "s"), broadcast_bytes=0)
    plan = physical(Growth(base).data["segment_monthly_revenue"])
    assert "BroadcastHashJoin" not in plan
    assert plan.index("SortMergeJoin") < plan.rindex("HashAggregate")
    small = bind(parquet, Entity("customer"), Sale("sale"), Dates("date"), segments=SegmentTable(table, "k", "s"))
    assert "BroadcastHashJoin" in physical(Growth(small).data["segment_monthly_revenue"])


def test_typed_rows_join_the_rows_once(spark, parquet, no_broadcast):
    table = spark.createDataFrame([(f"c{i}", "x") for i in range(7)], "k string, s string")
    base = bind(parquet, Entity("customer"), Sale("sale"), Dates("date"), segments=SegmentTable(table, "k", "s"), broadcast_bytes=0)
    plan = physical(new_existing.typed_rows(base))
    lines = plan.split("\n")
    top = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    # Below the topmost join its left side is the part drawn beside a colon.
    edge = next(i for i, c in enumerate(lines[top + 1]) if c == ":")
    rows_side = [line for line in lines[top + 1 :] if line[edge : edge + 1] == ":"]
    assert any("FileScan" in line for line in rows_side)
    assert not any("SortMergeJoin" in line for line in rows_side)


class FakeSession:
    """Enough of a session to see which checkpoint folder is chosen."""

    def __init__(self, master, configured=None, folder=None):
        self.folder, self.master, self.configured = folder, master, configured
        self.sparkContext = self.conf = self

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.configured or default


@pytest.mark.parametrize(
    "session, ready, folder",
    [
        (FakeSession("yarn", configured="hdfs:///shared"), True, "hdfs:///shared"),
        (FakeSession("yarn", folder="hdfs:///set"), True, "hdfs:///set"),
        (FakeSession("local[2]", configured="/shared"), True, "/shared"),
        (FakeSession("yarn"), False, None),
    ],
)
def test_checkpoint_folder_of_the_cluster_is_used(session, ready, folder):
    assert checkpoint_dir_ready(session) is ready
    assert session.folder == folder


def test_no_folder_of_its_own_in_a_local_session():
    session = FakeSession("local[2]")
    assert not checkpoint_dir_ready(session) and session.folder is None


def test_cluster_ranks_leave_the_rows_where_they_are(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(100).selectExpr("id % 4 as c", "cast(id as double) as v")
        plan = physical(rfm.rank_clusters(df, "c", "v"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_registered_queries_have_sql_or_train_models():
    import __spark_entry__ as registry

    queries, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(name.startswith(("ltv_", "op")) or name == "pipeline" for name in set(queries) - set(sql))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize(
    "name",
    ["growth_segment_monthly_revenue", "new_existing_rows", "retention_by_customer", "cohort_by_retention_pct", "rfm_segment", "ltv_cluster_hint"],
)
def test_queries_equal_their_sql(spark, name):
    pytest.importorskip("duckdb")
    from tools.check_oracle import checked, connect, differences

    import __spark_entry__ as registry

    sf_dir = "/root/testdata/sf0.001"
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert differences(got, checked(connect(sf_dir), registry.oracle_sql()[name])) is None
