"""Plan-shape checks: no Python UDF in core plans, scans pruned and filtered,
windows only over aggregated rows."""

import pytest
from pyspark.sql import functions as F

from tabsense.operators import business as B
from tabsense.operators import profile as P
from tabsense.operators import stats as S

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet")


def test_no_python_udf_in_core_plans(orders):
    for df in (B.kpis(orders, "o_totalprice"),
               B.trend_bins(orders, "o_orderdate", "o_totalprice"),
               B.breakdowns(orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice"),
               P.overview(orders), S.value_counts(orders)):
        p = plan(df)
        assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_breakdown_scan_is_pruned(orders):
    p = plan(B.breakdowns(orders, ["o_orderstatus"], "o_totalprice"))
    read = [x.split(">")[0] for x in p.split("ReadSchema: struct<")[1:]]
    assert read
    for cols in read:
        assert {c.split(":")[0] for c in cols.split(",")} <= {"o_orderstatus", "o_totalprice", ""}
    assert any("o_totalprice" in cols for cols in read)


def test_filter_pushed_to_scan(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").where(F.col("l_quantity") > 10)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in p


def test_windows_only_after_aggregation(orders):
    # every Window in the breakdown plan sits above a HashAggregate
    p = plan(B.breakdowns(orders, ["o_orderstatus"], "o_totalprice"))
    lines = p.splitlines()
    for i, ln in enumerate(lines):
        if "Window" in ln:
            assert any("HashAggregate" in x for x in lines[i:]), p


def test_analysis_reads_base_table_once(orders):
    # after the one-pass partials (checkpointed), report blocks read no parquet
    from tabsense.plans.analyze import analyze, metrics_long
    from tabsense.plans import facts as FA
    a = analyze(orders)
    for df in (metrics_long(a), FA.facts(a, orders.schema)):
        assert "FileScan parquet" not in plan(df)
    one = B.partials(orders, "o_orderdate", "o_totalprice", ["o_orderstatus"])
    assert plan(one).count("FileScan parquet") == 1


def _rows(df, order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("measure", ["o_totalprice", None, "o_comment_missing"])
def test_partials_path_equals_direct_path(spark, orders, measure):
    df = orders
    if measure == "o_comment_missing":   # a measure with no numeric value at all
        df = orders.withColumn(measure, F.lit("n/a"))
    dims = ["o_orderstatus", "o_orderpriority"]
    for frame in (df, df.limit(0)):
        pre = B.partials(frame, "o_orderdate", measure, dims)
        assert _rows(B.kpis(frame, measure, pre=pre), ["seq"]) == \
            _rows(B.kpis(frame, measure), ["seq"])
        assert _rows(B.trend_bins(frame, "o_orderdate", measure, pre=pre), ["idx"]) == \
            _rows(B.trend_bins(frame, "o_orderdate", measure), ["idx"])
        assert _rows(B.breakdowns(frame, dims, measure, pre=pre), ["dim_order", "rank"]) == \
            _rows(B.breakdowns(frame, dims, measure), ["dim_order", "rank"])


def test_change_batch_plans_no_full_outer_join(spark, orders):
    from tabsense.operators import changes as CH
    batch = (orders.where(F.col("o_orderstatus") == "P")
             .select(F.lit(1).cast("long").alias("seq"), F.lit("delete").alias("op"),
                     "o_orderkey"))
    for df in (CH.apply_changes(orders, batch, ["o_orderkey"]),
               CH.change_counts(orders, batch, ["o_orderkey"])):
        p = plan(df)
        assert "FullOuter" not in p


def test_change_batch_is_folded_once_and_keeps_no_field_twice(spark):
    import re
    from tabsense.operators import changes as CH
    base = spark.range(100).selectExpr("id", "id AS v", "CAST(id AS string) AS s")
    batch = spark.range(60).selectExpr(
        "id AS seq", "element_at(array('insert', 'update', 'delete'), int(id % 3) + 1) AS op",
        "array('v') AS set_cols", "id * 2 AS id", "id AS v", "'x' AS s")
    # sorted rows of one task: the base once, the batch once, one field a column and the reset
    p = plan(CH.apply_changes(base, batch, ["id"]))
    folds = [x for x in p.splitlines() if "partial_max_by(" in x]
    assert len(folds) == 1 and folds[0].count("partial_max_by(") == 3
    assert len(re.findall(r"Join .*LeftOuter", p)) == 1
    # the semi join against base keys takes inserted keys only
    assert re.search(r"Filter .*= insert\)", p)
    # counts: one join, and no hash map beside the sorted rows
    p = plan(CH.change_counts(base, batch, ["id"]))
    assert len(re.findall(r"Join \[", p)) == 1
    assert "HashAggregate(keys=[id" not in p


def test_profile_shuffles_no_texts(spark):
    import re
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (S.distinct_counts(docs), S.value_counts(docs, ["text", "lang"])):
        keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan(df))
        assert keys
        for k in keys:
            names = {x.split("#")[0].strip() for x in k.split(",")[:-1]}
            assert not names & {"value", "text", "sk", "head"}, k


def test_top_values_with_ties_and_long_equal_beginnings(spark):
    long_ = "x" * 100
    rows = [(long_ + c,) for c in "dcba" for _ in range(2)] + [("solo",), (None,)] + [("y",)] * 3
    df = spark.createDataFrame(rows, "t string")
    got = [(r["value"], r["n"]) for r in S.top_values(df, ["t"], 3).orderBy("rank").collect()]
    assert got == [("y", 3), (long_ + "a", 2), (long_ + "b", 2)]
