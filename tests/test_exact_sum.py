"""Order-free sums against exact arithmetic."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.operators import business as B
from tabsense.operators import exact_sum as X
from tabsense.plans.analyze import analyze
from tabsense.plans.facts import facts


def by_key(spark, rows, dtype, parts):
    df = spark.createDataFrame(rows, T.StructType([T.StructField("k", T.StringType()),
                                                   T.StructField("v", dtype)])).repartition(parts)
    out = X.summed(df.withColumn("t", X.term(F.col("v"), dtype)), ["k"], "t",
                   [("n", F.count("v"), "sum")])
    return {r["k"]: (r["s"], r["n"]) for r in out.select(
        "k", "n", X.value(F.col("acc"), F.col("odd"), dtype).alias("s")).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_doubles_are_rounded_once_and_in_any_order(spark, seed):
    rnd = random.Random(seed)
    inf = math.inf
    rows = [("cancel", x) for x in (1e300, 1.0, -1e300, 1e-300, 3.5e-5)]
    rows += [("tiny", 5e-324)] * 9 + [("tiny", -2.5e-310)]
    rows += [("money", round(rnd.uniform(-9e5, 9e5), 2)) for _ in range(4000)]
    rows += [("wide", rnd.uniform(-1, 1) * 10 ** rnd.uniform(-200, 200)) for _ in range(500)]
    rows += [("log", 2.0 ** rnd.randint(-1070, 1020)) for _ in range(50)]
    rows += [("edge", math.nextafter(2.0 ** e, 0) * s) for e in range(-60, 70) for s in (1, 1, -1)]
    rows += [("inf", inf), ("inf", 2.0), ("both", inf), ("both", -inf), ("zero", 0.0),
             ("zero", -0.0), ("none", None), ("nan", float("nan")), ("nan", 2.0)]
    rnd.shuffle(rows)
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    one, many = (by_key(spark, rows, T.DoubleType(), p) for p in (1, 7))
    assert sorted(map(str, one.items())) == sorted(map(str, many.items()))
    for k, vs in want.items():
        got = one[k]
        assert got[1] == sum(v is not None for v in vs)
        vs = [v for v in vs if v is not None and v == v]
        if not vs:
            assert got[0] is None
        elif k == "both":
            assert math.isnan(got[0])
        else:
            assert got[0] == (inf if k == "inf" else math.fsum(vs)), k


def test_whole_numbers_and_decimals_keep_their_digits(spark):
    rnd = random.Random(9)
    longs = [("a", rnd.randint(-2 ** 63, 2 ** 63 - 1)) for _ in range(3000)] + [
        ("b", 2 ** 53 + 1), ("b", 2 ** 53), ("c", None)]
    df = spark.createDataFrame(longs, "k string, v long").repartition(5)
    out = X.summed(df.withColumn("t", X.term(F.col("v"), T.LongType())), ["k"], "t")
    got = {r["k"]: r["d"] for r in out.select("k", X.digits(F.col("acc"), T.LongType())
                                              .alias("d")).collect()}
    assert got == {"a": sum(v for k, v in longs if k == "a"), "b": 2 ** 54 + 1, "c": None}
    dec = T.DecimalType(18, 4)
    vals = [Decimal(rnd.randint(-10 ** 17, 10 ** 17)).scaleb(-4) for _ in range(2000)]
    df = spark.createDataFrame([("a", v) for v in vals], T.StructType([
        T.StructField("k", T.StringType()), T.StructField("v", dec)])).repartition(4)
    out = X.summed(df.withColumn("t", X.term(F.col("v"), dec)), ["k"], "t")
    assert out.select(X.digits(F.col("acc"), dec)).first()[0] == sum(vals)


def test_partial_sums_add_up_as_rows_do(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(40), rnd.uniform(-1, 1) * 10 ** rnd.randint(-9, 9))
            for _ in range(3000)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(6)
    days = X.summed(df.withColumn("t", X.term(F.col("v"), T.DoubleType())), ["k"], "t",
                    [("c", F.count(F.lit(1)), "sum"), ("x", F.max("v"), "max")])
    out = X.merged(days.withColumn("bin", F.col("k") % 3), ["bin"], [("c", "sum"), ("x", "max")])
    got = {r["bin"]: (r["s"], r["c"], r["x"]) for r in out.select(
        "bin", "c", "x", X.value(F.col("acc"), F.col("odd"), T.DoubleType()).alias("s")).collect()}
    for b in range(3):
        vs = [v for k, v in rows if k % 3 == b]
        assert got[b] == (math.fsum(vs), len(vs), max(vs))


def test_figures_of_a_report_do_not_depend_on_the_partitions(spark):
    rnd = random.Random(2)
    rows = [(f"2024-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}", rnd.choice("abcdefghijk"),
             rnd.uniform(-1, 1) * 10 ** rnd.randint(0, 12)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "d string, dim string, amount double").withColumn(
        "d", F.to_date("d"))

    def figures(frame):
        return [sorted(map(str, x.collect())) for x in (
            B.kpis(frame, "amount"), B.trend(frame, "d", "amount"),
            B.breakdowns(frame, ["dim"], "amount"))]
    assert figures(df.repartition(1)) == figures(df.repartition(7, "amount"))


def test_equal_totals_rank_by_label(spark):
    # 0.1 + 0.2 + 0.3 in any order: the same total, so labels decide
    rows = [(k, v) for k, vs in (("b", (0.1, 0.2, 0.3)), ("a", (0.3, 0.2, 0.1)),
                                 ("c", (0.2, 0.3, 0.1))) for v in vs]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "dim string, amount double").repartition(parts)
        out = B.breakdowns(df, ["dim"], "amount").orderBy("rank").collect()
        assert [r["label"] for r in out] == ["a", "b", "c"]


def test_long_totals_are_printed_in_full(spark):
    df = spark.createDataFrame([("x", 2 ** 53 + 1), ("y", 2 ** 53 + 2), ("x", 5)] * 10,
                               "dim string, amount long")
    a = analyze(df, {"measure": "amount", "dimensions": ["dim"]})
    texts = [r["text"] for r in facts(a, df.schema).collect()]
    assert any(str(10 * (2 ** 54 + 8)) in t for t in texts), texts
    assert any(str(2 ** 53 + 2) in t for t in texts)
