import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.operators import profile as P
from tabsense.operators import quantile as Q
from tabsense.operators import stats as S


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(7)
    rows = []
    for i in range(200):
        rows.append((i + 1, rng.gauss(100, 20), rng.randint(1, 9),
                     rng.choice(["Riyadh", "Jeddah", "Dammam"]),
                     rng.choices(["done", "new", "void"], [0.7, 0.2, 0.1])[0],
                     dt.datetime(2025, 1, 1) + dt.timedelta(days=i),
                     None if i < 150 else "ok"))
    rows[0] = rows[0][:1] + (900.0,) + rows[0][2:]          # one clear outlier
    return spark.createDataFrame(rows, "order_id long, amount double, qty long, city string, "
                                       "status string, order_date timestamp_ntz, note string")


def test_overview(frame):
    o = P.overview(frame).first()
    assert (o["rows"], o["cols"], o["duplicate_rows"]) == (200, 7, 0)
    assert o["missing_pct"] == round(100 * 150 / (200 * 7), 2)


def test_duplicates_exact_and_fingerprint(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, 1), (2, 3)], "a long, b long")
    assert P.duplicate_rows(df).first()[0] == 1
    assert P.duplicate_rows(df, exact=True).first()[0] == 1


def test_numeric_profile_matches_sorted_values(frame):
    vals = sorted(r[0] for r in frame.select("amount").collect())
    n = len(vals)

    def quant(p):
        h = (n - 1) * p
        lo, hi = int(h), min(int(h) + 1, n - 1)
        return vals[lo] + (h - lo) * (vals[hi] - vals[lo])
    row = {r["column"]: r for r in P.numeric(frame).collect()}["amount"]
    assert row["median"] == pytest.approx(round(quant(0.5), 4))
    q1, q3 = quant(0.25), quant(0.75)
    iqr = q3 - q1
    assert row["outliers"] == sum(1 for v in vals if v < q1 - 1.5 * iqr or v > q3 + 1.5 * iqr)
    assert row["outliers"] >= 1


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def expected(vals, p):
    vals, h = sorted(vals), (len(vals) - 1) * p
    lo, hi = vals[int(h)], vals[min(int(h) + 1, len(vals) - 1)]
    return lo if lo == hi or h == int(h) else lo + (h - int(h)) * (hi - lo)


def distributions():
    rnd = random.Random(7)
    n = 6000
    inf = float("inf")
    return {
        "hot": [5.0] * (n // 3) + [float(i) for i in range(n - n // 3)],
        "log_uniform": [10 ** rnd.uniform(-300, 300) * rnd.choice([-1, 1]) for _ in range(n)],
        "infinite": [rnd.choice([inf, -inf, rnd.gauss(0, 1)]) for _ in range(n)],
        "steps": [float(rnd.randint(0, 9)) for _ in range(n)],
        "normal": [rnd.gauss(0, 1e6) for _ in range(n)],
        "holes": [None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(i % 97) ** 2
                  for i in range(n)],
        "one": [3.5] + [None] * (n - 1),
        "two": [3.5, -1.0] + [None] * (n - 2),
        "none": [None] * n}


@pytest.mark.parametrize("accuracy", [10_000, 300, 40])
def test_quantiles_of_any_distribution_are_exact(spark, accuracy):
    # small sketches force refined brackets: more scans, the same figures
    cols = distributions()
    df = spark.createDataFrame(list(zip(*cols.values())),
                               ", ".join(f"{c} double" for c in cols)).repartition(5)
    found = Q.profile(df, list(cols), PROBS, fences=True, accuracy=accuracy)
    for k, (name, vals) in enumerate(cols.items()):
        vals = [v for v in vals if v is not None and v == v]
        if not vals:
            assert not any(k == j for j, _ in found.quantile)
            continue
        for p in PROBS:
            got, want = found.quantile[k, p], expected(vals, p)
            assert got == want or math.isnan(got) and math.isnan(want), (name, p)
        low, high = Q.fences_of(expected(vals, 0.25), expected(vals, 0.75))
        assert found.outliers.get(k, 0) == sum(v < low or v > high for v in vals), name


def test_a_sketch_beyond_its_bound_only_costs_a_scan(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    opened = Q._open

    def astray(facts, probs, accuracy):
        ranks = opened(facts, probs, accuracy)
        for r in ranks:
            r.lo, r.hi = 0.0, 1.0
        return ranks
    monkeypatch.setattr(Q, "_open", astray)
    got = Q.profile(df, ["v"], [0.5, 0.9])
    assert got.quantile == {(0, 0.5): 499.5, (0, 0.9): pytest.approx(899.1)}


def test_quantiles_read_the_table_twice(spark, tmp_path, monkeypatch):
    spark.range(5000).select((F.col("id") * 7 % 1009).alias("a"), F.rand(3).alias("b")
                             ).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    scans = []
    for name in ("_first", "_refine", "_groups"):
        def counted(*args, kept=getattr(Q, name), name=name):
            scans.append(name)
            return kept(*args)
        monkeypatch.setattr(Q, name, counted)
    P.numeric(df).collect()
    assert scans == ["_first", "_groups"]
    scans.clear()
    Q.profile(df, ["a", "b"], [0.25, 0.5, 0.75], fences=True, accuracy=200)
    assert scans == ["_first", "_refine", "_groups"]        # three at most
    groups = Q._groups(df, [F.col("a"), F.col("b")], [[(1.0, 2.0)], []])
    assert "Window" not in groups._jdf.queryExecution().executedPlan().toString()


def test_top_values_and_identifiers(frame):
    top = P.top_values(frame).where(F.col("column") == "status").orderBy("rank").collect()
    assert top[0]["value"] == "done"
    ids = {r["column"]: r["is_identifier"] for r in P.identifiers(S.column_stats(frame)).collect()}
    assert ids["order_id"] and not ids["qty"]


def test_correlations_constant_column_is_safe(spark):
    rows = [(float(i), 2.0 * i + 1, 7.0) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, k double")
    got = [(r["a"], r["b"], r["r"]) for r in P.correlations(df).collect()]
    assert got == [("a", "b", 1.0)]


def test_correlations_pairwise_complete(spark):
    rows = [(float(i), float(i) if i % 3 else None, float(-i)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["a"], r["b"]): r["r"] for r in P.correlations(df).collect()}
    assert got[("a", "b")] == 1.0 and got[("a", "c")] == -1.0 and got[("b", "c")] == -1.0


def test_histogram_counts_sum(frame):
    h = P.histogram(frame, "amount").collect()
    assert len(h) == 12 and sum(r["count"] for r in h) == 200


def test_series_daily_fallback(frame):
    s = P.series(frame, "order_date", "amount").collect()
    assert s[0]["granularity"] == "month" and len(s) == 7


def test_column_stats_chunked_equals_single_aggregate(frame, monkeypatch):
    full = sorted(tuple(r) for r in S.column_stats(frame).collect())
    monkeypatch.setattr(S, "STATS_CHUNK", 2)
    chunked = S.column_stats(frame)
    assert sorted(tuple(r) for r in chunked.collect()) == full
    assert chunked.columns == S.column_stats(frame).columns


def test_three_hundred_columns_correlate_in_two_scans(spark, monkeypatch):
    import numpy as np
    rnd = np.random.default_rng(5)
    k, n = 300, 400
    base = rnd.normal(0, 1, (n, 20))
    x = base[:, rnd.integers(0, 20, k)] * rnd.uniform(-50, 50, k) + rnd.normal(0, 9, (n, k)) + 1e6
    x[:, 7] = 3.25                                        # a constant
    x[rnd.random((n, k)) < 0.1] = np.nan
    x[5, 9] = np.inf
    names = [f"c{i}" if i % 50 else f"c.{i} 'it`s'" for i in range(k)]
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in x],
                               T.StructType([T.StructField(c, T.DoubleType()) for c in names])
                               ).repartition(3)
    jobs = []
    frame = type(df)
    for name in ("agg", "mapInArrow"):
        def counted(self, *args, kept=getattr(frame, name), name=name, **kw):
            jobs.append(name)
            return kept(self, *args, **kw)
        monkeypatch.setattr(frame, name, counted)
    got = {(r["a"], r["b"]): r["r"] for r in P.correlations(df, cut=0.0).collect()}
    assert sorted(jobs) == ["agg", "mapInArrow"]
    for i in range(0, k, 7):
        for j in range(i + 1, k, 11):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            key = (names[i], names[j])
            if 7 in (i, j) or 9 in (i, j):
                assert key not in got
            else:
                want = np.corrcoef(x[both, i], x[both, j])[0, 1]
                assert got[key] == pytest.approx(want, abs=6e-4)
