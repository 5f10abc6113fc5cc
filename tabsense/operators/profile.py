"""Structural profile of a table (PRF-1..12).

All outputs are long DataFrames.  Heavy work: one stats aggregate, one
value-count shuffle, two scans for exact quantiles, one fingerprint shuffle
for duplicates; everything after that runs on per-column or per-bin rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W
from . import gram as G
from . import quantile as Q
from . import stats as S
from .stats import as_number, q


def _num_or_raw(df: DataFrame, name: str) -> Column:
    kind = S.kind_of(df.schema[name].dataType)
    return as_number(q(name)) if kind == "numeric" else q(name)


# ------------------------------------------------------------------ PRF-1
def row_fingerprint(df: DataFrame) -> list[Column]:
    """128-bit fingerprint of a whole row (nulls marked, so positions count)."""
    # maps cannot be hashed: their entries, sorted by key, stand for them
    cols = [F.sort_array(F.map_entries(q(c))) if df.schema[c].dataType.typeName() == "map"
            else _num_or_raw(df, c) for c in df.columns]
    nulls = F.array(*[c.isNull() for c in cols])
    return [F.xxhash64(nulls, *cols).alias("fp1"),
            F.xxhash64(F.lit("tabsense"), nulls, *cols).alias("fp2")]


def duplicate_rows(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row ``duplicate_rows``: rows equal to an earlier row (nulls equal).

    Default groups on a 128-bit row fingerprint so the shuffle moves 16
    bytes per row instead of whole rows; ``exact`` groups on the columns.
    """
    keys = [q(c) for c in df.columns] if exact else row_fingerprint(df)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long")
                 .alias("duplicate_rows")))


def overview(df: DataFrame, exact_duplicates: bool = False) -> DataFrame:
    """PRF-1: ``rows, cols, missing_pct, duplicate_rows``."""
    ncols = len(df.columns)
    nulls = [F.sum(F.when(_num_or_raw(df, c).isNull(), 1).otherwise(0)) for c in df.columns]
    missing = sum(nulls[1:], nulls[0]) if nulls else F.lit(0)
    base = df.agg(F.count(F.lit(1)).alias("rows"), missing.alias("missing"))
    cells = F.greatest(F.col("rows") * ncols, F.lit(1))
    return (base.crossJoin(duplicate_rows(df, exact_duplicates))
            .select(F.col("rows").cast("long").alias("rows"),
                    F.lit(ncols).cast("long").alias("cols"),
                    F.round(100 * F.col("missing") / cells, 2).alias("missing_pct"),
                    "duplicate_rows"))


# ------------------------------------------------------------------ PRF-2
def columns(stats: DataFrame) -> DataFrame:
    """PRF-2: ``ordinal, column, kind, nulls, distinct``."""
    return stats.select("ordinal", "column", "kind",
                        (F.col("rows") - F.col("nonnull")).alias("nulls"), "distinct")


# --------------------------------------------------------------- PRF-3/4
def numeric(df: DataFrame, exact: bool = True) -> DataFrame:
    """PRF-3 + PRF-4: mean, sample std, min, max, median, IQR outliers.

    Values rounded to 4 dp.  Outliers lie strictly outside
    ``[q1 - 1.5*iqr, q3 + 1.5*iqr]`` with linear-interpolated quartiles.
    Exact figures take one scan with moments and sketches and one that counts
    inside the brackets and beyond the fences (see ``quantile``).
    """
    nums = [(i, c) for i, c, k, _ in S.columns_by_kind(df) if k == "numeric"]
    names = [c for _, c in nums]
    if exact:
        found = Q.profile(df, names, [0.25, 0.5, 0.75], fences=True, moments=True)
        rows = []
        for k, ((i, c), f) in enumerate(zip(nums, found.facts)):
            quarts = [found.quantile.get((k, p)) for p in (0.5, 0.25, 0.75)]
            rows.append((i, c, f["mean"], f["std"], f["lo"], f["hi"], *quarts,
                         found.outliers.get(k, 0)))
    else:
        rows = _approximate(df, nums)
    out = S.local_frame(df.sparkSession, rows,
                        "ordinal int, column string, mean double, std double, min double, "
                        "max double, median double, q1 double, q3 double, outliers long")
    figures = ["mean", "std", "min", "max", "median", "q1", "q3"]
    return out.select("ordinal", "column", *[F.round(c, 4).alias(c) for c in figures], "outliers")


def _approximate(df: DataFrame, nums: list[tuple[int, str]]) -> list[tuple]:
    """Rows of :func:`numeric` with sketched quartiles and the outliers by them."""
    names = [c for _, c in nums]
    facts = {r["column"]: r for r in S.column_stats(df, distinct_for=[]).where(
        F.col("kind") == "numeric").collect()}                # one row per column
    quart: dict[str, dict] = {c: {} for c in names}
    for r in S.approx_quantiles(df, names, [0.25, 0.5, 0.75]).collect():
        quart[r["column"]][r["prob"]] = r["value"]
    aggs = []
    for k, c in enumerate(names):
        low, high = (Q.fences_of(quart[c][0.25], quart[c][0.75]) if quart[c]
                     else (None, None))
        v = as_number(q(c))
        aggs.append(F.coalesce(F.sum(F.when((v < F.lit(low)) | (v > F.lit(high)), 1)),
                               F.lit(0)).alias(f"o{k}"))
    beyond = df.agg(*aggs).first() if aggs else None
    return [(i, c, facts[c]["mean"], facts[c]["std"], facts[c]["min_num"], facts[c]["max_num"],
             quart[c].get(0.5), quart[c].get(0.25), quart[c].get(0.75), beyond[f"o{k}"])
            for k, (i, c) in enumerate(nums)]


# ------------------------------------------------------------------ PRF-5
def datetimes(stats: DataFrame) -> DataFrame:
    """PRF-5: first and last date of every datetime column."""
    return (stats.where(F.col("kind") == "datetime")
            .select("ordinal", "column", F.col("min_text").alias("min"),
                    F.col("max_text").alias("max")))


# -------------------------------------------------------------- PRF-6/10
def top_values(df: DataFrame, k: int = W.PROFILE_TOP_VALUES) -> DataFrame:
    """PRF-6: the ``k`` most frequent values of each categorical column."""
    cats = [c for _, c, kind, _ in S.columns_by_kind(df) if kind == "categorical"]
    return (S.top_values(df, cats, k)
            .select("ordinal", "column", "rank", "value", F.col("n").alias("count")))


def bars(df: DataFrame) -> DataFrame:
    """PRF-10: category bars for categoricals with 1 < distinct <= 30."""
    cats = [c for _, c, kind, _ in S.columns_by_kind(df) if kind == "categorical"]
    counts = S.distinct_counts(df, cats) if cats else None
    few = {r["ordinal"] for r in counts.collect()                # one row per column
           if 1 < r["distinct"] <= W.PROFILE_BAR_MAX_DISTINCT} if cats else set()
    return (S.top_values(df, [c for i, c, _, _ in S.columns_by_kind(df) if i in few],
                         W.PROFILE_TOP_VALUES)
            .select("ordinal", "column", "rank", "value", F.col("n").alias("count")))


# ------------------------------------------------------------------ PRF-7
def numeric_names(df: DataFrame) -> list[str]:
    """The columns whose distinct counts the identifier rule needs."""
    return [c for _, c, kind, _ in S.columns_by_kind(df) if kind == "numeric"]


def identifiers(stats: DataFrame) -> DataFrame:
    """PRF-7: identifier columns, profile flavour (name rule or all-unique numeric)."""
    low = F.lower(F.col("column"))
    by_name = ((low == "id") | low.endswith("_id") | low.endswith("-id") |
               low.startswith("id_"))
    unique = ((F.col("kind") == "numeric") & (F.col("rows") > 0) &
              (F.col("distinct") == F.col("rows")))
    return stats.select("ordinal", "column", (by_name | unique).alias("is_identifier"))


# ------------------------------------------------------------------ PRF-8
def correlations(df: DataFrame, cut: float = W.CORRELATION_CUT) -> DataFrame:
    """PRF-8: Pearson r of every numeric pair, pairwise complete, ``|r| >= cut``.

    Two scans for any number of columns (see ``gram``).  A column that is
    constant over a pair's rows, or infinite in one, gives no r.
    """
    nums = [c for _, c, k, _ in S.columns_by_kind(df) if k == "numeric"]
    if len(nums) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    names = F.expr("array(" + ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'"
                                        for n in nums) + ")")
    out = G.pearson(G.pair_sums(df, nums)).where(F.abs("r") >= cut)
    return out.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"),
                      F.round("r", 3).alias("r"))


# ------------------------------------------------------------------ PRF-9
def series(df: DataFrame, date_col: str, measure: str) -> DataFrame:
    """PRF-9: sum of ``measure`` per month end over the whole date range,
    empty months 0; fewer than 3 months falls back to days.
    ``(position, label, granularity, value)``, value rounded 4 dp."""
    ts = q(date_col).cast("timestamp_ntz")
    daily = (df.select(ts.alias("ts"), as_number(q(measure)).alias("m"))
             .where(F.col("ts").isNotNull())
             .groupBy(F.to_date("ts").alias("day")).agg(F.sum("m").alias("s")))
    bnd = daily.agg(F.min("day").alias("mn"), F.max("day").alias("mx")).where(
        F.col("mn").isNotNull())
    months = F.size(F.sequence(F.trunc("mn", "MM"), F.trunc("mx", "MM"),
                               F.expr("interval 1 month")))
    bnd = bnd.withColumn("granularity", F.when(months >= 3, "month").otherwise("day"))
    month = F.col("granularity") == "month"
    spine = bnd.select("granularity", F.explode(F.when(
        month, F.transform(F.sequence(F.trunc("mn", "MM"), F.trunc("mx", "MM"),
                                      F.expr("interval 1 month")), lambda d: F.last_day(d)))
        .otherwise(F.sequence("mn", "mx", F.expr("interval 1 day")))).alias("bin"))
    binned = (daily.crossJoin(F.broadcast(bnd.select("granularity")))
              .groupBy(F.when(month, F.last_day("day")).otherwise(F.col("day")).alias("bin"))
              .agg(F.sum("s").alias("s")))
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    return (spine.join(binned, "bin", "left")
            .select((F.row_number().over(w) - 1).alias("position"),
                    F.date_format("bin", "yyyy-MM-dd").alias("label"), "granularity",
                    F.round(F.coalesce("s", F.lit(0.0)), 4).alias("value")))


# ----------------------------------------------------------------- PRF-11
def histogram(df: DataFrame, column: str) -> DataFrame:
    """PRF-11: equal-width histogram, ``min(12, max(5, floor(sqrt(n))))`` bins,
    last bin closed.  ``(bin, lo, hi, count)``; all bins present."""
    v = as_number(q(column))
    vals = df.select(v.alias("v")).where(F.col("v").isNotNull())
    bnd = vals.agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                   F.count(F.lit(1)).alias("n"))
    bnd = bnd.where(F.col("n") > 0).withColumn(
        "bins", F.least(F.lit(W.HISTOGRAM_MAX_BINS), F.greatest(
            F.lit(W.HISTOGRAM_MIN_BINS), F.floor(F.sqrt("n")).cast("int"))))
    width = (F.col("hi") - F.col("lo"))
    idx = F.when(width == 0, F.floor(F.col("bins") / 2)).otherwise(
        F.least(F.floor((F.col("v") - F.col("lo")) / width * F.col("bins")),
                F.col("bins") - 1)).cast("int")
    counts = (vals.crossJoin(F.broadcast(bnd)).groupBy(idx.alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    edges = bnd.select("lo", "hi", "bins", F.explode(
        F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / F.col("bins")
    return (edges.join(counts, "bin", "left")
            .select(F.lit(column).alias("column"), "bin",
                    F.round(F.col("lo") + step * F.col("bin"), 4).alias("lo"),
                    F.round(F.when(F.col("bin") == F.col("bins") - 1, F.col("hi"))
                            .otherwise(F.col("lo") + step * (F.col("bin") + 1)), 4).alias("hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


# ----------------------------------------------------------------- PRF-12
def multi_overview(frames: dict[str, DataFrame], relationships: int = 0) -> DataFrame:
    """PRF-12: over all given tables — tables, rows, cols, row-weighted
    missing %, relationships."""
    rows = None
    for name, df in frames.items():
        one = overview(df).select(F.lit(name).alias("table"), "rows", "cols", "missing_pct")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(
        F.count(F.lit(1)).cast("long").alias("tables"),
        F.sum("rows").cast("long").alias("rows"), F.sum("cols").cast("long").alias("cols"),
        F.round(F.coalesce(F.try_divide(F.sum(F.col("missing_pct") * F.col("rows")),
                                        F.sum("rows")), F.lit(0.0)), 2).alias("missing_pct"),
        F.lit(relationships).cast("long").alias("relationships"))


def sample_rows(df: DataFrame, order_by: list[str], n: int = W.SAMPLE_ROWS) -> DataFrame:
    """PRJ-3: first ``n`` rows under an explicit order (Spark has no file order)."""
    return df.orderBy(*[q(c).asc_nulls_first() for c in order_by]).limit(n)


def series_auto(df: DataFrame, stats: DataFrame) -> DataFrame | None:
    """PRF-9 column choice: first datetime column x first numeric non-identifier."""
    ids = identifiers(stats)
    rows = (stats.join(ids.select("ordinal", "is_identifier"), "ordinal")
            .where((F.col("kind") == "datetime") |
                   ((F.col("kind") == "numeric") & ~F.col("is_identifier")))
            .select("ordinal", "column", "kind").collect())
    dates = [r["column"] for r in sorted(rows, key=lambda r: r["ordinal"]) if r["kind"] == "datetime"]
    nums = [r["column"] for r in sorted(rows, key=lambda r: r["ordinal"]) if r["kind"] == "numeric"]
    if not dates or not nums:
        return None
    return series(df, dates[0], nums[0])
