"""Business aggregates: KPIs, trimmed time trend, ranked breakdowns.

KPI-1, TRD-1..4, BRK-1..5.  All heavy work is a partially aggregated
``groupBy`` over the base table; every window below runs on already
aggregated rows (days, <=24 bins, or the groups of one dimension), never on
base rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import words as W
from . import exact_sum as X
from .semantics import is_rate
from .stats import q, top_k_per_group, try_number


def _all():
    """Whole-frame window; only ever used on <= a few dozen aggregated rows."""
    return Window.partitionBy(F.lit(0))


def _round2(c: Column) -> Column:
    return F.round(c, 2)


# ----------------------------------------------------------------- one pass
def partials(df: DataFrame, date_col: str | None, measure: str | None,
             dims: list[str]) -> DataFrame:
    """Everything a report needs from the base rows, in one scan.

    Each row is stacked once per block — grand total (``part`` 0), its day
    (``part`` 1, rows with a date) and each dimension label (``part`` 2,
    non-null labels) — and grouped, partially aggregated map-side:
    ``c`` rows, ``nn`` numeric measure values, ``s`` sum, ``x`` max,
    ``t0``/``t1`` first/last timestamp.  The result has 1 + days + groups
    rows; KPIs, trend, trend summary and breakdowns all derive from it.

    Sums are exact and rounded once (see ``exact_sum``); ``acc`` and ``odd`` let
    them be added further, ``digits`` has those of whole numbers and decimals.
    """
    dtype = _type(df, measure)
    m = try_number(q(measure)) if measure else F.lit(None).cast("double")
    t = X.term(q(measure) if measure else m, dtype)
    ts = q(date_col).cast("timestamp_ntz") if date_col else F.lit(None).cast("timestamp_ntz")
    null_i, null_s = F.lit(None).cast("int"), F.lit(None).cast("string")

    def block(part, j, col, label, day):
        return F.struct(F.lit(part).alias("part"), j.alias("dim_order"), col.alias("column"),
                        label.alias("label"), day.alias("day"))
    blocks = [block(0, null_i, null_s, null_s, F.lit(None).cast("date"))]
    if date_col:
        blocks.append(block(1, null_i, null_s, null_s, F.to_date(ts)))
    blocks += [block(2, F.lit(j), F.lit(d), q(d).cast("string"), F.lit(None).cast("date"))
               for j, d in enumerate(dims)]
    keep = ((F.col("part") == 0) | ((F.col("part") == 1) & F.col("day").isNotNull()) |
            ((F.col("part") == 2) & F.col("label").isNotNull()))
    whole = (q(measure).cast("decimal(38,6)") if X.is_whole(dtype)
             else F.lit(None).cast("decimal(38,6)"))
    stacked = df.select(m.alias("m"), t.alias("t"), whole.alias("whole"), ts.alias("ts"),
                        F.inline(F.array(*blocks))).where(keep)
    out = X.summed(stacked, ["part", "dim_order", "column", "label", "day"], "t", [
        ("c", F.count(F.lit(1)), "sum"), ("nn", F.count("m"), "sum"), ("x", F.max("m"), "max"),
        ("top", F.max("whole"), "max"),
        ("t0", F.min("ts"), "min"), ("t1", F.max("ts"), "max")])
    exact = (X.digits(F.col("acc"), dtype).cast("decimal(38,6)")
             if X.is_whole(dtype) else F.lit(None).cast("decimal(38,6)"))
    return (out.withColumn("s", X.value(F.col("acc"), F.col("odd"), dtype))
            .withColumn("digits", exact))


def _type(df: DataFrame, measure: str | None) -> T.DataType:
    return df.schema[measure].dataType if measure else T.DoubleType()


# --------------------------------------------------------------------- KPIs
def kpis(df: DataFrame, measure: str | None, pre: DataFrame | None = None,
         exact: bool = False) -> DataFrame:
    """KPI-1: ``(seq, key, value, column)``, with ``exact`` also ``digits``.

    ``records`` always; for the measure coerced to a number (null when it
    does not parse): ``total`` (not for rates), ``average``, ``highest`` —
    only when at least one value parses.  Values rounded to 2 dp; ``digits`` is
    a decimal for totals and maxima of whole numbers and decimals, which may have
    more digits than a double, and null elsewhere.
    """
    if pre is None:
        pre = partials(df, None, measure, [])
    one = (pre.where(F.col("part") == 0)      # one row, or none for an empty table
           .agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
                F.coalesce(F.sum("nn"), F.lit(0)).alias("nn"),
                F.max("s").alias("s"), F.max("x").alias("x"), F.max("digits").alias("digits"),
                F.max("top").alias("top"))
           .withColumn("a", F.try_divide(F.col("s"), F.col("nn").cast("double"))))
    none, has = F.lit(None).cast("decimal(38,6)"), F.col("nn") > 0
    entries = [(0, "records", F.col("n").cast("double"), F.lit(None).cast("string"),
                none, F.lit(True))]
    if measure is not None:
        if not is_rate(measure):
            entries.append((1, "total", _round2(F.col("s")), F.lit(measure), F.col("digits"), has))
        entries += [(2, "average", _round2(F.col("a")), F.lit(measure), none, has),
                    (3, "highest", _round2(F.col("x")), F.lit(measure), F.col("top"), has)]
    structs = [F.struct(F.lit(s).alias("seq"), F.lit(k).alias("key"),
                        v.cast("double").alias("value"), c.alias("column"),
                        *([d.alias("digits")] if exact else []), keep.alias("keep"))
               for s, k, v, c, d, keep in entries]
    return (one.select(F.inline(F.array(*structs)))
            .where("keep").drop("keep"))


# -------------------------------------------------------------------- trend
def _daily(df: DataFrame, date_col: str, measure: str | None,
           pre: DataFrame | None = None) -> DataFrame:
    """Per-day partial result: the only pass over base rows for a trend."""
    if pre is None:
        pre = partials(df, date_col, measure, [])
    return pre.where(F.col("part") == 1).select("day", "acc", "odd", "c", "t0", "t1")


def trend_bins(df: DataFrame, date_col: str, measure: str | None = None,
               tail: int = W.MAX_TREND_POINTS, pre: DataFrame | None = None) -> DataFrame:
    """TRD-1..3: the last ``tail`` bins with a ``kept`` flag after trimming.

    Columns: ``idx`` (0-based), ``bin`` (date: month end or day), ``label``,
    ``granularity``, ``value`` (sum of the measure, or row count when there
    is no measure; empty bins 0; rounded 2 dp), ``records``, ``t0``/``t1``
    (first/last timestamp in the bin), ``kept``.
    """
    daily = _daily(df, date_col, measure, pre)
    bounds = daily.agg(F.min("t0").alias("mn"), F.max("t1").alias("mx"))
    bounds = bounds.select(
        "mn", "mx",
        F.when(F.expr(f"timestampdiff(DAY, mn, mx)") > W.MONTH_SPAN_DAYS, "month")
        .otherwise("day").alias("granularity")).where(F.col("mn").isNotNull())
    month = F.col("granularity") == "month"
    last_bin = F.when(month, F.last_day(F.to_date("mx"))).otherwise(F.to_date("mx"))
    first_month = F.greatest(F.trunc(F.to_date("mn"), "MM"),
                             F.add_months(F.trunc(F.to_date("mx"), "MM"), -(tail - 1)))
    first_day = F.greatest(F.to_date("mn"), F.date_sub(F.to_date("mx"), tail - 1))
    months = F.transform(
        F.sequence(first_month, F.trunc(F.to_date("mx"), "MM"), F.expr("interval 1 month")),
        lambda d: F.last_day(d))
    days = F.sequence(first_day, F.to_date("mx"), F.expr("interval 1 day"))
    spine = bounds.select("granularity", F.explode(F.when(month, months).otherwise(days))
                          .alias("bin"))
    binned = (daily.crossJoin(F.broadcast(bounds.select("granularity")))
              .withColumn("bin", F.when(month, F.last_day("day")).otherwise(F.col("day"))))
    binned = (X.merged(binned, ["bin"], [("c", "sum"), ("t0", "min"), ("t1", "max")])
              .withColumn("s", X.value(F.col("acc"), F.col("odd"), _type(df, measure))))
    value = (F.coalesce(F.col("s"), F.lit(0.0)) if measure
             else F.coalesce(F.col("c"), F.lit(0)).cast("double"))
    bins = (spine.join(binned, "bin", "left")
            .select("bin", "granularity", _round2(value).alias("value"),
                    F.coalesce("c", F.lit(0)).alias("records"), "t0", "t1")
            .withColumn("idx", F.row_number().over(
                Window.partitionBy(F.lit(0)).orderBy("bin")) - 1))
    # TRD-3 in closed form: L = least(first ok, n-2), R = greatest(last ok, L+1)
    floor_ = F.median("records").over(_all()) * W.MIN_EDGE_SHARE
    bins = (bins.withColumn("n", F.count(F.lit(1)).over(_all()))
            .withColumn("ok", F.col("records") >= floor_))
    bins = (bins.withColumn("f", F.min(F.when(F.col("ok"), F.col("idx"))).over(_all()))
            .withColumn("g", F.max(F.when(F.col("ok"), F.col("idx"))).over(_all()))
            .withColumn("L", F.when(F.col("n") <= 2, 0)
                        .otherwise(F.least("f", F.col("n") - 2)))
            .withColumn("R", F.when(F.col("n") <= 2, F.col("n") - 1)
                        .otherwise(F.greatest("g", F.col("L") + 1)))
            .withColumn("kept", (F.col("idx") >= F.col("L")) & (F.col("idx") <= F.col("R"))))
    return bins.select("idx", "bin", F.date_format("bin", "yyyy-MM-dd").alias("label"),
                       "granularity", "value", "records", "t0", "t1", "kept", "n")


def trend(df: DataFrame, date_col: str, measure: str | None = None,
          pre: DataFrame | None = None) -> DataFrame:
    """Kept bins only, renumbered: ``(position, label, value, records, granularity)``.

    A single bin is no trend: no rows then.
    """
    kept = (trend_bins(df, date_col, measure, pre=pre).where("kept")
            .withColumn("bins", F.count(F.lit(1)).over(_all())).where("bins >= 2"))
    w = Window.partitionBy(F.lit(0)).orderBy("idx")
    return kept.select((F.row_number().over(w) - 1).alias("position"), "label", "value",
                       "records", "granularity")


def trend_summary(df: DataFrame, date_col: str, measure: str | None = None,
                  pre: DataFrame | None = None) -> DataFrame:
    """TRD-4: one row, or none when fewer than two bins survive trimming.

    ``first``, ``last``, ``change_pct`` (from the rounded values; null when
    first is 0), ``peak_label``/``peak_value`` (first bin holding the
    maximum), ``period_start``/``period_end`` (true min/max date of rows in
    kept bins), ``trimmed_periods``, ``granularity``, ``bins``.
    """
    b = trend_bins(df, date_col, measure, pre=pre)
    kept = b.where("kept")
    s = kept.agg(
        F.count(F.lit(1)).alias("bins"),
        F.min_by("value", "idx").alias("first"),
        F.max_by("value", "idx").alias("last"),
        F.min_by("label", F.struct(-F.col("value"), F.col("idx"))).alias("peak_label"),
        F.max("value").alias("peak_value"),
        F.min("t0").alias("p0"), F.max("t1").alias("p1"),
        F.max("n").alias("n"), F.max("granularity").alias("granularity"))
    change = F.when(F.col("first") != 0, F.round(
        (F.col("last") - F.col("first")) / F.col("first") * 100, 1))
    return s.where(F.col("bins") >= 2).select(
        F.lit(date_col).alias("column"), F.lit(measure).cast("string").alias("measure"),
        "granularity", "bins", "first", "last", change.alias("change_pct"),
        "peak_label", "peak_value",
        F.date_format("p0", "yyyy-MM-dd").alias("period_start"),
        F.date_format("p1", "yyyy-MM-dd").alias("period_end"),
        (F.col("n") - F.col("bins")).alias("trimmed_periods"))


# ---------------------------------------------------------------- breakdowns
def breakdown_kind(measure: str | None) -> str:
    if measure is None:
        return "count"
    return "avg" if is_rate(measure) else "sum"


def breakdowns(df: DataFrame, dims: list[str], measure: str | None = None,
               dedup: bool = True, pre: DataFrame | None = None) -> DataFrame:
    """BRK-1..5 for several dimensions in one scan.

    One row per shown group: ``dim_order, column, kind, rank, label, value,
    value_pct`` plus per-dimension ``categories, total, others, leader,
    leader_value, leader_share_pct, coverage_pct``.  Groups whose aggregate
    is null are dropped; order is value desc, label asc; 8 groups are shown
    (9 when exactly 9 exist); ``others`` is the rest of the total when
    positive.  With ``dedup`` a dimension giving the same labels and values
    as an earlier one is removed.
    """
    kind = breakdown_kind(measure)
    if pre is None:
        pre = partials(df, None, measure, dims)
    grouped = (pre.where(F.col("part") == 2)
               .select("dim_order", "column", "label", "s", "c", "acc", "odd",
                       F.try_divide(F.col("s"), F.col("nn").cast("double")).alias("a")))
    rows_all = pre.where(F.col("part") == 0).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("rows_all"))
    raw = {"sum": F.coalesce(F.col("s"), F.lit(0.0)), "avg": F.col("a"),
           "count": F.col("c").cast("double")}[kind]
    per_dim_cov = grouped.groupBy("dim_order").agg(F.sum("c").alias("rows_dim"))
    g = grouped.select("dim_order", "column", "label", raw.alias("raw")).where(
        F.col("raw").isNotNull())
    wd = Window.partitionBy("dim_order")
    # categories and total by aggregation; ranking by a two-stage top-k, so a
    # high-cardinality (override) dimension is never sorted in one task
    per_dim = g.groupBy("dim_order").agg(F.count(F.lit(1)).alias("categories"))
    if kind == "sum":      # of the rows, not of the rounded sums
        totals = X.merged(grouped, ["dim_order"])
    else:
        totals = X.summed(g.withColumn("t", X.term(F.col("raw"), T.DoubleType())),
                          ["dim_order"], "t")
    totals = totals.select("dim_order", F.coalesce(X.value(
        F.col("acc"), F.col("odd"), _type(df, measure) if kind == "sum" else T.DoubleType()),
        F.lit(0.0)).alias("total_raw"))
    per_dim = per_dim.join(totals, "dim_order")
    ranked = top_k_per_group(g, ["dim_order"], [F.desc("raw"), F.asc("label")],
                             W.TOP_N + 1, "label")
    shown_n = F.when(F.col("categories") == W.TOP_N + 1, W.TOP_N + 1).otherwise(W.TOP_N)
    top = (ranked.join(F.broadcast(per_dim), "dim_order").where(F.col("rank") <= shown_n)
           .withColumn("value", F.round("raw", 2)))
    top = (top.withColumn("shown_sum", F.sum(
        F.col("value").try_cast("decimal(38,2)")).over(wd).cast("double"))
           .withColumn("lead_raw", F.max(F.when(F.col("rank") == 1, F.col("raw"))).over(wd))
           .withColumn("leader", F.max(F.when(F.col("rank") == 1, F.col("label"))).over(wd)))
    others = F.round(F.col("total_raw") - F.col("shown_sum"), 2)
    out = (top.join(per_dim_cov, "dim_order").crossJoin(F.broadcast(rows_all))
           .select(
               "dim_order", "column", F.lit(kind).alias("kind"),
               F.lit(measure if kind != "count" else None).cast("string").alias("measure"),
               "rank", "label", "value",
               F.when(F.col("total_raw") != 0,
                      F.round(100 * F.col("value") / F.col("total_raw"), 1))
               .alias("value_pct"),
               "categories", F.round("total_raw", 2).alias("total"),
               F.when((F.col("categories") > W.TOP_N) & (others > 0), others).alias("others"),
               "leader", F.round("lead_raw", 2).alias("leader_value"),
               F.when((F.col("total_raw") != 0) & F.lit(kind != "avg"),
                      F.round(100 * F.col("lead_raw") / F.col("total_raw"), 1))
               .alias("leader_share_pct"),
               F.when(F.col("rows_all") > 0,
                      F.round(100 * F.col("rows_dim") / F.col("rows_all"), 1))
               .otherwise(100.0).alias("coverage_pct")))
    if dedup and len(dims) > 1:
        sig = (out.groupBy("dim_order")
               .agg(F.array_sort(F.collect_list(F.struct("rank", "label", "value")))
                    .alias("sig")))
        keep = sig.groupBy("sig").agg(F.min("dim_order").alias("dim_order"))
        out = out.join(F.broadcast(keep.select("dim_order")), "dim_order", "left_semi")
    return out


def breakdown(df: DataFrame, dim: str, measure: str | None = None) -> DataFrame:
    return breakdowns(df, [dim], measure, dedup=False)


def breakdown_summary(bd: DataFrame) -> DataFrame:
    """One row per dimension (BRK-3 leader, BRK-4 coverage, BRK-2 others)."""
    return (bd.where(F.col("rank") == 1)
            .select("dim_order", "column", "kind", "measure", "categories", "total",
                    "others", "leader", "leader_value", "leader_share_pct",
                    "coverage_pct"))
