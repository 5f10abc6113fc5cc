"""Full analysis of one table (BIZ-1) and the long metrics table (SNK-2).

``analyze`` first turns text columns that hold only dates into timestamps (one
aggregate over the text columns), runs one statistics job (one row per column reaches the
driver), chooses measure / date / dimensions, then makes one more pass over
the base rows: ``business.partials`` (grand total, per day, per dimension
label) in a single scan and shuffle.  That small table is checkpointed into
the session's shared checkpoint folder (lineage cut, safe against executor
loss) and KPIs, trend, trend summary and breakdowns — and every fact and
narrative sentence built on them — read it instead of rescanning the base
table once per block.  Nothing else is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import business as B
from ..operators import semantics as S
from ..operators.clean import promote_text_dates
from ..session import ensure_checkpoint_dir


@dataclass
class Analysis:
    roles: DataFrame
    choice: S.Choice
    kpis: DataFrame
    trend: DataFrame | None
    trend_summary: DataFrame | None
    breakdowns: DataFrame | None


def analyze(df: DataFrame, overrides: dict | None = None,
            approx_distinct: bool = False) -> Analysis:
    df = promote_text_dates(df)
    roles = S.semantics(df, approx_distinct=approx_distinct)
    choice = S.choose(roles, overrides)
    ensure_checkpoint_dir(df.sparkSession)
    pre = B.partials(df, choice.date, choice.measure, choice.dimensions).checkpoint()
    trend = summary = bds = None
    if choice.date:
        trend = B.trend(df, choice.date, choice.measure, pre=pre)
        summary = B.trend_summary(df, choice.date, choice.measure, pre=pre)
    if choice.dimensions:
        bds = B.breakdowns(df, choice.dimensions, choice.measure, pre=pre)
    return Analysis(roles, choice, B.kpis(df, choice.measure, pre=pre, exact=True), trend, summary, bds)


def metrics_long(a: Analysis) -> DataFrame:
    """SNK-2: ``(seq, metric, column, value, label)`` from KPIs, trend, breakdowns.

    Breakdown labels carry the share: ``"X (p%)"`` (plain ``X`` without one).
    """
    parts = [a.kpis.select(
        F.lit(0).alias("block"), F.col("seq").alias("seq"), F.col("key").alias("metric"),
        F.coalesce("column", F.lit("")).alias("column"), "value",
        F.lit("").alias("label"))]
    if a.trend is not None:
        parts.append(a.trend.select(
            F.lit(1).alias("block"), F.col("position").alias("seq"),
            F.lit("trend").alias("metric"),
            F.lit(a.choice.measure or "").alias("column"), "value", "label"))
    if a.breakdowns is not None:
        pct = F.regexp_replace(F.col("value_pct").cast("string"), r"\.0$", ".0")
        parts.append(a.breakdowns.select(
            (F.lit(2) + F.col("dim_order")).alias("block"), F.col("rank").alias("seq"),
            F.col("column").alias("metric"),
            F.coalesce("measure", F.lit("")).alias("column"), "value",
            F.when(F.col("value_pct").isNull(), F.col("label"))
            .otherwise(F.format_string("%s (%s%%)", F.col("label"), pct)).alias("label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
