"""Ranking and comparison tables over breakdown rows (PRS-1..3).

Inputs are the output of ``business.breakdowns`` (at most 9 shown rows per
dimension), so these are small projections, windows over a few rows each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import words as W


def rank_table(bd: DataFrame, language: str = "en") -> DataFrame:
    """PRS-1: ``dim_order, column, rank, label, value, pct`` plus one unranked
    "Others (n categories)" row per dimension that has others."""
    ranked = bd.select("dim_order", "column", F.col("rank").cast("int").alias("rank"),
                       "label", "value", F.col("value_pct").alias("pct"))
    head = bd.where(F.col("rank") == 1)
    shown = bd.groupBy("dim_order").agg(F.count(F.lit(1)).alias("shown"))
    rest = F.col("categories") - F.col("shown")
    word = "أخرى" if language == "ar" else "Others"
    others = (head.join(shown, "dim_order").where(F.col("others").isNotNull())
              .select("dim_order", "column", F.lit(None).cast("int").alias("rank"),
                      F.format_string(f"{word} (%d %s)", rest,
                                      L.categories_word(rest, language)).alias("label"),
                      F.col("others").alias("value"),
                      F.when(F.col("total") != 0,
                             F.round(100 * F.col("others") / F.col("total"), 1)).alias("pct")))
    return ranked.unionByName(others)


def leader_gap(bd: DataFrame) -> DataFrame:
    """PRS-2: leader vs runner-up for dimensions with at least two shown groups."""
    w = Window.partitionBy("dim_order")
    two = bd.withColumn("shown", F.count(F.lit(1)).over(w)).where(F.col("shown") >= 2)
    return (two.groupBy("dim_order", "column")
            .agg(F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("leader"),
                 F.max(F.when(F.col("rank") == 2, F.col("label"))).alias("runner_up"),
                 F.round(F.max(F.when(F.col("rank") == 1, F.col("value"))) -
                         F.max(F.when(F.col("rank") == 2, F.col("value"))), 2).alias("gap"),
                 F.max("leader_share_pct").alias("share")))


def concentration(bd: DataFrame, language: str = "en") -> DataFrame:
    """PRS-3: the strongest leader share >= 50 % (first dimension wins ties),
    flagged partial when coverage < 95 %."""
    heads = bd.where((F.col("rank") == 1) &
                     (F.col("leader_share_pct") >= W.CONCENTRATION_PCT))
    first = heads.orderBy(F.desc("leader_share_pct"), "dim_order").limit(1)
    what = L.humanize(F.coalesce(F.col("measure"), F.col("column")), language)
    tmpl = ("«%s» يستحوذ على %s%% من %s" if language == "ar" else "'%s' holds %s%% of %s")
    return first.select(
        "column", "leader", F.col("leader_share_pct").alias("pct"),
        F.format_string(tmpl, F.col("leader"), L.fmt_number(F.col("leader_share_pct")),
                        what).alias("text"),
        (F.col("coverage_pct") < W.COVERAGE_FULL_PCT).alias("partial"))
