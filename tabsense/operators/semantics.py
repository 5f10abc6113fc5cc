"""Semantic roles of columns: measures, dates, dimensions (SEM-1..6).

Rules run as DataFrame expressions over the one-row-per-column statistics
from ``stats.column_stats`` — name hints are substring tests on the
lower-cased name, statistics come from the single stats job.  The output is
one row per column with its role, score and rank; ``choose`` collects the
handful of rows needed to decide which columns to analyse.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W
from . import stats as S


def _has_any(low: Column, hints: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for h in hints:
        out = out | low.contains(h)
    return out


def _tokens(name: Column) -> Column:
    parts = F.split(F.lower(F.trim(name)), r"[\s_\-.]+")
    return F.filter(parts, lambda t: F.length(t) > 0)


def is_rate_name(name: Column) -> Column:
    """Rate/unit-price columns are averaged, never summed (SEM-3)."""
    return _has_any(F.lower(name), W.RATE_HINTS)


def is_rate(name: str) -> bool:
    low = str(name).lower()
    return any(h in low for h in W.RATE_HINTS)


def classify(stats: DataFrame) -> DataFrame:
    """Add role columns to ``column_stats`` output.

    Columns: ``is_identifier``, ``is_flag``, ``is_rate``, ``score``,
    ``role`` (measure / date / dimension / none), ``role_rank`` (1-based
    order inside the role).
    """
    low = F.lower(F.col("column"))
    toks = _tokens(F.col("column"))
    id_words = F.array(*[F.lit(t) for t in W.ID_TOKENS])
    by_name = (F.size(toks) > 0) & (
        F.array_contains(id_words, F.element_at(toks, 1)) |
        F.array_contains(id_words, F.element_at(toks, -1)))
    near_unique = (F.col("is_integer") & (F.col("rows") >= W.MIN_ROWS_FOR_RATIO) &
                   (F.col("distinct") / F.col("rows") >= W.NEAR_UNIQUE_RATIO))
    numeric = F.col("kind") == "numeric"
    is_id = numeric & (by_name | F.coalesce(near_unique, F.lit(False)))
    is_flag = numeric & (F.col("nonnull") > 0) & F.col("flag_values")
    m_score = (F.when(_has_any(low, W.MEASURE_HINTS), 2).otherwise(0) +
               F.when(_has_any(low, W.COUNT_HINTS), 1).otherwise(0) +
               F.when(_has_any(low, W.AGGREGATE_HINTS), 2).otherwise(0) -
               F.when(_has_any(low, W.RATE_HINTS), 3).otherwise(0))
    d_score = F.when(_has_any(low, W.DIM_HINTS), 1).otherwise(0)
    repetitive = ((F.col("nonnull") < W.MIN_ROWS_FOR_RATIO) |
                  (F.col("distinct") / F.col("nonnull") <= W.REPETITIVE_RATIO))
    dim_ok = ((F.col("kind") == "categorical") & ~_has_any(low, W.NON_DIM_HINTS) &
              (F.col("distinct") > 1) & (F.col("distinct") <= W.MAX_DIM_CATEGORIES) &
              F.coalesce(repetitive, F.lit(False)))
    role = (F.when(F.col("kind") == "datetime", "date")
            .when(numeric & ~is_id & ~is_flag, "measure")
            .when(dim_ok, "dimension")
            .otherwise("none"))
    score = (F.when(role == "measure", m_score)
             .when(role == "dimension", d_score).otherwise(0))
    out = stats.select(
        "*", is_id.alias("is_identifier"), is_flag.alias("is_flag"),
        is_rate_name(F.col("column")).alias("is_rate"),
        role.alias("role"), score.alias("score"))
    # measures: score desc, column order; dimensions: hint desc, distinct asc, order
    order = (F.when(F.col("role") == "dimension", F.col("distinct")).otherwise(0))
    w = Window.partitionBy("role").orderBy(F.desc("score"), order, "ordinal")
    return out.withColumn("role_rank", F.row_number().over(w))


@dataclass
class Choice:
    """Columns chosen for analysis (SEM-6): user overrides win."""
    measure: str | None = None
    date: str | None = None
    dimensions: list[str] = field(default_factory=list)
    measures: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    all_dimensions: list[str] = field(default_factory=list)


def choose(roles: DataFrame, overrides: dict | None = None) -> Choice:
    """Collect the ranked role rows (one per column) and apply overrides."""
    rows = (roles.where(F.col("role") != "none")
            .select("role", "role_rank", "column").collect())
    ranked: dict[str, list[str]] = {"measure": [], "date": [], "dimension": []}
    for r in sorted(rows, key=lambda r: (r["role"], r["role_rank"])):
        ranked[r["role"]].append(r["column"])
    o = overrides or {}
    return Choice(
        measure=o.get("measure") or (ranked["measure"][0] if ranked["measure"] else None),
        date=o.get("date") or (ranked["date"][0] if ranked["date"] else None),
        dimensions=list(o.get("dimensions") or ranked["dimension"][:3]),
        measures=ranked["measure"], dates=ranked["date"],
        all_dimensions=ranked["dimension"])


STATS_SCHEMA = ("rows long, ordinal int, column string, kind string, spark_type string, "
                "is_integer boolean, nonnull long, min_num double, max_num double, "
                "mean double, std double, min_text string, max_text string, "
                "flag_values boolean, distinct long")


def semantics(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Column roles of ``df`` (SEM-1..5).

    Distinct counts matter only for the near-unique identifier test (integer
    columns) and the dimension test (text and boolean columns); both are
    counted on keys no wider than a 128-bit hash.  One row per column
    reaches the driver.
    """
    kinds = S.columns_by_kind(df)
    ints = [n for _, n, k, is_int in kinds if k == "numeric" and is_int]
    cats = [n for _, n, k, _ in kinds if k == "categorical"]
    if approx_distinct:
        return classify(S.column_stats(df, approx_distinct=True))
    rows = [r.asDict() for r in S.column_stats(df, distinct_for=[*ints, *cats])
            .select(*[f.split()[0] for f in STATS_SCHEMA.split(", ")]).collect()]
    spark = df.sparkSession
    stats = S.local_frame(
        spark, [tuple(r[f.split()[0]] for f in STATS_SCHEMA.split(", ")) for r in rows],
        STATS_SCHEMA)
    # classify once on the <= one-row-per-column table and keep the result
    # on the driver: ``choose`` and the role queries then read a local
    # relation instead of re-running the rules in a job each time
    roles = classify(stats)
    return S.local_frame(spark, [tuple(r) for r in roles.collect()], roles.schema)
