"""Labels for names that stand in rows, with a table of user labels (LBL-1..3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L


def labelled(names: DataFrame, name_col: str, overrides: DataFrame | None = None,
             languages: tuple[str, ...] = ("en", "ar"),
             others: list[Column] | None = None) -> DataFrame:
    """One row per distinct name: the name, ``label_<language>`` each, ``overridden``, ``others``.

    ``overrides`` has (name, label), a row a name; a blank label counts as none.
    Names are folded first (``others`` are aggregates over their rows), so the
    words of a name are looked up once however many rows bear it, and a name
    in most rows is one row before the shuffle.  Null names have no label.
    """
    once = names.groupBy(F.col(name_col).alias("name")).agg(
        *(others or [F.count(F.lit(1)).alias("rows")]))
    if overrides is None:
        once = once.withColumn("_label", F.lit(None).cast("string"))
    else:
        given = overrides.groupBy("name").agg(F.max("label").alias("_label"))
        once = once.join(given, "name", "left")
    own = F.nullif(L.strip_ws(F.col("_label")), F.lit(""))
    return once.select(
        "*", *[L.label(F.col("name"), F.col("_label"), lang).alias(f"label_{lang}")
               for lang in languages], own.isNotNull().alias("overridden")).drop("_label")
