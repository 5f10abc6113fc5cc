"""Ingest cleaning (CLN-1..5).

Column decisions (which columns are empty, which text columns are dates)
come from one aggregate each — one row per table reaches the driver; the
row-level work stays in the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W
from .stats import kind_of, q

_WS = re.compile(r"\s+")
# FIXED VALUE: a detached Arabic article "ال " followed by an Arabic letter is re-attached.
_DANGLING_AL = re.compile(r"(?<![\w؀-ۿ])ال\s+(?=[؀-ۿ])")

# FIXED VALUES: text-date formats tried in order (Spark datetime patterns).
# Ambiguous slashed dates are read month first; a month above 12 makes it day first.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm",
                "yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy", "d/M/yyyy")
# A longer text is no date; it is not even tried.
LONGEST_DATE = 32


def clean_header(name: str) -> str:
    """CLN-2: collapse whitespace runs, trim, re-attach a detached "ال"."""
    return _DANGLING_AL.sub("ال", _WS.sub(" ", str(name)).strip())


def drop_empty(df: DataFrame) -> DataFrame:
    """CLN-3: drop all-null columns, then all-null rows."""
    if not df.columns:
        return df
    counts = df.agg(*[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    keep = [c for i, c in enumerate(df.columns) if counts[f"c{i}"] > 0]
    out = df.select(*[q(c) for c in keep])
    return out.na.drop(how="all") if keep else out


def clean_frame(df: DataFrame) -> DataFrame:
    """CLN-2..4: drop empty columns/rows, normalise headers, drop ``unnamed*``
    columns unless none would remain."""
    out = drop_empty(df)
    renamed, seen = [], set()
    for c in out.columns:
        name, n = clean_header(c), 1
        # headers that clean to one name stay apart: name, name_2, name_3
        while (name if n == 1 else f"{name}_{n}").lower() in seen:
            n += 1
        renamed.append(name if n == 1 else f"{name}_{n}")
        seen.add(renamed[-1].lower())
    out = out.toDF(*renamed)
    keep = [c for c in renamed if not c.lower().startswith("unnamed")]
    return out.select(*[q(c) for c in keep]) if keep else out


def parse_date(c: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First format that parses, as ``timestamp_ntz``; null if none does."""
    text = F.nullif(F.trim(c.cast("string")), F.lit(""))
    text = F.when(F.length(text) <= LONGEST_DATE, text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast(
        "timestamp_ntz")


def date_candidates(df: DataFrame, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """CLN-5 test per string column: ``column, nonempty, parsed, promoted``.

    A column is promoted when it has at least one non-empty value and every
    non-empty value parses with one of the fixed formats.
    """
    strings = [f.name for f in df.schema.fields if kind_of(f.dataType) == "categorical"
               and f.dataType.simpleString() == "string"]
    spark = df.sparkSession
    if not strings:
        return spark.createDataFrame(
            [], "column string, nonempty long, parsed long, promoted boolean")
    aggs = []
    for i, c in enumerate(strings):
        text = F.nullif(F.trim(q(c)), F.lit(""))
        aggs += [F.count(text).alias(f"n{i}"), F.count(parse_date(q(c), formats)).alias(f"p{i}")]
    one = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nonempty"),
                        F.col(f"p{i}").alias("parsed")) for i, c in enumerate(strings)]
    return (one.select(F.inline(F.array(*structs)))
            .withColumn("promoted", (F.col("nonempty") > 0) &
                        (F.col("parsed") == F.col("nonempty"))))


def promote_text_dates(df: DataFrame, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """CLN-5: turn text columns whose every value is a date into timestamps."""
    promoted = [r["column"] for r in date_candidates(df, formats).where("promoted")
                .select("column").collect()]
    out = df
    for c in promoted:
        out = out.withColumn(c, parse_date(q(c), formats))
    return out


def pick_header(cells: DataFrame, scan: int = W.HEADER_SCAN_ROWS) -> DataFrame:
    """CLN-1: choose the header row per ``(file, sheet)``.

    ``cells``: ``file, sheet, row_no, cells array<string>, is_text
    array<boolean>`` (null cell = empty).  Over the first ``scan`` rows,
    score = filled + 0.5*non-blank text cells + 0.5*distinct filled values;
    empty rows skipped; highest wins, first on ties.  Returns
    ``file, sheet, header_row``.
    """
    filled = F.filter("cells", lambda x: x.isNotNull())
    texts = F.filter(F.arrays_zip("cells", "is_text"),
                     lambda z: z["is_text"] & (strip(z["cells"]) != ""))
    score = (F.size(filled) + 0.5 * F.size(texts) + 0.5 * F.size(F.array_distinct(filled)))
    first = (cells.where(F.col("row_no") < scan).withColumn("score", score)
             .where(F.size(filled) > 0))
    w = Window.partitionBy("file", "sheet").orderBy(F.desc("score"), "row_no")
    return (first.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1)
            .select("file", "sheet", F.col("row_no").alias("header_row")))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, "^\\s+|\\s+$", "")
