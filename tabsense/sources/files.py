"""Table sources (SRC-1, SRC-2, SRC-4, SRC-5).

Production reads should pass an explicit schema (``inferSchema`` scans the
data twice); the option exists for ad-hoc uploads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import NotFound, TabsenseError
from ..operators.clean import clean_frame
from ..operators.stats import q
from .csv_blocks import read_csv_blocks


# FIXED VALUES: words that stand for a missing value in uploaded files.
MISSING_WORDS = ("NA", "N/A", "n/a", "nan", "NaN", "NULL", "null", "None", "<NA>", "#N/A")


def _csv_words(options):
    return options.option("quote", '"').option("escape", '"')


def without_missing_words(df: DataFrame) -> DataFrame:
    """Text columns with the usual words for a missing value turned into nulls."""
    return df.select(*[
        F.when(~F.trim(q(c)).isin(*MISSING_WORDS), q(c)).alias(c) if t == "string" else q(c)
        for c, t in df.dtypes])


def read_file(spark: SparkSession, path: str, schema: StructType | str | None = None
              ) -> DataFrame:
    """SRC-1..3 by extension: csv, json; ``unsupportedFormat`` and ``emptyFile`` otherwise.

    A workbook has several tables: see ``workbook.read_sheets``.
    """
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind not in ("csv", "json"):
        raise TabsenseError("unsupportedFormat", path=path)
    df = (read_csv if kind == "csv" else read_json_records)(spark, path, schema, clean=False)
    if not df.columns or df.isEmpty():
        raise TabsenseError("emptyFile", path=path)
    return clean_frame(without_missing_words(df))


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             clean: bool = True, multi_line: bool = True) -> DataFrame:
    """SRC-1: CSV with a header row; inferred types unless a schema is given.

    Doubled quotes inside quotes and quoted line breaks are read as the value
    they stand for, in as many tasks as a file has blocks (see ``csv_blocks``);
    with ``multi_line`` off a quoted line break ends the row.
    """
    if multi_line:
        df = read_csv_blocks(spark, path, schema)
    else:
        reader = _csv_words(spark.read.option("header", True))
        df = (reader.schema(schema) if schema is not None
              else reader.option("inferSchema", True)).csv(path)
    return clean_frame(df) if clean else df


def read_json_records(spark: SparkSession, path: str,
                      schema: StructType | str | None = None, clean: bool = True) -> DataFrame:
    """SRC-2: a JSON array of records (multi-line documents)."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    return clean_frame(df) if clean else df


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower_bound: int | None = None,
              upper_bound: int | None = None, num_partitions: int | None = None,
              fetch_size: int = 10000) -> DataFrame:
    """SRC-4: a relational table; with a numeric ``partition_column`` the read
    is split into ``num_partitions`` parallel range queries."""
    reader = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
              .option("fetchsize", fetch_size))
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column:
        if None in (lower_bound, upper_bound, num_partitions):
            raise TabsenseError("badPartitioning", column=partition_column)
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", lower_bound).option("upperBound", upper_bound)
                  .option("numPartitions", num_partitions))
    return reader.load()


def select_sources(tables: dict[str, DataFrame], wanted: list[str] | None = None,
                   most: int | None = None) -> dict[str, DataFrame]:
    """SRC-5: empty selection = all tables; unknown name = ``tableMissing``;
    more tables than ``most`` (when given) = ``tooManyTables``."""
    names = list(wanted or tables)
    if not names:
        raise TabsenseError("noTablesToAnalyze")
    for n in names:
        if n not in tables:
            raise NotFound("tableMissing", table=n)
    if most is not None and len(names) > most:
        raise TabsenseError("tooManyTables", tables=len(names), most=most)
    return {n: tables[n] for n in names}
