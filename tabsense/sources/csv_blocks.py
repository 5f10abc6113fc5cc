"""CSV with quoted line breaks, read in as many tasks as the file has blocks (SRC-1).

A line break ends a record only outside quotes, and whether a line begins
inside quotes depends on everything before it.  The built-in ``multiLine``
reader therefore reads a file in one task.  Here every physical line is a
function of that one bit: what the state is after it if it began outside, and
if it began inside quotes (well-formed quotes flip the state or leave it; a
stray quote inside an unquoted field does neither).

1. The functions of the lines of a block are composed in order, then those of
   the blocks of a file (one row a block): the state at each block's start.
2. Blocks that begin outside quotes and leave every line so hold a record a
   line and go straight to the parser.
3. In the others lines are numbered by the records that begin; lines of one
   record, also across blocks, are put together by that number.

Spark's own CSV parser then reads the records.  Blocks are what the text source
cuts files into; compressed files are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import TabsenseError
from ..session import cut

# possessive groups, so that long lines need no backtracking
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"[^,]*+'
_FIELD = rf'(?:{_QUOTED}|[^",][^,]*+)?+'
_OPENS = r'"[^"]*+(?:""[^"]*+)*+$'
_STARTS_OUT = rf'^(?:{_FIELD},)*+{_OPENS}'
_STAYS_IN = r'^[^"]*+(?:""[^"]*+)*+$'
_OPENS_AGAIN = rf'^[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,{_FIELD}(?=,|$))*+,{_OPENS}'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines with the file, the block and their order in it, and their function."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    v = F.col("value")
    quoted = F.contains(v, F.lit('"'))
    out = quoted & v.rlike(_STARTS_OUT)          # inside quotes after it, begun outside
    into = ~quoted | v.rlike(_STAYS_IN) | v.rlike(_OPENS_AGAIN)
    return lines.withColumn("fixed", F.when(out == into, out.cast("int"))).withColumn(
        "flip", (out & ~into).cast("int"))


def _composed(order: Window, upto: int) -> tuple[Column, Column]:
    """(fixed, flip) of all functions of the window up to the row ``upto`` away.

    ``fixed`` is the state where one of them sets it, else null: then the state
    is what it was before, flipped if ``flip`` is 1.
    """
    rows = order.rowsBetween(Window.unboundedPreceding, upto)
    through = order.rowsBetween(Window.unboundedPreceding, 0)
    flips = F.coalesce(F.sum("flip").over(rows), F.lit(0)) % 2
    # a state that was set, as if flipped back to the beginning
    base = F.when(F.col("fixed").isNotNull(),
                  (F.col("fixed") + F.sum("flip").over(through)) % 2)
    return flips, base


def _states(df: DataFrame, by: list[str], at: str, upto: int) -> DataFrame:
    """``df`` with the composed function before (-1) or through (0) each row."""
    order = Window.partitionBy(*by).orderBy(at)
    flips, base = _composed(order, upto)
    known = df.withColumn("_base", base).withColumn("_flips", flips)
    last = F.last("_base", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, upto))
    return (known.withColumn("_last", last)
            .withColumn("all_flip", F.col("_flips"))
            .withColumn("all_fixed", (F.col("_last") + F.col("_flips")) % 2)
            .drop("_base", "_flips", "_last"))


def _apply(fixed: Column, flip: Column, state: Column) -> Column:
    return F.coalesce(fixed, (state + flip) % 2)


def _blocks(lines: DataFrame) -> DataFrame:
    """(file, block, state, plain, begun): the state at its start, whether its lines are records
    as they are, and how many records begin in the blocks before."""
    light = lines.select("file", "block", "at", "fixed", "flip",
                         (F.rtrim(F.col("value"), F.lit("\r")) == "").alias("blank"))
    own = ["file", "block"]
    whole = _states(light, own, "at", 0).groupBy(*own).agg(
        F.max_by("all_fixed", "at").alias("fixed"), F.max_by("all_flip", "at").alias("flip"),
        # a line that ends inside quotes if it begins outside
        F.max(F.coalesce("fixed", "flip")).alias("busy"))
    # one row a block from here on
    started = _states(whole, ["file"], "block", -1).withColumn(
        "state", _apply(F.col("all_fixed"), F.col("all_flip"), F.lit(0)))
    started = cut(started.select(*own, "state", ((F.col("state") == 0) & (F.col("busy") == 0)
                                                 & (F.col("block") > 0)).alias("plain")))
    counts = (_numbered(light.join(started, own)).groupBy(*own)
              .agg(F.max("record").alias("records")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    return cut(started.join(counts, own).withColumn(
        "begun", F.coalesce(F.sum("records").over(before), F.lit(0))).drop("records"))


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with ``record`` (records begun in the block so far), ``open`` (inside quotes after
    it) and ``starts``."""
    own = ["file", "block"]
    known = _states(lines, own, "at", -1).withColumn(
        "inside", _apply(F.col("all_fixed"), F.col("all_flip"), F.col("state"))).drop(
        "all_fixed", "all_flip")
    known = known.withColumn("open", _apply(F.col("fixed"), F.col("flip"), F.col("inside"))
                             ).withColumn("starts", (F.col("inside") == 0) & ~F.col("blank"))
    return known.withColumn("record", F.sum(F.col("starts").cast("int")).over(
        Window.partitionBy(*own).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))


def csv_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, records): the first record of every file, and all the others, as texts."""
    lines = _lines(spark, path)
    blocks = _blocks(lines)
    own = ["file", "block"]
    placed = lines.join(blocks, own)
    text = F.rtrim(F.col("value"), F.lit("\r"))
    plain = placed.where("plain").select(text.alias("value")).where("value <> ''")
    busy = _numbered(placed.where("not plain").withColumn("blank", text == "")).withColumn(
        "record", F.col("record") + F.col("begun")).where("starts or inside = 1")
    single = busy.where("starts and open = 0").select("file", "record", text.alias("value"))
    several = (busy.where("not (starts and open = 0)").groupBy("file", "record")
               .agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("l"))
               .select("file", "record", F.rtrim(F.array_join(F.transform(
                   "l", lambda x: x["value"]), "\n"), F.lit("\r")).alias("value")))
    known = single.union(several)
    return (known.where("record = 1").select("file", "value"),
            plain.union(known.where("record <> 1").select("value")))


def _parsed(spark: SparkSession, records: DataFrame, reader) -> DataFrame:
    """Texts of one record each through the built-in parser."""
    strings = getattr(records._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return reader._df(reader._jreader.csv(strings))


def read_csv_blocks(spark: SparkSession, path: str, schema: StructType | str | None = None
                    ) -> DataFrame:
    """SRC-1: the table of a CSV file or folder with header rows, types inferred without a schema."""
    headers, records = csv_records(spark, path)
    first = headers.orderBy("file").first()
    if first is None:
        raise TabsenseError("emptyFile", path=path)

    def reader():
        return (spark.read.option("quote", '"').option("escape", '"').option("header", False)
                # a record keeps its line breaks: none of them ends it
                .option("lineSep", "\u0000"))
    text = first["value"].lstrip("﻿")
    one = _parsed(spark, spark.createDataFrame([(text,)], "value string"), reader()).first()
    names = [n if n is not None else f"_c{i}" for i, n in enumerate(one)]
    if schema is not None:
        return _parsed(spark, records, reader().schema(schema))
    df = _parsed(spark, records, reader().option("inferSchema", True))
    if len(df.columns) != len(names):       # without records there is nothing to infer from
        return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))
    return df.toDF(*names)
