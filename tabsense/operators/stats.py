"""One-pass column statistics, value counts and approximate quantiles.

Everything here returns *long* DataFrames keyed by column ordinal, so wide
tables never produce wide rows and later steps can join/rank per column.

Scale notes
-----------
* ``column_stats`` is a single aggregate over the table (partial aggregation
  map-side, one tiny row out); wide tables stay one scan.
* ``value_counts`` unpivots ``(column, value)`` and groups it by a 128-bit
  hash: one shuffle of partially aggregated rows of bounded width.  A hot
  value (a third of all rows) is folded by the map-side partial aggregate
  before the shuffle; whole texts are fetched for the top values only.
* exact quantiles are in ``quantile``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def q(name: str) -> Column:
    """Column reference that survives dots, spaces and backticks in names."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(dtype: T.DataType) -> str:
    """numeric / datetime / categorical / other (arrays, maps, structs, binary)."""
    if isinstance(dtype, T.BooleanType):
        return "categorical"
    if isinstance(dtype, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "categorical"
    return "other"


def as_number(c: Column) -> Column:
    """Double with NaN folded to null (NaN counts as missing)."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def try_number(c: Column) -> Column:
    """Coerce anything to double, null on failure (works with ANSI on)."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def local_frame(spark, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A small driver-side table as a ``LocalRelation`` (an inline ``VALUES``).

    Used for results that are already on the driver and bounded by
    construction (one row per column, per wanted quantile, per bucket
    range).  Unlike ``createDataFrame`` of a Python list (a pickled RDD that
    every later action re-reads in a job), filters and projections over a
    ``LocalRelation`` are folded by the optimizer and collecting it runs no
    job.  Values travel as bound parameters, never as SQL text.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    fields = [("`" + f.name.replace("`", "``") + "`", f.dataType.simpleString())
              for f in schema.fields]
    if not rows:
        return spark.createDataFrame([], schema)
    args, tuples = {}, []
    for i, row in enumerate(rows):
        marks = []
        for j, v in enumerate(row):
            args[f"p{i}_{j}"] = v
            marks.append(f":p{i}_{j}")
        tuples.append("(" + ", ".join(marks) + ")")
    cols = ", ".join(f"c{j}" for j in range(len(fields)))
    casts = ", ".join(f"CAST(c{j} AS {t}) AS {n}" for j, (n, t) in enumerate(fields))
    return spark.sql(f"SELECT {casts} FROM VALUES {', '.join(tuples)} AS t({cols})",
                     args=args)


def columns_by_kind(df: DataFrame) -> list[tuple[int, str, str, bool]]:
    """``(ordinal, name, kind, is_integer)`` for every column, in order."""
    return [(i, f.name, kind_of(f.dataType), isinstance(f.dataType, INTEGRAL_TYPES))
            for i, f in enumerate(df.schema.fields)]


_STAT_SCHEMA = ("ordinal int, column string, kind string, spark_type string, "
                "is_integer boolean, nonnull long, min_num double, max_num double, "
                "mean double, std double, min_text string, max_text string, "
                "flag_values boolean, approx_distinct long")


STATS_CHUNK = 64


def column_stats(df: DataFrame, approx_distinct: bool = False,
                 distinct_for: list[str] | None = None) -> DataFrame:
    """One row per column: counts, min/max, mean, sample std, 0/1 test.

    Adds ``rows`` (all rows) and ``distinct`` (exact, from
    ``distinct_counts`` unless ``approx_distinct``).  ``distinct_for`` limits the exact distinct
    count to the named columns (others get null).  Columns of kind
    ``other`` only get counts.
    """
    per_col: list[tuple[list[Column], Column]] = []   # (aggregates, output struct)
    for i, name, kind, is_int in columns_by_kind(df):
        c = q(name)
        v = as_number(c) if kind == "numeric" else c
        nn = F.count(v)
        aggs = [nn.alias(f"nn{i}")]
        null_d = F.lit(None).cast("double")
        null_s = F.lit(None).cast("string")
        if kind == "numeric":
            aggs += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"),
                     F.avg(v).alias(f"av{i}"), F.stddev_samp(v).alias(f"sd{i}"),
                     # flag test: every non-null value is 0 or 1
                     F.coalesce(F.bool_and(v.isin(0.0, 1.0)), F.lit(False)).alias(f"fl{i}")]
            mn, mx, av, sd, fl = (F.col(f"mn{i}"), F.col(f"mx{i}"), F.col(f"av{i}"),
                                  F.col(f"sd{i}"), F.col(f"fl{i}"))
            mnt, mxt = null_s, null_s
        elif kind == "datetime":
            aggs += [F.min(c).alias(f"mn{i}"), F.max(c).alias(f"mx{i}")]
            mn, mx, av, sd, fl = null_d, null_d, null_d, null_d, F.lit(False)
            mnt = F.date_format(F.col(f"mn{i}"), "yyyy-MM-dd")
            mxt = F.date_format(F.col(f"mx{i}"), "yyyy-MM-dd")
        else:
            mn, mx, av, sd, fl = null_d, null_d, null_d, null_d, F.lit(False)
            mnt, mxt = null_s, null_s
        ad = F.lit(None).cast("long")
        per_col.append((aggs, F.struct(
            F.lit(i).alias("ordinal"), F.lit(name).alias("column"),
            F.lit(kind).alias("kind"),
            F.lit(df.schema.fields[i].dataType.simpleString()).alias("spark_type"),
            F.lit(is_int).alias("is_integer"), F.col(f"nn{i}").alias("nonnull"),
            mn.alias("min_num"), mx.alias("max_num"), av.alias("mean"), sd.alias("std"),
            mnt.alias("min_text"), mxt.alias("max_text"), fl.alias("flag_values"),
            ad.alias("approx_distinct"))))
    # one aggregate per group of STATS_CHUNK columns: a single aggregate over
    # hundreds of columns outgrows the JIT method limit and loses codegen;
    # each group's scan reads only its own columns
    stats = None
    for j in range(0, max(len(per_col), 1), STATS_CHUNK):
        chunk = per_col[j:j + STATS_CHUNK]
        one = df.agg(F.count(F.lit(1)).alias("__rows"), *[a for aggs, _ in chunk for a in aggs])
        part = (one.select(F.col("__rows").alias("rows"),
                           F.inline(F.array(*[st for _, st in chunk])))
                if chunk else one.select(F.col("__rows").alias("rows")).where(F.lit(False)))
        stats = part if stats is None else stats.unionByName(part)
    stats = stats.drop("approx_distinct") if per_col else stats
    if approx_distinct:
        # HLL is an imperative aggregate: kept out of the codegen'd one above
        kinds = columns_by_kind(df)
        hll = df.agg(*[F.approx_count_distinct(
            as_number(q(name)) if kind == "numeric" else q(name)).alias(f"ad{i}")
            for i, name, kind, _ in kinds if kind != "other"] or [F.lit(0).alias("none")])
        dist = hll.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("ordinal"), F.col(f"ad{i}").alias("distinct"))
            for i, name, kind, _ in kinds if kind != "other"] or [
            F.struct(F.lit(-1).alias("ordinal"), F.lit(0).cast("long").alias("distinct"))])))
        return (stats.join(F.broadcast(dist), "ordinal", "left")
                .withColumn("distinct", F.col("distinct").cast("long")))
    distinct = distinct_counts(df, distinct_for)
    out = stats.join(distinct, "ordinal", "left")
    if distinct_for is None:
        return out.withColumn("distinct", F.coalesce("distinct", F.lit(0)).cast("long"))
    wanted = F.col("column").isin(*distinct_for) if distinct_for else F.lit(False)
    return out.withColumn("distinct", F.when(wanted, F.coalesce("distinct", F.lit(0)))
                          .cast("long"))


def key128(v: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a value as a grouping or join key."""
    return [F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("value"), v).alias("h2")]


def _stack_text(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """``(ordinal, column, value)``: every non-null value as text."""
    want = set(columns) if columns is not None else None
    structs = []
    for i, name, kind, _ in columns_by_kind(df):
        if kind == "other" or (want is not None and name not in want):
            continue
        v = as_number(q(name)) if kind == "numeric" else q(name)
        structs.append(F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("column"),
                                v.cast("string").alias("value")))
    if not structs:
        return df.sparkSession.createDataFrame([], "ordinal int, column string, value string")
    return df.select(F.inline(F.array(*structs))).where(F.col("value").isNotNull())


HEAD = 64


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(ordinal, column, h1, h2, head, n)``: count of every non-null value per column.

    Values are compared as text (numbers after NaN->null) by a 128-bit key;
    ``head`` is the value's first 64 characters.  One scan, one shuffle of
    partially aggregated rows of bounded width, however long the texts are.
    """
    return (_stack_text(df, columns)
            .select("ordinal", "column", *key128(F.col("value")),
                    F.substring("value", 1, HEAD).alias("head"))
            .groupBy("ordinal", "column", "h1", "h2")
            .agg(F.min("head").alias("head"), F.count(F.lit(1)).alias("n")))


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(ordinal, distinct)``: distinct non-null values of ``columns`` (by
    default of all columns of a known kind).

    Values are unpivoted on typed keys — integers as ``long``, other numbers
    as ``double`` (NaN is missing), text and dates as a 128-bit hash — so
    nothing is rendered to text and no shuffle row is wider than a hash.
    Each unpivot is one pruned scan and one partially aggregated shuffle: a
    value holding a third of all rows folds map-side.
    """
    want = set(columns) if columns is not None else None
    fixed, text = [], []
    null_l, null_d = F.lit(None).cast("long"), F.lit(None).cast("double")
    for i, name, kind, is_int in columns_by_kind(df):
        c = q(name)
        if kind == "other" or (want is not None and name not in want):
            continue
        if kind == "numeric" and is_int:
            fixed.append((i, c.cast("long"), null_d))
        elif kind == "numeric":
            fixed.append((i, null_l, as_number(c)))
        else:
            text.append((i, c.cast("string")))
    parts = []
    if fixed:
        cols = ["lk"] if all(d is null_d for _, _, d in fixed) else ["lk", "dk"]
        structs = [F.struct(F.lit(i).alias("ordinal"), lk.alias("lk"), dk.alias("dk"))
                   for i, lk, dk in fixed]
        parts.append(df.select(F.inline(F.array(*structs)))
                     .where(F.col("lk").isNotNull() | F.col("dk").isNotNull())
                     .select("ordinal", *cols).distinct())
    if text:
        structs = [F.struct(F.lit(i).alias("ordinal"), v.isNotNull().alias("some"),
                            *key128(v)) for i, v in text]
        parts.append(df.select(F.inline(F.array(*structs))).where("some")
                     .select("ordinal", "h1", "h2").distinct())
    if not parts:
        return df.sparkSession.createDataFrame([], "ordinal int, distinct long")
    counts = [p.groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct")) for p in parts]
    return counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1])


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    salt_col: str, buckets: int = 256) -> DataFrame:
    """Rows ranked ``1..k`` (column ``rank``) inside each group by ``order``.

    Two stages, so a group holding millions of rows is never sorted in one
    task: the top ``k`` inside each of ``buckets`` hash slices of the group
    (sliced by ``salt_col``, unique within the group), then the top ``k`` of
    those ``buckets*k`` candidates.  ``order`` must be a total order.
    """
    salt = F.pmod(F.xxhash64(F.col(salt_col)), F.lit(buckets))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    cand = (df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(w1))
            .where(F.col("_r") <= k).drop("_salt", "_r"))
    w2 = Window.partitionBy(*group).orderBy(*order)
    return cand.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)


# Candidate values up to this many are looked up with a broadcast.
_MOST_CANDIDATES = 100_000


def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """``(ordinal, column, value, n, rank)``: top ``k`` values per column, ordered by count
    desc then value asc.

    Counting runs on hashes.  Values that can be among the first ``k`` are
    those not behind the k-th by (count, first 64 characters), equal ones
    included; only they are fetched as whole texts, in a second scan.
    """
    counts = value_counts(df, columns)
    # the k-th by (count, head) of each column, then everything not behind it
    kth = (top_k_per_group(counts, ["ordinal"], [F.desc("n"), F.asc("head"), F.asc("h1"),
                                                 F.asc("h2")], k, "h1")
           .groupBy("ordinal").agg(F.max(F.struct((-F.col("n")).alias("m"), "head"))
                                   .alias("last")))
    ensure_checkpoint_dir(df.sparkSession)
    found = (counts.join(F.broadcast(kth), "ordinal")          # one row per column
             .where(F.struct((-F.col("n")).alias("m"), "head") <= F.col("last"))
             .select("ordinal", "h1", "h2", "n").checkpoint())
    few = F.broadcast(found) if found.count() <= _MOST_CANDIDATES else found
    named = (_stack_text(df, columns).select("*", *key128(F.col("value")))
             .join(few, ["ordinal", "h1", "h2"])
             .groupBy("ordinal", "column", "h1", "h2", "n").agg(F.min("value").alias("value")))
    return top_k_per_group(named, ["ordinal"], [F.desc("n"), F.asc("value")], k,
                           "h1").drop("h1", "h2")


def approx_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                     accuracy: int = 10000) -> DataFrame:
    """One-pass approximate quantiles (Greenwald-Khanna): ``(column, prob, value, ordinal)``."""
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], "column string, prob double, value double, ordinal int")
    arr = F.array(*[F.lit(float(p)) for p in probs])
    vals = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("k"), F.lit(name).alias("column"), as_number(q(name)).alias("v"))
        for i, name in enumerate(columns)]))).where(F.col("v").isNotNull())
    return (vals.groupBy("k", "column")
            .agg(F.percentile_approx("v", arr, accuracy).alias("qs"))
            .select("column", F.posexplode("qs").alias("j", "value"), "k")
            .select("column", F.element_at(arr, F.col("j") + 1).alias("prob"), "value",
                    F.col("k").alias("ordinal")))
