"""Mixing sources to target weights by Poisson replication.

A source with share ``w`` of the wanted mixture gets the mean repetition rate
``rate = w * wanted rows / its rows``.  Every document draws its number of
copies from the Poisson distribution with that mean by inverting the
distribution function at a uniform number hashed from seed and id: the draw
is the same whatever the partitioning, and does not change when other
documents come or go as long as the rate holds.  The copies are exploded and
put into a global random order by a second hash.

A rate above 8 is split into equal parts, whose draws (each with its own
hash) are added: the sum of Poisson draws is a Poisson draw, and the
distribution function stays short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import cut, fresh_name, unit_hash

_PART = 8.0
_MOST_BROADCAST = 10_000


def poisson_parts(rate: Column) -> Column:
    """(parts, cdf): how many equal parts a rate is split into, and their distribution function."""
    parts = F.when(rate > 0, F.ceil(rate / _PART)).otherwise(F.lit(0)).cast("long")
    mean = rate / F.greatest(parts, F.lit(1))
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("cdf"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * mean / i
        return F.struct(term.alias("term"), F.array_append(
            s["cdf"], F.element_at(s["cdf"], -1) + term).alias("cdf"))
    # terms of a mean of at most 8 are below 2**-53 from 64 on
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, step, lambda s: s["cdf"])
    return F.struct(parts.alias("parts"), cdf.alias("cdf"))


def poisson_draw(parts: Column, seed: int, *identity: Column) -> Column:
    """Sum of one draw a part: the distribution function inverted at hashed uniforms."""
    def one(part: Column) -> Column:
        u = unit_hash(F.lit(str(seed)), part.cast("string"), *identity)
        # bound by the outer lambda: hashed once, not once a term
        return F.get(F.transform(F.array(u), lambda x: F.size(
            F.filter(parts["cdf"], lambda c: c < x))), 0).cast("long")

    draws = F.aggregate(F.sequence(F.lit(1).cast("long"), parts["parts"]),
                        F.lit(0).cast("long"), lambda s, part: s + one(part))
    return F.when(parts["parts"] > 0, draws).otherwise(F.lit(0).cast("long"))


def poisson_count(rate: Column, seed: int, *identity: Column) -> Column:
    """A Poisson draw of mean ``rate``; 0 for a rate of 0 or null."""
    return poisson_draw(poisson_parts(rate), seed, *identity)


def source_rates(docs: DataFrame, source_col: str = "source",
                 weights: dict[str, float] | None = None,
                 wanted_rows: int | None = None) -> DataFrame:
    """(source, n_docs, rate); null is a source like any other.

    ``weights`` gives the mixture (sources it does not name get 0, named ones
    that are absent leave their share to the others); by default every source
    present weighs the same.  ``wanted_rows`` is the expected
    size of the mixture, by default the size of ``docs``.
    """
    counts = cut(docs.groupBy(F.col(source_col).alias("source"))
                 .agg(F.count("*").alias("n_docs")))
    if weights is None:
        shares = counts.withColumn("share", F.lit(1.0))
    else:
        named = docs.sparkSession.createDataFrame(
            [(s, float(w)) for s, w in weights.items()], "name string, share double")
        shares = (counts.join(named, F.col("source").eqNullSafe(F.col("name")), "left")
                  .drop("name").fillna(0.0, ["share"]))
    share, rows = shares.agg(F.sum("share"), F.sum("n_docs")).first()
    wanted = rows if wanted_rows is None else wanted_rows
    scale = float(wanted or 0) / share if share else 0.0
    return shares.select("source", "n_docs",
                         (F.col("share") * F.lit(scale) / F.col("n_docs")).alias("rate"))


def with_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                seed: int = 7, weights: dict[str, float] | None = None,
                wanted_rows: int | None = None, out: str = "n_copies") -> DataFrame:
    """``docs`` with its Poisson number of copies in column ``out``."""
    rates = source_rates(docs, source_col, weights, wanted_rows)
    rate, name = fresh_name(docs, "rate"), fresh_name(docs, "rate_source")
    # the distribution function is computed once a source, not once a document
    rates = cut(rates.select(F.col("source").alias(name),
                             poisson_parts(F.col("rate")).alias(rate)))
    if rates.count() <= _MOST_BROADCAST:
        rated = docs.join(F.broadcast(rates), F.col(source_col).eqNullSafe(F.col(name)), "left")
    else:
        # beyond the bound: both sides by (source, salt), each rate once a salt
        salt, salts = fresh_name(docs, "salt"), 64
        spread = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int"))
        rated = salted.join(
            spread.withColumnRenamed(salt, salt + "_s"),
            F.col(source_col).eqNullSafe(F.col(name)) & (F.col(salt) == F.col(salt + "_s")),
            "left").drop(salt, salt + "_s")
    identity = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return rated.withColumn(out, poisson_draw(F.col(rate), seed, identity)).drop(rate, name)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 7,
        weights: dict[str, float] | None = None, wanted_rows: int | None = None,
        copies_col: str = "n_copies", copy_col: str = "copy",
        key_col: str = "shuffle_key") -> DataFrame:
    """The mixture in random order: every document once per copy.

    Adds the number of copies, the copy (from 1) and the shuffle key; rows are
    in the order of that key.  A column that already has one of these names is
    replaced.  A document with 0 copies is left out (that is
    the sampling the target weights ask for).
    """
    counted = with_counts(docs, id_col, source_col, seed, weights, wanted_rows, copies_col)
    copies = (counted.where(F.col(copies_col) > 0)
              .withColumn(copy_col, F.explode(F.sequence(F.lit(1).cast("long"),
                                                         F.col(copies_col)))))
    identity = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    key = F.md5(F.concat_ws("|", F.lit(f"order-{seed}"), F.col(copy_col).cast("string"),
                            identity).cast("binary"))
    return copies.withColumn(key_col, key).orderBy(key_col)
