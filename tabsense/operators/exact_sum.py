"""Sums that do not depend on the order of the rows.

A number is written as ``x * 2**b`` with an integer ``x`` of at most 62 bits
and ``b`` a multiple of 8 that its size decides (whole numbers and short
decimals: their own digits, ``b`` 0).  ``x`` is cut into three limbs of 21
bits, and rows are grouped by the keys and ``b`` with plain sums of longs: exact,
partially aggregated, compiled, and safe for 2**42 rows.  What is left is a
handful of rows per key, added once from the largest ``b`` down in
doubles with a running error term, so the rows are rounded once.

Partial sums travel as ``acc`` (an array of the limbs by ``b``) and ``odd`` (the
sum of infinities); :func:`merged` adds partial sums as exactly as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stats import INTEGRAL_TYPES, try_number

_BITS = 21
_MASK = (1 << _BITS) - 1
_STEP = 8
_LIMBS = ("hi", "mid", "lo")


def _scaled(v: Column, e: Column) -> Column:
    """``v * 2**e`` by two factors, as one may leave the range of doubles."""
    half = F.floor(e / 2)
    return v * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), e - half)


def is_whole(dtype: T.DataType) -> bool:
    """Types whose digits are summed as they are."""
    return isinstance(dtype, INTEGRAL_TYPES) or (
        isinstance(dtype, T.DecimalType) and dtype.precision <= 18)


def places(dtype: T.DataType) -> int:
    return dtype.scale if isinstance(dtype, T.DecimalType) and is_whole(dtype) else 0


def term(v: Column, dtype: T.DataType) -> Column:
    """``v`` as a struct (b, hi, mid, lo, odd); all null where it is no number."""
    if is_whole(dtype):
        x = (v * F.lit(10 ** places(dtype))).cast("long") if places(dtype) else v.cast("long")
        b, odd = F.when(v.isNotNull(), F.lit(0)), F.lit(None).cast("double")
    else:
        d = try_number(v)
        finite = F.abs(d) < float("inf")
        # the lowest bit of d is at log2 - 53 or above, whatever log2's last digit
        b = F.when(finite & (d != 0), F.floor((F.log2(F.abs(d)) - 53) / _STEP) * _STEP
                   ).when(d.isNotNull(), F.lit(0)).cast("int")
        x = F.when(finite, _scaled(d, -b)).cast("long")
        x = F.when(d.isNotNull(), F.coalesce(x, F.lit(0).cast("long")))
        odd = F.when(~finite, d)
    mask = F.lit(_MASK).cast("long")
    # named_struct: aliases inside a struct get lost beside a generator
    return F.named_struct(F.lit("b"), b, F.lit("hi"), F.shiftright(x, 2 * _BITS),
                          F.lit("mid"), F.shiftright(x, _BITS).bitwiseAND(mask),
                          F.lit("lo"), x.bitwiseAND(mask), F.lit("odd"), odd)


def summed(df: DataFrame, keys: list[str], term_col: str,
           others: list[tuple[str, Column, str]] = ()) -> DataFrame:
    """``df`` grouped by ``keys``: ``acc``, ``odd`` and the other aggregates.

    ``others`` are (name, aggregate of rows, name of the function that joins
    two of its results: sum, min or max).
    """
    t = F.col(term_col)
    fine = df.groupBy(*keys, t["b"].alias("_b")).agg(
        *[F.sum(t[x]).alias(f"_{x}") for x in _LIMBS], F.sum(t["odd"]).alias("odd"),
        *[agg.alias(name) for name, agg, _ in others])
    return _gathered(fine, keys, [(name, how) for name, _, how in others])


def _gathered(fine: DataFrame, keys: list[str], others: list[tuple[str, str]]) -> DataFrame:
    limbs = F.struct(F.col("_b").alias("b"), *[F.col(f"_{x}").alias(x) for x in _LIMBS])
    # a sum has at most one entry for every 8 powers of two
    return fine.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("_b").isNotNull(), limbs)).alias("acc"),
        F.sum("odd").alias("odd"), *[getattr(F, how)(name).alias(name) for name, how in others])


def merged(df: DataFrame, keys: list[str], others: list[tuple[str, str]] = ()) -> DataFrame:
    """Partial sums (``acc``, ``odd``) of ``df`` added up by ``keys``; others as in :func:`summed`."""
    rest = [F.col(name) for name, _ in others]
    # the other results of a row go with its first entry only
    opened = df.select(*keys, "odd", *rest, F.posexplode_outer("acc").alias("_i", "e"))
    first = F.coalesce(F.col("_i"), F.lit(0)) == 0
    fine = opened.groupBy(*keys, F.col("e.b").alias("_b")).agg(
        *[F.sum(F.col(f"e.{x}")).alias(f"_{x}") for x in _LIMBS],
        F.sum(F.when(first, F.col("odd"))).alias("odd"),
        *[getattr(F, how)(F.when(first, F.col(name))).alias(name) for name, how in others])
    return _gathered(fine, keys, list(others))


def _normal(e: Column) -> tuple[Column, Column, Column]:
    """The limbs of an entry with the lower two below 2**21."""
    mask = F.lit(_MASK).cast("long")
    mid = e["mid"] + F.shiftright(e["lo"], _BITS)
    return (e["hi"] + F.shiftright(mid, _BITS), mid.bitwiseAND(mask), e["lo"].bitwiseAND(mask))


def digits(acc: Column, dtype: T.DataType) -> Column:
    """The exact sum of a whole type as a decimal; null without a value."""
    hi, mid, lo = _normal(F.get(acc, F.lit(0)))       # one entry, as b is 0
    total = (hi.cast("decimal(20,0)") * F.lit(1 << 2 * _BITS).cast("decimal(13,0)")
             + (mid * F.lit(1 << _BITS) + lo).cast("decimal(20,0)")).cast("decimal(38,0)")
    at = places(dtype)
    if at:
        total = (total / F.lit(10 ** at).cast(f"decimal({at + 1},0)")).cast(f"decimal(38,{at})")
    return F.when(F.size(acc) > 0, total)


def value(acc: Column, odd: Column, dtype: T.DataType) -> Column:
    """The sum as a double, rounded once; null without a value."""
    if is_whole(dtype):
        return digits(acc, dtype).cast("double")

    def parts(e: Column) -> Column:
        hi, mid, lo = _normal(e)
        low31 = F.lit((1 << 31) - 1).cast("long")
        return F.array(*[_scaled(x.cast("double"), e["b"] + F.lit(p)) for x, p in (
            (F.shiftright(hi, 31), 2 * _BITS + 31), (hi.bitwiseAND(low31), 2 * _BITS),
            (mid, _BITS), (lo, 0))])

    def add(a: Column, x: Column) -> Column:
        s = a["s"] + x
        z = s - a["s"]
        return F.struct(s.alias("s"), (a["c"] + ((a["s"] - (s - z)) + (x - z))).alias("c"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    total = F.aggregate(F.flatten(F.transform(F.sort_array(acc, asc=False), parts)), zero, add,
                        lambda a: F.when(F.abs(a["s"]) < float("inf"), a["s"] + a["c"])
                        .otherwise(a["s"]))
    return F.when(F.size(acc) > 0, F.coalesce(odd, total))
