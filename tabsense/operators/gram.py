"""Correlations of every pair of columns from two scans, however many columns there are.

The first scan gives the means.  The second makes a Gram matrix a task: with
values centred on the means and 0 for what is missing (V), their squares and
the presence bits (P), the products VtV, VtP, (V*V)tP and PtP hold all sums a
pair needs over the rows where both are present.  Tasks add them up batch by
batch as matrices; a task hands over one row a pair, and these are added by a
partially aggregated ``groupBy``.  As aggregates of the SQL engine the pairs
would be hundreds of thousands of expressions, or a scan for every few of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import as_number, q

_SUMS = ("n", "a", "b", "aa", "bb", "ab", "odd")
_SCHEMA = "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS)
# what rounding leaves of the spread of a constant
_NOTHING = 1e-13


def _matrices(means: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, total = len(means), None
        shift = np.array(means)
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64)
                          for c in batch.columns], axis=1)
            there = ~np.isnan(x)                       # nulls come as NaN
            odd = np.isinf(x)
            p, o = there.astype(np.float64), odd.astype(np.float64)
            v = np.where(there & ~odd, x - shift, 0.0)
            sums = np.stack((p.T @ p, v.T @ p, p.T @ v, (v * v).T @ p, p.T @ (v * v), v.T @ v,
                             o.T @ p + p.T @ o if odd.any() else np.zeros((k, k))))
            total = sums if total is None else total + sums
        if total is not None:
            i, j = np.triu_indices(k, 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                 *(pa.array(s[i, j]) for s in total)], names=["i", "j", *_SUMS])
    return run


def pair_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, n, a, b, aa, bb, ab, odd) of every pair of numeric columns, by position."""
    vals = [as_number(q(c)) for c in columns]
    finite = [F.when(F.abs(v) < float("inf"), v) for v in vals]
    first = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(finite)]).first()
    means = [first[f"m{i}"] or 0.0 for i in range(len(vals))]
    rows = df.select(*[v.alias(f"v{i}") for i, v in enumerate(vals)])
    return (rows.mapInArrow(_matrices(means), _SCHEMA).groupBy("i", "j")
            .agg(*[F.sum(s).alias(s) for s in _SUMS]))


def pearson(sums: DataFrame) -> DataFrame:
    """``sums`` with ``r``; null where a column does not vary or is infinite somewhere."""
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    xx = F.col("aa") - F.try_divide(a * a, n)
    yy = F.col("bb") - F.try_divide(b * b, n)
    xy = F.col("ab") - F.try_divide(a * b, n)
    varies = (xx > F.col("aa") * _NOTHING) & (yy > F.col("bb") * _NOTHING) & (F.col("odd") == 0)
    return sums.withColumn("r", F.when(varies, F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy))))
