"""Interactive reads: browse pages, sample, instant chart series (PRJ-1..6).

Pages are a distributed top-k; the order always ends with every other column
so paging is stable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotFound, TabsenseError
from ..functions import words as W
from .stats import NUMERIC_TYPES, q

CHART_ROWS = 40


def check_table(tables: dict[str, DataFrame], name: str) -> DataFrame:
    if name not in tables:
        raise NotFound("tableMissing", table=name)
    return tables[name]


def _order(df: DataFrame, order_by: str | None, direction: str) -> list[tuple[str, bool]]:
    """Columns of the total order and whether each runs downwards."""
    if order_by is not None and order_by not in df.columns:
        raise TabsenseError("unknownSortColumn", column=order_by)
    if direction not in ("asc", "desc"):
        raise TabsenseError("badSortDirection")
    first = [] if order_by is None else [(order_by, direction == "desc")]
    return first + [(c, False) for c in df.columns if c != order_by
                    and not isinstance(df.schema[c].dataType, T.MapType)]


def _sorted(df: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    return df.orderBy(*[q(c).desc_nulls_last() if down else q(c).asc_nulls_first()
                        for c, down in order])


def page(df: DataFrame, limit: int = 50, offset: int = 0, order_by: str | None = None,
         direction: str = "asc", row_limit: int = W.BROWSE_ROW_LIMIT) -> DataFrame:
    """PRJ-1/5: one page; limit capped at ``row_limit``, negative offset 0.

    An offset reads past the rows before it; to go on from a page at any
    depth use :func:`page_after`.
    """
    out = _sorted(df, _order(df, order_by, direction))
    if offset > 0:
        out = out.offset(offset)
    return out.limit(max(0, min(limit, row_limit)))


def page_after(df: DataFrame, last: dict, limit: int = 50, order_by: str | None = None,
               direction: str = "asc", row_limit: int = W.BROWSE_ROW_LIMIT) -> DataFrame:
    """PRJ-1 by key: the page after the row ``last`` in the same order as :func:`page`.

    A filter and a top-k, whatever the depth: each task keeps ``limit`` rows.
    Rows equal to ``last`` in every column count as seen.
    """
    order = _order(df, order_by, direction)
    after, same = F.lit(False), F.lit(True)
    for c, down in order:
        v, here = F.lit(last[c]).cast(df.schema[c].dataType), q(c)
        if down:          # nulls last: behind every value
            beyond = F.coalesce(here < v, here.isNull() & v.isNotNull())
        else:             # nulls first
            beyond = F.coalesce(here > v, here.isNotNull() & v.isNull())
        after = after | (same & beyond)
        same = same & here.eqNullSafe(v)
    return _sorted(df.where(after), order).limit(max(0, min(limit, row_limit)))


def total(df: DataFrame) -> DataFrame:
    """PRJ-1 total rows, as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("total"))


def chart_series(result: DataFrame, order_by: list[str] | None = None,
                 rows: int = CHART_ROWS) -> DataFrame | None:
    """PRJ-6: x = first non-numeric column, y = first numeric column, first
    ``rows`` rows; null x shows as '—', non-numeric y as 0."""
    numeric = [f.name for f in result.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
    other = [f.name for f in result.schema.fields if f.name not in numeric]
    if not numeric or not other:
        return None
    x, y = other[0], numeric[0]
    ordered = result.orderBy(*[q(c).asc_nulls_first() for c in (order_by or result.columns)])
    return ordered.limit(rows).select(
        F.coalesce(q(x).cast("string"), F.lit("—")).alias("x"),
        F.coalesce(q(y).try_cast("double"), F.lit(0.0)).alias("y"))
