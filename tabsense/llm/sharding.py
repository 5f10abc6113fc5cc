"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of rows (equal values of a key) are placed whole.  They enter in
falling size, each into the bin with the tightest remaining capacity that
still takes it; the bins stand in a balanced tree ordered by what they have
left.

The packing needs only how many groups there are of each size: groups of one
size fill the tightest bin until it takes no more, then the next tightest, so
a run of equal sizes is placed at once and the result is the one that placing
them singly gives.  Sizes above 4,096 are rounded up to 12 significant bits
for the packing (a bin never overflows; at most 1/2,048 of it is wasted),
which bounds the size table that reaches the driver by some 110,000 rows
however many groups there are.  Which groups of a size go to which bin is
decided by their rank, numbered in parallel blocks.

With ``shards`` the number of bins is given and the capacity is searched
(bisection over best-fit-decreasing runs): the smallest capacity for which
the groups fit.  A group that alone exceeds an even share of what is left
gets a bin to itself first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.llm.common import cut, fresh_name, text_key

_BITS = 12


def size_class(size: Column) -> Column:
    """``size`` rounded up to 12 significant bits (exact up to 4,096)."""
    spare = F.greatest(F.lit(0), F.length(F.bin(size)) - _BITS)
    unit = F.pow(F.lit(2.0), spare).cast("long")
    return size + F.pmod(-size, unit)


@dataclass
class _Node:
    left: int                      # remaining capacity
    bin: int
    level: int = 1
    low: "_Node | None" = None
    high: "_Node | None" = None


class BinTree:
    """Bins ordered by (remaining capacity, number) in an AA tree."""

    def __init__(self) -> None:
        self._root: _Node | None = None

    @staticmethod
    def _skew(n: _Node) -> _Node:
        if n.low and n.low.level == n.level:
            m = n.low
            n.low, m.high = m.high, n
            return m
        return n

    @staticmethod
    def _split(n: _Node) -> _Node:
        if n.high and n.high.high and n.high.high.level == n.level:
            m = n.high
            n.high, m.low = m.low, n
            m.level += 1
            return m
        return n

    def add(self, left: int, number: int) -> None:
        def put(n: _Node | None) -> _Node:
            if n is None:
                return _Node(left, number)
            if (left, number) < (n.left, n.bin):
                n.low = put(n.low)
            else:
                n.high = put(n.high)
            return self._split(self._skew(n))
        self._root = put(self._root)

    def remove(self, left: int, number: int) -> None:
        def level(n: _Node | None) -> int:
            return n.level if n else 0

        def take(n: _Node | None, key: tuple[int, int]) -> _Node | None:
            if n is None:
                return None
            if key < (n.left, n.bin):
                n.low = take(n.low, key)
            elif key > (n.left, n.bin):
                n.high = take(n.high, key)
            elif n.low is None:
                return n.high
            else:
                m = n.low
                while m.high:
                    m = m.high
                n.left, n.bin = m.left, m.bin
                n.low = take(n.low, (m.left, m.bin))
            want = min(level(n.low), level(n.high)) + 1
            if want < n.level:
                n.level = want
                if n.high and n.high.level > want:
                    n.high.level = want
            n = self._skew(n)
            if n.high:
                n.high = self._skew(n.high)
                if n.high.high:
                    n.high.high = self._skew(n.high.high)
            n = self._split(n)
            if n.high:
                n.high = self._split(n.high)
            return n
        self._root = take(self._root, (left, number))

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The bin with the least remaining capacity of at least ``size``."""
        n, found = self._root, None
        while n:
            if n.left >= size:
                found, n = (n.left, n.bin), n.low
            else:
                n = n.high
        return found


@dataclass
class Packing:
    bins: int = 0
    pieces: list[tuple[int, int, int]] = field(default_factory=list)  # (size, groups, bin)


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int | None = None,
                        first_bin: int = 0) -> Packing | None:
    """Pack ``(size, groups)``, given in falling size, into bins of ``capacity``.

    Returns None when a group does not fit a bin or more than ``most`` bins
    would be needed.
    """
    tree, out = BinTree(), Packing()
    for size, groups in sizes:
        if size > capacity:
            return None
        while groups:
            if (found := tree.tightest(size)) is not None:
                left, number = found
                tree.remove(left, number)
            else:
                if most is not None and out.bins == most:
                    return None
                left, number = capacity, first_bin + out.bins
                out.bins += 1
            took = min(groups, left // size) if size else groups
            out.pieces.append((size, took, number))
            groups -= took
            tree.add(left - took * size, number)
    return out


def pack_into(sizes: list[tuple[int, int]], shards: int) -> Packing:
    """Pack into ``shards`` bins with the smallest capacity that best-fit-decreasing finds."""
    sizes = sorted(((s, n) for s, n in sizes if n), reverse=True)
    out, total = Packing(bins=shards), sum(s * n for s, n in sizes)
    own = 0
    while sizes and shards - own > 1 and sizes[0][0] * (shards - own) > total:
        size, groups = sizes[0]
        out.pieces.append((size, 1, own))
        own, total = own + 1, total - size
        sizes = ([(size, groups - 1)] if groups > 1 else []) + sizes[1:]
    if not sizes:
        return out
    bins = shards - own
    low = max(sizes[0][0], -(-total // bins))
    high, best = low, None
    while best is None:                          # first capacity that works
        best = best_fit_decreasing(sizes, high, bins, own)
        if best is None:
            low, high = high + 1, high + max(1, high // 64)
    while low < high and high - low > high >> 16:
        mid = (low + high) // 2
        tried = best_fit_decreasing(sizes, mid, bins, own)
        if tried is None:
            low = mid + 1
        else:
            best, high = tried, mid
    out.pieces += best.pieces
    return out


def numbered(df: DataFrame, by: str, out: str) -> DataFrame:
    """``df`` with a gapless ``out`` from 0 within each ``by``, counted in blocks.

    Rows are numbered inside (by, block of a task's rows) and shifted by the
    counts of the blocks before, so a ``by`` that holds most rows is spread
    over many tasks.  The input is materialised first: the numbering is the
    same when a task is repeated.
    """
    at = fresh_name(df, "at")
    block, before = fresh_name(df, "block"), fresh_name(df, "before")
    flat = cut(df.withColumn(at, F.monotonically_increasing_id()))
    # 2**16 rows of a task at a time: a bound on what one window holds
    flat = flat.withColumn(block, F.shiftright(at, 16))
    counts = flat.groupBy(by, block).agg(F.count("*").alias(before))
    running = F.sum(before).over(Window.partitionBy(by).orderBy(block)
                                 .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(by, block, F.coalesce(running, F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(by, block).orderBy(at))
    return (flat.withColumn(out, inside - 1).join(offsets, [by, block])
            .withColumn(out, (F.col(out) + F.col(before)).cast("long"))
            .drop(at, block, before))


def assign_groups(groups: DataFrame, size_col: str, shards: int | None = None,
                  capacity: int | None = None) -> DataFrame:
    """``groups`` (one row each) with an int column ``shard``.

    Give either ``shards`` (sizes near equal) or ``capacity`` (fewest bins;
    a group beyond the capacity raises).
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = groups.sparkSession
    cls, rank = fresh_name(groups, "size_class"), fresh_name(groups, "class_rank")
    ranked = numbered(groups.withColumn(cls, size_class(F.col(size_col))), cls, rank)
    # at most ~110,000 distinct classes by construction
    sizes = sorted(((r[0], r[1]) for r in ranked.groupBy(cls).count().collect()), reverse=True)
    if shards is not None:
        packing = pack_into(sizes, shards)
    else:
        packing = best_fit_decreasing(sizes, capacity)
        if packing is None:
            raise ValueError(f"a group is larger than the capacity {capacity}")
    plan: dict[int, list[tuple[int, int]]] = {}
    for size, n, number in packing.pieces:
        ends = plan.setdefault(size, [])
        ends.append(((ends[-1][0] if ends else 0) + n, number))
    schema = T.StructType([
        T.StructField(cls, T.LongType()),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("bins", T.ArrayType(T.IntegerType()))])
    table = spark.createDataFrame(
        [(s, [e for e, _ in p], [b for _, b in p]) for s, p in plan.items()], schema)
    piece = F.expr(f"bins[size(filter(ends, e -> e <= `{rank}`))]")
    return (ranked.join(F.broadcast(table), cls).withColumn("shard", piece)
            .drop(cls, rank, "ends", "bins"))


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id",
                    text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; equal texts share a shard.

    ``size`` is the text's UTF-8 bytes (null: none) plus ``overhead``; null
    texts are one group each (their size class spreads them).  ``slot`` is
    gapless from 0 inside each shard.
    """
    raw = F.encode(F.col(text_col), "UTF-8")
    rows = cut(docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.coalesce(text_key(F.col(text_col)),
                   F.encode(F.concat(F.lit("null-"), F.monotonically_increasing_id()
                                     .cast("string")), "UTF-8")).alias("key")))
    groups = rows.groupBy("key").agg(F.sum("size").alias("total"))
    placed = assign_groups(groups, "total", shards=shards).select("key", "shard")
    return numbered(rows.join(placed, "key").drop("key"), "shard", "slot")
