"""Exact quantiles and IQR outliers from sketch brackets.

1. One scan sketches every column (Greenwald-Khanna, rank error at most
   1/accuracy of the rows): two quantiles of the sketch bracket each wanted
   one for certain.
2. A bracket that may still hold more rows than a sketch has entries is
   sketched itself, on an even grid, in one more scan for all of them; a scan
   divides it by about accuracy/10, so one is enough up to some 10**11 rows.
3. One scan counts: every value lies in a bracket, where equal values are
   counted together, or between two, where only the number counts.  The
   fences of the outliers are bracketed by what is known of the quartiles and
   counted in the same scan.

The counts settle the ranks whatever the sketches said: a rank outside its
bracket (a sketch beyond its bound) is looked for once more beside it.  Rows
are only ever partially aggregated; a value that holds most rows is one row
before the shuffle, and what is ranked are the distinct values inside the
brackets.  The driver sees a handful of numbers per column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import stats as S
from .stats import as_number, q

ACCURACY = 10_000
GRID = 1_000


@dataclass
class _Rank:
    """A wanted rank (from 0) of column ``k`` and the closed bracket it lies in."""
    k: int
    rank: int
    lo: float
    hi: float
    most: float                      # rows the bracket may hold
    value: float | None = None


@dataclass
class Profile:
    """What is known of the numeric columns, by position."""
    columns: list[str]
    facts: list[dict]                # n, lo, hi (and mean, std) of every column
    quantile: dict[tuple[int, float], float] = field(default_factory=dict)
    outliers: dict[int, int] = field(default_factory=dict)


def _margins(accuracy: int) -> list[float]:
    return [2.0 ** j / accuracy for j in range(1, int(math.log2(accuracy)) + 1)]


def _sketch(v: Column, probs: list[float], accuracy: int) -> Column:
    """Quantiles around each of ``probs`` at growing distances, below and above."""
    return F.percentile_approx(v, _doubles([x for p in probs for x in (
        *(max(0.0, p - m) for m in _margins(accuracy)),
        *(min(1.0, p + m) for m in _margins(accuracy)))]), F.lit(accuracy))


def _doubles(values: list[float]) -> Column:
    return F.expr("array(" + ", ".join(
        f"{x!r}D" if math.isfinite(x) else f"double('{x!r}')" for x in values) + ")")


def _first(df: DataFrame, vals: list[Column], probs: list[float], accuracy: int,
           moments: bool) -> list[dict]:
    """One scan: counts, bounds, moments and sketches of all columns."""
    aggs = []
    for k, v in enumerate(vals):
        aggs += [F.count(v).alias(f"n{k}"), F.min(v).alias(f"lo{k}"), F.max(v).alias(f"hi{k}")]
        aggs.append(_sketch(v, probs, accuracy).alias(f"s{k}"))
        if moments:
            aggs += [F.avg(v).alias(f"m{k}"), F.stddev_samp(v).alias(f"d{k}")]
    row = df.agg(*aggs).first()
    return [{"n": row[f"n{k}"], "lo": row[f"lo{k}"], "hi": row[f"hi{k}"],
             "mean": row[f"m{k}"] if moments else None,
             "std": row[f"d{k}"] if moments else None,
             "sketch": row[f"s{k}"]}
            for k in range(len(vals))]


def _open(facts: list[dict], probs: list[float], accuracy: int) -> list[_Rank]:
    out = []
    for k, f in enumerate(facts):
        for i, p in enumerate(probs):
            if not f["n"]:
                continue
            margins = _margins(accuracy)
            # the sketch's error, what the value it names may be off, and two ranks
            fits = [j for j, m in enumerate(margins) if m >= 2 / accuracy + 3 / f["n"]]
            lo, hi, most = f["lo"], f["hi"], float(f["n"])
            if fits:
                m, at = margins[fits[0]], 2 * len(margins) * i + fits[0]
                if p - m > 0:
                    lo = f["sketch"][at]
                if p + m < 1:
                    hi = f["sketch"][at + len(margins)]
                most = (2 * m + 2 / accuracy) * f["n"]
            at = (f["n"] - 1) * p
            out += [_Rank(k, r, lo, hi, most) for r in sorted({math.floor(at), math.ceil(at)})]
    return out


def _refine(df: DataFrame, vals: list[Column], wide: list[_Rank], accuracy: int) -> None:
    """One scan: sketch the inside of all wide brackets on a grid and narrow them."""
    brackets = sorted({(r.k, r.lo, r.hi) for r in wide})
    grid = _doubles([j / GRID for j in range(GRID + 1)])
    aggs = []
    for b, (k, lo, hi) in enumerate(brackets):
        v = vals[k]
        inside = F.when((v >= lo) & (v <= hi), v)
        aggs += [F.sum(F.when(v < lo, 1).otherwise(0)).alias(f"u{b}"),
                 F.count(inside).alias(f"n{b}"),
                 F.percentile_approx(inside, grid, F.lit(accuracy)).alias(f"g{b}")]
    row = df.agg(*aggs).first()
    for r in wide:
        b = brackets.index((r.k, r.lo, r.hi))
        n, local = row[f"n{b}"], r.rank - row[f"u{b}"]
        r.most = float(n)
        if not n or not 0 <= local < n:
            continue                  # beside its bracket: the counts will tell
        margin = (2 / accuracy + 3 / n) * GRID
        lo, hi = math.floor(local / n * GRID - margin), math.ceil((local + 1) / n * GRID + margin)
        if lo > 0:
            r.lo = row[f"g{b}"][lo]
        if hi < GRID:
            r.hi = row[f"g{b}"][hi]
        r.most = n * ((min(hi, GRID) - max(lo, 0)) / GRID + 2 / accuracy)


def _disjoint(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _groups(df: DataFrame, vals: list[Column], spans: list[list[tuple[float, float]]]
            ) -> DataFrame:
    """(k, zone, v, c): counts by value inside the spans of column k, in all between them.

    ``zone`` counts the spans that begin at or below the value; a count
    without ``v`` is of the values after span number ``zone``.
    """
    # the bounds of every column lie in arrays by k: the expression does not grow
    # with the number of columns
    row, v = F.col("k") + 1, F.col("v")
    zone, inside = F.lit(0), F.lit(False)
    for j in range(max(map(len, spans))):
        lo, hi = (F.element_at(_doubles([x[j][side] if j < len(x) else math.nan
                                         for x in spans]), row) for side in (0, 1))
        zone = zone + (v >= lo).cast("int")
        inside = inside | ((v >= lo) & (v <= hi))
    stack = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), x.alias("v"))
                                         for k, x in enumerate(vals)]))).where(v.isNotNull())
    return (stack.select("k", zone.alias("zone"), F.when(inside, v).alias("v"))
            .groupBy("k", "zone", "v").agg(F.count(F.lit(1)).alias("c")))


def _settle(groups: DataFrame, ranks: list[_Rank]) -> None:
    """Give every rank the value that the counts put there; widen brackets that miss theirs."""
    by_value = Window.partitionBy("k").orderBy("zone", F.col("v").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, 0)
    placed = groups.withColumn("upto", F.sum("c").over(by_value))
    wanted = S.local_frame(groups.sparkSession,
                           sorted({(r.k, r.rank) for r in ranks}), "k int, rank long")
    hits = (placed.join(F.broadcast(wanted), "k")          # a few ranks a column
            .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto")
                                                      - F.col("c")))
            .select("k", "rank", "zone", "v").collect())
    got = {(h["k"], h["rank"]): h for h in hits}
    for r in ranks:
        r.value = got[r.k, r.rank]["v"]


def fences_of(q1: float, q3: float) -> tuple[float, float]:
    """Values strictly outside are outliers."""
    return q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def _at(lo: float, hi: float, share: float) -> float:
    return lo if lo == hi else lo + share * (hi - lo)


def profile(df: DataFrame, columns: list[str], probs: list[float], fences: bool = False,
            accuracy: int = ACCURACY, moments: bool = False) -> Profile:
    """Exact linear-interpolated quantiles, and outliers by the quartiles with ``fences``."""
    vals = [as_number(q(c)) for c in columns]
    if fences:
        probs = sorted({*probs, 0.25, 0.75})
    if not vals:
        return Profile(columns, [])
    facts = _first(df, vals, probs, accuracy, moments)
    out = Profile(columns, facts)
    ranks = _open(facts, probs, accuracy)
    while wide := [r for r in ranks if r.lo < r.hi and r.most > accuracy]:
        before = {id(r): (r.lo, r.hi) for r in wide}
        _refine(df, vals, wide, accuracy)
        if all(before[id(r)] == (r.lo, r.hi) for r in wide):
            break                     # hot values: few distinct ones are left

    def bracket(k: int, p: float) -> tuple[float, float]:
        at = (facts[k]["n"] - 1) * p
        lo, hi = (next(r for r in ranks if (r.k, r.rank) == (k, x))
                  for x in (math.floor(at), math.ceil(at)))
        return ((lo.lo, hi.hi) if lo.value is None or hi.value is None
                else (_at(lo.value, hi.value, at - math.floor(at)),) * 2)

    some = [k for k, f in enumerate(facts) if f["n"]]
    while missing := [r for r in ranks if r.value is None]:
        spans: list[list[tuple[float, float]]] = [[] for _ in vals]
        for r in ranks:
            spans[r.k].append((r.lo, r.hi))
        if fences:
            for k in some:
                (a, b), (c, d) = bracket(k, 0.25), bracket(k, 0.75)
                # the fences move outwards as the spread of the quartiles grows
                low = (a - 1.5 * (d - a), b - 1.5 * max(c - b, 0.0))
                high = (c + 1.5 * max(c - b, 0.0), d + 1.5 * (d - a))
                # infinite quartiles: all that is known
                spans[k].append(low if not any(map(math.isnan, low)) else (-math.inf, b))
                spans[k].append(high if not any(map(math.isnan, high)) else (c, math.inf))
        groups = cut(_groups(df, vals, [_disjoint(x) for x in spans]))
        _settle(groups, missing)
        for r in missing:
            if r.value is None:       # a sketch beyond its bound
                r.lo, r.hi = facts[r.k]["lo"], facts[r.k]["hi"]
    for k in some:
        for p in probs:
            out.quantile[k, p] = bracket(k, p)[0]
    if fences and some:
        # a value between brackets lies on the same side of a fence as all beside it
        sides = []
        for k in some:
            low, high = fences_of(out.quantile[k, 0.25], out.quantile[k, 0.75])
            if math.isnan(low) or math.isnan(high):
                continue
            zones = _disjoint(spans[k])
            below = sum(1 for lo, _ in zones if lo <= low)
            above = sum(1 for lo, _ in zones if lo <= high)
            sides.append((k, low, high, below, above))
        if sides:
            bound = F.broadcast(S.local_frame(
                df.sparkSession, sides, "k int, low double, high double, below int, above int"))
            v, zone = F.col("v"), F.col("zone")
            outside = F.when(v.isNotNull(), (v < F.col("low")) | (v > F.col("high"))).otherwise(
                (zone < F.col("below")) | (zone >= F.col("above")))
            for r in (groups.join(bound, "k").where(outside).groupBy("k")
                      .agg(F.sum("c").alias("c")).collect()):
                out.outliers[r["k"]] = r["c"]
    return out


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    accuracy: int = ACCURACY) -> DataFrame:
    """``(column, prob, value, ordinal)``: the value at position ``(n-1)*prob``, interpolated."""
    found = profile(df, columns, probs, accuracy=accuracy)
    return S.local_frame(df.sparkSession, [
        (columns[k], float(p), found.quantile[k, p], k)
        for k, f in enumerate(found.facts) for p in probs if f["n"]],
        "column string, prob double, value double, ordinal int")
