"""Line deduplication by winnowing over line hashes.

The non-blank lines of a text (trimmed) are hashed.  Every two consecutive
lines are a gram; of every ``window`` consecutive grams the one with the
smallest hash (the rightmost of equal ones) is a fingerprint, so a run of
``window + 1`` lines that occurs elsewhere shares a fingerprint with it for
certain.  A line of ``LONG_WORDS`` words or more is a fingerprint in itself, and
so is every gram whose two lines hold that many together: a passage of so many
words in whole lines is found however it is broken into lines.  Words are what
stands between blanks of any kind (tabs, non-breaking and other Unicode blanks).

The corpus is ordered by (id, text hash) and line.  Each place of a
fingerprint is joined with the fingerprint's first place, with the first one
that has the same line before it and with the first one that has the same line
after it; the match is extended line by line in both directions, and the later
one of the two runs is deleted.  An early copy of a part of a run so does not
hide a later copy of the whole: every line of a run stands in a fingerprint of
it or next to one.  A line is only deleted for an equal earlier one, so the
first copy of every line stays.

Everything is DataFrame expressions.  Places are compared with first places
only, never with each other; a fingerprint found everywhere is folded before
the shuffle, and the lines of a text that many others meet are copied so that
no task gets all of these.

Null texts stay null; texts without a repeated run stay as they are.  A row
repeated with id and text is one document: both rows get the same result.
Null ids come before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import cut, fresh_name

WINDOW = 2
LONG_WORDS = 50
MEETINGS = 1000


def _hash60(text: Column) -> Column:
    """60 bits of an MD5 as a long: the same number in any engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _line_arrays(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, line, words): the hashes of the non-blank lines and their numbers of words."""
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n", -1), lambda x: F.trim(x)),
                     lambda x: x != "")
    kept = (docs.where(F.col(text_col).isNotNull())
            .select(*_identity(id_col, text_col), lines.alias("lines")))
    return (kept.select("id", "h", F.transform("lines", _hash60).alias("line"),
                        F.transform("lines", lambda x: F.size(F.filter(
                            F.split(x, r"(?U)\s+", -1), lambda w: w != ""))).alias("words"))
            .where("size(line) > 0").dropDuplicates(["id", "h"]))


def _identity(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-1 << 63)).alias("id"),
            F.xxhash64(text_col).alias("h")]


def _fingerprints(arrays: DataFrame, window: int) -> DataFrame:
    """(id, h, pos, n, fp, before, after): winnowed grams, long lines and long grams of every text.

    ``before`` and ``after`` are the lines next to it, null at the ends.
    """
    grams = arrays.withColumn("gram", F.when(F.size("line") > 1, F.transform(
        F.sequence(F.lit(0), F.size("line") - 2),
        lambda i: _hash60(F.concat_ws("|", F.get("line", i).cast("string"),
                                      F.get("line", i + 1).cast("string")))))
        .otherwise(F.array().cast("array<long>")))
    # the smallest hash of a window, the rightmost on ties: the least (hash, -place)
    winners = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("gram") - window, F.lit(0))),
        lambda i: F.array_min(F.transform(
            F.sequence(i, F.least(i + window, F.size("gram")) - 1),
            lambda j: F.struct(F.get("gram", j).alias("g"), (-j).alias("at")))))
    # sequence(0, -1) counts down: a single line has no sum and falls out as null
    heavy = F.filter(F.transform(
        F.sequence(F.lit(0), F.size("gram") - 1),
        lambda i: F.when(F.get("words", i) + F.get("words", i + 1) >= LONG_WORDS, i)),
        lambda i: i.isNotNull())
    chosen = F.when(F.size("gram") > 0, F.transform(
        F.array_union(F.transform(winners, lambda w: -w["at"]), heavy),
        lambda p: F.struct(p.alias("pos"), F.lit(2).alias("n"), F.get("gram", p).alias("fp"))))
    single = F.filter(F.transform(
        F.sequence(F.lit(0), F.size("line") - 1),
        lambda i: F.when(F.get("words", i) >= LONG_WORDS, F.struct(
            i.alias("pos"), F.lit(1).alias("n"), F.get("line", i).alias("fp")))),
        lambda s: s.isNotNull())
    return grams.select("id", "h", "line", F.explode(F.concat(
        F.coalesce(chosen, F.filter(single, lambda s: F.lit(False))), single)).alias("x")
    ).select("id", "h", "x.pos", "x.n", "x.fp",
             F.get("line", F.col("x.pos") - 1).alias("before"),
             F.get("line", F.col("x.pos") + F.col("x.n")).alias("after"))


def _with_first(places: DataFrame, key: list[str], here: Column) -> DataFrame:
    """``places`` of the keys that occur more than once, with the ``first`` place of the key."""
    first = (places.groupBy(*key)
             .agg(F.count("*").alias("times"), F.min(here).alias("first"))
             .where("times > 1").select(*key, "first"))
    return places.join(first, key)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW) -> DataFrame:
    """(id, h, runs): ranges (lo, hi) of non-blank lines to delete, by document."""
    arrays = cut(_line_arrays(docs, id_col, text_col))
    here = F.struct("id", "h", "pos")
    known = cut(_with_first(_fingerprints(arrays, window), ["n", "fp"], here))
    sides = known.select("id", "h", "pos", "n", "fp", F.posexplode(
        F.array("before", "after")).alias("side", "line")).where("line is not null")
    firsts = known.select("id", "h", "pos", "first").union(
        _with_first(sides, ["n", "fp", "side", "line"], here).select("id", "h", "pos", "first"))
    links = cut(firsts.where(here != F.col("first"))
             .select("id", "h", "pos", F.col("first.id").alias("id0"),
                     F.col("first.h").alias("h0"),
                     (F.col("first.pos") - F.col("pos")).alias("shift"))
             .groupBy("id", "h", "id0", "h0", "shift")
             .agg(F.collect_set("pos").alias("hits")))      # at most a text's lines
    # a text that very many others meet is copied, a copy for every MEETINGS links
    heads = links.groupBy("id0", "h0").agg(
        F.ceil(F.count("*") / MEETINGS).cast("long").alias("copies"))
    met = (arrays.select(F.col("id").alias("id0"), F.col("h").alias("h0"),
                         F.col("line").alias("line0")).join(heads, ["id0", "h0"])
           .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"),
                                                    F.col("copies") - 1))).drop("copies"))
    both = (links.join(heads, ["id0", "h0"])
            .withColumn("copy", F.pmod(F.xxhash64("id", "h"), F.col("copies")))
            .join(arrays.select("id", "h", "line"), ["id", "h"])
            .join(met, ["id0", "h0", "copy"]))
    # along the diagonal: the places where the two texts differ, and its two ends
    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(F.size("line"), F.size("line0") - F.col("shift"))
    breaks = F.concat(
        F.array(low - 1),
        F.filter(F.sequence(low, high - 1),
                 lambda i: F.get("line", i) != F.get("line0", i + F.col("shift"))),
        F.array(high))
    runs = both.select("id", "h", "hits", breaks.alias("breaks"))
    spans = F.transform("hits", lambda p: F.struct(
        (F.array_max(F.filter("breaks", lambda b: b < p)) + 1).alias("lo"),
        (F.array_min(F.filter("breaks", lambda b: b > p)) - 1).alias("hi")))
    return (runs.select("id", "h", F.array_distinct(spans).alias("runs"))
            .groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list("runs")))
                                    .alias("runs")))


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      window: int = WINDOW, out_col: str | None = None,
                      removed_col: str = "n_removed", lines_col: str = "n_lines") -> DataFrame:
    """``docs`` with later repeated runs of lines cut out of ``out_col`` (default: the text).

    Adds the numbers of non-blank lines and of deleted ones; blank lines inside a
    deleted run go with it.  A column that already has one of these names is
    replaced.
    """
    out_col = out_col or text_col
    taken = docs.select("*", *[F.lit(0).alias(c) for c in (out_col, removed_col, lines_col)])
    key_id, key_h, runs, places, cuts, gone, left = (
        fresh_name(taken, c) for c in ("key_id", "key_h", "runs", "places", "cuts", "gone",
                                       "left"))
    found = repeated_runs(docs, id_col, text_col, window).toDF(key_id, key_h, runs)
    keyed = docs.select("*", *[c.alias(k) for c, k in zip(_identity(id_col, text_col),
                                                          (key_id, key_h))])
    lines = F.split(F.col(text_col), "\n", -1)
    # places of the non-blank lines among all lines
    filled = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i)),
                      lambda i: i.isNotNull())
    # from numbers among the non-blank lines to numbers among all lines
    at = F.transform(F.col(runs), lambda r: F.struct(
        F.get(F.col(places), r["lo"]).alias("lo"), F.get(F.col(places), r["hi"]).alias("hi")))

    # numbers of the deleted lines, each once; set operations keep this linear
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.array_join(F.transform(F.col(left), lambda i: F.get(lines, i)), "\n")
    none = F.col(cuts).isNull()
    return (keyed.join(found, [key_id, key_h], "left")
            .withColumn(places, filled).withColumn(cuts, at)
            .withColumn(gone, F.array_distinct(F.flatten(F.transform(
                F.col(cuts), lambda r: F.sequence(r["lo"], r["hi"])))))
            .withColumn(left, F.array_except(every, F.col(gone)))
            .withColumn(lines_col, F.when(F.col(places).isNull(), 0)
                        .otherwise(F.size(places)).cast("long"))
            .withColumn(removed_col, F.when(none, 0).otherwise(
                F.size(F.array_intersect(F.col(places), F.col(gone)))).cast("long"))
            .withColumn(out_col, F.when(none, F.col(text_col)).otherwise(kept))
            .drop(key_id, key_h, runs, places, cuts, gone, left))
