"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised to their words (A-Z lower-cased, words are runs of code
points outside ASCII punctuation, blanks and controls) with one blank around
every word.  The patterns are the windows of ten consecutive words of the
benchmark items (the whole item when it has fewer, but some), also between
blanks, so that a pattern occurs exactly where its words do.  One automaton
holds all windows; each document is scanned once, and the offsets of the hits
are mapped back to word numbers and to code points of the original text.

The benchmark is measured before it is shipped: windows of up to
``pattern_bytes`` go into one automaton.  A larger benchmark is cut into that
many parts by a hash of the window, and the documents are scanned once a
part, the hits so far being carried along: exact at any size, and neither the
driver nor a task holds more than one part.

Null texts and texts without words have no words, no hits and no items; so
has an empty benchmark.  Items with a null id count as hits but name no item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import cut, fresh_name, stored

WINDOW = 10
PATTERN_BYTES = 64 << 20
# The word class as the contract writes it (fixed value).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The normalised words of a text (null: none)."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)),
                      F.array().cast("array<string>"))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
            size: int = WINDOW) -> DataFrame:
    """(pattern, items): every distinct window of the benchmark and the items it occurs in."""
    listed = items.select(F.col(id_col).cast("string").alias("item"),
                          words(F.col(text_col)).alias("w")).where("size(w) > 0")
    each = listed.select("item", F.explode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))),
        lambda i: F.concat(F.lit(" "), F.array_join(F.slice("w", i + 1, size), " "),
                           F.lit(" ")))).alias("pattern"))
    return each.groupBy("pattern").agg(F.collect_set("item").alias("items"))


def _scanner(patterns: list[tuple[str, list[str]]], names: list[str], text_col: str,
             keep: list[str]):
    """A task function: adds this part's hits to the spans and items carried so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for pattern, ids in patterns:
            machine.add_word(pattern, (pattern.count(" ") - 1, len(pattern), ids))
        if patterns:
            machine.make_automaton()
        word = re.compile(WORD)
        for batch in batches:
            n_words, spans, found = [], [], []
            for text, old_spans, old_items in zip(
                    batch.column(text_col).to_pylist(), batch.column(names[1]).to_pylist(),
                    batch.column(names[2]).to_pylist()):
                listed = word.findall(text.translate(_FOLD)) if text else []
                n_words.append(len(listed))
                runs: list[tuple[int, int]] = []
                items = set(old_items or ())
                if patterns and listed:
                    line = f" {' '.join(listed)} "
                    seen, at = 0, 0
                    for end, (n, length, ids) in machine.iter(line):
                        # blanks up to the hit's first one number its first word;
                        # hits come by rising end, so the count moves on
                        at += line.count(" ", seen, end + 1)
                        seen = end + 1
                        last = at - 1                    # words that end before this blank
                        items.update(ids)
                        if runs and last - n <= runs[-1][1]:
                            runs[-1] = (min(runs[-1][0], last - n), max(runs[-1][1], last))
                        else:
                            runs.append((last - n, last))
                spans.append(_union(runs, old_spans))
                found.append(sorted(items))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep],
                 pa.array(n_words, pa.int64()),
                 pa.array([[list(x) for x in s] for s in spans], pa.list_(pa.list_(pa.int64()))),
                 pa.array(found, pa.list_(pa.string()))],
                names=[*keep, *names])
    return run


def _union(runs: list[tuple[int, int]], more: list[list[int]] | None) -> list[tuple[int, int]]:
    """Disjoint half-open word ranges that cover both lists, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted([*runs, *map(tuple, more or ())]):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def scan(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", size: int = WINDOW, pattern_bytes: int = PATTERN_BYTES,
         names: tuple[str, str, str] = ("n_words", "hit_spans", "hit_items"),
         keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) plus three columns called ``names``.

    They hold the number of words, the disjoint ranges of hit words (first
    inclusive, last exclusive) and the sorted ids of the items found.
    """
    found = cut(windows(items, item_id, item_text, size))
    total = found.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    parts = max(1, -(-int(total) // pattern_bytes))
    out = docs.select("*", F.lit(0).cast("long").alias(names[0]),
                      F.lit(None).cast("array<array<long>>").alias(names[1]),
                      F.lit(None).cast("array<string>").alias(names[2]))
    for k in range(parts):
        mine = found.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k)
        patterns = [(r[0], r[1]) for r in mine.collect()]    # at most about pattern_bytes
        kept = docs.columns if keep is None or k + 1 < parts else keep
        out = out.mapInArrow(_scanner(patterns, list(names), text_col, kept),
                             out.select(*kept, *names).schema)
        if k + 1 < parts:
            out = stored(out)
    return out


def hit_offsets(text: Column, spans: Column) -> Column:
    """Code-point ranges [from, to) of the hit words in the original text (Python)."""
    @F.udf("array<array<long>>")
    def run(t, ranges):
        if not t or not ranges:
            return []
        at = [m.span() for m in re.finditer(WORD, t.translate(_FOLD))]
        return [[at[lo][0], at[hi - 1][1]] for lo, hi in ranges]
    return run(text, spans)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    found = scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                 items, "text", keep=["id"], **options)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return found.select(
        "id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; the columns stay."""
    names = tuple(fresh_name(docs, c) for c in ("n_words", "hit_spans", "hit_items"))
    found = scan(docs, items, text_col, names=names, **options)
    return found.where(F.size(names[1]) == 0).drop(*names)
