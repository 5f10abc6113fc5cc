"""Exact removal of repeated byte strings by sorting suffixes, deep-shallow.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts at an
earlier place (a smaller id, or an earlier byte of the same document).  Which
strings are equal is decided by suffix sorting, each suffix to a depth of
``LENGTH`` bytes:

* shallow: multikey quicksort on characters of eight bytes, going on to the
  next character inside runs of equal ones only;
* deep: what is still tied after ``SHALLOW`` bytes shares a long prefix and
  is ordered by blind tries, which look only at the byte where the members of
  a node part.  All nodes of one generation are split at once.

Not every suffix is sorted.  Every window of ``LENGTH`` bytes has one anchor,
its ``GRAM``-byte string of smallest hash; equal windows have equal anchors, so
an anchor that occurs once in the corpus cannot belong to a repeat.  Windows
that follow each other with one anchor are a segment.  Segments meet by the
hash of their anchor (8 bytes of hash and a place travel, some 1/40 of the
places); copies of a whole segment are folded onto the earliest, which alone
is sorted and whose result holds for all; the bytes of a segment travel only
if other segments with its anchor are left.  The suffixes of a task are sorted
in pieces that hold all segments of an anchor.

Hot anchors: those that stand out in a sample of the documents are dealt over
salted slices, folded there and folded once more; the sample decides where
rows go, never what is found.  An anchor with more than ``CAP`` different
segments (the edge of a passage in very many documents) is settled by an
aggregate over its windows instead, exactly, without a group in one task.

Odd input: null and short texts have nothing to remove; null ids come before
all others.  Rows with one id are no earlier than each other: rows repeated in
full get the same result, different texts under one id are compared with
smaller ids and with themselves only (they are told apart by 24 bits of a
hash).  Empty tables give no rows; other columns are not read.  Ids are
integers.  Texts have less than 2**31 bytes; long ones are read in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsense.llm.common import blocks, cut, mix64, stored, text_bytes

LENGTH = 100
GRAM = 20
SHALLOW = 16
CAP = 8192
SAMPLE = 64
_HOT_SHARE = 4096       # a hot anchor has more than this part of the sampled segments
_HOT_LEAST = 256
_SALTS = 32
_BLOCK = 1 << 20        # bytes of text that are hashed at once
_PIECE = 1 << 20        # bytes of segments that are sorted at once
_PLACE_BITS = 22
_ODD = 0x9E3779B97F4A7C15
_SEGMENT = "h long, seg long, doc long, at long, gone boolean"


# --- suffix sorting -----------------------------------------------------------

def _words(data: np.ndarray) -> np.ndarray:
    """Every eight bytes of ``data`` as a big-endian number: a view, no copy."""
    return np.ndarray((max(len(data) - 7, 0),), ">u8", buffer=data, strides=(1,))


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for shift in range(8, 64, 8):
        out += x >> np.uint64(shift) == 0
    return out


def _tied(new: np.ndarray) -> np.ndarray:
    """Places that share their run with a neighbour; ``new`` marks where runs begin."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return np.flatnonzero(~alone)


def suffix_order(data: np.ndarray, at: np.ndarray, depth: int = LENGTH,
                 shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the suffixes ``at`` sorted by ``depth`` bytes, and where a value begins.

    ``data`` ends in eight bytes at least after the last suffix's ``depth`` bytes.
    """
    words = _words(data)
    n = len(at)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    char = words[at].astype(np.uint64)
    order = np.argsort(char)
    new = np.ones(n, bool)
    new[1:] = char[order][1:] != char[order][:-1]
    for off in range(8, shallow, 8):
        ties = _tied(new)
        if not len(ties):
            break
        run = np.cumsum(new)[ties]
        char = words[at[order[ties]] + off].astype(np.uint64)
        by = np.lexsort((char, run))
        order[ties] = order[ties][by]
        char, run = char[by], run[by]
        new[ties[1:]] |= (char[1:] != char[:-1]) & (run[1:] == run[:-1])
    _blind_tries(data, words, at, order, new, shallow, depth)
    return order, new


def _blind_tries(data, words, at, order, new, known: int, depth: int) -> None:
    """Order the runs of equal ``known`` bytes by tries, a generation of nodes at a time."""
    ties = _tied(new)
    deep = np.full(len(ties), known, np.int64)
    while len(ties):
        head = new[ties]
        node = np.cumsum(head) - 1
        heads = np.flatnonzero(head)
        mine = at[order[ties]]
        first = mine[heads][node]
        # bytes shared with the node's first member, from what is known
        lcp = np.full(len(ties), depth, np.int64)
        left, off = np.arange(len(ties)), 0
        while len(left):
            left = left[deep[left] + off < depth]
            x = (words[mine[left] + deep[left] + off] ^ words[first[left] + deep[left] + off]
                 ).astype(np.uint64)
            parts = np.flatnonzero(x)
            lcp[left[parts]] = np.minimum(
                depth, deep[left[parts]] + off + _leading_zero_bytes(x[parts]))
            left = left[x == 0]
            off += 8
        branch = np.minimum.reduceat(lcp, heads)
        go = np.flatnonzero(branch[node] < depth)      # other nodes are one value
        ties, node, deep = ties[go], node[go], branch[node[go]]
        char = data[mine[go] + deep]
        by = np.lexsort((char, node))
        order[ties] = order[ties][by]
        char, node = char[by], node[by]                # depth is the node's, the same for all
        new[ties[1:]] |= (char[1:] != char[:-1]) & (node[1:] == node[:-1])
        begins = new[ties]
        alone = begins.copy()
        alone[:-1] &= begins[1:]
        ties, deep = ties[~alone], deep[~alone] + 1


# --- anchors and segments -----------------------------------------------------

def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(
        ([np.uint64(1)], np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64))))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class _Hasher:
    """Hashes of substrings of a block from prefix sums of weighted byte values."""

    def __init__(self) -> None:
        self.values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
        self.size = 0

    def _room(self, n: int) -> None:
        if n > self.size:
            self.size = n + (n >> 2)
            self.power = _powers(_ODD, self.size)
            self.inverse = _powers(pow(_ODD, -1, 1 << 64), self.size)

    def segments(self, data: np.ndarray, valid: np.ndarray, length: int, gram: int):
        """(start, windows, anchor hash, segment hash) of the runs of valid window starts."""
        n = len(data)
        self._room(n)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[:n], out=prefix[1:])
        grams = (prefix[gram:] - prefix[:-gram]) * self.inverse[:n - gram + 1]
        low = np.uint64((1 << _PLACE_BITS) - 1)
        packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        anchor = _sliding_min(packed, length - gram + 1) & low
        starts = np.flatnonzero(valid[:len(anchor)])
        if not len(starts):
            none = np.zeros(0, np.int64)
            return none, none, none, none
        its = anchor[starts].astype(np.int64)
        head = np.ones(len(starts), bool)
        head[1:] = (its[1:] != its[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(starts)))
        start = starts[first]
        end = start + count + length - 1
        seg = mix64((prefix[end] - prefix[start]) * self.inverse[start]
                    + count.astype(np.uint64))
        return start, count, mix64(grams[its[first]]).view(np.int64), seg.view(np.int64)


def _later(doc: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which members of sorted classes have an earlier one.

    Members are sorted by (class, doc, at), ``at`` beginning with the text's
    mark; ``new`` marks where classes begin.
    """
    cls = np.cumsum(new) - 1
    behind = doc != doc[np.flatnonzero(new)][cls]
    own = new.copy()
    own[1:] |= (doc[1:] != doc[:-1]) | ((at[1:] >> 40) != (at[:-1] >> 40))
    first = at[np.flatnonzero(own)][np.cumsum(own) - 1]
    return behind | (at >> 8 != first >> 8)


def _classes(h: np.ndarray, seg: np.ndarray) -> np.ndarray:
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (seg[1:] != seg[:-1])
    return new


def _runs(start: np.ndarray, count: np.ndarray, same: np.ndarray
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows put together where they follow each other: (index, start, count)."""
    if not len(start):
        return np.zeros(0, np.int64), start, count
    head = np.ones(len(start), bool)
    head[1:] = ~same[1:] | (start[1:] != start[:-1] + count[:-1])
    first = np.flatnonzero(head)
    total = np.add.reduceat(count, first)
    parts = -(-total // 255)                     # a run's length travels in a byte
    index = np.repeat(first, parts)
    nth = np.arange(len(index)) - np.repeat(np.cumsum(parts) - parts, parts)
    return index, start[index] + 255 * nth, np.minimum(255, np.repeat(total, parts) - 255 * nth)


def _segment_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            docs = batch.column("doc").to_numpy()
            marks = batch.column("mark").to_numpy().astype(np.int64)
            for i, j in blocks(offsets, _BLOCK):
                lo, hi = int(offsets[i]), int(offsets[j])
                for a in range(lo, max(hi - length + 1, lo + 1), _BLOCK if j == i + 1 else hi + 1):
                    b = min(hi, a + _BLOCK + length - 1) if j == i + 1 else hi
                    if b - a < length:
                        continue
                    ends = np.minimum(offsets[i + 1:j + 1], b) - a
                    sizes = np.diff(np.concatenate(([0], ends)))
                    valid = np.repeat(ends, sizes) - np.arange(b - a) >= length
                    start, count, h, seg = hasher.segments(data[a:b], valid, length, gram)
                    its = i + np.searchsorted(ends, start, side="right")
                    doc = docs[its]
                    place = (marks[its] << 40) | ((start + a - offsets[its]) << 8)
                    by = np.lexsort((place, doc, seg, h))
                    gone = np.zeros(len(h), bool)
                    gone[by] = _later(doc[by], place[by], _classes(h[by], seg[by]))
                    stay = ~gone
                    yield _batch(h[stay], seg[stay], doc[stay], place[stay] | count[stay], False)
                    if gone.any():
                        its, start, count = its[gone], start[gone], count[gone]
                        same = np.concatenate(([False], its[1:] == its[:-1]))
                        k, start, count = _runs(start, count, same)
                        its = its[k]
                        zero = np.zeros(len(k), np.int64)
                        yield _batch(zero, zero, docs[its], (marks[its] << 40)
                                     | ((start + a - offsets[its]) << 8) | count, True)
    return run


def _batch(h, seg, doc, at, gone: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(h, pa.int64()), pa.array(seg, pa.int64()), pa.array(doc, pa.int64()),
         pa.array(at, pa.int64()), pa.array(np.full(len(h), gone))],
        names=["h", "seg", "doc", "at", "gone"])


def _whole(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None,
           size: str | None = None) -> Iterator[pa.Table]:
    """Sorted rows in tables that hold every value of ``key`` whole.

    With ``most``, a table ends at the first change of the key after that many
    bytes of the column ``size``.
    """
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        k = held.column(key).to_numpy()
        change = np.flatnonzero(k[1:] != k[:-1]) + 1
        done = 0
        if most is None:
            ends = change[-1:]
        else:
            so_far = np.cumsum([0, *(len(x) for x in held.column(size).to_pylist())])
            ends, last = [], 0
            for c in change:
                if so_far[c] - so_far[last] >= most:
                    ends.append(c)
                    last = c
        for end in ends:
            yield held.slice(done, end - done)
            done = int(end)
        held = held.slice(done)
    if held is not None and held.num_rows:
        yield held


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (p, h, seg, doc, at): copies of segments, and what has to be sorted.

    ``kind`` 0: windows that have an earlier copy; 1: segments that share
    their anchor with others; 2: earliest copies of a slice of a hot anchor.
    """
    for table in _whole(batches, "p"):
        p, h, seg, doc, at = (table.column(c).to_numpy() for c in ("p", "h", "seg", "doc", "at"))
        hot, gone = (table.column(c).to_numpy(zero_copy_only=False) for c in ("hot", "gone"))
        head = np.ones(len(p), bool)
        head[1:] = p[1:] != p[:-1]
        new = head | _classes(h, seg)
        done = gone | (_later(doc, at, new) & ~gone)
        left = np.add.reduceat((~done).astype(np.int64), np.flatnonzero(head))
        some = left[np.cumsum(head) - 1] > 1
        kind = np.where(done, 0, np.where(hot, 2, np.where(some, 1, -1)))
        out = kind >= 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind[out].astype(np.int32)), *(pa.array(x[out]) for x in (h, doc, at, seg))],
            names=["kind", "h", "doc", "at", "seg"])


def _cut_segments(length: int):
    """The bytes of the wanted segments of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            docs = batch.column("doc").to_numpy()
            raw = data.tobytes()
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                got = []
                for w in wanted:
                    lo = int(offsets[i]) + ((w["at"] >> 8) & 0xFFFFFFFF)
                    got.append(raw[lo:lo + (w["at"] & 255) + length - 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["h"] for w in wanted], pa.int64()),
                     pa.array([w["big"] for w in wanted], pa.bool_()),
                     pa.array(np.full(len(got), docs[i]), pa.int64()),
                     pa.array([w["at"] for w in wanted], pa.int64()), pa.array(got, pa.binary())],
                    names=["h", "big", "doc", "at", "bytes"])
    return run


def _sorted_repeats(length: int):
    """Windows of the segments of a task that occur earlier in another, by suffix sorting."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, "h", _PIECE, "bytes"):
            parts = table.column("bytes").to_pylist()
            doc, at = (table.column(c).to_numpy() for c in ("doc", "at"))
            data = np.frombuffer(b"".join([*parts, bytes(16)]), np.uint8)
            sizes = np.array([len(x) for x in parts], np.int64)
            windows = sizes - (length - 1)
            row = np.repeat(np.arange(len(parts)), windows)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            order, new = suffix_order(data, (np.cumsum(sizes) - sizes)[row] + nth, length)
            ties = _tied(new)
            its = order[ties]
            value = np.cumsum(new)[ties]
            place = (at[row[its]] & ~255) + (nth[its] << 8)
            by = np.lexsort((place, doc[row[its]], value))
            its, value, place = its[by], value[by], place[by]
            first = np.ones(len(its), bool)
            first[1:] = value[1:] != value[:-1]
            gone = np.sort(its[_later(doc[row[its]], place, first)])
            own = row[gone]
            same = np.concatenate(([False], own[1:] == own[:-1])) if len(own) else own > 0
            k, start, count = _runs(nth[gone], np.ones(len(gone), np.int64), same)
            own = own[k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[own]), pa.array((at[own] & ~255) + (start << 8) + count)],
                names=["doc", "at"])
    return run


def _open_windows(length: int):
    """Every window of a segment by its digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, at, raw in zip(*(batch.column(c).to_pylist()
                                      for c in ("doc", "at", "bytes"))):
                n = len(raw) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.md5(raw[k:k + length]).digest() for k in range(n)],
                              pa.binary()),
                     pa.array([doc] * n, pa.int64()),
                     pa.array([(at & ~255) + (k << 8) + 1 for k in range(n)], pa.int64())],
                    names=["key", "doc", "at"])
    return run


def _repeats_of_hot(windows: DataFrame) -> DataFrame:
    """(doc, at) of the windows that occur earlier, by aggregates over their digests."""
    mark, start = F.shiftright("at", 40), F.shiftright("at", 8)
    own = windows.groupBy("key", "doc", mark.alias("mark")).agg(
        F.min(start).alias("begins"), F.max(start).alias("ends"))
    # values seen once drop out here, so the salted copies are few
    least = (own.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most"),
                                    F.max(F.col("begins") != F.col("ends")).alias("twice"))
             .where("least <> most or twice")
             .select("key", "least", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
                     .alias("salt")))
    salted = own.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(_SALTS)).cast("int"))
    known = salted.join(least, ["key", "salt"]).where("doc > least or begins <> ends")
    return (windows.withColumn("mark", mark).join(
        known.select("key", "doc", "mark", "least", "begins"), ["key", "doc", "mark"])
        .where((F.col("doc") > F.col("least")) | (start > F.col("begins")))
        .select("doc", "at"))


def _assemble(length: int):
    """Removed runs and remaining bytes of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            raw = data.tobytes()
            spans, kept, sizes = [], [], np.diff(offsets)
            for i, ats in enumerate(batch.column("ats").to_pylist()):
                lo, size = int(offsets[i]), int(sizes[i])
                found, left, at = [], [], 0
                if ats:
                    v = np.array(ats, np.int64)
                    start, count = (v >> 8) & 0xFFFFFFFF, v & 255
                    by = np.argsort(start, kind="stable")
                    start, end = start[by], (start + count + length - 1)[by]
                    far = np.maximum.accumulate(end)
                    head = np.ones(len(start), bool)
                    head[1:] = start[1:] > far[:-1]
                    first = np.flatnonzero(head)
                    found = list(zip(start[first].tolist(), far[np.append(
                        first[1:] - 1, len(far) - 1)].tolist()))
                for a, b in found:
                    left.append(raw[lo + at:lo + a])
                    at = b
                left.append(raw[lo + at:lo + size])
                spans.append([{"begin": a, "end": b} for a, b in found])
                kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes), pa.array(
                    spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "spans", "kept"])
    return run


def repeated_windows(rows: DataFrame, length: int = LENGTH, gram: int = GRAM,
                     cap: int = CAP) -> DataFrame:
    """(doc, at) of the runs of windows of ``rows`` (doc, mark, text) that occur earlier."""
    segments = rows.select("doc", "mark", "text").mapInArrow(
        _segment_rows(length, gram), _SEGMENT)
    some = (rows.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)
            .select("doc", "mark", "text").mapInArrow(_segment_rows(length, gram), _SEGMENT))
    counts = cut(some.where("not gone").groupBy("h").count())
    seen = counts.agg(F.sum("count")).first()[0] or 0
    # fewer than _HOT_SHARE values by construction
    hot = counts.where(F.col("count") > max(_HOT_LEAST, seen // _HOT_SHARE)).select(
        "h", F.lit(True).alias("is_hot"))
    dealt = segments.join(F.broadcast(hot), "h", "left").withColumn(
        "hot", F.coalesce("is_hot", F.lit(False)) & ~F.col("gone")).withColumn(
        "p", F.when(F.col("gone"), F.xxhash64("doc", "at"))
        .when(F.col("hot"), F.xxhash64("h", "seg", F.pmod(F.xxhash64("doc"), F.lit(_SALTS))))
        .otherwise(F.col("h"))).drop("is_hot")
    marks = stored(dealt.repartition("p").sortWithinPartitions("p", "h", "seg", "doc", "at")
                   .mapInArrow(_fold, "kind int, h long, doc long, at long, seg long"))

    # earliest copies of the slices of hot anchors: at most a slice's number a segment
    each = Window.partitionBy("h", "seg")
    slices = marks.where("kind = 2").withColumn("least", F.min("doc").over(each)).withColumn(
        "begins", F.min(F.shiftright("at", 8)).over(
            Window.partitionBy("h", "seg", "doc", F.shiftright("at", 40))))
    behind = (F.col("doc") > F.col("least")) | (F.shiftright("at", 8) > F.col("begins"))
    leads = marks.where("kind = 1").select("h", "doc", "at").union(
        slices.where(~behind).select("h", "doc", "at"))
    sizes = leads.groupBy("h").count().where("count > 1").select(
        "h", (F.col("count") > cap).alias("big"))
    wanted = (leads.join(sizes, "h").groupBy("doc", F.shiftright("at", 40).alias("mark"))
              .agg(F.collect_list(F.struct("h", "at", "big")).alias("wanted")))
    pieces = stored(rows.select("doc", "mark", "text").join(wanted, ["doc", "mark"])
                    .select("doc", "text", "wanted").mapInArrow(
                        _cut_segments(length), "h long, big boolean, doc long, at long, bytes binary"))
    by_sorting = (pieces.where("not big").select("h", "doc", "at", "bytes")
                  .repartition("h").sortWithinPartitions("h")
                  .mapInArrow(_sorted_repeats(length), "doc long, at long"))
    by_digest = _repeats_of_hot(pieces.where("big").select("doc", "at", "bytes").mapInArrow(
        _open_windows(length), "key binary, doc long, at long"))
    return (marks.where("kind = 0").select("doc", "at")
            .union(slices.where(behind).select("doc", "at"))
            .union(by_sorting).union(by_digest))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                length: int = LENGTH, gram: int = GRAM, cap: int = CAP) -> DataFrame:
    """(id, n_bytes, spans, kept): removed runs and remaining bytes of every row.

    ``spans`` are (begin, end) in bytes, apart from each other; ``kept`` is
    binary, as a removed run may end inside a character.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-1 << 63)).alias("doc"),
        F.shiftright(F.xxhash64(F.col(f"`{text_col}`")), 40).alias("mark"),
        F.col(f"`{text_col}`").alias("text"))
    found = repeated_windows(rows.where("text is not null"), length, gram, cap)
    runs = found.groupBy("doc", F.shiftright("at", 40).alias("mark")).agg(
        F.collect_list("at").alias("ats"))
    return (rows.join(runs, ["doc", "mark"], "left").select("id", "text", "ats")
            .mapInArrow(_assemble(length),
                        "id long, n_bytes long, spans array<struct<begin:long,end:long>>, "
                        "kept binary"))
