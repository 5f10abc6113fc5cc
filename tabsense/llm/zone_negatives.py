"""Hard negatives from Hilbert-ordered Parquet blocks with min/max zone maps.

Vectors are turned to integers and sorted along a Hilbert curve through all
dimensions, so rows near each other in the file are near each other in space.
The sorted rows are written as Parquet units of ``UNIT_ROWS`` rows, every unit
with the smallest and largest value of every dimension (and label) of each of
its blocks of ``BLOCK_ROWS`` rows: the zone maps.

An inner product with a vector lies between two sums over the dimensions that
interval arithmetic gives from a zone.  Two searches use these bounds to choose
the blocks that are read at all:

1. the nearest rows of an anchor's own label: blocks whose upper bound reaches
   the score that the anchor's own unit has already to offer;
2. rows of other labels whose score lies in the window under each of these:
   blocks whose bounds meet one of the anchor's windows.

Zone maps are read without the vectors (column pruning), anchors go in groups,
and a unit's vectors are joined only with the groups that chose it.  Scores
are integers and exact.  Every (anchor, unit) pair gives a handful of rows at
most, which a window keeps the best of.

Odd input: rows with a null id, a null label, a null vector or any null or
non-finite component take no part; rows repeated with id, label and vector
count once; rows that share an id only are rows of their own.  Vectors of
different lengths are compared as if the missing components were 0.
Components are taken to lie within +-2**27 after scaling and set to that bound
beyond.  An anchor without a positive, or without a row in the window, gives
no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsense.llm.common import cut, stored

UNIT_ROWS = 4096
BLOCK_ROWS = 128
GROUP_ANCHORS = 256
SHELF = 64
_PEAK = 1 << 27
_KEY_BITS = 256
_LEAST = -(1 << 63)

_UNIT = ("unit long, ids binary, labels binary, q binary, zones binary, "
         "a_uid binary, a_id binary, a_label binary, a_q binary, a_seed binary")
_GROUP = ("uids binary, ids binary, labels binary, q binary, seeds binary, "
          "p_id binary, p_score binary")
_HIT = "uid long, anchor_id long, row long, id long, score long"


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Index along the Hilbert curve of every row of ``cells`` (n x d, below 2**bits).

    Skilling's transform: undo the rotations from the highest bit down, Gray
    encode, then interleave the bits of the dimensions.
    """
    x = cells.T.astype(np.int64)
    d = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            hit = (x[i] >> b) & 1 == 1
            swap = (x[0] ^ x[i]) & low
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= np.where(hit, 0, swap)
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    planes = np.concatenate([(x >> b) & 1 for b in range(bits - 1, -1, -1)]).astype(np.uint8)
    return [r.tobytes() for r in np.ascontiguousarray(np.packbits(planes, axis=0).T)]


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray,
           slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of every row of ``a`` with a point of every zone."""
    up, down = np.maximum(a, 0.0), np.minimum(a, 0.0)
    return (up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack)


def products(a: np.ndarray, b: np.ndarray, exact_float: bool) -> np.ndarray:
    """Integer inner products; through floats only where these are exact."""
    if exact_float:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= edge)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def _matrix(values: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list array as an int32 matrix, short rows filled with 0."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    n = np.asarray(values.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(n), dim), np.int32)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat))
        - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _binary(arrays: list[np.ndarray | None]) -> pa.Array:
    return pa.array([None if a is None else np.ascontiguousarray(a).tobytes() for a in arrays],
                    pa.binary())


def _ints(blob: bytes, dtype=np.int64) -> np.ndarray:
    return np.frombuffer(blob, dtype)


def _curve(dim: int, peak: int):
    bits = max(1, min(4, _KEY_BITS // max(dim, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("q"), dim).astype(np.int64)
            cells = (q + peak) * (1 << bits) // (2 * peak + 1)
            keys = hilbert_keys(cells, bits) if dim else [b""] * len(q)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())],
                                             names=["id", "label", "q", "curve"])
    return run


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of ``most`` rows (the last one shorter)."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        while held.num_rows >= most:
            yield held.slice(0, most)
            held = held.slice(most)
    if held is not None and held.num_rows:
        yield held


def _pack(dim: int, anchor_every: int, positives: int, float_ok: bool):
    """Sorted rows to units with zone maps, and the anchors among them with a first offer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        last = None
        for table in _pieces(batches, UNIT_ROWS):
            ids = table.column("id").to_numpy()
            labels = table.column("label").to_numpy()
            q = _matrix(table.column("q"), dim)
            keep = np.ones(len(ids), bool)      # repeated rows lie side by side
            keep[1:] = ((ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1])
                        | (q[1:] != q[:-1]).any(axis=1))
            keep[0] = last != (ids[0], labels[0], q[0].tobytes())
            last = ids[-1], labels[-1], q[-1].tobytes()
            if not keep.any():
                continue
            ids, labels, q = ids[keep], labels[keep], q[keep]
            full = np.concatenate((q, labels[:, None].astype(np.int64)), axis=1)
            at = np.arange(0, len(full), BLOCK_ROWS)
            zones = np.stack((np.minimum.reduceat(full, at), np.maximum.reduceat(full, at)))
            mine = np.flatnonzero(ids % anchor_every == 0)
            uid = (number << 13) + mine
            seeds = np.full(len(mine), _LEAST)
            if len(mine):
                scores = products(q[mine], q, float_ok)
                for r, m in enumerate(mine):
                    own = scores[r][(labels == labels[m]) & (np.arange(len(ids)) != m)]
                    if len(own) >= positives:
                        seeds[r] = np.partition(own, len(own) - positives)[len(own) - positives]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), *(_binary([x]) for x in (
                    ids, labels.astype(np.int64), q, zones, uid, ids[mine],
                    labels[mine].astype(np.int64), q[mine], seeds))],
                names=[c.split(" ")[0] for c in _UNIT.split(", ")])
            number += 1
    return run


def _open_anchors(dim: int):
    """The anchors of every unit, one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uid = _ints(row["a_uid"])
                if len(uid):
                    q = _ints(row["a_q"], np.int32).reshape(len(uid), dim)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(uid), pa.array(_ints(row["a_id"])),
                         pa.array(_ints(row["a_label"])),
                         pa.array([v.tobytes() for v in q], pa.binary()),
                         pa.array(_ints(row["a_seed"]))],
                        names=["uid", "id", "label", "q", "seed"])
    return run


def _group(positives: int):
    """Anchors in groups, a row each; windows without an entry hold the smallest long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _pieces(batches, GROUP_ANCHORS):
            n = table.num_rows
            p_id = np.full((n, positives), _LEAST)
            p_score = np.full((n, positives), _LEAST)
            for i, ps in enumerate(table.column("positives").to_pylist()):
                for j, p in enumerate(ps or []):
                    p_id[i, j], p_score[i, j] = p["id"], p["score"]
            cols = [table.column(c).to_numpy().astype(np.int64) for c in ("uid", "id", "label")]
            q = np.frombuffer(b"".join(table.column("q").to_pylist()), np.int32)
            yield pa.RecordBatch.from_arrays(
                [_binary([x]) for x in (*cols, q, table.column("seed").to_numpy(),
                                        p_id, p_score)],
                names=[c.split(" ")[0] for c in _GROUP.split(", ")])
    return run


def _wanted(low: np.ndarray, high: np.ndarray, zl: np.ndarray, zh: np.ndarray, group: dict,
            n: int, share: tuple[int, int] | None) -> np.ndarray:
    """Which blocks every anchor of a group has to read (anchors x blocks)."""
    if share is None:
        labels = _ints(group["labels"])[:, None]
        seeds = _ints(group["seeds"])[:, None].astype(np.float64)
        return (high >= seeds) & (zl[None, :, -1] <= labels) & (labels <= zh[None, :, -1])
    ps = _ints(group["p_score"]).reshape(n, -1)
    want = np.zeros(low.shape, bool)
    for j in range(ps.shape[1]):
        top = ps[:, j:j + 1].astype(np.float64)
        want |= (ps[:, j:j + 1] >= 0) & (share[1] * high >= share[0] * top) & (low <= top)
    return want


def _choose(dim: int, share: tuple[int, int] | None, slack: float):
    """The bounds test: (unit, group, blocks) of what has to be read."""
    names = [c.split(" ")[0] for c in _GROUP.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                zones = _ints(row["zones"]).reshape(2, -1, dim + 1)
                a = _ints(row["q"], np.int32).reshape(-1, dim).astype(np.float64)
                low, high = bounds(a, zones[0][:, :dim].astype(np.float64),
                                   zones[1][:, :dim].astype(np.float64), slack)
                want = _wanted(low, high, zones[0], zones[1], row, len(a), share)
                some = np.flatnonzero(want.any(axis=1))
                if not len(some):
                    continue
                cols = []
                for c in names:
                    kind = np.int32 if c == "q" else np.int64
                    cols.append(_binary([_ints(row[c], kind).reshape(len(a), -1)[some]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["unit"]]), *cols, _binary([want.any(axis=0)])],
                    names=["unit", *names, "blocks"])
    return run


def _opened(row: dict, dim: int, float_ok: bool):
    """Rows of the chosen blocks of a unit and their scores with the anchors of a group."""
    blocks = _ints(row["blocks"], np.bool_)
    ids = _ints(row["u_ids"])
    read = np.repeat(blocks, BLOCK_ROWS)[:len(ids)]
    at = np.flatnonzero(read)
    a = _ints(row["q"], np.int32).reshape(-1, dim)
    scores = products(a, _ints(row["u_q"], np.int32).reshape(-1, dim)[at], float_ok)
    return at, ids[at], _ints(row["u_labels"])[at], scores


def _score_positives(dim: int, positives: int, float_ok: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, ids, labels, scores = _opened(row, dim, float_ok)
                out = []
                own, a_ids = _ints(row["uids"]), _ints(row["ids"])
                for r, label in enumerate(_ints(row["labels"])):
                    near = np.flatnonzero((labels == label)
                                          & ((row["unit"] << 13) + at != own[r]))
                    for k in near[best(scores[r][near], ids[near], positives)]:
                        out.append((int(own[r]), int(a_ids[r]), (row["unit"] << 13) + int(at[k]),
                                    int(ids[k]), int(scores[r, k])))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*out)],
                        names=[c.split(" ")[0] for c in _HIT.split(", ")])
    return run


def _score_negatives(dim: int, keep: int, share: tuple[int, int], float_ok: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, ids, labels, scores = _opened(row, dim, float_ok)
                own, a_ids = _ints(row["uids"]), _ints(row["ids"])
                p_score = _ints(row["p_score"]).reshape(len(own), -1)
                out = []
                for r, label in enumerate(_ints(row["labels"])):
                    tops = p_score[r][p_score[r] >= 0]
                    if not len(tops):
                        continue
                    s = scores[r]
                    some = np.flatnonzero((labels != label) & (s <= tops.max())
                                          & (share[1] * s >= share[0] * tops.min()))
                    for j in np.flatnonzero(p_score[r] >= 0):
                        top = p_score[r, j]
                        fit = some[(s[some] <= top) & (share[1] * s[some] >= share[0] * top)]
                        for k in fit[best(s[fit], ids[fit], keep)]:
                            out.append((int(own[r]), int(a_ids[r]), int(j),
                                        int(ids[k]), int(s[k])))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*out)],
                        names=[c.split(" ")[0] for c in _HIT.split(", ")])
    return run


def quantised(rows: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(id, label, q) of the rows that take part, components as scaled integers."""
    x = F.col(f"`{vec_col}`")
    whole = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)
                                & (F.abs(v) < float("inf"))), F.lit(False))
    scaled = F.transform(x, lambda v: F.greatest(F.lit(float(-_PEAK)), F.least(
        F.lit(float(_PEAK)), F.floor(v.cast("double") * 256).cast("double"))).cast("int"))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                       label.cast("long").alias("label"),
                       F.when(whole, scaled).alias("q")).where(
        "id is not null and label is not null and q is not null")


class Blocks:
    """Units written along the curve, their zone maps, and the anchors among them."""

    def __init__(self, points: DataFrame, anchor_every: int, positives: int):
        size = points.agg(F.max(F.size("q")).alias("dim"), F.max(F.greatest(
            F.abs(F.array_max("q")), F.abs(F.array_min("q")))).alias("peak")).first()
        self.dim, peak = size["dim"] or 0, max(size["peak"] or 0, 1)
        largest = self.dim * peak * peak
        self.float_ok = largest < 1 << 53
        self.slack = 0.0 if self.float_ok else largest * 2.0 ** -48
        self.positives = positives
        on_curve = points.mapInArrow(_curve(self.dim, peak),
                                     "id long, label long, q array<int>, curve binary")
        order = ["curve", "id", "label", "q"]
        self.units = stored(on_curve.repartitionByRange(*order).sortWithinPartitions(*order)
                            .mapInArrow(_pack(self.dim, anchor_every, positives, self.float_ok),
                                        _UNIT))
        self.anchors = cut(self.units.select("a_uid", "a_id", "a_label", "a_q", "a_seed")
                           .mapInArrow(_open_anchors(self.dim),
                                       "uid long, id long, label long, q binary, seed long"))
        shelves = max(1, -(-self.units.count() // SHELF))
        self.shelves = shelves
        self.zones = self.units.select("unit", "zones", F.pmod(
            F.xxhash64("unit"), F.lit(shelves)).alias("shelf"))

    def search(self, windows: DataFrame | None, share: tuple[int, int] | None, scorer
               ) -> DataFrame:
        """Hits of the anchors (with the windows in ``windows``) in the blocks they choose."""
        none = F.lit(None).cast("array<struct<id:long,score:long>>")
        rows = (self.anchors.withColumn("positives", none) if windows is None
                else self.anchors.join(windows, "uid"))
        groups = cut(rows.repartitionByRange("uid").sortWithinPartitions("uid")
                     .mapInArrow(_group(self.positives), _GROUP))
        # every group meets every zone map, a shelf of zone maps at a time
        tested = groups.withColumn("shelf", F.explode(F.sequence(
            F.lit(0).cast("long"), F.lit(self.shelves - 1).cast("long"))))
        chosen = (tested.join(self.zones, "shelf").drop("shelf")
                  .mapInArrow(_choose(self.dim, share, self.slack),
                              f"unit long, {_GROUP}, blocks binary"))
        vectors = self.units.select("unit", F.col("ids").alias("u_ids"),
                                    F.col("labels").alias("u_labels"), F.col("q").alias("u_q"))
        return chosen.join(vectors, "unit").mapInArrow(scorer, _HIT)


def mine(rows: DataFrame, label: Column, id_col: str = "vec_id", vec_col: str = "embedding",
         anchor_every: int = 100, positives: int = 5, negatives: int = 5,
         share: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id ``anchor_every`` divides; a negative's score
    lies between ``share[0] / share[1]`` of the positive's score and that score.
    """
    blocks = Blocks(quantised(rows, id_col, vec_col, label), anchor_every, positives)
    nearest = Window.partitionBy("uid").orderBy(F.col("score").desc(), "id", "row")
    found = cut(blocks.search(None, None, _score_positives(
        blocks.dim, positives, blocks.float_ok))
        .withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= positives))
    windows = found.groupBy("uid").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("nth", "id", "score"))),
        lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives"))
    hits = blocks.search(windows, share, _score_negatives(
        blocks.dim, negatives, share, blocks.float_ok))
    by_window = Window.partitionBy("uid", "row").orderBy(F.col("score").desc(), "id")
    ranked = (hits.withColumn("rank", F.row_number().over(by_window))
              .where(F.col("rank") <= negatives))
    return ranked.join(found.select("uid", (F.col("nth") - 1).cast("long").alias("row"),
                                    F.col("id").alias("positive_id"),
                                    F.col("score").alias("positive_score")), ["uid", "row"]
                       ).select("anchor_id", "positive_id", F.col("rank").cast("int"),
                                F.col("id").alias("negative_id"), "positive_score",
                                F.col("score").alias("negative_score"))
