"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A document is the weighted set of its five-word shingles (the whole word
sequence when it has fewer than five words, but some); a shingle that occurs
``c`` times weighs ``1 + ln(c) / 4``.  The similarity is the probability Jaccard

    J_P(x, y) = sum_i 1 / sum_j max(x_j / x_i, y_j / y_i)

over the common shingles ``i``; with equal weights it is the Jaccard index.
Two texts are linked when it, or the Jaccard index of their plain shingle
sets, reaches the threshold.

1. Equal texts are folded into one representative (the smallest id).
2. ProbMinHash: shingle ``d`` is a Poisson process of rate ``w(d)`` seeded by
   its hash; each arrival names a random register, a register keeps its
   earliest arrival, and a shingle stops once its next arrival lies beyond
   the document's latest register.  Two registers agree with probability J_P.
   A text with repeated shingles is sketched once more with equal weights:
   those registers agree with the probability of the plain Jaccard index.
3. Bands of registers are bucketed.  Inside a bucket the registers of its
   members are compared, and those that agree often enough (4 standard
   deviations below the threshold) join a cluster.
4. Inside a cluster the exact similarity decides; the classes are the
   connected components of the pairs that reach the threshold.

Steps 3 and 4 compare inside a task and give only a spanning forest of what
they find: a member is compared with those it is not yet connected to, so a
tight group costs little more than one round, and no list of pairs is ever
made.  Buckets and clusters are cut into blocks of bounded size; those with
several blocks are compared once more block against block, members of
different parts only, so nothing is capped and nothing is lost.

Null texts are in a class of their own each; texts without words only join
equal texts.  Repeated rows (same id, same text) share a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import (blocks, cut, fresh_name, mix64, stored, text_bytes, text_key,
                                 word_hashes)
from tabsense.llm.components import connected

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
_BLOCK_BYTES = 2 << 20


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """(document, shingle hash, weight) of every distinct shingle, by document and hash."""
    words, first = word_hashes(data, offsets)
    counts = np.diff(first)
    n_sh = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    total = int(n_sh.sum())
    doc = np.repeat(np.arange(len(counts)), n_sh)
    at = np.repeat(first[:-1], n_sh) + np.arange(total) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh)
    have = np.minimum(np.repeat(counts, n_sh), size)
    h = np.zeros(total, np.uint64)
    for k in range(size):
        more = have > k
        h[more] = mix64(h[more] * np.uint64(3) + words[at[more] + k] + np.uint64(k + 1))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(total, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    head = np.flatnonzero(new)
    times = np.diff(np.append(head, total))
    return doc[head], h[head], 1.0 + np.log(times) / 4


def prob_minhash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, docs: int,
                 size: int) -> np.ndarray:
    """Registers (docs x size) of winning items; documents without items keep zeros."""
    best = np.full(docs * size, np.inf)
    won = np.zeros(docs * size, np.uint64)
    time = np.zeros(len(doc))
    step = 0
    while len(doc):
        step += 1
        r = mix64(item + np.uint64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((r >> np.uint64(12)).astype(np.float64) + 0.5)
                             / float(1 << 52)) / weight
        register = (mix64(r ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(size)).astype(np.int64)
        slot = doc * size + register
        np.minimum.at(best, slot, time)
        wins = best[slot] == time
        won[slot[wins]] = item[wins]
        last = best.reshape(docs, size).max(axis=1)
        go = time < last[doc]
        doc, item, weight, time = doc[go], item[go], weight[go], time[go]
    return won.reshape(docs, size)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray],
                        b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted sets given as (sorted items, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    items = np.union1d(a[0], b[0])
    x, y = np.zeros(len(items)), np.zeros(len(items))
    x[np.searchsorted(items, a[0])] = a[1]
    y[np.searchsorted(items, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    xs, ys, rs = x[order], y[order], ratio[order]
    below = np.concatenate(([0.0], np.cumsum(ys)))
    above = np.concatenate((np.cumsum(xs[::-1])[::-1], [0.0]))
    both = (xs > 0) & (ys > 0)
    cutoff = np.searchsorted(rs, rs[both], side="left")
    return float(np.sum(xs[both] / (above[cutoff] + rs[both] * below[cutoff])))


def _bands(regs: np.ndarray, rows: int, some: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Bucket keys and short registers of the documents in ``some``; none for the others."""
    keys = regs.reshape(len(regs), regs.shape[1] // rows, rows)
    h = np.broadcast_to(np.arange(keys.shape[1], dtype=np.uint64), keys.shape[:2])
    for k in range(rows):
        h = mix64(h * np.uint64(5) + keys[:, :, k] + np.uint64(1))
    ends = np.concatenate(([0], np.cumsum(some) * keys.shape[1]))
    short = (regs >> np.uint64(48)).astype(np.uint16)
    return (pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                     pa.array(h[some].reshape(-1).view(np.int64))),
            pa.array([r.tobytes() if ok else None for r, ok in zip(short, some)], pa.binary()))


def _sketch(size: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in blocks(offsets, _BLOCK_BYTES):
                lo = offsets[i:j + 1]
                doc, item, weight = weighted_shingles(data[lo[0]:lo[-1]], lo - lo[0])
                some = np.zeros(j - i, bool)
                some[doc] = True
                many = np.zeros(j - i, bool)       # documents with a repeated shingle
                many[doc[weight > 1.0]] = True
                also = many[doc]
                buckets, sketch = _bands(prob_minhash(doc, item, weight, j - i, size), rows, some)
                flat, flat_sketch = _bands(prob_minhash(
                    doc[also], item[also], np.ones(int(also.sum())), j - i, size), rows, many)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, j - i) for c in ("uid", "id", "key")]
                    + [buckets, sketch, flat, flat_sketch],
                    names=["uid", "id", "key", "buckets", "sketch", "plain_buckets",
                           "plain_sketch"])
    return run


def forest(part: np.ndarray, match) -> list[tuple[int, int]]:
    """Edges that join parts of 0..n-1: ``match(i, js)`` says which of ``js`` go with ``i``.

    Every pair of members is compared unless they are connected already.
    """
    part, edges = part.copy(), []
    for i in range(len(part) - 1):
        js = i + 1 + np.flatnonzero(part[i + 1:] != part[i])
        if not len(js):
            continue
        found = js[match(i, js)]
        if len(found):
            parts, first = np.unique(part[found], return_index=True)
            edges += [(i, int(found[k])) for k in first]
            part[np.isin(part, parts)] = part[i]
    return edges


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows again, each cell (cell, block) whole in one table."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        cell, block = (table.column(c).to_numpy() for c in ("cell", "block"))
        if not len(cell):
            continue
        last = int(np.flatnonzero((cell != cell[-1]) | (block != block[-1]))[-1]) + 1 \
            if (cell[0], block[0]) != (cell[-1], block[-1]) else 0
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None and held.num_rows:
        yield held


def _forests(matcher):
    """A task function: spanning forests of the sorted cells it gets, as (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            cell, block, uid, part = (table.column(c).to_numpy()
                                      for c in ("cell", "block", "uid", "part"))
            new = np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1])) + 1
            match = matcher(table.column("payload"))
            a, b = [], []
            for lo, hi in zip(np.append(0, new).tolist(), np.append(new, len(cell)).tolist()):
                if hi - lo > 1:
                    for i, j in forest(part[lo:hi], match(lo, hi)):
                        a.append(uid[lo + i])
                        b.append(uid[lo + j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _sketch_matcher(size: int, least: int):
    def matcher(payload):
        rows = np.frombuffer(b"".join(payload.to_pylist()), np.uint16).reshape(-1, size)
        return lambda lo, hi: lambda i, js: (
            (rows[lo + js] == rows[lo + i]).sum(axis=1) >= least)
    return matcher


def _text_matcher(threshold: float):
    def matcher(payload):
        data, offsets = text_bytes(payload)

        def cell(lo: int, hi: int):
            at = offsets[lo:hi + 1]
            doc, item, weight = weighted_shingles(data[at[0]:at[-1]], at - at[0])
            _, item = np.unique(item, return_inverse=True)
            ends = np.searchsorted(doc, np.arange(hi - lo + 1))
            total = np.add.reduceat(np.append(weight, 0.0), ends[:-1])
            count = np.diff(ends)
            plain = np.maximum.reduceat(np.append(weight, 0.0), ends[:-1]) == 1.0
            mine = np.zeros(item.max() + 1 if len(item) else 1)

            def match(i: int, js: np.ndarray) -> np.ndarray:
                own = slice(ends[i], ends[i + 1])
                mine[item[own]] = weight[own]
                got = mine[item]
                # J_P is at most the share of either side's weight that is common
                theirs = np.add.reduceat(np.append(np.where(got > 0, weight, 0.0), 0.0),
                                         ends[:-1])[js]
                ours = np.add.reduceat(np.append(got, 0.0), ends[:-1])[js]
                both = np.add.reduceat(np.append(got > 0, 0), ends[:-1], dtype=np.int64)[js]
                mine[item[own]] = 0.0
                ok = both >= threshold * (count[js] + count[i] - both) - 1e-9
                maybe = ((theirs >= threshold * total[js] - 1e-9)
                         & (ours >= threshold * total[i] - 1e-9)
                         & ~(plain[js] & plain[i]))   # equal weights: no other value
                for k in np.flatnonzero(maybe & ~ok):
                    other = slice(ends[js[k]], ends[js[k] + 1])
                    a, b = np.argsort(item[own]), np.argsort(item[other])
                    ok[k] = probability_jaccard(
                        (item[own][a], weight[own][a]),
                        (item[other][b], weight[other][b])) >= threshold - 1e-12
                return ok
            return match
        return cell
    return matcher


def _linked(members: DataFrame, matcher) -> DataFrame:
    """Links (a, b) that connect what matches inside each cell.

    ``members`` has (cell, blocks, uid, payload); a cell is cut into ``blocks``
    blocks by a hash of uid.
    """
    def run(rows: DataFrame) -> DataFrame:
        return cut(rows.select("cell", "block", "uid", "part", "payload")
                   .repartition("cell", "block").sortWithinPartitions("cell", "block", "uid")
                   .mapInArrow(_forests(matcher), "a long, b long"))

    members = members.withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")))
    links = run(members.withColumn("part", F.col("uid")))
    wide = members.where("blocks > 1")
    if wide.isEmpty():
        return links
    placed = (wide.join(connected(links).withColumnRenamed("node", "uid"), "uid", "left")
              .withColumn("part", F.coalesce("component", "uid")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    across = (placed.withColumn("other", other).where("other <> block")
              .withColumn("block", F.least("block", "other") * F.col("blocks")
                          + F.greatest("block", "other")))
    return links.union(run(across))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
                 block_rows: int = 2048, block_bytes: int = 4 << 20) -> DataFrame:
    """(id, key, class_id, is_representative): one row per input row.

    ``class_id`` is the smallest id of the class, null for a null id.  One row
    of every class is its representative; rows with null text or null id
    always are their own.
    """
    size = bands * rows
    keyed = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
        F.when(F.col(id_col).isNotNull(), text_key(F.col(text_col))).alias("key"))
    rows_ = stored(keyed.select(F.monotonically_increasing_id().alias("uid"), "id", "key", "text")
                   .mapInArrow(_sketch(size, rows),
                               "uid long, id long, key binary, buckets array<long>, "
                               "sketch binary, plain_buckets array<long>, plain_sketch binary"))
    # copies of a text meet as one partial row per task and key
    reps = cut(rows_.where("key is not null").groupBy("key")
               .agg(F.min(F.struct("id", "uid")).alias("m"))
               .select("key", F.col("m.id").alias("id"), F.col("m.uid").alias("uid")))
    # without repeated shingles the plain sketch is the weighted one
    nodes = (rows_.join(reps.select("uid"), "uid", "left_semi")
             .select("uid", F.posexplode(F.array(
                 F.struct("buckets", F.col("sketch").alias("payload")),
                 F.struct(F.col("plain_buckets").alias("buckets"),
                          F.col("plain_sketch").alias("payload")))).alias("kind", "s"))
             .select("uid", "kind", "s.buckets", "s.payload").where("size(buckets) > 0"))

    bucketed = nodes.select("uid", "kind", F.explode("buckets").alias("cell"))
    shared = (bucketed.groupBy("cell")
              .agg(F.count("*").alias("n"), F.min("uid").alias("a"), F.max("uid").alias("b"))
              .where("a < b").select("cell", F.ceil(F.col("n") / block_rows).alias("blocks")))
    members = (bucketed.join(shared, "cell")
               .join(nodes.select("uid", "kind", "payload"), ["uid", "kind"]))
    least = int(size * threshold - 4 * (size * threshold * (1 - threshold)) ** 0.5)
    clusters = connected(_linked(members, _sketch_matcher(size, least)))

    wanted = clusters.withColumnRenamed("node", "uid").join(reps, "uid")
    # a row repeated in full gives its text more than once: one per representative
    texts = stored(keyed.join(wanted, ["id", "key"]).groupBy("uid").agg(
        F.first("component").alias("cell"), F.first("text").alias("payload")))
    sizes = texts.groupBy("cell").agg(F.greatest(
        F.ceil(F.count("*") / block_rows),
        F.ceil(F.sum(F.octet_length("payload")) / block_bytes)).alias("blocks"))
    classes = connected(_linked(texts.join(sizes, "cell"), _text_matcher(threshold)))

    named = (reps.join(classes.withColumnRenamed("node", "uid"), "uid", "left")
             .select("key", "id", "uid", F.coalesce("component", "uid").alias("part")))
    # the class is named by its smallest id, and that row represents it
    heads = (named.groupBy("part").agg(F.min(F.struct("id", "uid")).alias("m"))
             .select("part", F.col("m.id").alias("class_id"), F.col("m.uid").alias("head")))
    by_key = named.select("key", "part").join(heads, "part")
    return (rows_.select("uid", "id", "key").join(by_key, "key", "left")
            .select("id", "key", F.coalesce("class_id", "id").alias("class_id"),
                    F.coalesce(F.col("head") == F.col("uid"), F.lit(True))
                    .alias("is_representative")))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of every near-duplicate class (its smallest id).

    Rows with a null id or a null text are kept.  A row repeated with id and
    text stays once.
    """
    id_name, key_name = fresh_name(docs, "near_id"), fresh_name(docs, "near_key")
    keyed = docs.withColumn(id_name, F.col(id_col).cast("long")).withColumn(
        key_name, F.when(F.col(id_col).isNotNull(), text_key(F.col(text_col))))
    heads = (near_classes(docs, id_col, text_col, threshold)
             .where("is_representative and key is not null")
             .select(F.col("id").alias(id_name), F.col("key").alias(key_name)))
    chosen = (keyed.where(F.col(key_name).isNotNull())
              .join(heads, [id_name, key_name], "left_semi")
              .dropDuplicates([id_name, key_name]))
    return (chosen.unionByName(keyed.where(F.col(key_name).isNull()))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
