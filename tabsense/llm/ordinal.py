"""Text quality by ordinal regression on graded ratings.

A cumulative-link (proportional odds) model: a text's score is a weighted sum
of hashed features, ``P(grade >= k) = sigmoid(score - threshold_k)`` with
rising thresholds, all grades sharing the weights.  It gives the expected
grade and the tail probabilities to select by.

Features, hashed into 2**18 weights: blank-separated words, beginnings of
words (five bytes), word shapes (which kinds of bytes occur, the last byte)
and the share of words that do not repeat, in tenths; each counts once a
text, scaled by the root of how many there are.

Fitting takes at most ``docs_per_grade`` documents of each grade, chosen by a
hash of their id.  Null and empty texts have no features and get the score of
an empty text.  With fewer than two grades the model is the grade's frequency
(or grade 0 without any rating).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.llm.common import blocks, bounded_sample, excerpt, hash_spans, mix64, spans_of, text_bytes

BITS = 18
_b = np.arange(256)
_BLANK = (_b == 0x20) | ((_b >= 0x09) & (_b <= 0x0D))
_KIND = np.zeros(256, np.uint8)
_KIND[0x30:0x3A] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x61:0x7B] = 4
_KIND[0x80:] = 8
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 16
_KIND[[ord(c) for c in "#*$%&|<>"]] = 32


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray         # rising, one less than the grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. (texts x grades - 1)."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS):
    """(text, feature) of every distinct hashed feature of every text."""
    starts, ends = spans_of(~_BLANK[data], offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    words = hash_spans(data, starts, ends)
    heads = mix64(hash_spans(data, starts, np.minimum(ends, starts + 5)) + np.uint64(1))
    kinds = np.bitwise_or.reduceat(_KIND[data], starts)   # blanks in between are kind 0
    shapes = mix64(kinds.astype(np.uint64) * np.uint64(256)
                   + data[ends - 1].astype(np.uint64) + np.uint64(2))
    # how much of the text repeats: the share of words that are new, in tenths
    order = np.lexsort((words, doc))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (words[order][1:] != words[order][:-1])
    n = np.bincount(doc)
    tenth = (10 * np.bincount(doc[order], new) // np.maximum(1, n)).astype(np.uint64)
    some = np.flatnonzero(n)
    fresh = mix64(tenth[some] * np.uint64(1024) + np.uint64(3))
    slot = np.concatenate([words, heads, shapes, fresh]) >> np.uint64(64 - bits)
    pairs = np.unique(np.concatenate([np.tile(doc, 3), some]) << bits | slot.astype(np.int64))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def _score(weights: np.ndarray, doc: np.ndarray, slot: np.ndarray, docs: int) -> np.ndarray:
    n = np.bincount(doc, minlength=docs)
    return np.bincount(doc, weights[slot], minlength=docs) / np.sqrt(np.maximum(1, n))


def train(doc: np.ndarray, slot: np.ndarray, grade: np.ndarray, grades: int, bits: int = BITS,
          steps: int = 120, rate: float = 0.3, ridge: float = 5e-5) -> Ordinal:
    """Maximum likelihood by full-batch Adam; thresholds as a first one and log gaps."""
    docs = len(grade)
    n = np.sqrt(np.maximum(1, np.bincount(doc, minlength=docs)))
    w = np.zeros(1 << bits)
    cut = np.zeros(grades - 1)                       # first threshold, then log gaps
    m = [np.zeros_like(w), np.zeros_like(cut)]
    v = [np.zeros_like(w), np.zeros_like(cut)]
    # grades of different frequency weigh the same
    freq = np.bincount(grade, minlength=grades)
    weight = (docs / (np.maximum(1, freq) * (freq > 0).sum()))[grade] / docs
    for step in range(1, steps + 1):
        theta = cut[0] + np.concatenate(([0.0], np.cumsum(np.exp(cut[1:]))))
        s = np.bincount(doc, w[slot], minlength=docs) / n
        tail = 1 / (1 + np.exp(-np.clip(s[:, None] - theta[None, :], -40, 40)))
        full = np.hstack([np.ones((docs, 1)), tail, np.zeros((docs, 1))])
        slope = np.hstack([np.zeros((docs, 1)), tail * (1 - tail), np.zeros((docs, 1))])
        at = np.arange(docs)
        p = np.maximum(1e-12, full[at, grade] - full[at, grade + 1])
        d_s = -weight * (slope[at, grade] - slope[at, grade + 1]) / p
        d_theta = np.zeros(grades + 1)
        np.add.at(d_theta, grade, weight * slope[at, grade] / p)
        np.add.at(d_theta, grade + 1, -weight * slope[at, grade + 1] / p)
        inner = d_theta[1:grades]
        d_cut = np.concatenate(([inner.sum()], [
            inner[k:].sum() * np.exp(cut[k]) for k in range(1, grades - 1)]))
        d_w = np.bincount(slot, (d_s / n)[doc], minlength=1 << bits) + ridge * w
        for i, (param, grad) in enumerate(((w, d_w), (cut, d_cut))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.99 * v[i] + 0.01 * grad * grad
            param -= (rate * (1 - 0.8 * step / steps) * (m[i] / (1 - 0.9 ** step))
                      / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-9))
    theta = cut[0] + np.concatenate(([0.0], np.cumsum(np.exp(cut[1:]))))
    return Ordinal(w, theta)


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        grade_col: str = "grade", grades: int = 3, docs_per_grade: int = 2500,
        longest: int = 20_000) -> Ordinal:
    """Fit on a bounded sample of the rated documents; grades run from 0.

    Of a text longer than ``longest`` characters so many are read, from a hashed place.
    """
    some = docs.where(F.col(text_col).isNotNull())
    keys = (some.select(F.col(id_col).alias("id")).distinct()
            .join(ratings.select(F.col(id_col).alias("id"),
                                 F.col(grade_col).cast("int").alias("label")), "id")
            .where(F.col("label").between(0, grades - 1)))
    rows = sorted((r[0], r[1], bytes(r[2])) for r in bounded_sample(
        keys, some, id_col, docs_per_grade)
        .select("sample_label", "sample_h", F.encode(
            excerpt(F.col(text_col), F.col("sample_h"), longest), "UTF-8")).collect())
    grade = np.array([r[0] for r in rows], np.int64)
    if len(set(grade.tolist())) < 2:
        only = int(grade[0]) if len(grade) else 0
        return Ordinal(np.zeros(1 << BITS),
                       np.array([-5.0 if k <= only else 5.0 for k in range(1, grades)]))
    ends = np.concatenate(([0], np.cumsum([len(r[2]) for r in rows])))
    data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    parts = []
    for i, j in blocks(ends, 1 << 20):
        lo = ends[i:j + 1]
        doc, slot = features(data[lo[0]:lo[-1]], lo - lo[0])
        parts.append((doc + i, slot))
    return train(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]),
                 grade, grades)


def predict(docs: DataFrame, model: Ordinal, keep: list[str], text_col: str = "text"
            ) -> DataFrame:
    """Columns ``keep`` of every row plus expected_grade and tails (P(grade >= 1), ...)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)   # 2 MB by construction

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(text_col))
            score = np.zeros(batch.num_rows)
            for i, j in blocks(offsets, 1 << 20):
                lo = offsets[i:j + 1]
                score[i:j] = _score(model.weights, *features(data[lo[0]:lo[-1]], lo - lo[0]),
                                    j - i)
            tails = model.tails(score)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(tails.sum(axis=1)),
                 pa.array(tails.tolist(), pa.list_(pa.float64()))],
                names=[*keep, "expected_grade", "tails"])
    out = docs.select(*keep).schema.add("expected_grade", "double").add("tails", T.ArrayType(T.DoubleType()))
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, out)
