"""Quality rules and line labelling with a linear-chain conditional random field.

Every line of a text that has a word is described by indicator features
(symbol, case, digit and punctuation shares, repetition, length, licence
wording).  A two-label chain (content, boilerplate) scores the lines and the
changes between them; Viterbi decoding marks the lines of a whole text, and
the share of its words that lies in content lines decides whether the text is
kept.  Beside that stand plain counts over the whole text (`base_counts`).

There are no line labels to learn from.  The lines of a document rated good
are taken as content and those of one rated bad as boilerplate; a first fit
judges each line by itself, the lines of bad documents take the labels it
gives them as long as some line stays boilerplate, and the chain is fitted.  The smallest
content share to keep is the one that separates good from bad documents of
the sample best.  The sample has at most ``docs_per_label`` documents of each
rating, chosen by a hash of their id.

Null texts have no words and no lines, so they fail the base rules; without
ratings of both kinds every line is content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import blocks, bounded_sample, excerpt, hash_spans, mix64, spans_of, text_bytes

CONTENT, BOILERPLATE = 0, 1
_b = np.arange(256)
# Blank and symbol characters as the contract lists them (fixed values).
BLANK = (_b == 0x20) | ((_b >= 0x09) & (_b <= 0x0D))
SYMBOL = np.isin(_b, [ord(c) for c in "#*$%&|<>"])
_UPPER = (_b >= 0x41) & (_b <= 0x5A)
_DIGIT = (_b >= 0x30) & (_b <= 0x39)
_MARK = np.isin(_b, [ord(c) for c in "!?=_~^{}[]()/\\@:;\"'`+-"])
_LICENCE = (b"licen", b"copyright", b"all rights reserved", b"cookie", b"terms of", b"subscribe")
_STEPS = (0.0, 0.03, 0.08, 0.15, 0.3, 0.5, 0.75)
_SIZES = (1, 2, 4, 8, 16, 40, 100)
REPEAT = 8
MIN_WORDS, MAX_REPEAT_PCT = 20, 30


def _per(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over [start, end)."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[ends] - total[starts]


@dataclass
class Lines:
    """Words and lines of a block of texts; lines without a word are left out."""
    n_docs: int
    word_doc: np.ndarray
    words: np.ndarray              # hash of every word, in order
    chars: np.ndarray              # code points of every word
    symbols: np.ndarray            # by text
    line_doc: np.ndarray
    line_words: np.ndarray
    first_word: np.ndarray         # of each line, plus the end
    duplicate: np.ndarray          # the line equals an earlier one of its text
    data: np.ndarray
    line_start: np.ndarray
    line_end: np.ndarray


def read_lines(data: np.ndarray, offsets: np.ndarray) -> Lines:
    starts, ends = spans_of(~BLANK[data], offsets)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    words = hash_spans(data, starts, ends, fold=False)
    chars = _per((data & 0xC0) != 0x80, starts, ends)
    symbols = _per(SYMBOL[data], offsets[:-1], offsets[1:])
    line_start, line_end = spans_of(data != 0x0A, offsets)
    at = np.searchsorted(starts, line_start)
    to = np.searchsorted(starts, line_end)
    some = to > at
    line_start, line_end, at = line_start[some], line_end[some], at[some]
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    lines = hash_spans(data, line_start, line_end, fold=False)
    order = np.lexsort((np.arange(len(lines)), lines, line_doc))
    duplicate = np.zeros(len(lines), bool)
    if len(lines):
        a, b = order[:-1], order[1:]
        duplicate[b] = (lines[a] == lines[b]) & (line_doc[a] == line_doc[b])
    return Lines(len(offsets) - 1, doc, words, chars, symbols, line_doc, to[some] - at,
                 np.append(at, len(words)), duplicate, data, line_start, line_end)


def base_counts(x: Lines) -> dict[str, np.ndarray]:
    """The plain counts of every text (see the module's contract for their names)."""
    n = x.n_docs
    repeat = np.zeros(len(x.words), bool)
    at = np.arange(max(0, len(x.words) - REPEAT + 1))
    at = at[x.word_doc[at] == x.word_doc[at + REPEAT - 1]] if len(at) else at
    h = np.zeros(len(at), np.uint64)
    for k in range(REPEAT):
        h = mix64(h * np.uint64(3) + x.words[at + k])
    # order by document and window; equal neighbours are windows found again
    order = np.lexsort((h, x.word_doc[at]))
    again = ((h[order][1:] == h[order][:-1])
             & (x.word_doc[at][order][1:] == x.word_doc[at][order][:-1]))
    found = np.zeros(len(at), bool)
    found[order[1:][again]] = True
    found[order[:-1][again]] = True
    edge = np.zeros(len(x.words) + 1, np.int64)
    np.add.at(edge, at[found], 1)
    np.add.at(edge, at[found] + REPEAT, -1)
    repeat = np.cumsum(edge[:-1]) > 0
    count = lambda doc, w=None: np.bincount(doc, w, minlength=n).astype(np.int64)
    n_words = count(x.word_doc)
    out = {"n_words": n_words, "word_chars": count(x.word_doc, x.chars),
           "n_symbols": x.symbols.astype(np.int64),
           "n_dup_lines": count(x.line_doc, x.duplicate),
           "n_repeat_words": count(x.word_doc, repeat)}
    out["base_failed"] = ((n_words < MIN_WORDS)
                          | (100 * out["n_repeat_words"] > MAX_REPEAT_PCT * n_words))
    return out


def line_features(x: Lines) -> np.ndarray:
    """Indicator features of every line (lines x features, uint8)."""
    size = np.maximum(1, x.line_end - x.line_start)
    share = lambda table: _per(table[x.data], x.line_start, x.line_end) / size
    words = np.maximum(1, x.line_words)
    back = np.zeros(len(x.words), bool)
    for k in (1, 2):
        back[k:] |= x.words[k:] == x.words[:-k]
    first, last = x.first_word[:-1], x.first_word[:-1] + x.line_words
    ratios = [share(SYMBOL), share(_UPPER), share(_DIGIT), share(_MARK),
              _per(back, first, last) / words, _per(x.chars == 1, first, last) / words]
    cols = [np.ones(len(size), bool)]
    cols += [r > t for r in ratios for t in _STEPS]
    cols += [x.line_words > t for t in _SIZES]
    cols += [_per(x.chars, first, last) / words > t for t in (3, 5, 8, 12)]
    ending = x.data[np.maximum(0, x.line_end - 1)] if len(size) else np.zeros(0, np.uint8)
    cols += [np.isin(ending, [ord(c) for c in ".!?"]), x.duplicate]
    raw = x.data.tobytes()
    cols.append(np.array([any(w in raw[s:e].lower() for w in _LICENCE)
                          for s, e in zip(x.line_start.tolist(), x.line_end.tolist())], bool))
    return np.stack(cols, axis=1).astype(np.uint8)


@dataclass
class Chain:
    emit: np.ndarray               # features x 2
    change: np.ndarray             # from x to
    first: np.ndarray              # 2
    least_share: float = 0.5


def _steps(doc: np.ndarray, n: int) -> list[np.ndarray]:
    """For t = 0, 1, ..: the lines that are the t-th of their text, by text."""
    count = np.bincount(doc, minlength=n)
    start = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    falling = count[order]
    out = []
    for t in range(int(count.max()) if n else 0):
        out.append(start[order[:np.searchsorted(-falling, -t, side="left")]] + t)
    return out


def viterbi(chain: Chain, x: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The best label of every line, text by text."""
    label = np.zeros(len(x), np.int64)
    steps = _steps(doc, n)
    if not steps:
        return label
    score = x.astype(np.float32) @ chain.emit.astype(np.float32)
    best = score[steps[0]] + chain.first
    back = [None]
    for at in steps[1:]:                       # the texts that go on come first
        ways = best[:len(at), :, None] + chain.change[None, :, :]
        back.append(ways.argmax(axis=1))
        best[:len(at)] = ways.max(axis=1) + score[at]
    now = best.argmax(axis=1)
    for at, pointers in zip(steps[::-1], back[::-1]):
        label[at] = now[:len(at)]
        if pointers is not None:
            now[:len(at)] = pointers[np.arange(len(at)), now[:len(at)]]
    return label


def _marginals(chain: Chain, score: np.ndarray, steps: list[np.ndarray]):
    """Label probabilities of every line and, by step, of every pair of lines."""
    alpha, beta = np.zeros_like(score), np.zeros_like(score)
    alpha[steps[0]] = score[steps[0]] + chain.first
    for before, at in zip(steps, steps[1:]):
        ways = alpha[before[:len(at)]][:, :, None] + chain.change[None]
        alpha[at] = np.logaddexp(ways[:, 0], ways[:, 1]) + score[at]
    for before, at in list(zip(steps, steps[1:]))[::-1]:
        ways = chain.change[None] + (score[at] + beta[at])[:, None, :]
        beta[before[:len(at)]] = np.logaddexp(ways[:, :, 0], ways[:, :, 1])
    both = alpha + beta
    total = np.logaddexp(both[:, 0], both[:, 1])
    pairs = [np.exp(alpha[before[:len(at)]][:, :, None] + chain.change[None]
                    + (score[at] + beta[at])[:, None, :] - total[at][:, None, None])
             for before, at in zip(steps, steps[1:])]
    return np.exp(both - total[:, None]), pairs


def train(x: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int,
          chained: bool = True, rounds: int = 120, rate: float = 0.1,
          ridge: float = 1e-4) -> Chain:
    """Maximum conditional likelihood (forward-backward, Adam); weight: by line.

    Without ``chained`` changes between lines score nothing: each line by itself.
    """
    xf = x.astype(np.float64)
    params = [np.zeros((x.shape[1], 2)), np.zeros((2, 2)), np.zeros(2)]
    m1, m2 = ([np.zeros_like(p) for p in params] for _ in range(2))
    steps = _steps(doc, n)
    given = np.zeros((len(x), 2))
    given[np.arange(len(x)), y] = 1.0
    for step in range(1, rounds + 1):
        chain = Chain(*params)
        p, pairs = _marginals(chain, xf @ params[0], steps)
        off = (p - given) * weight[:, None]
        grads = [xf.T @ off + ridge * params[0], ridge * params[1], off[steps[0]].sum(axis=0)]
        for before, at, pair in zip(steps, steps[1:], pairs):
            w = weight[at][:, None, None]
            told = given[before[:len(at)]][:, :, None] * given[at][:, None, :]
            grads[1] = grads[1] + ((pair - told) * w).sum(axis=0)
        for i, g in enumerate(grads if chained else grads[:1]):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            params[i] = params[i] - rate * (m1[i] / (1 - 0.9 ** step)) / (
                np.sqrt(m2[i] / (1 - 0.99 ** step)) + 1e-9)
    return Chain(*params)


def content_share(chain: Chain | None, x: Lines) -> np.ndarray:
    """Share of each text's words that lies in content lines (0 for no words)."""
    total = np.bincount(x.line_doc, x.line_words, minlength=x.n_docs)
    if chain is None:
        return (total > 0).astype(float)
    good = viterbi(chain, line_features(x), x.line_doc, x.n_docs) == CONTENT
    return np.bincount(x.line_doc, x.line_words * good, minlength=x.n_docs) / np.maximum(1, total)


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", docs_per_label: int = 1500,
        longest: int = 20_000) -> Chain | None:
    """Fit the chain and the smallest share on a bounded sample of rated documents.

    Of a text longer than ``longest`` characters so many are read, from a hashed place.
    """
    some = docs.where(F.col(text_col).isNotNull())
    keys = (some.select(F.col(id_col).alias("id")).distinct()
            .join(ratings.select(F.col(id_col).alias("id"),
                                 F.col(label_col).cast("int").alias("label")), "id")
            .where("label in (0, 1)"))
    rows = sorted((r[0], r[1], bytes(r[2])) for r in bounded_sample(
        keys, some, id_col, docs_per_label)
        .select("sample_label", "sample_h", F.encode(
            excerpt(F.col(text_col), F.col("sample_h"), longest), "UTF-8")).collect())
    rating = np.array([r[0] for r in rows])
    if len(set(rating.tolist())) < 2:
        return None
    ends = np.concatenate(([0], np.cumsum([len(r[2]) for r in rows])))
    lines = read_lines(np.frombuffer(b"".join(r[2] for r in rows), np.uint8), ends)
    x, doc, n = line_features(lines), lines.line_doc, len(rows)
    y = np.where(rating[doc] == 1, CONTENT, BOILERPLATE)
    per_doc = 1.0 / (np.bincount(rating, minlength=2)[rating] * 2)
    weight = (per_doc / np.maximum(1, np.bincount(doc, minlength=n)))[doc]
    alone = train(x, doc, y, weight, n, chained=False)
    # again as a chain, with the labels that lines by themselves get in bad documents
    told = viterbi(alone, x, doc, n)
    some = np.bincount(doc, told == BOILERPLATE, minlength=n) > 0
    y = np.where((rating[doc] == 0) & some[doc], told, y)
    chain = train(x, doc, y, weight, n)
    share = content_share(chain, lines)
    tries = np.linspace(0.05, 0.95, 19)
    hit = [((share >= t)[rating == 1].mean() + (share < t)[rating == 0].mean(), -abs(t - 0.5))
           for t in tries]
    chain.least_share = float(tries[max(range(len(tries)), key=hit.__getitem__)])
    return chain


def _judge(chain: Chain | None, keep: list[str], text_col: str, block: int = 1 << 20):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(text_col))
            for i, j in blocks(offsets, block):
                lo = offsets[i:j + 1]
                lines = read_lines(data[lo[0]:lo[-1]], lo - lo[0])
                base = base_counts(lines)
                share = content_share(chain, lines)
                good = share >= (chain.least_share if chain else 0.5)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(i, j - i) for c in keep],
                     *[pa.array(base[c]) for c in names], pa.array(base["base_failed"]),
                     pa.array(share), pa.array(~base["base_failed"] & good)],
                    names=[*keep, *names, "base_failed", "content_share", "kept"])
    return run


def judge(docs: DataFrame, chain: Chain | None, keep: list[str],
          text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row plus the counts, content_share and kept."""
    out = docs.select(*keep).schema
    for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        out = out.add(c, "long")
    out = out.add("base_failed", "boolean").add("content_share", "double").add("kept", "boolean")
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(
        _judge(chain, keep, text_col), out)


def line_labels(chain: Chain | None, text: str | None) -> list[tuple[str, int]]:
    """The lines with a word of one text and their labels."""
    raw = (text or "").encode()
    lines = read_lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    label = (viterbi(chain, line_features(lines), lines.line_doc, 1) if chain
             else np.zeros(len(lines.line_doc), int))
    return [(raw[s:e].decode(), int(k))
            for s, e, k in zip(lines.line_start, lines.line_end, label)]
