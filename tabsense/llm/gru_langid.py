"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes: an embedding, one gated recurrent layer each
way, and a softmax that labels every position; a document's probabilities are
the geometric mean of its positions' (normalised).  It is trained in numpy by
backpropagation through time on windows of labelled documents.

Training takes a bounded sample: up to ``docs_per_label`` documents of each
language, chosen by a hash of their id, and up to ``windows_per_doc`` windows
of ``span`` bytes of each.  Scoring reads every byte of every text, in
windows of ``span`` bytes (the state starts anew in each), many windows at a
time.

A text that is null or has no letter gets the label ``und`` and score 0.
Without any training document every text gets ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import blocks, bounded_sample, excerpt, text_bytes

SPAN = 64
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Weights; the embedding ends in a constant 1, whose input weights are the biases."""
    labels: list[str]
    emb: np.ndarray               # 256 x (e + 1)
    w: list[np.ndarray]           # per direction: (e + 1) x 3h
    state: list[np.ndarray]       # per direction: h x 3h
    out: list[np.ndarray]         # per direction: h x labels
    bias: np.ndarray

    @property
    def hidden(self) -> int:
        return self.state[0].shape[0]

    @property
    def inputs(self) -> list[np.ndarray]:
        """Per direction what each byte gives to the three gates: 256 x 3h."""
        return [self.emb @ w for w in self.w]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _forward(net: Network, d: int, x: np.ndarray, mask: np.ndarray, keep: bool):
    """States of direction ``d`` for windows ``x`` (span x rows), in reading order."""
    h = net.hidden
    span, rows = x.shape
    state = np.zeros((rows, h), np.float32)
    states = np.zeros((span, rows, h), np.float32)
    saved = []
    order = range(span) if d == 0 else range(span - 1, -1, -1)
    inputs = net.inputs[d]
    u_rz, u_n = net.state[d][:, :2 * h], net.state[d][:, 2 * h:]
    for t in order:
        a = inputs[x[t]]
        rz = _sigmoid(a[:, :2 * h] + state @ u_rz)
        r, z = rz[:, :h], rz[:, h:]
        gated = r * state
        n = np.tanh(a[:, 2 * h:] + gated @ u_n)
        new = n + z * (state - n)
        on = mask[t][:, None]
        new = np.where(on, new, state)
        if keep:
            saved.append((t, state, r, z, n, gated))
        states[t] = state = new
    return states, saved


def _states(net: Network, d: int, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """Like :func:`_forward` for scoring: states laid out hidden x span x rows.

    The sigmoid is taken as ``(tanh(a / 2) + 1) / 2`` with the halves folded
    into the weights.
    """
    h = net.hidden
    half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(np.float32)[:, None]
    w = np.ascontiguousarray(net.w[d].T * half)
    u_rz = np.ascontiguousarray(net.state[d][:, :2 * h].T * 0.5)
    u_n = np.ascontiguousarray(net.state[d][:, 2 * h:].T)
    span, rows = x.shape
    states = np.empty((h, span, rows), np.float32)
    state = np.zeros((h, rows), np.float32)
    for t in (range(span) if d == 0 else range(span - 1, -1, -1)):
        a = w @ net.emb.take(x[t], axis=0).T     # gathers rows, lets BLAS turn them
        rz = a[:2 * h]
        rz += u_rz @ state
        np.tanh(rz, out=rz)
        rz += 1.0
        rz *= 0.5
        n = a[2 * h:]
        n += u_n @ (rz[:h] * state)
        np.tanh(n, out=n)
        new = state - n
        new *= rz[h:]
        new += n
        state = new if mask is None else np.where(mask[t], new, state)
        states[:, t] = state
    return states


def position_log_probs(net: Network, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Log probabilities of the labels at every position (labels x span x rows)."""
    k, h = len(net.labels), net.hidden
    some = None if mask.all() else mask
    logits = np.repeat(net.bias[:, None], x.size, axis=1)
    for d in (0, 1):
        logits += net.out[d].T @ _states(net, d, x, some).reshape(h, -1)
    logits -= logits.max(axis=0)
    logits -= np.log(np.exp(logits).sum(axis=0))
    return logits.reshape(k, *x.shape)


def train(labels: list[str], x: np.ndarray, mask: np.ndarray, y: np.ndarray, hidden: int = 8,
          steps: int = 200, rows: int = 128, rate: float = 0.02, seed: int = 3,
          embedding: int = 8) -> Network:
    """Fit by backpropagation through time (Adam); x, mask: span x windows; y: label numbers."""
    rng = np.random.default_rng(seed)
    k, span = len(labels), x.shape[0]

    def weights(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    params = {"emb": weights(256, embedding, scale=0.5), "bias": np.zeros(k, np.float32)}
    for d in (0, 1):
        params[f"w{d}"] = weights(embedding, 3 * hidden, scale=embedding ** -0.5)
        params[f"b{d}"] = np.zeros(3 * hidden, np.float32)
        params[f"u{d}"] = weights(hidden, 3 * hidden, scale=hidden ** -0.5)
        params[f"v{d}"] = weights(hidden, k, scale=hidden ** -0.5)
    m1 = {n: np.zeros_like(p) for n, p in params.items()}
    m2 = {n: np.zeros_like(p) for n, p in params.items()}

    def network() -> Network:
        one = np.ones((256, 1), np.float32)
        return Network(labels, np.hstack([params["emb"], one]),
                       [np.vstack([params[f"w{d}"], params[f"b{d}"]]) for d in (0, 1)],
                       [params["u0"], params["u1"]], [params["v0"], params["v1"]], params["bias"])

    for step in range(1, steps + 1):
        pick = rng.integers(0, x.shape[1], min(rows, x.shape[1]))
        bx, bm, by = x[:, pick], mask[:, pick], y[pick]
        net = network()
        runs = [_forward(net, d, bx, bm, keep=True) for d in (0, 1)]
        logits = net.bias + sum(runs[d][0] @ net.out[d] for d in (0, 1))
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(len(pick)), by] -= 1.0
        d_logits = (p * bm[:, :, None] / max(1, bm.sum())).astype(np.float32)
        grads = {n: np.zeros_like(v) for n, v in params.items()}
        grads["bias"] = d_logits.sum(axis=(0, 1))
        for d in (0, 1):
            states, saved = runs[d]
            grads[f"v{d}"] = np.einsum("trh,trk->hk", states, d_logits)
            from_out = d_logits @ net.out[d].T
            u = net.state[d]
            u_rz, u_n = u[:, :2 * hidden], u[:, 2 * hidden:]
            d_state = np.zeros_like(states[0])
            d_inputs = np.zeros((256, 3 * hidden), np.float32)
            for t, before, r, z, n, gated in reversed(saved):
                d_state = d_state + from_out[t]
                on = bm[t][:, None]
                d_new = np.where(on, d_state, 0.0).astype(np.float32)
                d_n = d_new * (1 - z) * (1 - n * n)
                d_gated = d_n @ u_n.T
                d_z = d_new * (before - n) * z * (1 - z)
                d_r = d_gated * before * r * (1 - r)
                d_rz = np.concatenate([d_r, d_z], axis=1)
                grads[f"u{d}"][:, 2 * hidden:] += gated.T @ d_n
                grads[f"u{d}"][:, :2 * hidden] += before.T @ d_rz
                np.add.at(d_inputs, bx[t], np.concatenate([d_rz, d_n], axis=1))
                d_state = (np.where(on, 0.0, d_state) + d_new * z + d_gated * r
                           + d_rz @ u_rz.T).astype(np.float32)
            grads[f"b{d}"] = d_inputs.sum(axis=0)
            grads[f"w{d}"] = params["emb"].T @ d_inputs
            grads["emb"] += d_inputs @ params[f"w{d}"].T
        now = rate * (1 - 0.9 * step / steps)
        for n, g in grads.items():
            m1[n] = 0.9 * m1[n] + 0.1 * g
            m2[n] = 0.99 * m2[n] + 0.01 * g * g
            params[n] = (params[n] - now * (m1[n] / (1 - 0.9 ** step))
                         / (np.sqrt(m2[n] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return network()


def windowed(data: np.ndarray, offsets: np.ndarray, span: int):
    """(bytes as span x windows, mask, document of each window); texts are cut every ``span``."""
    lengths = np.diff(offsets)
    per = -(-lengths // span)
    doc = np.repeat(np.arange(len(lengths)), per)
    number = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[doc] + number * span
    size = np.minimum(span, offsets[doc + 1] - start)
    at = start[None, :] + np.arange(span)[:, None]
    mask = np.arange(span)[:, None] < size[None, :]
    x = data[np.where(mask, at, 0)] if len(data) else np.zeros(at.shape, np.uint8)
    return x, mask, doc


def document_probabilities(net: Network, data: np.ndarray, offsets: np.ndarray,
                           span: int = SPAN, rows: int = 2048) -> np.ndarray:
    """Pooled label probabilities (documents x labels); uniform for empty texts."""
    n, k = len(offsets) - 1, len(net.labels)
    x, mask, doc = windowed(data, offsets, span)
    whole = mask[-1]
    total = np.zeros((k, n))
    # whole windows need no mask; each text's last one may
    for group in (np.flatnonzero(whole), np.flatnonzero(~whole)):
        for i in range(0, len(group), rows):
            at = group[i:i + rows]
            m = mask[:, at]
            lp = (position_log_probs(net, x[:, at], m) * m).sum(axis=1)
            for c in range(k):
                total[c] += np.bincount(doc[at], lp[c], minlength=n)
    total = total.T
    mean = total / np.maximum(1, np.diff(offsets))[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        docs_per_label: int = 400, windows_per_doc: int = 12, longest: int = 20_000,
        span: int = SPAN, **options) -> Network | None:
    """Train on a bounded sample of the labelled rows of ``docs``; None when there are none.

    Of a text longer than ``longest`` characters so many are read, from a hashed place.
    """
    keys = docs.where(F.char_length(text_col) > 0).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    drawn = sorted((r[0], bytes(r[1])) for r in bounded_sample(
        keys, docs, id_col, docs_per_label)
        .where(F.char_length(text_col) > 0)
        .select("sample_label", F.encode(excerpt(F.col(text_col), F.col("sample_h"), longest),
                                         "UTF-8")).collect())
    if not drawn:
        return None
    labels = sorted({label for label, _ in drawn})
    xs, ms, ys = [], [], []
    for label, text in drawn:
        data = np.frombuffer(text, np.uint8)
        x, m, _ = windowed(data, np.array([0, len(data)]), span)
        step = max(1, x.shape[1] // windows_per_doc)
        xs.append(x[:, ::step][:, :windows_per_doc])
        ms.append(m[:, ::step][:, :windows_per_doc])
        ys.append(np.full(xs[-1].shape[1], labels.index(label)))
    return train(labels, np.concatenate(xs, 1), np.concatenate(ms, 1), np.concatenate(ys),
                 **options)


def _predictor(net: Network | None, text_col: str, keep: list[str], span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_col)
            lettered = np.array([bool(t and _LETTER.search(t)) for t in column.to_pylist()], bool)
            best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            if net is not None:
                data, offsets = text_bytes(column)
                for i, j in blocks(offsets, 1 << 20):
                    lo = offsets[i:j + 1]
                    p = document_probabilities(net, data[lo[0]:lo[-1]], lo - lo[0], span)
                    best[i:j], score[i:j] = p.argmax(axis=1), p.max(axis=1)
            else:
                lettered[:] = False
            names = net.labels if net else [UND]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep],
                 pa.array([names[b] if ok else UND for b, ok in zip(best, lettered)]),
                 pa.array(np.where(lettered, score, 0.0))],
                names=[*keep, "lang_pred", "score"])
    return run


def predict(docs: DataFrame, net: Network | None, keep: list[str], text_col: str = "text",
            span: int = SPAN) -> DataFrame:
    """Columns ``keep`` of every row plus (lang_pred, score)."""
    out = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(
        _predictor(net, text_col, keep, span), out)
