"""Toxicity by a weighted finite-state pattern grammar.

Words are read by a lexical transducer (a prefix tree with failure links) that
rewrites a text into symbols: insult, threat, target, negation, report, other
and clause boundary.  Three small transducers follow the symbols of a clause:
whether a negation stands up to three words before, whether reported speech
has been opened, whether someone is addressed.  Their composition (a product
automaton built once) reads the symbol string and emits a pattern at every
insult or threat: bare or addressed, and each of them plain, negated or
reported.  What a document scores is the weight of its matched clauses:
each pattern sums the weights of the words it matched, and a logistic model
over the pattern sums gives the probability.

Insults come from a short fixed list and from the labels: word beginnings
(and whole words) that occur in toxic training documents far more often than
in clean ones, weighted by their log likelihood ratio.  The pattern weights
are fitted on out-of-fold features: a half of the training sample is read
with the words learned from the other half.

Training takes at most ``docs_per_label`` documents of each label, chosen by
a hash of their id, and of near copies among them one.  Null and empty texts match nothing and get the score of
a document without patterns.  Without training labels of both kinds only the
fixed list speaks, with fixed weights.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import bounded_sample, excerpt, cut, mix64, text_bytes
from tabsense.llm.prob_minhash import weighted_shingles

# The general vocabulary of the grammar.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless",
           "disgusting", "clown", "dumm", "trottel", "abschaum", "imbécile", "crétin",
           "ordure", "idiota", "estúpido", "imbécil", "escoria")
THREATS = ("kill", "destroy", "hurt", "töten", "umbringen", "tuer", "détruire", "matar",
           "destruir")
TARGETS = ("you", "your", "yours", "u", "du", "dich", "dir", "dein", "ihr", "euch", "tu",
           "toi", "vous", "ton", "votre", "tú", "te", "ti", "usted", "vosotros")
NEGATIONS = ("not", "never", "no", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca",
             "jamás")
REPORTS = ("said", "says", "wrote", "called", "quoted", "sagte", "schrieb", "nannte", "dit",
           "écrit", "appelé", "dijo", "escribió", "llamó")

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, BOUNDARY = range(7)
# Patterns: (insult or threat) x (bare or addressed) x (plain, negated, reported).
PATTERNS = tuple(itertools.product(("insult", "threat"), ("bare", "addressed"),
                                   ("plain", "negated", "reported")))
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]+")
SHORTEST, LONGEST = 3, 8
_SEED_WEIGHT = 3.0


@dataclass(frozen=True)
class Machine:
    """A deterministic transducer: next state and output by state and symbol."""
    start: int
    step: tuple[tuple[int, ...], ...]
    out: tuple[tuple[int, ...], ...]


def _machine(states: int, rule) -> Machine:
    table = [[rule(s, x) for x in range(7)] for s in range(states)]
    return Machine(0, tuple(tuple(n for n, _ in row) for row in table),
                   tuple(tuple(o for _, o in row) for row in table))


def negation_machine(reach: int = 3) -> Machine:
    """Outputs 1 within ``reach`` words after a negation in the clause."""
    def rule(s: int, x: int):
        if x == BOUNDARY:
            return 0, 0
        return (reach if x == NEGATION else max(0, s - 1)), int(s > 0)
    return _machine(reach + 1, rule)


def report_machine() -> Machine:
    """Outputs 1 once reported speech is open in the clause."""
    return _machine(2, lambda s, x: (0, 0) if x == BOUNDARY else (int(s or x == REPORT), s))


def target_machine() -> Machine:
    """Outputs 1 once somebody is addressed in the clause."""
    return _machine(2, lambda s, x: (0, 0) if x == BOUNDARY else (int(s or x == TARGET), s))


def compose(*machines: Machine) -> tuple[list[list[int]], list[list[int]]]:
    """Product of the machines: next-state table and the pattern emitted (-1: none)."""
    states = list(itertools.product(*(range(len(m.step)) for m in machines)))
    number = {s: i for i, s in enumerate(states)}
    step, emit = [], []
    for s in states:
        step.append([number[tuple(m.step[q][x] for m, q in zip(machines, s))] for x in range(7)])
        row = []
        for x in range(7):
            negated, reported, addressed = (m.out[q][x] for m, q in zip(machines, s))
            if x in (INSULT, THREAT):
                manner = "reported" if reported else "negated" if negated else "plain"
                row.append(PATTERNS.index(("insult" if x == INSULT else "threat",
                                           "addressed" if addressed else "bare", manner)))
            else:
                row.append(-1)
        emit.append(row)
    return step, emit


class Grammar:
    """The composed transducer over a lexicon of (beginning, whole word, weight)."""

    def __init__(self, lexicon: list[tuple[str, bool, float]]) -> None:
        import ahocorasick

        self.step, self.emit = compose(negation_machine(), report_machine(), target_machine())
        self.words = {w: s for s, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS),
                                         (REPORT, REPORTS)) for w in ws}
        entries: dict[str, list[tuple[bool, int, float]]] = {}
        for text, whole, weight in lexicon:
            entries.setdefault(text, []).append((whole, INSULT, weight))
        for text in INSULTS:
            if not any(w for w, _, _ in entries.get(text, [])):
                entries.setdefault(text, []).append((True, INSULT, _SEED_WEIGHT))
        for text in THREATS:
            entries.setdefault(text, []).append((True, THREAT, _SEED_WEIGHT))
        self.lexical = ahocorasick.Automaton()
        for text, found in entries.items():
            self.lexical.add_word(text, (len(text), found))
        self.lexical.make_automaton()

    def marked(self, low: str) -> dict[int, tuple[int, float]]:
        """Start of every insult or threat word, its symbol and weight (the heaviest entry)."""
        hits: dict[int, tuple[int, float]] = {}
        for end, (length, found) in self.lexical.iter(low):
            start = end - length + 1
            if start and (low[start - 1].isalpha()):
                continue
            ends_word = end + 1 == len(low) or not low[end + 1].isalpha()
            for whole, symbol, weight in found:
                if ends_word or not whole:
                    if start not in hits or weight > hits[start][1]:
                        hits[start] = (symbol, weight)
        return hits

    def features(self, text: str | None) -> np.ndarray:
        """Pattern sums of a text: log(1 + weight of the matched clauses), by pattern."""
        sums = np.zeros(len(PATTERNS))
        if not text:
            return sums
        low = text.lower()
        hits = self.marked(low)
        if not hits:                         # only insults and threats emit
            return sums
        clause: list[tuple[int, float]] = []
        for m in _TOKEN.finditer(low):
            token, at = m.group(), m.start()
            if not token[0].isalpha():
                self._read(clause, sums)
                clause = []
            else:
                clause.append(hits.get(at) or (self.words.get(token, OTHER), 0.0))
        self._read(clause, sums)
        return np.log1p(sums)

    def _read(self, clause: list[tuple[int, float]], sums: np.ndarray) -> None:
        """Run the composed transducer over a clause.

        Who is addressed after the insult counts as well, so a clause with a
        later target is read with the target symbol put first.
        """
        if not any(s in (INSULT, THREAT) for s, _ in clause):
            return
        state = 0
        if any(s == TARGET for s, _ in clause):
            state = self.step[state][TARGET]
        for symbol, weight in clause:
            pattern = self.emit[state][symbol]
            if pattern >= 0:
                sums[pattern] += weight
            state = self.step[state][symbol]


def learn_lexicon(counts: list[tuple[str, bool, int, int]], toxic: int, clean: int,
                  most: int = 2000, evidence: float = 18.0) -> list[tuple[str, bool, float]]:
    """(beginning, whole word, weight) of what marks toxic documents.

    ``counts`` has (beginning, whole word, toxic documents, clean documents).
    An entry needs a likelihood ratio of 20 and a log-likelihood statistic of
    ``evidence``; of nested beginnings the longest that keeps nine tenths of
    the shorter one's toxic documents stands for both.
    """
    if not toxic or not clean:
        return []
    strong = {}
    for text, whole, t, c in counts:
        weight = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        n, base = t + c, toxic / (toxic + clean)
        g = 2 * (t * math.log(t / (n * base)) if t else 0.0)
        g += 2 * (c * math.log(c / (n * (1 - base))) if c else 0.0)
        if weight >= math.log(20) and g >= evidence and t / n > base:
            strong[(text, whole)] = (t, weight)
    kept = []
    for (text, whole), (t, weight) in strong.items():
        longer = [k for k in strong if k != (text, whole) and not whole
                  and (k[0].startswith(text) and (len(k[0]) > len(text) or k[1]))]
        if not any(strong[k][0] >= 0.9 * t for k in longer):
            kept.append((text, whole, weight, t))
    kept.sort(key=lambda e: (-e[3], e[0], e[1]))
    return sorted((text, whole, weight) for text, whole, weight, _ in kept[:most])


@dataclass
class Model:
    lexicon: list[tuple[str, bool, float]]
    weights: np.ndarray            # by pattern, then the constant


def default_model() -> Model:
    """Without labels: an insult or threat word of the fixed list makes a text toxic."""
    return Model([], np.array([2.0] * len(PATTERNS) + [-1.5]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Newton's method with a ridge; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 5.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return w


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds eight minima of hashed three-word shingles: copies share some of them."""
    for b in batches:
        doc, item, _ = weighted_shingles(*text_bytes(b.column("text")), size=3)
        marks = np.zeros((b.num_rows, 8), np.uint64)
        heads = np.flatnonzero(np.diff(doc, prepend=-1))
        for k in range(8):
            if len(doc):
                low = np.minimum.reduceat(mix64(item ^ mix64(np.uint64([k + 1]))), heads)
                marks[doc[heads], k] = low
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(marks.view(np.int64).tolist(), pa.list_(pa.int64()))],
            names=[*b.schema.names, "marks"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", docs_per_label: int = 3000, longest: int = 20_000,
        candidates: int = 50_000) -> Model:
    """Learn words and pattern weights from labelled documents (rows of ``labels``).

    Of a text longer than ``longest`` characters so many are read, from a hashed
    place; of the word beginnings in the sample the ``candidates`` that speak
    most for a label are weighed.
    """
    some = docs.where(F.col(text_col).isNotNull())
    keys = (some.select(F.col(id_col).alias("id")).distinct()
            .join(labels.select(F.col(id_col).alias("id"),
                                F.col(label_col).cast("int").alias("label")), "id")
            .where("label in (0, 1)"))
    drawn = cut(bounded_sample(keys, some, id_col, docs_per_label)
                .select(excerpt(F.col(text_col), F.col("sample_h"), longest).alias("text"), F.col("sample_label").alias("label"),
                        F.col("sample_h").alias("h"))
                .mapInArrow(_sketched, "text string, label int, h long, marks array<long>"))
    # copies of one document are one piece of evidence: what shares six marks of
    # eight with the document of smallest hash that has them does not speak
    marks = drawn.select("h", F.posexplode("marks").alias("nth", "mark"))
    first = marks.groupBy("nth", "mark").agg(F.min("h").alias("low"))
    copies = (marks.join(first, ["nth", "mark"]).where("h > low").groupBy("h", "low").count()
              .where("count >= 6").select("h").distinct())
    drawn = cut(drawn.join(copies, "h", "left_anti").drop("marks")
                .withColumn("fold", F.pmod(F.shiftright("h", 8), F.lit(2))))
    sizes = {(r[0], r[1]): r[2] for r in drawn.groupBy("fold", "label").count().collect()}
    totals = [sum(n for (_, lab), n in sizes.items() if lab == k) for k in (0, 1)]
    if not all(totals):
        return default_model()
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    begun = F.flatten(F.transform(words, lambda w: F.concat(
        F.array(F.concat(w, F.lit("$"))),
        F.when(F.length(w) >= SHORTEST, F.transform(
            F.sequence(F.lit(SHORTEST), F.least(F.length(w), F.lit(LONGEST))),
            lambda n: F.substring(w, 1, n))).otherwise(F.array().cast("array<string>")))))
    # at most (documents of the sample) x (their words) rows; folded map-side
    counts = (drawn.select("fold", "label", F.explode(F.array_distinct(begun)).alias("entry"))
              .groupBy("entry").agg(*[
                  F.count_if((F.col("fold") == f) & (F.col("label") == k)).alias(f"n{f}{k}")
                  for f in (0, 1) for k in (0, 1)])
              .where("n01 + n11 >= 3 and (n01 + n11) * 4 >= n00 + n10")
              .orderBy(F.desc(F.expr("n01 + n11 - (n00 + n10)")), "entry").limit(candidates)
              .collect())

    def lexicon(folds: tuple[int, ...]):
        return learn_lexicon(
            [(r[0].rstrip("$"), r[0].endswith("$"), sum(r[f"n{f}1"] for f in folds),
              sum(r[f"n{f}0"] for f in folds)) for r in counts],
            *(sum(sizes.get((f, k), 0) for f in folds) for k in (1, 0)))

    others = [lexicon((1,)), lexicon((0,))]      # fold 0 is read with fold 1's words

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammars = [Grammar(x) for x in others]
        for b in batches:
            f = [grammars[k].features(t).tolist()
                 for t, k in zip(b.column("text").to_pylist(), b.column("fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(f, pa.list_(
                pa.float64()))], names=["label", "f"])

    rows = sorted((tuple(r[1]), r[0]) for r in
                  drawn.mapInArrow(read, "label int, f array<double>").collect())
    x = np.array([[*f, 1.0] for f, _ in rows])
    y = np.array([label for _, label in rows], float)
    weights = _logistic(x, y)
    unseen = (x[:, :-1] != 0).sum(axis=0) < 3
    weights[:-1][unseen] = default_model().weights[:-1][unseen]
    return Model(lexicon((0, 1)), weights)


def scores(model: Model, texts: list[str | None], grammar: Grammar | None = None) -> np.ndarray:
    grammar = grammar or Grammar(model.lexicon)
    x = np.array([grammar.features(t) for t in texts]).reshape(len(texts), len(PATTERNS))
    return 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text",
            out: str = "score") -> DataFrame:
    """Columns ``keep`` of every row plus its score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.lexicon)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep],
                 pa.array(scores(model, b.column(text_col).to_pylist(), grammar))],
                names=[*keep, out])
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(out, "double")
    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])]).mapInArrow(
        run, schema)
