"""Classifier chain for toxicity.

The categories are predicted one after another; each is a linear model over the words a text has (hashed, present
or not) and the probabilities of the categories before it. In fitting, those are out-of-fold predictions, so a later
model sees them as unsure as they are on new texts. Word weights start from damped log-odds and are refined by
logistic regression. The last category's threshold is set on out-of-fold predictions and folded into its
intercept, so 0.5 decides. Scoring is one map over whole texts.

The labels table has two binary columns; the default chain predicts low quality, then toxicity.

Defined cases: null and empty texts score as texts without words; null labels are left out of the fit; labels of one
value give its constant; repeated rows score alike; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planproof.llm.common import blocks_of, prepare, text_chunks
from planproof.llm.textblock import MULT, Words, mix, multisets

#: Bound of the labelled rows a fit reads, by default.
MAX_FIT_ROWS = 12_000
SLOTS = 1 << 18
FEATURES = 4000
FOLDS = 3
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def features(texts: pa.Array, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, slot) of the distinct words, texts."""
    w = Words(texts)
    d, h, _ = multisets(w.doc, mix(w.hash * MULT[20]), w.docs)
    return d, (h & np.uint64(slots - 1)).astype(np.int64), w.docs


@dataclass
class Linear:
    slots: np.ndarray  # float32 weight of each slot
    extra: np.ndarray  # weights of the earlier categories' probabilities
    bias: float

    def __call__(self, d, s, n, before):
        z = np.bincount(d, weights=self.slots[s], minlength=n) + self.bias
        if before.shape[1]:
            z = z + before @ self.extra
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(d, s, n, before, y, slots: int = SLOTS, steps: int = 120) -> Linear:
    k = before.shape[1]
    if not n or y.min() == y.max():
        p = np.clip(y.mean() if n else 0.5, 1e-6, 1 - 1e-6)
        return Linear(np.zeros(slots, np.float32), np.zeros(k), float(np.log(p / (1 - p))))
    pos, neg = np.bincount(s[y[d] == 1], minlength=slots), np.bincount(s[y[d] == 0], minlength=slots)
    a, b = (pos + 0.5) / (y.sum() + 1), (neg + 0.5) / (n - y.sum() + 1)
    odds = np.log(a / b)
    sure = np.abs(odds) / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    chosen = np.sort(np.argsort(-sure, kind="stable")[:FEATURES])
    chosen = chosen[(pos + neg)[chosen] >= 3]
    place = np.full(slots, -1)
    place[chosen] = np.arange(chosen.size)
    keep = place[s] >= 0
    row, col = d[keep], place[s[keep]]
    scale = np.minimum(np.abs(odds[chosen]), 4)
    w, v, bias = np.zeros(chosen.size), np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    moments = [np.zeros(chosen.size), np.zeros(k), 0.0]
    squares = [np.zeros(chosen.size), np.zeros(k), 0.0]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=(w * scale)[col], minlength=n) + before @ v + bias
        e = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        grads = [np.bincount(col, weights=e[row], minlength=chosen.size) * scale + 1e-5 * w, before.T @ e + 1e-5 * v, e.sum()]
        moved = []
        for i, g in enumerate(grads):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            squares[i] = 0.99 * squares[i] + 0.01 * g * g
            moved.append(0.1 * (moments[i] / (1 - 0.9**t)) / (np.sqrt(squares[i] / (1 - 0.99**t)) + 1e-8))
        w, v, bias = w - moved[0], v - moved[1], bias - moved[2]
    out = np.zeros(slots, np.float32)
    out[chosen] = w * scale
    return Linear(out, v, float(bias))


def best_shift(p: np.ndarray, y: np.ndarray) -> float:
    """Log-odds of the threshold with the best F1; halfway to the next score."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, y.size + 1) + max(1, y.sum()))
    at = int(np.argmax(f1))
    z = np.log(np.clip(p[order], 1e-12, 1 - 1e-12) / (1 - np.clip(p[order], 1e-12, 1 - 1e-12)))
    return float((z[at] + z[min(at + 1, y.size - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame, chain=CHAIN, max_rows: int = MAX_FIT_ROWS, seed: int = 23) -> list[Linear]:
    """From at most max_rows labelled rows, those with the lowest hash of their id."""
    prepare(docs.sparkSession)
    known = labels.where("doc_id is not null")
    for _, column, _ in chain:
        known = known.where(F.col(column).isNotNull())
    ys = [F.max((F.col(c) == v).cast("int")).alias(f"y{i}") for i, (_, c, v) in enumerate(chain)]
    some = known.groupBy("doc_id").agg(*ys).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)
    names = [f"y{i}" for i in range(len(chain))]

    def run(batches):
        for c in text_chunks(batches):
            d, s, n = features(c.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(n + 1)).astype(np.int32)), pa.array(s.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([c.column("doc_id"), *(c.column(x) for x in names), lists], ["doc_id", *names, "slots"])

    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"])
    got = blocks_of(rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{x} int" for x in names) + ", slots array<int>")).sort_by("doc_id")
    n = got.num_rows
    lists = got["slots"].combine_chunks() if n else pa.array([], pa.list_(pa.int32()))
    d, s = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()) if n else []), lists.flatten().to_numpy().astype(np.int64)
    fold = np.arange(n) % FOLDS
    before, models = np.zeros((n, 0)), []
    for i in range(len(chain)):
        y = got[f"y{i}"].to_numpy().astype(np.float64)
        guess = np.zeros(n)
        for f in range(FOLDS):
            use, rest = fold != f, fold == f
            to = np.cumsum(use) - 1
            m = fit_linear(to[d[use[d]]], s[use[d]], int(use.sum()), before[use], y[use])
            to = np.cumsum(rest) - 1
            guess[rest] = m(to[d[rest[d]]], s[rest[d]], int(rest.sum()), before[rest])
        model = fit_linear(d, s, n, before, y)
        if n and 0 < y.sum() < n:
            shift = best_shift(guess, y)
            model.bias -= shift
            z = np.log(np.clip(guess, 1e-12, 1 - 1e-12) / (1 - np.clip(guess, 1e-12, 1 - 1e-12))) - shift
            guess = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        models.append(model)
        before = np.column_stack([before, guess])
    return models


def score(docs: DataFrame, models: list[Linear], chain=CHAIN) -> DataFrame:
    """doc_id, p_<category> of each category, and the last category's name: 1 from 0.5 on."""
    prepare(docs.sparkSession)
    names = [f"p_{c[0]}" for c in chain]

    def run(batches):
        for c in text_chunks(batches):
            d, s, n = features(c.column("text"))
            p = np.zeros((n, 0))
            for m in models:
                p = np.column_stack([p, m(d, s, n, p)])
            yield pa.RecordBatch.from_arrays([c.column("doc_id").cast(pa.int64()), *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(len(names))), pa.array((p[:, -1] >= 0.5).astype(np.int32))], ["doc_id", *names, chain[-1][0]])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{x} double" for x in names) + f", {chain[-1][0]} int")


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    return score(docs, fit(docs, labels, max_rows=max_rows))
