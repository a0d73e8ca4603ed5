"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of its byte n-grams (n = 1 to 3 as they stand, without folding of case, so that shouting
and markup count, and 4-grams of character classes). Indicators are scaled by the class log-count ratios of naive Bayes,
a text's vector is brought to unit length, and a linear hinge-loss model is fitted by dual coordinate descent. The
margin is calibrated to a probability on labelled texts that had no part in the fit.

Defined results: null and empty texts have no feature; their margin is the bias and their score its probability. Null
ids stay and are not held out; repeated rows are scored each. Labels of the held-out fold are never read by the fit.
Without labels of both classes every score is the share of label 1 (0 without labels). Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, platt, table, text_blocks, training_rows

#: The fit's bounds: labelled rows of each class, and bytes of their whole texts.
ROWS_PER_CLASS, BYTES_PER_CLASS = 2000, 16 << 20
THRESHOLD = 0.7
_BITS = 18
_SIZE = (1 << 8) + (1 << 16) + (1 << _BITS) + (1 << 12)
_CLASS = np.full(256, 7, np.uint32)  # what is none of those below
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:'-\"()?", b"!")):
    _CLASS[list(_chars)] = _k


def grams(b: np.ndarray) -> np.ndarray:
    """Feature numbers of all n-grams of a text, with repetitions."""
    x = b.astype(np.uint32)
    c = _CLASS[b]
    out = [x]
    if len(x) > 1:
        out.append((1 << 8) + (x[:-1] << 8 | x[1:]))
    if len(x) > 2:
        h = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)
        out.append(np.uint32((1 << 8) + (1 << 16)) + (h >> np.uint32(32 - _BITS)))
    if len(x) > 3:
        out.append(np.uint32((1 << 8) + (1 << 16) + (1 << _BITS)) + (c[:-3] << 9 | c[1:-2] << 6 | c[2:-1] << 3 | c[3:]))
    return np.concatenate(out)


def indicators(b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The distinct feature numbers. last: a scratch array over all features, so that no sort is needed."""
    g = grams(b)
    at = np.arange(len(g), dtype=np.int32)
    last[g] = at
    return g[last[g] == at]


def dual_coordinate_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias's) of the L1-loss hinge model: min |w|^2/2 + sum cost_i max(0, 1 - y_i w.x_i).

    x: sparse rows (features, values). One pass moves each dual variable to its optimum within [0, cost_i] while w follows.
    """
    w = np.zeros(size + 1)
    alpha = np.zeros(len(x))
    diagonal = np.array([(v * v).sum() + 1.0 for _, v in x])
    order = np.arange(len(x))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        most = 0.0
        for i in order:
            f, v = x[i]
            g = y[i] * ((w[f] * v).sum() + w[-1]) - 1
            projected = min(g, 0.0) if alpha[i] <= 0 else max(g, 0.0) if alpha[i] >= cost[i] else g
            most = max(most, abs(projected))
            if abs(projected) > 1e-12:
                new = min(max(alpha[i] - g / diagonal[i], 0.0), cost[i])
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[f] += step * v
                w[-1] += step
        if most < 1e-3:
            break
    return w


@dataclass
class Model:
    """ratio: the class log-count ratios; weights: of the hinge model, ratio folded in; both of fixed size."""

    ratio: np.ndarray | None
    weights: np.ndarray | None
    bias: float
    scale: np.ndarray
    prior: float

    def margin(self, b: np.ndarray, last: np.ndarray) -> float:
        f = indicators(b, last)
        r = self.ratio[f]
        norm = np.sqrt(float((r * r).sum())) or 1.0
        return float(self.weights[f].sum()) / norm + self.bias

    def score(self, data: np.ndarray, offsets: np.ndarray, last: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(offsets) - 1, self.prior)
        m = np.array([self.margin(data[a:b], last) for a, b in zip(offsets[:-1], offsets[1:])])
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * m + self.scale[1], -35, 35)))


def fit(rows: list[tuple[str, int]], counts: dict[int, int]) -> Model:
    """Ratios and hinge model from three quarters of the rows, calibration on the rest, weighted to the classes' shares among all labels."""
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    last = np.zeros(_SIZE, np.int32)
    made = [(indicators(np.frombuffer(t.encode(), np.uint8), last), y) for t, y in rows]
    train = [m for i, m in enumerate(made) if i % 4]
    rest = [m for i, m in enumerate(made) if not i % 4]
    if {y for _, y in train} != {0, 1} or {y for _, y in rest} != {0, 1}:
        return Model(None, None, 0.0, np.zeros(2), prior)
    p, q = (np.bincount(np.concatenate([f for f, y in train if y == k]), minlength=_SIZE) + 1.0 for k in (1, 0))
    n = {k: sum(y == k for _, y in train) for k in (0, 1)}
    # indicators: each class's counts against its number of texts
    ratio = (np.log(p / (n[1] + 2)) - np.log(q / (n[0] + 2))).astype(np.float32)
    x = []
    for f, _ in train:
        v = ratio[f].astype(np.float64)
        x.append((f, v / (np.sqrt((v * v).sum()) or 1.0)))
    y = np.array([1.0 if y else -1.0 for _, y in train])
    cost = np.where(y > 0, len(y) / (2 * n[1]), len(y) / (2 * n[0])) * 4.0
    w = dual_coordinate_descent(x, y, cost, _SIZE)
    model = Model(ratio, (w[:-1] * ratio).astype(np.float32), float(w[-1]), np.zeros(2), prior)
    m, z = [], np.array([y for _, y in rest])
    for f, _ in rest:
        r = ratio[f]
        m.append(float(model.weights[f].sum()) / (np.sqrt(float((r * r).sum())) or 1.0) + model.bias)
    weight = np.where(z == 1, prior / max(1, (z == 1).sum()), (1 - prior) / max(1, (z == 0).sum())) * len(z)
    model.scale = platt(np.array(m)[:, None], z, weight)
    return model


def score_texts(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, over its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two float arrays of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(_SIZE, np.int32)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for low, high, data, offsets in text_blocks(batch, "text"):
                score[low:high] = shared.value.score(data, offsets, last)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fit_quality(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*training_rows(docs, labels, "quality", ROWS_PER_CLASS, BYTES_PER_CLASS))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
