"""Quality classifier: a byte-level convolutional network in numpy.

Filters over ``WIDTH`` bytes run along overlapping chunks that cover the whole text. A filter is a
table of a weight for each offset and byte, so convolving is a table lookup. Each filter is
max-pooled within a chunk; the chunks are combined by their maximum, mean and minimum (the minimum
shows chunks that lack what all text has, such as one word said over and over); a logistic layer
over these gives one probability. Gradients flow to the pooled places only, so training is cheap.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosted_rules import labelled_sample
from .common import append_columns, text_bytes, unit_hash

FILTERS, WIDTH, CHUNK, STEP = 24, 5, 256, 192
#: Labelled documents for training, and their bytes together, at most in expectation.
TRAIN_ROWS, TRAIN_BYTES = 2500, 12_000_000
#: What each training document counts besides its text.
ROW_BYTES = 100


@dataclass
class Network:
    table: np.ndarray  # (WIDTH, 256, FILTERS)
    top: np.ndarray  # (3 * FILTERS,)
    bias: float
    mean: np.ndarray
    scale: np.ndarray


def chunk_starts(n: int) -> list[int]:
    """Chunks of CHUNK bytes every STEP bytes, the last one ending with the text."""
    if n <= CHUNK:
        return [0]
    return [*range(0, n - CHUNK, STEP), n - CHUNK]


def pooled(text: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, filters) maxima and the places of the maxima. A short text is padded with zero bytes."""
    c = np.frombuffer(text if len(text) >= WIDTH else text + bytes(WIDTH - len(text)), np.uint8)
    best, where = [], []
    starts = chunk_starts(len(c))
    group = 64  # chunks that are convolved together
    for g in range(0, len(starts), group):
        some = starts[g : g + group]
        lo, hi = some[0], min(len(c), some[-1] + CHUNK)
        m = hi - lo - WIDTH + 1
        y = table[0][c[lo : lo + m]]
        for j in range(1, WIDTH):
            y += table[j][c[lo + j : lo + j + m]]
        for s in some:
            part = y[s - lo : s - lo + CHUNK - WIDTH + 1]
            at = part.argmax(axis=0)
            best.append(part[at, np.arange(FILTERS)])
            where.append(at + s)
    return np.array(best), np.array(where)


def combine(p: np.ndarray) -> np.ndarray:
    r = np.tanh(p)
    return np.concatenate([r.max(axis=0), r.mean(axis=0), r.min(axis=0)])


def probability(net: Network, text: bytes) -> float:
    z = (combine(pooled(text, net.table)[0]) - net.mean) / net.scale @ net.top + net.bias
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 8, seed: int = 1) -> Network:
    """Stochastic gradient descent on filters and top layer together, classes weighted alike, then a
    Newton fit of the top layer over the learned filters. With one class only, its share is constant."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.35, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(3 * FILTERS), 0.0, np.zeros(3 * FILTERS), np.ones(3 * FILTERS))
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        net.bias = float(np.log(p / (1 - p)))
        return net
    start = np.array([combine(pooled(t, net.table)[0]) for t in texts])
    net.mean, net.scale = start.mean(axis=0), start.std(axis=0) + 0.05
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for epoch in range(epochs):
        rate = 0.05 / (1 + 0.5 * epoch)
        for i in rng.permutation(len(y)):
            p, where = pooled(texts[i], net.table)
            x = (combine(p) - net.mean) / net.scale
            err = weight[i] * (1 / (1 + np.exp(-np.clip(x @ net.top + net.bias, -30, 30))) - y[i])
            back = (err * net.top / net.scale).reshape(3, FILTERS)
            net.top -= rate * (err * x + 1e-4 * net.top)
            net.bias -= rate * err
            g = np.tile(back[1] / len(p), (len(p), 1))
            f = np.arange(FILTERS)
            np.add.at(g, (p.argmax(axis=0), f), back[0])
            np.add.at(g, (p.argmin(axis=0), f), back[2])
            g *= 1 - np.tanh(p) ** 2
            c = np.frombuffer(texts[i].ljust(WIDTH, b"\0"), np.uint8)
            for j in range(WIDTH):
                np.subtract.at(net.table[j], (c[where + j], np.broadcast_to(f, where.shape)), (rate * g).astype(np.float32))
    x = np.array([combine(pooled(t, net.table)[0]) for t in texts])
    net.mean, net.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = np.column_stack([(x - net.mean) / net.scale, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q) + 1e-6)[:, None]).T @ x + np.diag([1.0] * (len(w) - 1) + [1e-6])
        w -= np.linalg.solve(h, x.T @ (q - y) + np.append(w[:-1], 0))
    net.top, net.bias = w[:-1], float(w[-1])
    return net


def train_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, seed: int = 9
) -> Network:
    """A network trained on whole labelled documents, chosen by a hash of the id whatever their length: about
    ``rows`` of them, fewer if those would have more than ``most_bytes`` together. A null label or id is left
    out; of several labels of an id the least counts. Equal texts under one id count once; different ones are
    chosen one by one, so an id that many rows share adds no more than its part of the bytes."""
    picked = labelled_sample(labels, id_col, label_col, rows, seed)
    some = docs.select(F.col(f"`{id_col}`").alias("__id"), text_bytes(text_col).alias("__text")).join(F.broadcast(picked), "__id")
    text = F.xxhash64("__id", "__text")
    weight = F.octet_length("__text") + ROW_BYTES  # so that empty texts are bounded as well
    size = some.groupBy(text.alias("of")).agg(F.max(weight).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    got = some.where(unit_hash(text, seed + 1) < min(1.0, most_bytes / max(1, size))).distinct().collect()
    got.sort(key=lambda r: (r["__id"], bytes(r["__text"])))
    return train([bytes(r["__text"]) for r in got], np.array([r["__label"] for r in got], float))


def score_quality(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with score, the probability that the whole text is of label 1.

    Null texts count as empty; empty and very short texts are padded to one window. Rows are scored
    one by one, chunk by chunk, so memory does not grow with a text's length beyond a group of
    chunks; equal texts get equal scores. An empty table stays empty. An input column named score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        return lambda texts: [[probability(shared.value, t.as_py()) for t in texts]]

    return append_columns(docs, [text_bytes(text_col)], [T.StructField("score", T.DoubleType())], make)
