"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three characters of the whole lower-cased text, weighted by
(1 + log count) * idf and scaled to length one. The weights are learned with follow-the-regularised-
leader (per-coordinate rates, L1 and L2 penalties); a temperature fitted on a held-back part of
the sample then calibrates the probabilities.

The model is fitted on a hash sample of labelled documents, about ``TRAIN_ROWS`` of each language.
Executors turn texts into sparse vectors; only these reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, unit_hash

DIMS = 1 << 15
TRAIN_ROWS = 500
#: Characters of a long text that are counted at a time.
PIECE = 1 << 18


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the whole text between two spaces, and their counts; each begins in one piece."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(DIMS, np.int64)
    for start in range(0, len(c), PIECE):
        x = c[start : start + PIECE + 2]
        two = x[:-1] * np.uint32(0x9E3779B1) + x[1:]
        three = two[:-1] * np.uint32(0x85EBCA77) + x[2:]
        grams = np.concatenate([x[:PIECE] * np.uint32(0xC2B2AE3D), two[:PIECE] * np.uint32(0x27D4EB2F), three[:PIECE] * np.uint32(0x165667B1)])
        total += np.bincount((grams >> np.uint32(17)).astype(np.int64), minlength=DIMS)
    at = np.flatnonzero(total)
    return at, total[at]


def weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(n)) * idf[at]
    norm = float(np.sqrt(v @ v))
    return v / norm if norm else v


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (DIMS + 1, languages); the last row is the bias
    temperature: float

    def probabilities(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = (weigh(at, n, self.idf) @ self.weights[at] + self.weights[-1]) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates and an elastic net, for several classes."""

    def __init__(self, dims: int, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02) -> None:
        self.z, self.n = np.zeros((dims, classes)), np.zeros((dims, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, v: np.ndarray, label: int) -> None:
        w = self.weights(at)
        s = v @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[label] -= 1
        g = v[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 3, seed: int = 3) -> LanguageModel:
    """A model of the labels' languages; every fifth vector fits the temperature only."""
    languages = sorted(set(labels))
    df = np.zeros(DIMS)
    for at, _ in vectors:
        df[at] += 1
    idf = np.log((1 + len(vectors)) / (1 + df)) + 1
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[x] for x in labels], np.int64)
    x = [(np.append(at, DIMS), np.append(weigh(at, n, idf), 1.0)) for at, n in vectors]
    held = np.arange(len(x)) % 5 == 4
    model = Ftrl(DIMS + 1, max(1, len(languages)))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(~held)):
            model.learn(*x[i], y[i])
    weights = model.weights(slice(None))
    if held.any():
        logits = np.array([x[i][1] @ weights[x[i][0]] for i in np.flatnonzero(held)])

        def loss(t: float) -> float:
            z = logits / t
            z = z - z.max(axis=1, keepdims=True)
            return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), y[held]]).mean())

        temperature = min(np.geomspace(0.25, 10, 81), key=loss)
    else:
        temperature = 1.0
    return LanguageModel(languages, idf, weights, float(temperature))


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, seed: int = 3) -> LanguageModel:
    """Fit on about ``rows`` documents of each language with text and label, chosen by a hash of id and text.

    Equal texts under one id count once, so copies neither fill the sample nor the driver. Every language is
    learned; the model takes 32,769 weights for each."""
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("id is not null and text is not null and lang is not null")
    text = F.xxhash64("id", "text")
    counts = known.groupBy("lang").agg(F.approx_count_distinct(text).alias("n"))
    rates = counts.select(F.col("lang").alias("__of"), (F.lit(float(rows)) / F.col("n")).alias("__rate"))
    some = known.join(F.broadcast(rates), F.col("lang") == F.col("__of")).where(unit_hash(text, seed) < F.col("__rate")).select("id", "text", "lang").distinct()

    def make():
        def run(texts: pa.Array) -> list:
            found = [ngram_counts(t.as_py()) for t in texts]
            return [[a.astype(np.int32).tobytes() for a, _ in found], [n.astype(np.int32).tobytes() for _, n in found]]

        return run

    fields = [T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())]
    got = append_columns(some, [F.col("text")], fields, make).select("id", "lang", "at", "n").collect()
    if not got:
        return LanguageModel([], np.ones(DIMS), np.zeros((DIMS + 1, 1)), 1.0)
    got.sort(key=lambda r: (r.id, r.lang, bytes(r.at)))
    return fit([(np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.int32)) for r in got], [r.lang for r in got])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the calibrated probability of lang_pred).

    Null texts and texts without a letter get `und` with score 1; so do all texts if no language was
    learned (score 0). Whole texts are read. Ties go to the first language by name. Rows are judged
    one by one; an empty table stays empty. Input columns named like an output column are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(texts: pa.Array) -> list:
            m, names, scores = shared.value, [], []
            for t in texts:
                t = t.as_py()
                if t is None or not any(map(str.isalpha, t)):
                    name, p = "und", 1.0
                elif not m.languages:
                    name, p = "und", 0.0
                else:
                    all_p = m.probabilities(*ngram_counts(t))
                    k = int(all_p.argmax())
                    name, p = m.languages[k], float(all_p[k])
                names.append(name)
                scores.append(p)
            return [names, scores]

        return run

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return append_columns(docs, [F.col(f"`{text_col}`")], fields, make)
