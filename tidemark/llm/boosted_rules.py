"""Quality rules: statistics of a document, fixed base rules, and gradient-boosted trees over the statistics.

The trees are trained here (histograms of 64 bins, logistic loss, Newton steps) and flattened into
numpy arrays of nodes, so that a batch of documents descends all trees at once. The score never
rises with the share of symbols, of repeated lines or of repeated words (monotonic constraints:
a split that would break them is not taken, and the middle of a split bounds what lies below it).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, append_columns, materialize, release, text_bytes, unit_hash, windows

#: Labelled rows that the trees are trained on, at most in expectation.
TRAIN_ROWS = 20_000
BINS = 64
FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_per_line", "chars_per_word", "symbol_share",
    "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "same_next_share", "wide_share",
)
#: -1: the score does not rise with the feature.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_WS = b" \t\n\x0b\x0c\r"
_NOT_FIRST = bytes(range(0x80, 0xC0))  # bytes that continue a code point
_SYMBOLS = b"#*$%&|<>"


def statistics(text: bytes, hasher: WordHash, width: int = 8) -> list[float]:
    """The values of FEATURES for one text."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _WS + _NOT_FIRST))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(_WS)]
    dup = len(lines) - len(set(lines))
    h = hasher.of(words)
    repeat = 0
    if n > width:
        _, inverse, counts = np.unique(windows(h, width), return_inverse=True, return_counts=True)
        cover = np.zeros(n + 1, np.int64)
        twice = np.flatnonzero(counts[inverse] > 1)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + width, -1)
        repeat = int(np.count_nonzero(np.cumsum(cover)[:n]))
    share = lambda x, of: x / of if of else 0.0
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(text) - len(text.translate(None, b"0123456789"))
    marks = len(text) - len(text.translate(None, b"!?;:\"'()[]{}/\\=+_~^@"))
    wide = sum(map(len, words)) - chars
    distinct = len(np.unique(h))
    same = int(np.count_nonzero(h[1:] == h[:-1]))
    return [
        n, chars, symbols, dup, repeat, share(n, len(lines)), share(chars, n), share(symbols, chars), share(dup, len(lines)), share(repeat, n),
        share(upper, chars), share(digits, chars), share(marks, chars), share(distinct, n), share(same, max(1, n - 1)), share(wide, chars),
    ]


@dataclass
class Trees:
    """Flattened nodes: feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        while (inner := self.feature[node] >= 0).any():
            value = x[rows, np.maximum(self.feature[node], 0)]
            node = np.where(inner, np.where(value <= self.cut[node], self.left[node], self.right[node]), node)
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def train_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, levels: int = 3, rate: float = 0.2, l2: float = 1.0) -> Trees:
    """Boosted trees for y in {0, 1}; with no rows or one class only, a constant."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(p / (1 - p)))
    nodes: list[list] = []
    roots: list[int] = []
    sign = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    if len(y) and y.min() < y.max():
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), base)

        def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
            at = len(nodes)
            gs, hs = g[rows].sum(), h[rows].sum()
            leaf = float(np.clip(-gs / (hs + l2), low, high))
            nodes.append([-1, 0.0, -1, -1, rate * leaf])
            best, choice = 1e-6, None
            if level and len(rows) >= 8:
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(bins[rows, f], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(bins[rows, f], h[rows], len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(bins[rows, f], minlength=len(c) + 1))[:-1]
                    wl, wr = np.clip(-gl / (hl + l2), low, high), np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    gain[(nl < 4) | (nl > len(rows) - 4) | (sign[f] * (wr - wl) < 0)] = 0
                    if gain.max() > best:
                        best, k = float(gain.max()), int(gain.argmax())
                        choice = (f, k, float(wl[k]), float(wr[k]))
            if choice:
                f, k, wl, wr = choice
                go = bins[rows, f] <= k
                middle = (wl + wr) / 2
                bounds = ((low, high), (low, high)) if not sign[f] else ((middle, high), (low, middle)) if sign[f] < 0 else ((low, middle), (middle, high))
                left = grow(rows[go], level - 1, *bounds[0], g, h)
                right = grow(rows[~go], level - 1, *bounds[1], g, h)
                nodes[at] = [f, float(cuts[f][k]), left, right, 0.0]
            return at

        for _ in range(rounds):
            q = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(len(y)), levels, -4.0, 4.0, q - y, np.maximum(q * (1 - q), 1e-6)))
            flat = _flatten(nodes, roots[-1:], 0.0)
            margin = margin + flat.margin(x)
    if not roots:
        nodes, roots = [[-1, 0.0, -1, -1, 0.0]], [0]
    return _flatten(nodes, roots, base)


def _flatten(nodes: list[list], roots: list[int], base: float) -> Trees:
    f, c, left, right, v = (np.array(x) for x in zip(*nodes, strict=True))
    return Trees(f.astype(np.int64), c.astype(float), left.astype(np.int64), right.astype(np.int64), v.astype(float), np.array(roots), base)


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with __stats, the array of FEATURES."""

    def make():
        hasher = WordHash()
        return lambda texts: [[statistics(t.as_py(), hasher) for t in texts]]

    return append_columns(docs, [text_bytes(text_col)], [T.StructField("__stats", T.ArrayType(T.DoubleType()))], make)


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, rows: int, seed: int) -> DataFrame:
    """At most about ``rows`` labelled ids, chosen by hash; one label for each id (the least)."""
    known = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__label")).where("__id is not null and __label is not null")
    rate = min(1.0, rows / max(1, known.count()))
    return known.where(unit_hash(F.col("__id"), seed) < rate).groupBy("__id").agg(F.min("__label").alias("__label"))


def train_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, seed: int = 5) -> Trees:
    """Trees trained on the statistics of a hash sample of labelled documents; only the statistics reach the driver.

    Equal statistics under one id count once. Where ids repeat so often that the sample has more than twice ``rows``
    documents, a second hash, of id and statistics, thins it to that."""
    picked = labelled_sample(labels, id_col, label_col, rows, seed)
    some = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")).join(F.broadcast(picked), "__id")
    sample = materialize(with_statistics(some, "__text").select("__id", "__label", "__stats").distinct(), "labelled")
    rate = min(1.0, 2 * rows / max(1, sample.count()))
    found = sample.where(unit_hash(F.xxhash64("__id", "__stats"), seed + 1) < rate).collect()
    release(sample)
    found.sort(key=lambda r: (r["__id"], r["__stats"]))
    x = np.array([r["__stats"] for r in found]).reshape(-1, len(FEATURES))
    return train_trees(x, np.array([r["__label"] for r in found], float))


def apply_rules(docs: DataFrame, trees: Trees, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with the statistics of STATS (long), base_failed, rule_score and kept.

    Words are runs of characters other than ASCII white space. base_failed: fewer than 20 words, or
    over 30 % of the words in 8-word windows that occur twice or more. kept: not base_failed and the
    trees give at least ``least``. Null and empty texts have zero statistics and fail the base rules.
    Rows are judged one by one; an empty table stays empty. Input columns named like an output column are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    fields = [T.StructField(s, T.LongType()) for s in STATS]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("rule_score", T.DoubleType()), T.StructField("kept", T.BooleanType())]

    def make():
        hasher = WordHash()

        def run(texts: pa.Array) -> list:
            x = np.array([statistics(t.as_py(), hasher) for t in texts], float)
            n, repeat = x[:, 0], x[:, 4]
            failed = (n < 20) | (100 * repeat > 30 * n)
            score = shared.value.probability(x)
            return [*(x[:, i].astype(np.int64) for i in range(len(STATS))), failed, score, ~failed & (score >= least)]

        return run

    return append_columns(docs, [text_bytes(text_col)], fields, make)
