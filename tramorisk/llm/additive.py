"""Quality classifier: an additive model with pairwise interactions.

Features of the whole text are cut into bins. Boosting goes round the features
in turn; each step fits a tree of at most three splits to the gradient summed by
bin and adds it, shrunk, to that feature's lookup table. The strongest pairs
then get tables over both features' coarse bins. Scoring adds table entries.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``); each
row brings only its feature vector to the driver.

Defined results: null and empty texts have the features of the empty text and
are scored. With one class or no label the score is that prior (0.5 without
any). Several labels of one document count as their mean; a null label is none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tramorisk.llm.store import id_hash
from tramorisk.llm.textbytes import SPACED, annotate, byte_class, byte_codes, owners, sums, word_hashes, words

SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAST_ROWS = 60, 20, 0.15, 10
LINE = byte_class(lambda b: b not in (0x0A, 0x0D))
CODES, LINE_CODES = byte_codes(SPACED), byte_codes(LINE)
CLASSES = {
    "upper": byte_class(lambda b: 0x41 <= b <= 0x5A),
    "digit": byte_class(lambda b: 0x30 <= b <= 0x39),
    "stop": byte_class(lambda b: chr(b) in ".,;:!?" and b < 0x80),
    "symbol": byte_class(lambda b: chr(b) in "#$%&*@^~|<>{}[]\\/=+_" and b < 0x80),
    "space": ~SPACED,
    "wide": byte_class(lambda b: b >= 0x80),
}
FEATURES = ("log_words", "log_bytes", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "repeats",
            "distinct_lines", "line_words", *CLASSES)


def run_lengths(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(np.append(np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])), len(sorted_keys)))


def per_text(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements and the count of the most frequent one, of each text."""
    n = len(bounds) - 1
    distinct, top = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if len(hashes):
        key = np.sort((owners(bounds).astype(np.uint64) << np.uint64(51)) | (hashes >> np.uint64(13)))
        lengths = run_lengths(key)
        owner = (key[np.cumsum(lengths) - 1] >> np.uint64(51)).astype(np.int64)
        distinct = np.bincount(owner, minlength=n)
        np.maximum.at(top, owner, lengths)
    return distinct, top


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Texts x features, in the order of FEATURES."""
    first, last, bounds = words(buf, starts, ends, SPACED)
    h = word_hashes(buf, first, last, CODES)
    n = np.diff(bounds)
    some = np.maximum(n, 1)
    size = last - first
    distinct, top = per_text(h, bounds)
    again = np.zeros(len(h), dtype=np.int64)
    if len(h) > 1:
        again[1:] = h[1:] == h[:-1]
        again[bounds[:-1][n > 0]] = 0
    a, b, lines = words(buf, starts, ends, LINE)
    different, _ = per_text(word_hashes(buf, a, b, LINE_CODES), lines)
    m = np.maximum(np.diff(lines), 1)
    length = np.maximum(ends - starts, 1)
    edges = np.append(starts, len(buf))
    columns = [np.log1p(n), np.log1p(ends - starts), sums(size, bounds) / some, sums((size > 14).astype(int), bounds) / some,
               sums((size < 3).astype(int), bounds) / some, distinct / some, top / some, sums(again, bounds) / some, different / m, n / m]
    columns += [sums(inside[buf].astype(np.int32), edges) / length for inside in CLASSES.values()]
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass(frozen=True)
class Model:
    """Bin edges, lookup tables by feature and by pair of features, and the intercept."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    base: float


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)


def coarse(bins: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    width = np.array([len(e) + 1 for e in edges])
    return bins * PAIR_BINS // np.maximum(width, PAIR_BINS)


def shallow_tree(g: np.ndarray, h: np.ndarray, count: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Newton step by bin: a greedy tree over ordered bins with up to ``leaves`` leaves."""
    cuts = [(0, len(g))]
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0)
    while len(cuts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(cuts):
            left_g, left_h, left_n = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1], np.cumsum(count[a:b])[:-1]
            right_n = count[a:b].sum() - left_n
            if not len(left_g):
                continue
            value = left_g ** 2 / (left_h + 1.0) + (g[a:b].sum() - left_g) ** 2 / (h[a:b].sum() - left_h + 1.0) - gain(a, b)
            value[(left_n < LEAST_ROWS) | (right_n < LEAST_ROWS)] = 0
            at = int(value.argmax())
            if value[at] > best[0]:
                best = (value[at], k, a + at + 1)
        if best[1] is None:
            break
        a, b = cuts[best[1]]
        cuts[best[1]:best[1] + 1] = [(a, best[2]), (best[2], b)]
    step = np.zeros(len(g))
    for a, b in cuts:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return step


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the single tables, then of the strongest pairs on what is left."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(len(FEATURES))]
    prior = (float(y.sum()) + 1.0) / (len(y) + 2.0)
    base = float(np.log(prior / (1 - prior)))
    tables = [np.zeros(len(e) + 1) for e in edges]
    if len(y) < 2 * LEAST_ROWS or y.min() == y.max():
        return Model(edges, tables, [], base)
    bins = binned(x, edges)
    z = np.full(len(y), base)
    for _ in range(ROUNDS):
        for k, table in enumerate(tables):
            p = sigmoid(z)
            n = len(table)
            step = RATE * shallow_tree(np.bincount(bins[:, k], y - p, n), np.bincount(bins[:, k], p * (1 - p), n), np.bincount(bins[:, k], minlength=n))
            table += step
            z += step[bins[:, k]]
    small, cells = coarse(bins, edges), PAIR_BINS * PAIR_BINS
    p = sigmoid(z)
    ranked = []
    for i in range(len(edges)):
        for j in range(i + 1, len(edges)):
            cell = small[:, i] * PAIR_BINS + small[:, j]
            g, h = np.bincount(cell, y - p, cells), np.bincount(cell, p * (1 - p), cells)
            ranked.append((-(g ** 2 / (h + 5.0)).sum(), i, j))
    pairs = [(i, j, np.zeros(cells)) for _, i, j in sorted(ranked)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            p = sigmoid(z)
            cell = small[:, i] * PAIR_BINS + small[:, j]
            g, h, c = (np.bincount(cell, w, cells) for w in (y - p, p * (1 - p), None))
            step = RATE * np.where(c >= LEAST_ROWS, g / (h + 5.0), 0.0)
            table += step
            z += step[cell]
    return Model(edges, tables, pairs, base)


def score(x: np.ndarray, model: Model) -> np.ndarray:
    """Probability of label 1: a sum of table entries per row."""
    bins = binned(x, model.edges)
    z = np.full(len(x), model.base)
    for k, table in enumerate(model.tables):
        z += table[bins[:, k]]
    small = coarse(bins, model.edges)
    for i, j, table in model.pairs:
        z += table[small[:, i] * PAIR_BINS + small[:, j]]
    return sigmoid(z)


def train_model(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """Fit on at most about ``limit`` labelled rows outside the held-out fold, chosen by a hash of the id."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (id_hash("doc_id") % 3 != 1)).groupBy("doc_id").agg(F.avg("quality").alias("_y"))
    total = marks.count()
    if total > limit:
        marks = marks.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < int(limit / total * (1 << 30)))
    # The kept labels are bounded by ``limit``, so this broadcast has a fixed size and the texts stay in place.
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    wide = annotate(rows, "text", "_x", "array<double>", lambda r, buf, s, e: pa.array(list(features(buf, s, e)), pa.list_(pa.float64())))
    got = wide.select("doc_id", "_y", "_x").collect()
    got.sort(key=lambda r: (r["doc_id"], r["_x"]))
    return fit(np.array([r["_x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["_y"] for r in got]))


def classify(docs: DataFrame, model: Model, text: str = "text", out: str = "quality_score") -> DataFrame:
    """Add ``out``: score between 0 and 1. A column of that name is replaced."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, text, out, "double", lambda rows, buf, starts, ends: pa.array(score(features(buf, starts, ends), shipped.value)))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = classify(docs.select("doc_id", "text"), train_model(docs, labels), out="_score")
    return found.select("doc_id", (id_hash("doc_id") % 3 == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
