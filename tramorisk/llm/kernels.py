"""Language identification with string kernels.

A text is the set of its byte n-grams of orders 1 to 4 (blended spectrum,
presence only), hashed to a fixed number of dimensions. The kernel of two
texts is the number of shared n-grams over the root of the product of their
numbers. A few landmarks per language give a Nystroem feature map; one-versus-
rest ridge regression on it, solved from a bounded sample, is folded into one
matrix, so that scoring a batch is two matrix products.

Defined results: null texts and texts without a letter give ``und`` with score
0, as does everything when there is nothing to learn from. Ties go to the
language that is first in order. Repeated rows agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tramorisk.llm.store import id_hash
from tramorisk.llm.textbytes import STEP, annotate

DIMENSIONS = 1 << 14
ORDERS = (1, 2, 3, 4)
LANDMARKS = 64
SAMPLE_PER_LANGUAGE = 300
RIDGE = 1e-3
DOCS_PER_PRODUCT = 256
SCALE = 4.0


def presence(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Texts x dimensions: which hashed n-grams occur. ASCII letters are folded to lower case."""
    seen = np.zeros((len(starts), DIMENSIONS), dtype=bool)
    low = np.where((buf >= 0x41) & (buf <= 0x5A), buf + 32, buf).astype(np.uint64)
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    left = np.repeat(ends, ends - starts) - np.arange(len(buf))  # bytes from here to the end of the text
    gram = np.zeros(len(buf), dtype=np.uint64)
    for n in ORDERS:
        if len(buf) < n:
            break
        gram = (gram[:len(buf) - n + 1] << np.uint64(8)) | low[n - 1:]
        inside = left[:len(gram)] >= n
        slot = ((gram[inside] + np.uint64(n)) * STEP) >> np.uint64(64 - DIMENSIONS.bit_length() + 1)
        seen[doc[:len(gram)][inside], slot.astype(np.int64)] = True
    return seen


@dataclass(frozen=True)
class Model:
    """Languages, landmark presence (dimensions x landmarks) and the folded regression (landmarks x languages)."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray


def kernel(seen: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of texts with unit landmark columns."""
    size = np.sqrt(np.maximum(seen.sum(axis=1), 1)).astype(np.float32)
    return (seen.astype(np.float32) @ landmarks) / size[:, None]


def fit(seen: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Model from the presence rows and languages of the sample, which come in a fixed order."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros((0, 0), np.float32))
    label = np.array([names.index(x) for x in langs])
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(label == k)[:each] for k in range(len(names))])
    unit = seen[chosen].astype(np.float32)
    unit /= np.sqrt(np.maximum(unit.sum(axis=1, keepdims=True), 1))
    values, vectors = np.linalg.eigh((unit @ unit.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))  # K^(-1/2) up to a rotation
    phi = kernel(seen, unit.T).astype(np.float64) @ root
    # Every language weighs the same, however often it occurs in the sample.
    weight = (1.0 / np.bincount(label, minlength=len(names)))[label] * len(label) / len(names)
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    gram = (phi * weight[:, None]).T @ phi + ridge * len(label) * np.eye(phi.shape[1])
    solved = np.linalg.solve(gram, (phi * weight[:, None]).T @ target)
    return Model(names, np.ascontiguousarray(unit.T), (root @ solved).astype(np.float32))


def sample(train: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """About ``per_language`` rows of each language, by a hash of the id: a narrow filter after one small count."""
    counts = train.groupBy("lang").count().collect()  # one row per label to learn
    if not counts:
        return train.limit(0)
    parts = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))])
    return train.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")), F.lit(1 << 30)) < parts[F.col("lang")] * (1 << 30))


def packed(rows, buf, starts, ends) -> pa.Array:
    return pa.array([np.packbits(r).tobytes() for r in presence(buf, starts, ends)], pa.binary())


def train_model(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on a bounded sample; only its hashed presence bits reach the driver, 2 KB a text."""
    train = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (id_hash("doc_id") % 4 != 2))
    rows = annotate(sample(train.select("doc_id", "lang", "text"), per_language), "text", "_bits", "binary", packed, DOCS_PER_PRODUCT)
    got = rows.select("lang", "_bits", F.xxhash64(F.col("doc_id").cast("string")).alias("o")).collect()
    got.sort(key=lambda r: (r["o"], r["lang"], bytes(r["_bits"])))
    seen = np.array([np.unpackbits(np.frombuffer(bytes(r["_bits"]), dtype=np.uint8)) for r in got], dtype=bool).reshape(len(got), DIMENSIONS)
    return fit(seen, [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """Add ``out``: struct of ``lang`` and ``score`` (0 to 1). A column of that name is replaced."""
    if not model.languages:
        return docs.withColumn(out, F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score")))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # landmarks x dimensions floats, 4 MB whatever the input

    def run(rows, buf, starts, ends):
        m = shipped.value
        margin = kernel(presence(buf, starts, ends), m.landmarks) @ m.weights
        best = margin.argmax(axis=1)
        soft = np.exp(SCALE * (margin - margin.max(axis=1, keepdims=True)))
        score = 1.0 / soft.sum(axis=1)
        return pa.StructArray.from_arrays([pa.array([m.languages[b] for b in best], pa.string()), pa.array(score.astype(np.float64))], ["lang", "score"])

    found = annotate(docs, text, out, "struct<lang:string,score:double>", run, DOCS_PER_PRODUCT)
    spoken = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return found.withColumn(out, F.when(spoken, F.col(out)).otherwise(F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))))


def language_report(docs: DataFrame) -> DataFrame:
    model = train_model(docs)
    found = predict(docs.select("doc_id", "text"), model, out="_lang")
    return found.select("doc_id", (id_hash("doc_id") % 4 == 2).alias("held_out"), F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"))
