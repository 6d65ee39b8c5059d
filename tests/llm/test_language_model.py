"""The score of the language model: a plain version, sums to one, and one probability per text."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tramorisk.llm import maxent

WORDS = [f"w{i}{'abc'[i % 3]}" for i in range(30)]


def corpus(n: int, length: int = 12) -> list[tuple[int, str]]:
    return [(i, " ".join(np.random.default_rng(i).choice(WORDS, length))) for i in range(n)]


def softmax(z: list[float]) -> list[float]:
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def hashed(x: int) -> int:
    return int(maxent.mix(np.array([x], dtype=np.uint64))[0])


def plain_scores(rows: list[tuple[int, str]], shared: np.ndarray, levels: int, models: int) -> dict[int, float]:
    """Score by loops over tokens; each model's training tokens are one gradient step, as long as they fit one batch."""
    tokens = []  # id, trains, model, features, path, word
    for i, text in rows:
        raw = text.encode()
        h, bounds = maxent.tokens(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
        features, before = maxent.hashed_context(h, bounds)
        for j, w in enumerate(h.tolist()):
            path = (w & 15) << 4 * (levels - 1) | w >> (64 - 4 * (levels - 1))
            tokens.append((i, zlib.crc32(str(i).encode()) % 7 != 2, hashed((int(before[j]) + 9) % 2**64) >> (65 - models.bit_length()), [int(f) >> 48 for f in features[:, j]], path, w))
    count = Counter(t[5] for t in tokens if t[1])
    leaf_words = defaultdict(set)
    for t in tokens:
        if t[1]:
            leaf_words[t[4]].add(t[5])
    score = defaultdict(float)
    for i, *_, path, w in tokens:
        inside = leaf_words[path]
        score[i] += math.log10((count[w] + 1) / (sum(count[x] for x in inside) + len(inside) + 1))
    for model in range(models):
        mine = [t for t in tokens if t[2] == model]
        for level in range(levels):
            below = 4 * (levels - level - 1)
            digits = defaultdict(lambda: [0.5] * 16)
            for t in mine:
                if t[1]:
                    digits[t[4] >> (below + 4)][t[4] >> below & 15] += 1

            def start(t):
                if level:
                    found = digits[t[4] >> (below + 4)]
                    return [math.log(x / sum(found)) for x in found]
                narrow = maxent.WIDE_SLOTS // maxent.SLOTS
                return [float(sum(shared[k * maxent.SLOTS + f // narrow][d] for k, f in enumerate(t[3])) + shared[-1][d]) for d in range(16)]

            def slots(t):
                return [(k, f if not level else hashed(f | (t[4] >> (below + 4)) << 16) >> 48) for k, f in enumerate(t[3])]

            pull, met = defaultdict(lambda: [0.0] * 16), Counter()
            for t in mine:
                if t[1]:
                    p = softmax(start(t))
                    for s in slots(t):
                        met[s] += 1
                        for d in range(16):
                            pull[s][d] += (d == t[4] >> below & 15) - p[d]
            for t in mine:
                z = start(t)
                for s in slots(t):
                    if met[s]:
                        z = [a + g * maxent.RATE / math.sqrt((maxent.PRIOR + met[s]) * met[s]) for a, g in zip(z, pull[s], strict=True)]
                score[t[0]] += math.log10(softmax(z)[t[4] >> below & 15])
    return score


def test_score_is_that_of_a_plain_version(spark):
    rows = [*corpus(60), (100, ""), (101, "w1b unknown"), (102, "w1b unknown")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    h = [x for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for x in maxent.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t)]))[0].tolist()]
    train = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    # With one text in a task the order of the shared model's updates is fixed: both read the same partitions.
    shared = maxent.train(train.coalesce(1), np.bincount([x & 15 for x in h], minlength=16))
    levels = maxent.depth(sum(len(t) for _, t in rows) / maxent.BYTES_PER_WORD, maxent.LEAST_BUCKETS)
    wanted = plain_scores(rows, shared, levels, maxent.LEAST_MODELS)
    got = {r["doc_id"]: r["score"] for r in maxent.score_documents(docs.coalesce(1)).collect()}
    assert got.keys() == wanted.keys()
    assert all(abs(got[i] - wanted[i]) < 1e-3 * max(1, abs(wanted[i])) for i in got)


def unit(levels: int, features: np.ndarray, number: int, crowd: int = 0, at: int = 2) -> pa.Table:
    """Training tokens of one unit, and one held-out text that has every path behind the first token's features."""
    rng = np.random.default_rng(number)
    path = rng.integers(0, 16 ** levels, len(features)).astype("<u4")
    every = np.arange(16 ** levels, dtype="<u4")
    binary = lambda *parts: pa.array([p.tobytes() for p in parts], pa.binary())
    return pa.table({"unit": pa.array([at, at], pa.int32()), "crowd": pa.array([crowd] * 2, pa.int32()),
                     "keys": binary(np.array([7], "<i8"), np.arange(1000, 1000 + len(every), dtype="<i8")), "train": binary(np.ones(1, "u1"), np.zeros(len(every), "u1")),
                     "lengths": binary(np.array([len(path)], "<u4"), np.ones(len(every), "<u4")), "paths": binary(path, every),
                     "features": binary(features.astype("<u2"), np.tile(features[0].astype("<u2"), (len(every), 1)))})


def test_all_paths_of_a_context_sum_to_one():
    features = np.random.default_rng(1).integers(0, 50, (3000, maxent.FEATURES))
    shared = maxent.new_weights(np.ones(16)) + np.random.default_rng(2).normal(0, 0.1, 16).astype(np.float32)
    total = lambda t: sum(10 ** x for k, x in zip(t.column("key").to_pylist(), t.column("log").to_pylist(), strict=True) if k >= 1000)
    assert abs(total(maxent.path_logs(unit(2, features, 1), shared, 2)) - 1) < 1e-4
    crowds = maxent.Crowds(np.array([5], dtype=np.uint64), np.array([100]), 2, 1)
    first = int(crowds.first[int(crowds.crowd[0])])
    shards = [maxent.shard_updates(unit(2, features, k, int(crowds.crowd[0]), first + k), crowds, shared, 2) for k in range(3)]
    pieces = pa.concat_tables(shards)
    learned = pa.concat_tables([maxent.merged(pieces.filter(pa.compute.equal(pieces["level"], level))) for level in (-1, 0, 1)])
    answers = [maxent.shard_logs(unit(2, features, k, int(crowds.crowd[0]), first + k), learned, shared, 2) for k in range(3)]
    assert all(abs(total(a) - 1) < 1e-4 for a in answers)
    held = [[x for k, x in zip(a.column("key").to_pylist(), a.column("log").to_pylist(), strict=True) if k >= 1000] for a in answers]
    assert held[0] == held[1] == held[2]  # one probability, whatever the shard


def test_merging_averages_by_use():
    rows = [maxent.pieces(3, 0, b, np.array([1, s]), np.array([n, 1.0]), np.full((2, 16), v)) for b, s, n, v in [(0, 4, 1.0, 1.0), (1, 5, 3.0, 2.0)]]
    out = maxent.merged(maxent.piece_table(rows)).to_pylist()[0]
    assert (out["crowd"], out["level"], out["block"]) == (3, 0, 0)
    assert np.frombuffer(out["names"], "<u4").tolist() == [1, 4, 5] and np.frombuffer(out["seen"]).tolist() == [4, 1, 1]
    assert np.allclose(np.frombuffer(out["weights"], "<f4").reshape(-1, 16)[:, 0], [1.75, 1, 2])


@pytest.mark.parametrize("model_tokens", [64, 512, maxent.MODEL_TOKENS])
def test_equal_texts_have_equal_scores(spark, model_tokens):
    """Also behind crowded words (of which the small models have many, in up to some hundred shards) and at the start of a text."""
    rows = [*corpus(150), *[(1000 + i, corpus(8)[i % 8][1]) for i in range(200)]]
    docs = spark.createDataFrame([*rows, (None, "w1b"), (9999, None)], "doc_id long, text string")
    out = maxent.score_documents(docs, model_tokens=model_tokens)
    assert out.count() == len(rows) + 2 and not out.filter("score IS NULL OR isnan(score) OR score >= 0").count()
    by_text = out.join(docs, "doc_id").groupBy("text").agg(F.countDistinct("score").alias("n"))
    assert by_text.filter("n > 1").count() == 0


def test_crowded_words_learn_from_context(spark):
    """With every word crowded the model still beats the base on held-out texts that follow a rule."""
    rows = [(i, " ".join(WORDS[(s * 7 + j * (1 + s % 3)) % 30] for j in range(30))) for i, s in enumerate(np.random.default_rng(0).integers(0, 9, 300).tolist())]
    out = maxent.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), model_tokens=128)
    got = out.filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]
