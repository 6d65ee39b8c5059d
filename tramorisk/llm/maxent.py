"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

A word's path is a class, a hash of its last two bytes, and then digits of its
own hash; the end of a text has a class of its own. P(word | context) is the
product of one softmax per digit of the path and of P(word | path). Every softmax
takes the context's features: the word before, the two words before, and two
skips. The number of digits grows with the logarithm of the training tokens, so
that the leaves grow about as their root does, as a vocabulary does.

Tokens are dealt by the word before to models, whose number grows with the
training tokens; a model holds ``WIDE_SLOTS`` slots per feature and digit, learns
from all its training tokens and answers with one sum per text. A crowded word
(or the start of a text) stands before too many tokens for one task: crowds of such
words are models whose tokens are dealt by text over shards. Shards learn apart, their
updates are averaged slot by slot, and all shards are scored by the one result, so the
id never decides a probability. Beneath the first digit lies a small model shared by
all: tasks update it on their texts and Spark averages the updates; a round takes in
every training text. All weights are drawn to zero (``DECAY``).

The last factor is the maximum-entropy solution with word features only: (c + 1) /
(N_leaf + V_leaf + 1), where one place per leaf is for unknown words, so the
probabilities of known and unknown words sum to 1.

Counts never travel whole. Texts send their distinct words, packed, to buckets
by hash; a bucket knows the counts of its words and whole leaves, and answers with
one partial sum per text, which serves the base score and the last factor alike.

Defined results: null and empty texts are one end token. Repeated rows are
separate training texts with equal scores. A null id counts as the empty text
in the fold. Without any training text every count is 0 and the classes are
uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tramorisk.llm.repeats import binaries, joined, runs
from tramorisk.llm.store import id_hash, power_of_two, stored
from tramorisk.llm.textbytes import SPACED, STEP, byte_codes, groups, mix, owners, word_hashes, words

CLASSES, SLOTS, FEATURES = 16, 1 << 13, 4
WIDE_BITS, CROWD_BITS, MODEL_TOKENS, LEAST_MODELS = 16, 14, 1 << 20, 2
WIDE_SLOTS = 1 << WIDE_BITS
CROWD, SHARD, MERGED, COPIES, MOST_CROWDED = 16, 4, 16, 256, 1 << 22  # sizes of crowds and shards are multiples of a model's tokens
CODES = byte_codes(SPACED)
DIGIT = CLASSES.bit_length() - 1
END = mix(np.array([1], dtype=np.uint64))[0] & ~np.uint64(CLASSES - 1)  # class 0
ROUNDS, RATE, MINIBATCH, MODEL_BATCH = 1, 0.7, 1 << 15, 1 << 11
PRIOR, DECAY = 1.0, 0.05
START = np.uint64(1)  # stands for the word before the first one
BUCKET_BYTES, LEAST_BUCKETS, PACKED, BYTES_PER_WORD = 24 << 20, 32, 9, 8
SHARDS = 16


def tokens(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with the class in the low bits, one end after each text's words; and the bounds of each text."""
    first, last, bounds = words(buf, starts, ends, SPACED)
    h = word_hashes(buf, first, last, CODES)
    if len(h):
        tail = CODES[buf[last - 1]] + STEP * np.where(last - first > 1, CODES[buf[np.maximum(last - 2, 0)]], np.uint64(0))
        group = (mix(tail) % np.uint64(CLASSES - 1) + np.uint64(1))
        h = (h & ~np.uint64(CLASSES - 1)) | group
    n = len(starts)
    place = np.arange(len(h)) + owners(bounds)
    out = np.empty(len(h) + n, dtype=np.uint64)
    out[place] = h
    wide = bounds + np.arange(n + 1)
    out[wide[1:] - 1] = END
    return out, wide


def hashed_context(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of each token: word before, two words before, and skips over one and over two words; and the word before."""
    n, far = len(h), np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))
    before = []
    for k in (1, 2, 3):
        moved = np.zeros(n, dtype=np.uint64)
        moved[k:] = h[:n - k] if n > k else moved[k:]
        before.append(np.where(far >= k, moved, np.uint64(k)))
    raw = [before[0], before[0] * STEP + before[1], before[1], before[2]]
    return np.stack([mix(x + np.uint64(k)) for k, x in enumerate(raw)]), before[0]


def context(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Feature slots of each token in the shared model."""
    return (hashed_context(h, bounds)[0] >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64) + np.arange(FEATURES)[:, None] * SLOTS


def class_logits(slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = np.take(weights, slots[0], axis=0, mode="clip")  # slots are in range; clipping spares the copy that checking takes
    for s in slots[1:]:
        z += np.take(weights, s, axis=0, mode="clip")
    z += weights[-1]
    return z


def new_weights(class_counts: np.ndarray) -> np.ndarray:
    """Feature slots x classes, and a last row that every token has: at the start the log frequencies of the classes."""
    weights = np.zeros((FEATURES * SLOTS + 1, CLASSES), dtype=np.float32)
    weights[-1] = np.log((class_counts + 1.0) / (class_counts.sum() + len(class_counts)))
    return weights


def shares(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def learn(slots: np.ndarray, target: np.ndarray, weights: np.ndarray, speed: np.ndarray, start: np.ndarray | None = None, step_rows: int = MINIBATCH) -> None:
    """Gradient steps on the weights in place, over logits ``start``; a feature seen more often moves less at a time."""
    for a in range(0, len(target), step_rows):
        part, label = slots[:, a:a + step_rows], target[a:a + step_rows]
        z = class_logits(part, weights)
        z = shares(z if start is None else z + start[a:a + step_rows])
        np.negative(z, out=z)
        z[np.arange(len(label)), label] += 1.0
        for row in part:
            order = np.argsort(row.astype(np.uint16), kind="stable")  # a feature's slots are in one range of at most 16 bits, which sort fastest
            first, length = runs(row[order])
            step = np.take(z, order[first], axis=0, mode="clip")
            many = np.flatnonzero(length > 1)  # most slots of the longer features are met once, and need no sum
            if len(many):
                size = length[many]
                begin = np.cumsum(size) - size
                inside = np.repeat(first[many] - begin, size) + np.arange(int(size.sum()))
                step[many] = np.add.reduceat(np.take(z, order[inside], axis=0, mode="clip"), begin, axis=0)
            at = row[order][first]
            now, often = np.take(weights, at, axis=0, mode="clip"), speed[at] + length
            speed[at] = often
            step -= np.float32(DECAY) * now
            step *= (RATE / np.sqrt(often * length))[:, None].astype(np.float32)
            now += step
            weights[at] = now


def update(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One task's weights after its texts, times its tokens, in shards."""
    own, speed, seen = weights.copy(), np.ones(len(weights)), 0
    for batch in batches:
        for _, buf, starts, ends in groups(batch, "text"):
            h, bounds = tokens(buf, starts, ends)
            learn(context(h, bounds), (h & np.uint64(CLASSES - 1)).astype(np.int64), own, speed)
            seen += len(h)
    if seen:
        parts = np.array_split((own - weights).astype("<f4"), SHARDS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SHARDS), pa.int32()), pa.array([seen] * SHARDS, pa.int64()),
                                          pa.array([p.tobytes() for p in parts], pa.binary())], names=["shard", "tokens", "delta"])


def averaged(groups_of: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, weight = None, 0
    for batch in batches:
        for n, delta in zip(batch.column("tokens"), batch.column("delta"), strict=True):
            part = np.frombuffer(delta.as_buffer(), dtype="<f4").astype(np.float64) * n.as_py()
            total, weight = part if total is None else total + part, weight + n.as_py()
    yield pa.RecordBatch.from_arrays([pa.array([groups_of[0].as_py()], pa.int32()), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], names=["shard", "delta"])


def train(texts: DataFrame, class_counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the shared model after ``rounds`` of distributed updates over all of ``texts``. Their size is fixed, about 2 MB: what grows are the models above them."""
    weights, context_ = new_weights(class_counts), texts.sparkSession.sparkContext
    for _ in range(rounds):
        shipped = context_.broadcast(weights)
        sent = texts.select("text").mapInArrow(lambda b: update(b, shipped.value), "shard int, tokens long, delta binary")
        means = sent.groupBy("shard").applyInArrow(averaged, "shard int, delta binary").collect()
        shards = np.array_split(weights.copy(), SHARDS)
        for r in means:
            shards[r["shard"]] = shards[r["shard"]] + np.frombuffer(bytes(r["delta"]), dtype="<f4").reshape(shards[r["shard"]].shape)
        weights = np.concatenate(shards)
    return weights


def send(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct tokens of each text with their numbers, packed by bucket."""
    shift = np.uint64(64 - buckets.bit_length() + 1)
    for batch in batches:
        for rows, buf, starts, ends in groups(batch, "text"):
            keys = rows.column("key").to_numpy(zero_copy_only=False)
            trains = np.array(rows.column("train").to_pylist(), dtype=np.uint8)
            h, bounds = tokens(buf, starts, ends)
            # Distinct tokens of the group first, so that (text, token) sorts as one number.
            names, place = np.unique(h, return_inverse=True)
            pair = np.sort((owners(bounds) << 32) | place)
            first, tf = runs(pair)
            owner, value = pair[first] >> 32, names[pair[first] & 0xFFFFFFFF]
            bucket = (value >> shift).astype(np.int32)
            # Numbers above 255 stand as several entries of one token.
            cuts = -(-tf // 255)
            if len(cuts) and cuts.max() > 1:
                number = np.full(int(cuts.sum()), 255, dtype=np.int64)
                number[np.cumsum(cuts) - 1] = tf - (cuts - 1) * 255
                owner, value, bucket = np.repeat(owner, cuts), np.repeat(value, cuts), np.repeat(bucket, cuts)
            else:
                number = tf
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            owner, value, bucket, number = owner[order], value[order], bucket[order], number[order]
            start, length = runs(bucket.astype(np.int64) << 32 | owner)
            at, per = runs(bucket[start])
            ends_ = np.concatenate([[0], np.cumsum(length)])
            elements = ends_[at + per] - ends_[at]
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[start][at], pa.int32()), binaries(keys[owner[start]], per), binaries(trains[owner[start]], per),
                binaries(length.astype(np.uint32), per), binaries(value, elements), binaries(number.astype(np.uint8), elements)],
                names=["bucket", "keys", "train", "lengths", "words", "numbers"])


def depth(tokens_: float, buckets: int) -> int:
    """Digits of a path: about a leaf for each root of the tokens, and no leaf in two buckets."""
    return max(2, int(np.ceil(np.log2(max(tokens_, 1.0)) / 2 / DIGIT)), 1 + -(-(buckets.bit_length() - 1) // DIGIT))


def paths(h: np.ndarray, levels: int) -> np.ndarray:
    rest = np.uint64(DIGIT * (levels - 1))
    return (h & np.uint64(CLASSES - 1)) << rest | h >> (np.uint64(64) - rest)


def answer(table: pa.Table, levels: int, crowded_from: int) -> pa.Table:
    """Per text (kind 0): sums of number * log10(c + 1) and of number * log10(N_leaf + V_leaf + 1), tokens and known tokens;
    per class (1): tokens and distinct tokens of the training texts; crowded words (2) with their tokens."""
    keys, trains, lengths = joined(table.column("keys"), "<i8"), joined(table.column("train"), "u1"), joined(table.column("lengths"), "<u4").astype(np.int64)
    h, number = joined(table.column("words"), "<u8"), joined(table.column("numbers"), "u1").astype(np.int64)
    cell = np.repeat(np.arange(len(keys)), lengths)
    order = np.argsort(h)
    first, size = runs(h[order])
    word = h[order][first]
    count = np.add.reduceat((number * trains[cell])[order], first) if len(first) else np.zeros(0, np.int64)
    every = np.add.reduceat(number[order], first) if len(first) else np.zeros(0, np.int64)
    leaves, leaf = np.unique(paths(word, levels), return_inverse=True)
    places = (np.bincount(leaf, count, len(leaves)) + np.bincount(leaf[count > 0], minlength=len(leaves)) + 1.0)[leaf]
    c, wide = np.empty(len(h), dtype=np.int64), np.empty(len(h))
    c[order], wide[order] = np.repeat(count, size), np.repeat(places, size)
    names, place = np.unique(keys, return_inverse=True)  # copies of a row and its cells in one bucket are summed here
    per_text = lambda x: np.bincount(place, np.bincount(cell, x, len(keys)), len(names))
    group = (word & np.uint64(CLASSES - 1)).astype(np.int64)
    hot = every >= crowded_from
    none, some = np.zeros(CLASSES), np.zeros(int(hot.sum()))
    column = lambda texts_, classes, crowded, kind: pa.array(np.concatenate([texts_, classes, crowded]).astype(kind))
    return pa.table({
        "key": pa.array(np.concatenate([names, np.arange(CLASSES), word[hot].view(np.int64)])),
        "kind": column(np.full(len(names), 0), none + 1, some + 2, np.int32),
        "s": column(per_text(number * np.log10(c + 1.0)), none, some, np.float64),
        "norm": column(per_text(number * np.log10(wide)), none, some, np.float64),
        "tokens": column(per_text(number), none, every[hot], np.int64),
        "known": column(per_text(number * (c > 0)), np.bincount(group, count, CLASSES), some, np.int64),
        "distinct": column(np.zeros(len(names)), np.bincount(group[count > 0], minlength=CLASSES), some, np.int64)})


class Crowds:
    """Which words stand before too many tokens for one task, and the shards that share their tokens.

    Crowded words are hashed to crowds; a crowd is one model, and its tokens are dealt by text over shards.
    """

    def __init__(self, words_: np.ndarray, counts: np.ndarray, models: int, model_tokens: int):
        order = np.argsort(words_)
        self.words = words_[order]
        number = power_of_two(2, counts.sum() / (CROWD * model_tokens))
        self.crowd = (mix(self.words + np.uint64(9)) >> np.uint64(64 - number.bit_length() + 1)).astype(np.int64)
        shards = np.maximum(1, np.ceil(np.bincount(self.crowd, counts[order], number) / (SHARD * model_tokens))).astype(np.int64)
        self.shards, self.first = shards, models + np.cumsum(shards) - shards

    def find(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is crowded, and its crowd (of no meaning where it is not)."""
        if not len(self.words):
            return np.zeros(len(before), dtype=bool), np.zeros(len(before), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, before), len(self.words) - 1)
        return self.words[at] == before, self.crowd[at]


DEALT = "unit int, crowd int, keys binary, train binary, lengths binary, features binary, paths binary"


def path_type(levels: int) -> str:
    return "<u4" if levels * DIGIT <= 32 else "<u8"


def deal(batches: Iterator[pa.RecordBatch], models: int, levels: int, crowds: Crowds, crowded: bool) -> Iterator[pa.RecordBatch]:
    """Tokens of each text with their features and paths, packed by unit: the model of the word before, or (``crowded``) a shard of its crowd by text."""
    shift = np.uint64(64 - models.bit_length() + 1)
    for batch in batches:
        for rows, buf, starts, ends in groups(batch, "text"):
            keys = rows.column("key").to_numpy(zero_copy_only=False)
            trains = np.array(rows.column("train").to_pylist(), dtype=np.uint8)
            h, bounds = tokens(buf, starts, ends)
            features, before = hashed_context(h, bounds)
            hot, crowd = crowds.find(before)
            mine = np.flatnonzero(hot == crowded)
            owner, before, crowd = owners(bounds)[mine], before[mine], crowd[mine]
            if crowded:
                unit = (crowds.first[crowd] + (mix(keys[owner].view(np.uint64)) % crowds.shards[crowd].astype(np.uint64)).astype(np.int64)).astype(np.int32)
            else:
                unit = (mix(before + np.uint64(9)) >> shift).astype(np.int32)
            order = np.argsort(unit, kind="stable")
            start, length = runs((unit.astype(np.int64) << 32 | owner)[order])
            at, per = runs(unit[order][start])
            ends_ = np.concatenate([[0], np.cumsum(length)])
            elements = ends_[at + per] - ends_[at]
            narrow = (features[:, mine] >> np.uint64(48)).astype("<u2").T[order]
            cells, heads = owner[order][start], order[start][at]
            yield pa.RecordBatch.from_arrays([
                pa.array(unit[heads], pa.int32()), pa.array(crowd[heads].astype(np.int32), pa.int32()), binaries(keys[cells], per), binaries(trains[cells], per),
                binaries(length.astype(np.uint32), per), binaries(narrow.ravel(), elements * FEATURES), binaries(paths(h, levels)[mine][order].astype(path_type(levels)), elements)],
                names=["unit", "crowd", "keys", "train", "lengths", "features", "paths"])


def unpacked(table: pa.Table, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, features, path and whether it trains, of each token of one unit; texts in the order of their keys, so that a rerun learns in the same order."""
    keys, lengths = joined(table.column("keys"), "<i8"), joined(table.column("lengths"), "<u4").astype(np.int64)
    order = np.argsort(keys, kind="stable")
    begin, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return (np.repeat(keys[order], size), joined(table.column("features"), "<u2").reshape(-1, FEATURES)[place],
            joined(table.column("paths"), path_type(levels)).astype(np.uint64)[place], np.repeat(joined(table.column("train"), "u1")[order], size).astype(bool))


def digit_rows(features: np.ndarray, path: np.ndarray, level: int, levels: int, seen: np.ndarray, numbers: np.ndarray, shared: np.ndarray, bits: int):
    """Digits of one level, and for rows of it their feature slots (2^bits for each feature) and the logits that learning starts from:
    the shared model's for the first digit, else the log frequencies of the digits behind the same prefix in the training paths ``seen``."""
    below = np.uint64(DIGIT * (levels - level - 1))
    low, upper = np.uint64(CLASSES - 1), below + np.uint64(DIGIT)
    digit, range_ = (path >> below & low).astype(np.uint8), np.arange(FEATURES)[:, None]

    def slots(rows):
        wide = features[rows].T.astype(np.uint64)
        wide = mix(wide | path[rows] >> upper << np.uint64(16)) >> np.uint64(48) if level else wide
        return (wide >> np.uint64(16 - bits)).astype(np.int64) + (range_ << bits)

    if not level:
        narrow = WIDE_SLOTS // SLOTS
        return digit, slots, lambda rows: class_logits((features[rows].T // narrow).astype(np.int64) + range_ * SLOTS, shared)
    names, place = np.unique(seen >> upper, return_inverse=True)
    counts = np.bincount(place * CLASSES + (seen >> below & low).astype(np.int64), numbers, (len(names) + 1) * CLASSES).reshape(-1, CLASSES) + 0.5
    usual = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)  # the last row is for prefixes not seen

    def start(rows):
        prefix = path[rows] >> upper
        at = np.searchsorted(names, prefix)
        at[np.append(names, np.uint64(0))[at] != prefix] = len(names)
        return np.take(usual, at, axis=0, mode="clip")

    return digit, slots, start


def fitted(digit: np.ndarray, slots, start, known: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and the numbers of times their slots were met, after one pass over the training tokens."""
    weights, speed = np.zeros(((FEATURES << bits) + 1, CLASSES), dtype=np.float32), np.full((FEATURES << bits) + 1, PRIOR)
    rows = np.flatnonzero(known)
    for a in range(0, len(rows), MINIBATCH):
        some = rows[a:a + MINIBATCH]
        learn(slots(some), digit[some], weights, speed, start(some), MODEL_BATCH)
    return weights, speed - PRIOR


def digit_logs(digit: np.ndarray, slots, start, weights: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each token's digit."""
    log = np.empty(len(digit))
    for a in range(0, len(digit), MINIBATCH):
        some = np.arange(a, min(a + MINIBATCH, len(digit)))
        z = class_logits(slots(some), weights) + start(some)
        top = z.max(axis=1)
        log[some] = z[np.arange(len(z)), digit[some]] - top - np.log(np.exp(z - top[:, None]).sum(axis=1))
    return log


def text_logs(keys: np.ndarray, log: np.ndarray) -> pa.Table:
    first, _ = runs(keys)
    return pa.table({"key": pa.array(keys[first]), "log": pa.array(np.add.reduceat(log, first) / np.log(10.0) if len(first) else log)})


def path_logs(table: pa.Table, shared: np.ndarray, levels: int) -> pa.Table:
    """One model: learn from its training tokens, and answer with the log10 of the path factors per text."""
    keys, features, path, known = unpacked(table, levels)
    seen, numbers = np.unique(path[known], return_counts=True)
    log = np.zeros(len(path))
    for level in range(levels):
        digit, slots, start = digit_rows(features, path, level, levels, seen, numbers, shared, WIDE_BITS)
        log += digit_logs(digit, slots, start, fitted(digit, slots, start, known, WIDE_BITS)[0])
    return text_logs(keys, log)


PIECES = "crowd int, level int, block long, names binary, seen binary, weights binary"


def pieces(crowd: int, level: int, block: int, names: np.ndarray, seen: np.ndarray, weights: np.ndarray) -> list:
    return [crowd, level, block, names.astype("<u8" if level < 0 else "<u4").tobytes(), seen.astype("<f8").tobytes(), weights.astype("<f4").tobytes()]


def piece_table(rows: list[list]) -> pa.Table:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, types, strict=True)], names=["crowd", "level", "block", "names", "seen", "weights"])


def shard_updates(table: pa.Table, crowds: Crowds, shared: np.ndarray, levels: int) -> pa.Table:
    """What one shard of a crowd learns: per level the slots it met, how often, and their weights; and at level -1 its training paths and their numbers."""
    crowd = table.column("crowd")[0].as_py()
    block = table.column("unit")[0].as_py() - int(crowds.first[crowd])
    _, features, path, known = unpacked(table, levels)
    seen, numbers = np.unique(path[known], return_counts=True)
    rows = [pieces(crowd, -1, block, seen, numbers, np.zeros(0))] if len(seen) else []
    for level in range(levels if len(seen) else 0):
        digit, slots, start = digit_rows(features, path, level, levels, seen, numbers, shared, CROWD_BITS)
        weights, met = fitted(digit, slots, start, known, CROWD_BITS)
        at = np.flatnonzero(met)
        rows.append(pieces(crowd, level, block, at, met[at], weights[at]))
    return piece_table(rows)


def merged(table: pa.Table) -> pa.Table:
    """At most ``MERGED`` pieces of one crowd and level as one: numbers are summed, and each slot's weights are averaged by how often its shards met it."""
    table = table.sort_by("block")
    level = table.column("level")[0].as_py()
    names, seen = joined(table.column("names"), "<u8" if level < 0 else "<u4"), joined(table.column("seen"), "<f8")
    known, place = np.unique(names, return_inverse=True)
    total = np.bincount(place, seen, len(known))
    if level < 0:
        mean = np.zeros(0)
    else:
        mean, parts = np.zeros((len(known), CLASSES)), joined(table.column("weights"), "<f4").reshape(-1, CLASSES)
        for k in range(CLASSES):
            mean[:, k] = np.bincount(place, seen * parts[:, k], len(known)) / total
    return piece_table([pieces(table.column("crowd")[0].as_py(), level, table.column("block")[0].as_py() // MERGED, known, total, mean)])


def shard_logs(table: pa.Table, learned: pa.Table, shared: np.ndarray, levels: int) -> pa.Table:
    """The log10 of the path factors per text of one shard, by the merged model of its crowd."""
    keys, features, path, _ = unpacked(table, levels)
    at = {level: i for i, level in enumerate(learned.column("level").to_pylist())}
    get = lambda level, column, kind: np.frombuffer(learned.column(column)[at[level]].as_py(), kind) if level in at else np.zeros(0, kind)
    seen, numbers = get(-1, "names", "<u8"), get(-1, "seen", "<f8")
    log = np.zeros(len(path))
    for level in range(levels):
        weights = np.zeros(((FEATURES << CROWD_BITS) + 1, CLASSES), dtype=np.float32)
        weights[get(level, "names", "<u4")] = get(level, "weights", "<f4").reshape(-1, CLASSES)
        digit, slots, start = digit_rows(features, path, level, levels, seen, numbers, shared, CROWD_BITS)
        log += digit_logs(digit, slots, start, weights)
    return text_logs(keys, log)


def crowd_logs(dealt: DataFrame, crowds, shared, levels: int) -> DataFrame:
    """Path factors behind crowded words: shards learn, their updates are merged ``MERGED`` at a time, and every shard is scored by the one result.

    A crowd's weights reach its shards in two steps, so that no task writes all copies of them.
    """
    dealt = stored(dealt)
    learned = stored(dealt.groupBy("unit").applyInArrow(lambda t: shard_updates(t, crowds.value, shared.value, levels), PIECES))
    pieces_left = int(crowds.value.shards.max())
    while pieces_left > 1:
        learned = stored(learned.groupBy("crowd", "level", F.expr(f"block div {MERGED}").alias("_to")).applyInArrow(merged, PIECES))
        pieces_left = -(-pieces_left // MERGED)
    units = dealt.select("crowd", F.col("unit").alias("to"), F.pmod("unit", F.lit(COPIES)).alias("_block")).distinct()
    copies = units.select("crowd", "_block").distinct().join(learned.drop("block"), "crowd").repartition("crowd", "_block")
    sent = units.join(copies, ["crowd", "_block"]).select("to", "level", "names", "seen", "weights")
    return dealt.groupBy("unit").cogroup(sent.groupBy("to")).applyInArrow(lambda a, b: shard_logs(a, b, shared.value, levels), "key long, log double")


def score_documents(docs: DataFrame, text: str = "text", row: str = "doc_id", rounds: int = ROUNDS, model_tokens: int = MODEL_TOKENS) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (to nine decimals,
    so that equal texts have equal scores whatever the order of their partial sums)."""
    held = id_hash(row) % 7 == 2
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(row).alias("doc_id"), body.alias("text"), (~held).alias("train"), F.xxhash64(row, body).alias("key"))
    total, texts = keyed.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    total = total or 0
    buckets = power_of_two(LEAST_BUCKETS, total / BYTES_PER_WORD * PACKED / BUCKET_BYTES)
    levels = depth(total / BYTES_PER_WORD, buckets)
    # A word of a text takes two bytes at least, so at most MOST_CROWDED words (32 MB) are crowded.
    crowded_from = max(model_tokens // 4, (total // 2 + 2 * texts) // MOST_CROWDED)
    sent = keyed.select("key", "train", "text").mapInArrow(lambda b: send(b, buckets), "bucket int, keys binary, train binary, lengths binary, words binary, numbers binary")
    parts = stored(sent.groupBy("bucket").applyInArrow(lambda t: answer(t, levels, crowded_from), "key long, kind int, s double, norm double, tokens long, known long, distinct long"))
    classes = {r["key"]: (r["n"], r["v"]) for r in parts.filter("kind = 1").groupBy("key").agg(F.sum("known").alias("n"), F.sum("distinct").alias("v")).collect()}
    n, v = sum(x[0] for x in classes.values()), sum(x[1] for x in classes.values())
    weights = train(keyed.filter("train"), np.array([classes.get(k, (0, 0))[0] for k in range(CLASSES)]), rounds)
    hot = [(r["key"], r["tokens"]) for r in parts.filter("kind = 2").select("key", "tokens").collect()]
    hot += [(int(START), texts)] if texts >= crowded_from else []
    models, context_ = power_of_two(LEAST_MODELS, n / model_tokens), docs.sparkSession.sparkContext
    crowds = Crowds(np.array([h[0] for h in hot], dtype=np.int64).view(np.uint64), np.array([h[1] for h in hot], dtype=np.int64), models, model_tokens)
    shared, shipped = context_.broadcast(weights), context_.broadcast(crowds)
    dealt = lambda crowded: keyed.select("key", "train", "text").mapInArrow(lambda b: deal(b, models, levels, shipped.value, crowded), DEALT)
    logs = dealt(False).groupBy("unit").applyInArrow(lambda t: path_logs(t, shared.value, levels), "key long, log double")
    if hot:
        logs = logs.unionByName(crowd_logs(dealt(True), shipped, shared, levels))
    logs = logs.groupBy("key").agg(F.sum("log").alias("log"))
    sums = parts.filter("kind = 0").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("s", "norm", "tokens", "known")])
    # Copies of one row share a key and the sums of all of them.
    times = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    out = keyed.select("doc_id", "key", "train").join(sums.join(logs, "key").join(times, "key"), "key")
    s, tokens_ = F.col("s") / F.col("times"), (F.col("tokens") / F.col("times")).cast("long")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), tokens_.alias("n_tokens"), (F.col("known") / F.col("times")).cast("long").alias("n_known"),
                      F.lit(int(n)).cast("long").alias("train_tokens"), (s - tokens_ * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
                      F.round(s + (F.col("log") - F.col("norm")) / F.col("times"), 9).alias("score"))
