"""Benchmark decontamination by Wu-Manber search over words.

A benchmark window of 10 words is a pattern of 10 symbols. The shift table
tells, for the pair of words under the cursor, how far the cursor may jump
without passing an occurrence; a shift of 0 selects the patterns that end in
that pair, and the words themselves are compared. Cursors of many text
segments move in step as numpy vectors. Items of fewer words are patterns of
their own length. The benchmark is read in blocks of a stated size, each of
which is broadcast; documents stay where they are.

Defined results: null and empty texts have no words. An item without words has
no window. An item without id makes words count as hit but is not listed. Items
repeated under one id count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tramorisk.llm.textbytes import ALNUM, STEP, annotate, byte_codes, lowered, mix, sums, word_hashes, words

WINDOW = 10
BLOCK_BYTES = 16 << 20
SEGMENT = 256
CODES = byte_codes(ALNUM)
FOLD = bytes(lowered(b) for b in range(256))


@dataclass
class Patterns:
    """All patterns of one length: shift table, suffix buckets and the patterns' words."""

    length: int
    hashes: np.ndarray
    texts: list[bytes]
    items: list[list[str | None]]
    shift: np.ndarray
    order: np.ndarray
    bucket: np.ndarray


def pairs(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the block of words that ends at each word: two words, or one for patterns of one word."""
    if length == 1:
        return mix(h)
    return mix(h * STEP + np.concatenate([np.zeros(1, np.uint64), h[:-1]]))


def build(windows: dict[bytes, set[str | None]], length: int) -> Patterns:
    """Tables for the windows (words joined by blanks) of one length."""
    texts = sorted(windows)
    joined = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    first, last, _ = words(joined, np.array([0]), np.array([len(joined)]), ALNUM)
    hashes = word_hashes(joined, first, last, CODES).reshape(len(texts), length)
    block = min(2, length)
    size = 1 << max(12, (4 * hashes.size).bit_length())
    slots = (pairs(hashes.ravel(), length).reshape(hashes.shape) & np.uint64(size - 1)).astype(np.int64)
    shift = np.full(size, length - block + 1, dtype=np.int64)
    for end in range(block - 1, length):
        np.minimum.at(shift, slots[:, end], length - 1 - end)
    order = np.argsort(slots[:, -1], kind="stable")
    bucket = np.searchsorted(slots[order, -1], np.arange(size + 1)) if size <= 1 << 22 else None
    return Patterns(length, hashes, texts, [sorted(windows[t], key=str) for t in texts], shift, order,
                    bucket if bucket is not None else np.append(np.searchsorted(slots[order, -1], np.arange(size)), len(order)))


def compile_items(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[Patterns]:
    """Patterns of one block of benchmark items, by length."""
    by_length: dict[int, dict[bytes, set[str | None]]] = {}
    for item, text in rows:
        raw = (text or "").encode("utf-8")
        buf = np.frombuffer(raw, dtype=np.uint8)
        first, last, _ = words(buf, np.array([0]), np.array([len(buf)]), ALNUM)
        parts = [raw[a:b].translate(FOLD) for a, b in zip(first, last, strict=True)]
        n = min(window, len(parts))
        for i in range(len(parts) - n + 1 if n else 0):
            by_length.setdefault(n, {}).setdefault(b" ".join(parts[i:i + n]), set()).add(item)
    return [build(found, n) for n, found in sorted(by_length.items())]


def search(h: np.ndarray, bounds: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, pattern) of every place whose word hashes equal a pattern's."""
    m = patterns.length
    if len(h) < m:
        return np.zeros(0, int), np.zeros(0, int)
    slots = (pairs(h, m) & np.uint64(len(patterns.shift) - 1)).astype(np.int64)
    counts = np.maximum(0, np.diff(bounds) - m + 1)  # possible first words of each text
    cuts = -(-counts // SEGMENT)
    text = np.repeat(np.arange(len(counts)), cuts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    at = bounds[:-1][text] + nth * SEGMENT + m - 1
    stop = np.minimum(at + SEGMENT, bounds[1:][text])
    zeros = []
    while len(at):
        jump = patterns.shift[slots[at]]
        zeros.append(at[jump == 0])
        at = at + np.maximum(jump, 1)
        going = at < stop
        at, stop = at[going], stop[going]
    ends = np.concatenate(zeros) if zeros else np.zeros(0, int)
    low, high = patterns.bucket[slots[ends]], patterns.bucket[slots[ends] + 1]
    where, which = [], []
    for k in range(int((high - low).max()) if len(ends) else 0):
        live = low + k < high
        place, pattern = ends[live] - m + 1, patterns.order[low[live] + k]
        same = np.ones(len(place), dtype=bool)
        for j in range(m):
            same[same] = h[place[same] + j] == patterns.hashes[pattern[same], j]
        where.append(place[same])
        which.append(pattern[same])
    return (np.concatenate(where), np.concatenate(which)) if where else (np.zeros(0, int), np.zeros(0, int))


RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,first:array<int>,last:array<int>>"


def scan(block: list[Patterns], buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: pa.Array | None) -> pa.Array:
    """Result of a group of texts for one block of the benchmark, joined with that of the blocks before."""
    first, last, bounds = words(buf, starts, ends, ALNUM)
    h = word_hashes(buf, first, last, CODES)
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    found: list[set[str]] = [set() for _ in starts]
    raw = buf.tobytes()
    for patterns in block:
        at, which = search(h, bounds, patterns)
        if len(at):
            same = np.array([b" ".join(raw[a:b].translate(FOLD) for a, b in zip(first[i:i + patterns.length], last[i:i + patterns.length], strict=True))
                             == patterns.texts[p] for i, p in zip(at.tolist(), which.tolist(), strict=True)], dtype=bool)
            at, which = at[same], which[same]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + patterns.length, -1)
            doc = np.searchsorted(bounds, at, side="right") - 1
            for d, p in {*zip(doc.tolist(), which.tolist(), strict=True)}:
                found[d].update(x for x in patterns.items[p] if x is not None)
    if before is not None:
        for d, (items, a, b) in enumerate(zip(before.field("items").to_pylist(), before.field("first").to_pylist(), before.field("last").to_pylist(), strict=True)):
            found[d].update(items)
            np.add.at(cover, bounds[d] + np.array(a, dtype=int), 1)
            np.add.at(cover, bounds[d] + np.array(b, dtype=int), -1)
    hit = np.cumsum(cover)[:-1] > 0
    hits = sums(hit.astype(np.int64), bounds)
    firsts, lasts = [[] for _ in starts], [[] for _ in starts]
    for d in np.flatnonzero(hits):
        edge = np.diff(np.concatenate([[0], hit[bounds[d]:bounds[d + 1]].astype(np.int8), [0]]))
        firsts[d], lasts[d] = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
    text, whole = pa.list_(pa.string()), pa.list_(pa.int32())
    return pa.StructArray.from_arrays(
        [pa.array(np.diff(bounds), pa.int64()), pa.array(hits, pa.int64()), pa.array([sorted(f) for f in found], text), pa.array(firsts, whole), pa.array(lasts, whole)],
        fields=[pa.field("n_words", pa.int64()), pa.field("n_hit", pa.int64()), pa.field("items", text), pa.field("first", whole), pa.field("last", whole)])


def benchmark_blocks(items: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in blocks of about ``block_bytes``; only one block is on the driver at a time."""
    rows = items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r["item"], r["text"]) for r in part.collect()]


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", out: str = "contamination",
                  window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``out``: struct of ``n_words``, ``n_hit``, sorted ``items`` and the hit word runs ``first``/``last`` (end exclusive).

    A column of that name is replaced; every other column passes unchanged.
    """
    context, known = docs.sparkSession.sparkContext, False
    result = docs.drop(out)
    for rows in benchmark_blocks(items, item, text, block_bytes):
        shipped = context.broadcast(compile_items(rows, window))

        def kernel(batch, buf, starts, ends, shipped=shipped, known=known):
            before = batch.column(f"{out}_") if known else None
            return scan(shipped.value, buf, starts, ends, before)

        result = annotate(result, text, out, RESULT, kernel).withColumnRenamed(out, f"{out}_") if not known else annotate(
            result, text, out, RESULT, kernel).drop(f"{out}_").withColumnRenamed(out, f"{out}_")
        known = True
    return result.withColumnRenamed(f"{out}_", out)


def decontamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = decontaminate(docs.select("doc_id", "text"), items, out="_hit")
    return found.select("doc_id", "_hit.n_words", "_hit.n_hit", F.size("_hit.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("_hit.items", ","), 256).alias("items_sha256"), (F.col("_hit.n_hit") > 0).alias("contaminated"))


def digest(items: list[str]) -> str:
    """The digest of a sorted list of item ids, for tests."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
