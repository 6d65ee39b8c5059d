"""Which hashed elements of a text occur in another text (or twice in it), found bucket by bucket.

Every text sends the 52-bit hashes of its elements to buckets, packed: one
Arrow row per group of texts and bucket. A bucket is sorted as one numpy array
and answers, per text, with the elements that are repeated. Texts are named by
a hash of their content, so copies are one text from the start, and a bucket
holds about ``BUCKET_BYTES`` whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tramorisk.llm.store import power_of_two
from tramorisk.llm.textbytes import groups

OWNER = np.uint64(52)
HASH = np.uint64((1 << 52) - 1)
BUCKET_BYTES, LEAST_BUCKETS, PACKED = 24 << 20, 32, 6
SEEN = 255

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary column whose rows are consecutive pieces of ``values``, ``counts`` elements each."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    if offsets[-1] < 1 << 31:
        return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
    raise ValueError("a group of texts holds more than 2 GB of elements")


def joined(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """All rows of a binary column as one array."""
    parts = [np.frombuffer(x.as_buffer(), dtype=dtype) for x in column if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def row_counts(column: pa.ChunkedArray, itemsize: int) -> np.ndarray:
    return np.array([len(x.as_buffer()) // itemsize if x.is_valid else 0 for x in column], dtype=np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal neighbours."""
    if not len(values):
        return np.zeros(0, int), np.zeros(0, int)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return first, np.diff(np.append(first, len(values)))


def bucket_count(expected: float) -> int:
    """Buckets for so many elements."""
    return power_of_two(LEAST_BUCKETS, expected * PACKED / BUCKET_BYTES)


SENT = "bucket int, keys binary, counts binary, low binary, high binary, all_keys binary, all_sizes binary"


def send(batches: Iterator[pa.RecordBatch], kernel: Kernel, buckets: int) -> Iterator[pa.RecordBatch]:
    bits = np.uint64(buckets.bit_length() - 1)
    for batch in batches:
        for rows, buf, starts, ends in groups(batch, "text"):
            keys = rows.column("key").to_numpy(zero_copy_only=False)
            elements = kernel(buf, starts, ends)
            _, first = np.unique(keys, return_index=True)
            once = np.zeros(len(keys), dtype=bool)
            once[first] = True
            owner = (elements >> OWNER).astype(np.int64)
            sizes = np.bincount(owner, minlength=len(keys))
            elements, owner = elements[once[owner]], owner[once[owner]]
            h = elements & HASH
            bucket = (h & np.uint64(buckets - 1)).astype(np.int32)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            bucket, owner, rest = bucket[order], owner[order], h[order] >> bits
            start, length = runs(bucket.astype(np.int64) << 12 | owner)
            # A run longer than a byte can say is cut; the cuts lie next to each other in one row.
            cuts = -(-length // 255)
            cell = np.repeat(np.arange(len(start)), cuts)
            tail = np.cumsum(cuts) - 1
            counts = np.full(len(cell), 255, dtype=np.int64)
            counts[tail] = length - (cuts - 1) * 255
            at, per = runs(bucket[start][cell])
            ids = bucket[start][cell][at]
            firsts = np.concatenate([[0], np.cumsum(counts)])
            per_elements = firsts[at + per] - firsts[at]
            named = keys[owner[start]][cell]
            n = len(ids)
            if not n:
                ids, per, per_elements, n = np.zeros(1, np.int32), np.zeros(1, int), np.zeros(1, int), 1
            directory = np.zeros(n, dtype=np.int64)
            directory[int(keys[0]) % n] = len(first)  # the group's list of texts rides on one of its rows
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int32()), binaries(named.astype(np.int64), per), binaries(counts.astype(np.uint8), per),
                binaries(rest.astype(np.uint32), per_elements), binaries((rest >> np.uint64(32)).astype(np.uint16), per_elements),
                binaries(keys[first], directory), binaries(sizes[first].astype(np.int64), directory)],
                names=["bucket", "keys", "counts", "low", "high", "all_keys", "all_sizes"])


def answer(table: pa.Table, buckets: int) -> pa.Table:
    """Per text: its repeated elements in this bucket with their counts; and the sizes of the texts listed here."""
    bits = np.uint64(buckets.bit_length() - 1)
    keys, counts = joined(table.column("keys"), "<i8"), joined(table.column("counts"), "u1").astype(np.int64)
    row = np.repeat(np.arange(table.num_rows), row_counts(table.column("keys"), 8))
    h = joined(table.column("low"), "<u4").astype(np.uint64) | joined(table.column("high"), "<u2").astype(np.uint64) << np.uint64(32)
    # A text that several groups have sent counts by the first of them.
    names, place = np.unique(keys, return_inverse=True)
    least = np.full(len(names), table.num_rows)
    np.minimum.at(least, place, row)
    used = row == least[place]
    inside = np.repeat(used, counts)
    owner, h = np.repeat(place, counts)[inside], h[inside]
    order = np.argsort(h)
    start, length = runs(h[order])
    seen = np.empty(len(h), dtype=np.uint8)
    seen[order] = np.repeat(np.minimum(length, SEEN), length)
    many = seen > 1
    owner, h, seen = owner[many], h[many], seen[many]
    order = np.argsort(owner, kind="stable")
    owner, h, seen = owner[order], h[order], seen[order]
    start, length = runs(owner)
    full = (h << bits) | np.uint64(table.column("bucket")[0].as_py())
    listed, sizes = joined(table.column("all_keys"), "<i8"), joined(table.column("all_sizes"), "<i8")
    listed, first = np.unique(listed, return_index=True)
    none = pa.nulls(len(listed), pa.binary())
    return pa.table({
        "key": pa.array(np.concatenate([names[owner[start]], listed])),
        "h": pa.chunked_array([binaries(full, length), none]), "f": pa.chunked_array([binaries(seen, length), none]),
        "n": pa.chunked_array([pa.nulls(len(start), pa.int64()), pa.array(sizes[first])])})


def repeated_elements(docs: DataFrame, kernel: Kernel, expected: float) -> DataFrame:
    """(``key``, ``text``) to (``key``, ``n`` elements, ``parts``: array of (``h``, ``f``) with repeated hashes and counts up to 255).

    ``kernel`` gives a group's elements as sorted (row << 52 | hash); ``expected`` is their number over all texts.
    """
    buckets = bucket_count(expected)
    sent = docs.select("key", "text").mapInArrow(lambda batches: send(batches, kernel, buckets), SENT)
    found = sent.groupBy("bucket").applyInArrow(lambda table: answer(table, buckets), "key long, h binary, f binary, n long")
    return found.groupBy("key").agg(F.max("n").alias("n"), F.collect_list(F.when(F.col("h").isNotNull(), F.struct("h", "f"))).alias("parts"))
