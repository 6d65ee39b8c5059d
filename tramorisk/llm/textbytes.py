"""Numpy kernels over UTF-8 texts that lie one after another in one buffer.

A group of documents is ``buf`` (uint8) with ``starts`` and ``ends`` of each
text in it. Null and empty texts have ``start == end``. Nothing here loops over
bytes or words in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

GROUP_BYTES = 4 << 20
GROUP_DOCS = 4096
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_class(test: Callable[[int], bool]) -> np.ndarray:
    return np.array([test(b) for b in range(256)], dtype=bool)


def lowered(b: int) -> int:
    """ASCII lower case of one byte; other letters stay."""
    return b + 32 if 0x41 <= b <= 0x5A else b


#: Bytes of words that end at white space.
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words made of ASCII letters and digits and of everything beyond ASCII.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


def byte_codes(kept: np.ndarray, fold_case: bool = True) -> np.ndarray:
    """A random odd number for each byte, 0 for bytes outside ``kept``; cases share one if folded."""
    base = mix(np.arange(1, 257, dtype=np.uint64) * STEP) | np.uint64(1)
    if fold_case:
        base = base[[lowered(b) for b in range(256)]]
    return np.where(kept, base, np.uint64(0))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a string or binary Arrow column, without a copy."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, int)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), at.astype(np.int64)


def groups(batch: pa.RecordBatch, text: str, limit: int = GROUP_BYTES,
           docs: int = GROUP_DOCS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Cut a batch into groups of at most ``limit`` bytes (or one longer text) and ``docs`` rows."""
    data, at = column_bytes(batch.column(text))
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(at, at[i] + limit, side="right")) - 1
        j = max(i + 1, min(j, i + docs, n))
        yield batch.slice(i, j - i), data[at[i]:at[j]], at[i:j] - at[i], at[i + 1:j + 1] - at[i]
        i = j


def words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``kept`` bytes, and the first word index of each text (one more at the end)."""
    if not len(buf):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(len(starts) + 1, int)
    inside = kept[buf]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    full = ends > starts
    begin[starts[full]] = inside[starts[full]]
    stop[ends[full] - 1] = inside[ends[full] - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return first, last, np.append(np.searchsorted(first, starts), len(first))


def word_hashes(buf: np.ndarray, first: np.ndarray, last: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; ``codes`` is 0 for every byte between words."""
    if not len(first):
        return np.zeros(0, np.uint64)
    longest = int((last - first).max())
    powers = np.full(longest + 1, STEP, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    base = first[0]
    at = np.arange(len(buf) - base)
    at -= np.repeat(first - base, np.diff(np.append(first, len(buf))))
    np.minimum(at, longest, out=at)
    value = codes[buf[base:]] * powers[at]
    return mix(np.add.reduceat(value, first - base) + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def owners(bounds: np.ndarray) -> np.ndarray:
    """Row number of every element, from the first element of each row (and one bound more)."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each row's elements; rows without any give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def annotate(docs: DataFrame, text: str, name: str, ddl: str, kernel: Callable[..., pa.Array],
             docs_per_group: int = GROUP_DOCS, limit: int = GROUP_BYTES) -> DataFrame:
    """Add column ``name`` of type ``ddl``, computed by ``kernel(rows, buf, starts, ends)`` for a group of rows.

    All other columns pass unchanged; a column called ``name`` is replaced.
    """
    kept = [f for f in docs.schema.fields if f.name != name]
    schema = StructType([*kept, StructField(name, _parse_datatype_string(ddl))])
    names = [f.name for f in kept]
    carried = docs if len(kept) == len(docs.columns) else docs.select(*[docs[n] for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, starts, ends in groups(batch, text, limit, docs_per_group):
                yield pa.RecordBatch.from_arrays([*rows.columns, kernel(rows, buf, starts, ends)], names=[*names, name])

    return carried.mapInArrow(run, schema)
