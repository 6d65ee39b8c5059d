"""Removal of long repeated byte strings, by blockwise suffix sorting with a difference cover.

A difference cover modulo 133 holds 12 residues such that any two positions
meet, within 133 bytes, at a common distance in the cover. So if two strings
of 200 bytes are equal, some cover sample lies at the same place in both, with
the 68 bytes after it inside both strings.

1. Cover samples are ranked bucket by bucket. Only equality of ranks is used
   here, so a sample's rank is the fingerprint of its 68 bytes, and a bucket
   answers which samples are repeated.
2. A suffix can only tie over 200 bytes where a repeated sample says so; all
   others are settled. Texts with such suffixes are written once, those with a
   common sample next to each other.
3. The tied suffixes are sorted one bucket at a time, each by the fingerprint
   of its 200 bytes. A block of texts sends a repeated suffix once, and gets
   one bit per suffix back.

Fingerprints are 64-bit polynomial hashes (52 bits for samples, which only
choose candidates). Copies of a whole text are one text until the last join.

Defined results: a null text is empty. Texts shorter than 200 bytes lose
nothing. Repeated rows are copies. Null ids are allowed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tramorisk.llm.repeats import OWNER, binaries, joined, repeated_elements, row_counts, runs
from tramorisk.llm.store import power_of_two, stored
from tramorisk.llm.textbytes import STEP, byte_class, byte_codes, column_bytes, mix

LENGTH = 200
#: A difference cover of 133: every residue is a difference of two members. Fixed values.
MODULUS, COVER = 133, np.array([0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109])
SAMPLE = LENGTH - MODULUS + 1
CODES = byte_codes(byte_class(lambda b: True), fold_case=False)
SLICE = 1 << 17
BLOCK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 2 << 20, 24 << 20, 32
INVERSE = np.uint64(pow(int(STEP), -1, 1 << 64))
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


FORWARD, BACKWARD = powers(STEP, SLICE + LENGTH), powers(INVERSE, SLICE + LENGTH)


def fingerprints(buf: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes at each of the ascending places; slice by slice, so memory does not follow the text."""
    out = np.empty(len(at), dtype=np.uint64)
    for a in range(0, len(buf), SLICE):
        i, j = np.searchsorted(at, [a, a + SLICE])
        if i == j:
            continue
        piece = buf[a:a + SLICE + length]
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(CODES[piece] * FORWARD[:len(piece)], out=total[1:])
        place = at[i:j] - a
        out[i:j] = (total[place + length] - total[place]) * BACKWARD[place]
    return mix(out)


def cover_samples(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all cover samples, counted from the start of their text, and their rows."""
    size = ends - starts
    rounds = -(-size // MODULUS)
    doc = np.repeat(np.arange(len(size)), rounds)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(rounds) - rounds, rounds)
    at = (starts[doc] + nth * MODULUS)[:, None] + COVER
    inside = at + SAMPLE <= ends[doc][:, None]
    return at[inside], np.broadcast_to(doc[:, None], at.shape)[inside]


def sample_elements(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Samples as sorted (row << 52 | hash), each at most twice: more say no more."""
    at, doc = cover_samples(starts, ends)
    element = np.sort((doc.astype(np.uint64) << OWNER) | (fingerprints(buf, at, SAMPLE) >> np.uint64(12)))
    first, length = runs(element)
    return np.repeat(element[first], np.minimum(length, 2))


def tied_suffixes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, repeated: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes that a repeated sample covers (row, first, end exclusive, from the text's start)."""
    at, doc = cover_samples(starts, ends)
    h = fingerprints(buf, at, SAMPLE) >> np.uint64(12)
    wanted = np.unique(np.concatenate([(np.uint64(d) << OWNER) | r for d, r in enumerate(repeated)]) if repeated else np.zeros(0, np.uint64))
    mine = (doc.astype(np.uint64) << OWNER) | h
    hit = np.isin(mine, wanted)
    at, doc = at[hit], doc[hit]
    first = np.maximum(at - MODULUS + 1, starts[doc])
    end = np.minimum(at, ends[doc] - LENGTH) + 1
    good = end > first
    return doc[good], first[good] - starts[doc[good]], end[good] - starts[doc[good]]


def merged(doc: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of runs that come by row and ascending; the ends ascend as well."""
    if not len(doc):
        return doc, first, end
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] > end[:-1])])
    at = np.flatnonzero(new)
    return doc[at], first[at], end[np.append(at[1:], len(doc)) - 1]


def ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All whole numbers of the runs."""
    size = end - first
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def with_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their repeated samples to texts with their runs of tied suffixes; texts without any go."""
    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for key, copies, body, parts in zip(*(batch.column(c) for c in ("key", "copies", "body", "parts")), strict=True):
            raw = unpack.decompress(body.as_py())
            buf = np.frombuffer(raw, dtype=np.uint8)
            repeated = np.unique(np.concatenate([np.frombuffer(p["h"], dtype="<u8") for p in parts.as_py()]))
            doc, first, end = merged(*tied_suffixes(buf, np.array([0]), np.array([len(buf)]), [repeated]))
            if len(doc):
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(repeated[0])]), pa.array([key.as_py()]), pa.array([copies.as_py()]), pa.array([pack.compress(raw)], pa.binary()),
                    pa.array([len(buf)]), pa.array([np.stack([first, end], axis=1).astype("<i8").tobytes()], pa.binary())],
                    names=["near", "key", "copies", "body", "size", "runs"])


BLOCK = "block long, keys binary, copies binary, sizes binary, n_runs binary, runs binary, body binary"


def as_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring texts in blocks of about BLOCK_BYTES, with their runs; a longer text is a block of its own."""
    unpack, pack, count = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3), 0
    base = TaskContext.get().partitionId() << 33

    def block(rows: list[tuple]) -> pa.RecordBatch:
        keys, copies, sizes, found, bodies = zip(*rows, strict=True)
        pieces = [[base + count], *([np.array(x, dtype="<i8").tobytes()] for x in (keys, copies, sizes, [len(r) // 16 for r in found])),
                  [b"".join(found)], [pack.compress(b"".join(bodies))]]
        return pa.RecordBatch.from_arrays([pa.array(pieces[0], pa.int64()), *(pa.array(p, pa.binary()) for p in pieces[1:])], names=[c.split()[0] for c in BLOCK.split(", ")])

    rows, held = [], 0
    for batch in batches:
        for key, copies, body, size, found in zip(*(batch.column(c) for c in ("key", "copies", "body", "size", "runs")), strict=True):
            if rows and held + size.as_py() > BLOCK_BYTES:
                yield block(rows)
                rows, held, count = [], 0, count + 1
            rows.append((key.as_py(), copies.as_py(), size.as_py(), found.as_py(), unpack.decompress(body.as_py())))
            held += size.as_py()
    if rows:
        yield block(rows)


class Block:
    """One stored block: its texts and all its tied suffixes."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        take = lambda c: np.frombuffer(batch.column(c)[i].as_buffer(), dtype="<i8")
        self.id, self.keys, self.copies, self.sizes = batch.column("block")[i].as_py(), take("keys"), take("copies"), take("sizes")
        self.raw = zstandard.ZstdDecompressor().decompress(batch.column("body")[i].as_py())
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        found = take("runs").reshape(-1, 2)
        doc = np.repeat(np.arange(len(self.keys)), take("n_runs"))
        self.first, self.end = found[:, 0] + self.starts[doc], found[:, 1] + self.starts[doc]

    def suffixes(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the tied suffixes, their fingerprints turned so that they sort by bucket, the distinct ones, and which occur twice here."""
        bits = buckets.bit_length() - 1
        at = ranges(self.first, self.end)
        h = fingerprints(self.buf, at, LENGTH)
        order = np.argsort(h)
        first, length = runs(h[order])
        several = self.copies[np.searchsorted(self.ends, at, side="right")] > 1
        many = (length > 1) | (np.add.reduceat(several[order].astype(np.int64), first) > 0 if len(first) else np.zeros(0, bool))
        return at, h, h[order][first], many


def bucket_edges(buckets: int) -> np.ndarray:
    """Least value of each bucket."""
    return np.arange(buckets, dtype=np.uint64) << np.uint64(64 - buckets.bit_length() + 1)


def bucket_bounds(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted values; the leading bits name the bucket."""
    return np.append(np.searchsorted(values, bucket_edges(buckets)), len(values))


def packed(values: np.ndarray, edge: np.uint64) -> bytes:
    """Ascending values from ``edge`` on as steps, byte by byte place: the upper bytes of steps are zeros and compress to nothing."""
    steps = np.diff(values, prepend=edge).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes, edge: np.uint64) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64) + edge


def send(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            block = Block(batch, i)
            _, _, values, many = block.suffixes(buckets)
            bounds = bucket_bounds(values, buckets)
            size = np.diff(bounds)
            steps = [packed(values[a:b], edge) for a, b, edge in zip(bounds[:-1], bounds[1:], bucket_edges(buckets), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(buckets, dtype=np.int32)), pa.array(np.full(buckets, block.id)),
                pa.array(steps, pa.binary()), binaries(many.astype(np.uint8), size)], names=["bucket", "block", "suffixes", "many"])


def answer(table: pa.Table, buckets: int) -> pa.Table:
    """One bucket of suffixes, sorted: for each block, a bit for each of its suffixes that stands anywhere else."""
    edge = bucket_edges(buckets)[table.column("bucket")[0].as_py()]
    values = np.concatenate([unpacked(x.as_buffer(), edge) for x in table.column("suffixes")])
    many, size = joined(table.column("many"), "u1"), row_counts(table.column("suffixes"), 8)
    order = np.argsort(values)
    first, length = runs(values[order])
    twice = (length > 1) | (np.maximum.reduceat(many[order], first) > 0) if len(first) else np.zeros(0, bool)
    flag = np.empty(len(values), dtype=bool)
    flag[order] = np.repeat(twice, length)
    cuts = np.concatenate([[0], np.cumsum(size)])
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                     "bits": pa.array([np.packbits(flag[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


CUT = "key long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"


def cut(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks with their answers to the removed runs of each text."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = Block(batch, i)
            at, h, values, _ = block.suffixes(buckets)
            bounds, twice = bucket_bounds(values, buckets), np.zeros(len(values), dtype=bool)
            for part in batch.column("answers")[i].as_py():
                a, b = bounds[part["bucket"]], bounds[part["bucket"] + 1]
                twice[a:b] = np.unpackbits(np.frombuffer(part["bits"], dtype=np.uint8), count=b - a).astype(bool)
            hit = at[twice[np.searchsorted(values, h)]]
            doc, first, end = merged(np.searchsorted(block.ends, hit, side="right"), hit, hit + LENGTH)
            out = []
            by_doc = np.searchsorted(doc, np.arange(len(block.keys) + 1))
            for d, key in enumerate(block.keys):
                a, b = by_doc[d], by_doc[d + 1]
                kept, last = hashlib.sha256(), int(block.starts[d])
                for s, e in zip(first[a:b].tolist(), end[a:b].tolist(), strict=True):
                    kept.update(block.raw[last:s])
                    last = e
                kept.update(block.raw[last:int(block.ends[d])])
                spans = [{"start": int(s - block.starts[d]), "end": int(e - block.starts[d])} for s, e in zip(first[a:b], end[a:b], strict=True)]
                out.append((int(key), int((end[a:b] - first[a:b]).sum()), int(b - a), kept.hexdigest(), spans))
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in CUT.split(", ", 4)])


def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, at = column_bytes(batch.column("text"))
        bodies = [pack.compress(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("row"), pa.array(bodies, pa.binary())], names=["key", "row", "body"])


def repeated_spans(docs: DataFrame, text: str = "text", row: str = "doc_id") -> DataFrame:
    """Per document: ``row`` as ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the removed byte ``spans``."""
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(row).alias("doc_id"), body.alias("text")).withColumn("key", F.xxhash64("text")).withColumn("row", F.xxhash64("doc_id"))
    facts = stored(keyed.select("doc_id", "key", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")))
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    copies = facts.groupBy("key").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    samples = repeated_elements(keyed.filter(F.octet_length("text") >= SAMPLE), sample_elements, total * len(COVER) / MODULUS)
    wanted = samples.filter(F.size("parts") > 0).select("key", "parts").join(copies, "key")
    # Key and row together are spread evenly, however many copies a text has.
    bodies = keyed.filter(F.octet_length("text") >= LENGTH).select("key", "row", "text").mapInArrow(compressed, "key long, row long, body binary")
    # Repeated rows have one key and row: they become one where the join has put them, without a shuffle of the texts.
    once = bodies.join(wanted, ["key", "row"]).dropDuplicates(["key", "row"])
    tied = once.select("key", "copies", "body", "parts").mapInArrow(
        with_ties, "near long, key long, copies long, body binary, size long, runs binary")
    # Texts with a common sample become neighbours; the key cuts a crowd of them into many ranges.
    blocks = stored(tied.repartitionByRange("near", "key").sortWithinPartitions("near", "key").mapInArrow(as_blocks, BLOCK))
    suffixes = blocks.agg(F.sum(F.length("runs"))).first()[0] or 0
    buckets = power_of_two(LEAST_BUCKETS, total * 0.25 * 8 / BUCKET_BYTES) if suffixes else LEAST_BUCKETS
    sent = blocks.mapInArrow(lambda b: send(b, buckets), "bucket int, block long, suffixes binary, many binary")
    bits = sent.groupBy("bucket").applyInArrow(lambda table: answer(table, buckets), "block long, bucket int, bits binary")
    answers = bits.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    found = stored(blocks.join(answers, "block").mapInArrow(lambda b: cut(b, buckets), CUT))
    copied = copies.filter("copies > 1").select("key", F.lit(True).alias("copied"))
    known = found.join(copied, "key", "full")
    # One row per text: AQE splits a crowded text on the side of the documents.
    out = facts.select("doc_id", "key", "n_bytes", "sha").join(known, "key", "left")
    whole = F.col("copied") & (F.col("n_bytes") >= LENGTH)
    gone = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    pick = lambda a, b, c: F.when(whole, a).otherwise(F.coalesce(b, c))
    return out.select("doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
                      pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
                      pick(F.lit(EMPTY_SHA), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"), pick(gone, F.col("spans"), none).alias("spans"))
