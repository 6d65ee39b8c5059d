"""Exact set-similarity join of documents on five-word shingles.

Shingles are ordered rare first by the number of texts that hold them. A set
of ``n`` shingles can reach the threshold with another one only if their first
``n - ceil(t n) + 1`` shingles meet, so only those are filed; shingles of one
text alone meet nothing and are never filed at all. Candidates pass a length
filter, a positional filter (what can still be shared behind the place where
they meet) and a suffix filter (the sets cut by value, part against part), and
each pair is verified once by intersection.

Links only matter up to the class they join, so a crowded shingle is first
compared with one pivot (linear in its postings). Pairs of different classes
that still share a filed shingle are then all verified; pairs within a class
are never made.

Defined results: null texts and texts without words have no shingle, link with
nothing and are their own class, even as copies. A text of one to four words is
one shingle. Case is folded for A-Z only. Repeated rows are copies; a null id
takes part and its class is named by the smallest id that is not null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tramorisk.llm.components import components
from tramorisk.llm.repeats import OWNER, binaries, repeated_elements
from tramorisk.llm.store import stored
from tramorisk.llm.textbytes import SPACED, STEP, byte_codes, mix, owners, word_hashes, words

SHINGLE = 5
#: The threshold as a fraction, so that the decision is in whole numbers.
SHARED, OF = 75, 100
CODES = byte_codes(SPACED)
PARTS = 64
BYTES_PER_WORD = 6


def shingles(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Distinct shingles of each text as sorted (row << 52 | hash)."""
    first, last, bounds = words(buf, starts, ends, SPACED)
    h = word_hashes(buf, first, last, CODES)
    n = np.diff(bounds)
    rows, found = [], []
    if len(h) >= SHINGLE:
        joined = np.zeros(len(h) - SHINGLE + 1, dtype=np.uint64)
        for k in range(SHINGLE):
            joined = joined * STEP + h[k:k + len(joined)]
        owner = owners(bounds)[:len(joined)]
        inside = np.arange(SHINGLE, len(h) + 1) <= bounds[1:][owner]
        rows.append(owner[inside])
        found.append(mix(joined[inside]))
    for size in range(1, SHINGLE):
        short = np.flatnonzero(n == size)
        joined = np.full(len(short), size, dtype=np.uint64)
        for k in range(size):
            joined = joined * STEP + h[bounds[short] + k]
        rows.append(short)
        found.append(mix(joined))
    owner, value = np.concatenate(rows), np.concatenate(found)
    return np.unique((owner.astype(np.uint64) << OWNER) | (value >> np.uint64(12)))


def tokens(parts: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Repeated shingles of one text, rare first, and their counts."""
    h = np.concatenate([np.frombuffer(p["h"], dtype="<u8") for p in parts])
    f = np.concatenate([np.frombuffer(p["f"], dtype="u1") for p in parts])
    order = np.lexsort((h, f))
    return h[order], f[order]


def ordered_sets(found: DataFrame) -> DataFrame:
    """(``key``, ``n``, ``grams``: filed shingles, ``skip``: unrepeated ones before them, ``rest``: all repeated, sorted by value)."""

    def run(batches):
        for batch in batches:
            keys, sizes, kept, skips, grams, rest = [], [], [], [], [], []
            for key, n, parts in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                h, _ = tokens(parts)
                skip = n - len(h)
                filed = n - (-(-SHARED * n // OF)) + 1 - skip
                if filed > 0:
                    keys.append(key), sizes.append(n), skips.append(skip)
                    grams.append(h[:filed].astype(np.int64)), rest.append(np.sort(h))
            counts = lambda arrays: np.array([len(a) for a in arrays], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(skips, pa.int64()), pa.array(grams, pa.list_(pa.int64())),
                binaries(np.concatenate(rest) if rest else np.zeros(0, np.uint64), counts(rest))], names=["key", "n", "skip", "grams", "rest"])

    # A text can only link if what is repeated of it is at least the least overlap.
    least = F.size("parts") > 0
    return found.filter(least).mapInArrow(run, "key long, n long, skip long, grams array<bigint>, rest binary")


def may_link(na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Length filter, then the overlap still possible at positions ``pa_`` and ``pb`` against the least one."""
    length = F.least(na, nb) * OF >= F.greatest(na, nb) * SHARED
    left = F.least(na - pa_, nb - pb)
    return length & (left * (SHARED + OF) >= (na + nb) * SHARED)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) whose sets reach the threshold."""
    x = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("rest").alias("x"))
    y = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("y"))

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            columns = [batch.column(c) for c in ("na", "nb", "x", "y")]
            last, parts_x = None, None
            for i in range(batch.num_rows):
                na, nb = columns[0][i].as_py(), columns[1][i].as_py()
                p, q = (np.frombuffer(columns[k][i].as_buffer(), dtype="<u8") for k in (2, 3))
                least = -(-SHARED * (na + nb) // (SHARED + OF))
                if min(len(p), len(q)) < least:
                    continue
                edges = np.arange(1, PARTS, dtype=np.uint64) << np.uint64(52 - PARTS.bit_length() + 1)
                sizes_p = np.diff(np.concatenate([[0], np.searchsorted(p, edges), [len(p)]]))
                sizes_q = np.diff(np.concatenate([[0], np.searchsorted(q, edges), [len(q)]]))
                if np.minimum(sizes_p, sizes_q).sum() < least:  # suffix filter
                    continue
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                shared = int((q[at] == p).sum())
                keep[i] = OF * shared >= SHARED * (na + nb - shared)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long")


def set_links(sets: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) that join the same classes as all pairs at the threshold."""
    postings = stored(sets.select("key", "n", F.posexplode("grams").alias("_i", "gram"), "skip")
                      .select("gram", "key", "n", (F.col("skip") + F.col("_i")).alias("pos"), "skip"))
    # The pivot has the fewest shingles of its own: in a crowd of edited copies that is the text they were made from, or the least edited.
    pivots = postings.groupBy("gram").agg(F.min(F.struct("skip", "key", "n", "pos")).alias("p"), F.count(F.lit(1)).alias("_many")).filter("_many > 1")
    met = postings.join(pivots, "gram").filter((F.col("key") != F.col("p.key")) & may_link(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos")))
    star = stored(met.groupBy(F.col("p.key").alias("a"), F.col("key").alias("b")).agg(F.min("p.skip").alias("skip")))
    links = stored(verified(star.groupBy("b").agg(F.min(F.struct("skip", "a")).alias("m")).select("m.a", "b"), sets))
    classes = components(links)
    label = lambda df, key, out: df.join(classes.select(F.col("node").alias(key), F.col("label").alias(out)), key, "left").withColumn(out, F.coalesce(out, key))
    more = label(label(star, "a", "_ca"), "b", "_cb").filter("_ca <> _cb").select("a", "b")
    links = stored(links.unionByName(verified(more, sets)))
    classes = components(links)
    # What is left: shingles filed by texts of several classes, class against class.
    own = stored(label(postings, "key", "class"))
    split = own.groupBy("gram").agg(F.min("class").alias("_x"), F.max("class").alias("_y")).filter("_x <> _y").select("gram")
    own = stored(own.join(split, "gram"))
    # Bounds of a class at a shingle prune before its members are made; for a class of one they are the filters themselves.
    sides = own.groupBy("gram", "class").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("left"))
    side = lambda x: sides.select("gram", *[F.col(c).alias(f"{c}_{x}") for c in ("class", "lo", "hi", "left")])

    def possible(lo_a, hi_a, left_a, lo_b, hi_b, left_b) -> Column:
        sizes = (hi_a * OF >= lo_b * SHARED) & (hi_b * OF >= lo_a * SHARED)
        return sizes & (F.least(left_a, left_b) * (SHARED + OF) >= (lo_a + lo_b) * SHARED)

    c = F.col
    meet = side("a").join(side("b"), "gram").filter(
        (c("class_a") < c("class_b")) & possible(*[c(f"{k}_{x}") for x in "ab" for k in ("lo", "hi", "left")]))
    member = lambda x: own.select("gram", c("class").alias(f"class_{x}"), c("key").alias(x), c("n").alias(f"n{x}"), c("pos").alias(f"p{x}"))
    half = meet.join(member("a"), ["gram", "class_a"]).filter(possible(c("na"), c("na"), c("na") - c("pa"), c("lo_b"), c("hi_b"), c("left_b")))
    rest = half.select("gram", "class_b", "a", "na", "pa").join(member("b"), ["gram", "class_b"]).filter(may_link(c("na"), c("pa"), c("nb"), c("pb")))
    return links.unionByName(verified(rest.select("a", "b").distinct(), sets))


def similar_documents(docs: DataFrame, text: str = "text", row: str = "doc_id") -> DataFrame:
    """Per document: ``row`` as ``doc_id``, ``n_shingles``, ``component_id``."""
    keyed = docs.select(F.col(row).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = stored(repeated_elements(keyed, shingles, size / BYTES_PER_WORD))
    sets = stored(ordered_sets(found))
    classes = components(set_links(sets)).withColumnRenamed("node", "key")
    ids = stored(keyed.select("doc_id", "key"))
    known = found.select("key", "n").join(classes, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = ids.groupBy("key").agg(F.min("doc_id").alias("_least"))
    named = known.join(least, "key")
    named = named.join(named.groupBy("label").agg(F.min("_least").alias("component_id")), "label").select("key", "n", "component_id")
    # One row per text: AQE splits a crowded text on the side of the documents.
    out = ids.join(named, "key", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return out.select("doc_id", n.alias("n_shingles"), F.when(n > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
