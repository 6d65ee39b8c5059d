"""Mixing sources to target weights by cube-method balanced sampling.

A source's share beyond whole repeats is a fractional inclusion probability.
The flight phase moves three units of one source at a time along the null
space of the two balancing constraints (words and documents) until one of
them reaches 0 or 1; every block of a source leaves at most two fractional
units, which meet again in fewer blocks. The last two units of a size class land
on the side of a fixed draw; smaller classes make up for them. Blocks hold a bounded number of narrow rows, so a
source with a third of all rows is many blocks.

Defined results: a null or empty text has size 0 and is never taken. A null
source is a source of its own, last in order. Null ids are allowed; rows that
agree in id, source and size may change places with each other. Without words
every target is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tramorisk.llm.store import stored
from tramorisk.operators.ordered import global_rank

WORD = r"[^\x20\x09-\x0D]++"
SHARE, WEIGHTS, MOST = 1.5, (5.0, 2.0, 1.0), 2.0
BLOCK_ROWS = 2_000
SIZE_CLASSES = (16, 4, 1)  # times the median of a group


def text_size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Target words of each source: by weight, stopped at ``most`` times its size, the excess shared anew.

    Sources are ranked by range-partitioned slices; each round of sharing is
    one sum over the sources.
    """
    ranked = global_rank(sizes, [], [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = stored(ranked.select("source", "source_size", weight.alias("_weight"), (F.col("source_size") * most).alias("_most")))
    total, level = float(table.agg(F.sum("source_size")).first()[0] or 0) * share, 0.0
    while True:
        full = F.col("_most") <= F.col("_weight") * F.lit(level)
        held, free = table.agg(F.sum(F.when(full, F.col("_most"))), F.sum(F.when(~full, F.col("_weight")))).first()
        now = max(0.0, total - float(held or 0)) / float(free) if free else level
        if not free or now <= level * (1 + 1e-12):
            break
        level = now
    return table.withColumn("target", F.least(F.col("_most"), F.col("_weight") * F.lit(level))).drop("_weight", "_most")


def flight(sizes: np.ndarray, probs: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Move probabilities to 0 or 1, keeping sums of sizes and of counts, until at most two are fractional."""
    p, out, queue = probs.astype(float), probs.astype(float), []
    for k in np.flatnonzero((p > 0) & (p < 1)):
        queue.append(k)
        while len(queue) == 3:
            a, b, c = queue
            u = np.array([sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b]], dtype=float)
            if not u.any():
                u = np.array([1.0, -1.0, 0.0])
            x = out[queue]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.min(np.where(u > 0, (1 - x) / u, np.where(u < 0, -x / u, np.inf)))
                down = np.min(np.where(u > 0, x / u, np.where(u < 0, (x - 1) / u, np.inf)))
            x = x + u * (up if draw.random() * (up + down) < down else -down)
            x[x < 1e-9], x[x > 1 - 1e-9] = 0.0, 1.0
            out[queue] = x
            queue = [q for q in queue if 0 < out[q] < 1]
    return out


def fly(rows: pd.DataFrame) -> pd.DataFrame:
    """Flight phase of one block; rows come in a fixed order, so reruns agree."""
    rows = rows.sort_values(["_row", "size"], kind="stable").reset_index(drop=True)
    seed = int(rows["_row"].iloc[0]) & 0x7FFFFFFF
    return rows.assign(p=flight(rows["size"].to_numpy(), rows["p"].to_numpy(), np.random.default_rng(seed)))


def land(left: DataFrame, block_rows: int) -> DataFrame:
    """Fractional units with ``p`` moved to 0 or 1: flights by blocks, and a draw for the last two of each group."""
    done, level = None, 0
    while True:
        counts = left.groupBy("_group").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("_blocks"))
        cut = left.join(counts, "_group").withColumn("_block", F.pmod(F.xxhash64("_row", F.lit(level)), F.col("_blocks")))
        # Dealt by block: the join above leaves a source together.
        flown = stored(cut.select("_group", "_block", "_blocks", "_row", "size", "p").repartition("_group", "_block")
                       .groupBy("_group", "_block").applyInPandas(
                           lambda pdf: fly(pdf), "_group long, _block long, _blocks long, _row long, size long, p double"))
        fractional = (F.col("p") > 0) & (F.col("p") < 1)
        landing = F.when(F.pmod(F.xxhash64("_row", F.lit("land")), F.lit(1_000_000)) < F.col("p") * 1_000_000, 1.0).otherwise(0.0)
        ready = flown.filter(~fractional | (F.col("_blocks") == 1)).withColumn("p", F.when(fractional, landing).otherwise(F.col("p")))
        done = ready if done is None else done.unionByName(ready)
        left, level = flown.filter(fractional & (F.col("_blocks") > 1)).select("_row", "_group", "size", "p"), level + 1
        if left.isEmpty():
            return done.select("_row", "_group", "size", "p")


def balances(wanted: DataFrame, done: DataFrame, rest: DataFrame) -> DataFrame:
    """Per group ``_a`` and ``_b``: adding ``_a + _b * size`` to each p of the rest makes up for the words and units that landing has missed.

    Where that would leave 0 to 1, only the words are made up for, by one shift.
    """
    size = F.col("size").cast("double")
    landed = done.groupBy("_group").agg(F.sum(F.col("p") * size).alias("_dw"), F.sum("p").alias("_dr"))
    table = rest.groupBy("_group").agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum(size).alias("_s1"), F.sum(size * size).alias("_s2"), F.sum(F.col("p") * size).alias("_rw"), F.sum("p").alias("_rr"),
                                       F.min(size).alias("_lo"), F.max(size).alias("_hi"), F.min("p").alias("_plo"), F.max("p").alias("_phi"))
    words = F.col("_words") - F.coalesce("_dw", F.lit(0.0)) - F.col("_rw")
    units = F.col("_units") - F.coalesce("_dr", F.lit(0.0)) - F.col("_rr")
    det = F.col("_n") * F.col("_s2") - F.col("_s1") * F.col("_s1")
    slope = F.when(F.col("_hi") > F.col("_lo"), (F.col("_n") * words - F.col("_s1") * units) / det)
    base = (units - slope * F.col("_s1")) / F.col("_n")
    ends = [base + slope * F.col(c) for c in ("_lo", "_hi")]
    both = F.coalesce((F.col("_plo") + F.least(*ends) >= 0) & (F.col("_phi") + F.greatest(*ends) <= 1), F.lit(False))
    return table.join(wanted, "_group").join(landed, "_group", "left").select(
        "_group", F.when(both, base).otherwise(words / F.col("_s1")).alias("_a"), F.when(both, slope).otherwise(0.0).alias("_b"))


def cube_sample(units: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Units (``_row``, ``_group``, ``size``, ``p``) with ``p`` moved to 0 or 1, balanced on sizes and counts in each group.

    The largest units of a group land first, by classes of size against its
    median; the smaller ones take over what landing has missed, so that the last
    to land are at most of median size.
    """
    schema = units.select("_row", "_group", "size", "p")
    sure = schema.filter((F.col("p") <= 0) | (F.col("p") >= 1))
    left = schema.filter((F.col("p") > 0) & (F.col("p") < 1))
    wanted = stored(left.groupBy("_group").agg(F.percentile_approx("size", 0.5).alias("_median"), F.sum(F.col("p") * F.col("size")).alias("_words"), F.sum("p").alias("_units")))
    class_ = F.when(F.col("size") > F.col("_median") * SIZE_CLASSES[0], 0)
    for k, times in enumerate(SIZE_CLASSES[1:], 1):
        class_ = class_.when(F.col("size") > F.col("_median") * times, k)
    left = stored(left.join(wanted.select("_group", "_median"), "_group").select("_row", "_group", "size", "p", class_.otherwise(len(SIZE_CLASSES)).alias("_class")))
    done = None
    for k in range(len(SIZE_CLASSES) + 1):
        rows = left.filter(F.col("_class") == k)
        if rows.isEmpty():
            continue
        if done is not None:
            shift = stored(balances(wanted, done, left.filter(F.col("_class") >= k)))
            rows = rows.join(shift, "_group").withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") + F.col("_a") + F.col("_b") * F.col("size"))))
        landed = land(rows.select("_row", "_group", "size", "p"), block_rows)
        done = landed if done is None else done.unionByName(landed)
    return sure if done is None else sure.unionByName(done)


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", row: str = "doc_id", keep_source: bool = False) -> DataFrame:
    """Per document: ``row``, ``size``, ``source_size``, ``target`` of its source, ``taken`` words and ``copies``."""
    sized = stored(docs.select(F.col(row).alias("doc_id"), F.col(source).cast("string").alias("source"), text_size(text).alias("size")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    targets = stored(targets.withColumn("_group", F.xxhash64(F.col("source").isNull(), "source")))
    # One row per source: the join leaves the side of the documents to AQE, which splits a crowded source.
    with_target = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.doc_id", "d.source", "d.size", "t._group", "t.source_size", "t.target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-12)
    planned = stored(with_target.withColumn("_whole", whole.cast("long")).withColumn("p", F.greatest(F.lit(0.0), ratio - F.col("_whole")))
                     .withColumn("_row", F.xxhash64("doc_id", "_group", "size")))
    # Rows of one identity are one unit that moves together, so a repeated row never splits the key.
    units = planned.filter("size > 0").groupBy("_row", "_group", "p").agg(F.sum("size").alias("size"))
    chosen = cube_sample(units).select("_row", F.col("p").alias("_more"))
    copies = F.when(F.col("size") > 0, F.col("_whole") + F.coalesce(F.col("_more"), F.lit(0.0)).cast("long")).otherwise(F.lit(0)).cast("long")
    return planned.join(chosen, "_row", "left").withColumn("copies", copies).select(
        "doc_id", *["source"] * keep_source, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: documents that it takes, each with ``copies`` and ``taken`` beside its columns."""
    # By source too: rows of equal id and size in two sources are two decisions, and rows of one identity are one.
    mixed = mix_sources(docs, keep_source=True).filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "size", "source_size", "target", "taken", "copies").dropDuplicates(["_id", "_source", "size"])
    kept = docs.drop("size", "source_size", "target", "taken", "copies").withColumn("_size", text_size("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").cast("string").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("size"))
    return kept.join(mixed, same).drop("_id", "_source", "_size")
