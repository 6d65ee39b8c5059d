"""Exact duplicates by a content sort: sampled splitters, range-partitioned normalised bytes, neighbours compared in full.

Rows are ordered by the leading bytes of the normalised text, its SHA-256 (which
stands for the bytes behind them, so that a splitter stays short), the text
itself, the id and the place of the row in its input. Splitters are sampled in
proportion to bytes, so a slice holds about as many bytes as any other, and as
the id is part of them, a group of copies of any size runs through as many
slices as it needs. Within a slice an external sort puts equal texts side by
side and every row is compared in full with the row before it. A run that goes
on in the next slice is joined to it by the texts at the slices' ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tramorisk.llm.store import stored

HEAD_BYTES = 64
SLICE_BYTES = 256 << 20
SLICES_PER_PARTITION = 4
POINTS_PER_SLICE = 16
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Rows as (``row``: all columns, ``body``, ``key``); the key orders rows and is short whatever the text."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("place"))
    body = rows.withColumn("body", normalised(F.col(f"row.`{text}`")).cast("binary"))
    given = F.col(f"row.`{doc_id}`")
    return body.withColumn("key", F.struct(F.substring("body", 1, HEAD_BYTES).alias("head"), F.unhex(F.sha2("body", 256)).alias("sha"),
                                           given.isNull().alias("no_id"), given.alias("id"), F.col("place").alias("place")))


def splitters(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row with ``cuts``: the sorted lower ends of all slices but the first.

    A row is drawn once for every ``slice_bytes / POINTS_PER_SLICE`` bytes it
    holds, the rest by chance, before it is normalised. As many cuts are kept as
    there are slices: bytes / ``slice_bytes``, or a few for each shuffle
    partition; that bounds the row.
    """
    spark = docs.sparkSession
    weight = F.coalesce(F.octet_length(docs[text]), F.lit(0)) + 32
    total = docs.agg(F.sum(weight.cast("long")).alias("n")).first()["n"] or 0
    least = SLICES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(least, -(-total // slice_bytes))
    draws = F.floor(weight * F.lit(slices * POINTS_PER_SLICE / max(total, 1)) + F.rand(7)).cast("int")
    drawn = docs.select(*[docs[c] for c in dict.fromkeys([doc_id, text])], draws.alias("_draws_")).filter("_draws_ > 0")
    points = _keyed(drawn, text, doc_id).select("key", F.explode(F.sequence(F.lit(1), F.col("row._draws_"))).alias("copy"))
    ranges = points.repartitionByRange(slices, "key", "copy").select("key", F.spark_partition_id().alias("part"))
    ends = ranges.groupBy("part").agg(F.min("key").alias("key")).filter("part > 0")
    return stored(ends.agg(F.array_sort(F.collect_set("key")).alias("cuts")))


def _slice_of(cuts: Column, key: Column, bits: int) -> Column:
    """Number of cuts at or below ``key``, by binary search."""
    def step(at: Column, power: Column) -> Column:
        reach = at + power
        return F.when((reach <= F.size(cuts)) & (F.get(cuts, reach - 1) <= key), reach).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range(bits))]), F.lit(0), step)


def exact_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_text: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal if they are identical after each run of white space became
    one space; a null text counts as empty. Of equal texts the row with the
    smallest id stays, a row without an id only where none has one; of rows
    that share that id the first in the input stays, so that one row of each
    group is kept. ``keep_id`` is null where no row of the group has an id.
    All other columns pass unchanged (the text only with ``keep_text``);
    columns named like a result are replaced. An empty table gives no rows.

    Rows with one id and one text are told apart by their place in the input:
    give rows read from files, which come in the same order at every attempt.
    """
    carried = [c for c in docs.columns if c not in RESULT and (keep_text or c != text)]
    docs = docs.select(*[docs[c] for c in dict.fromkeys([*carried, doc_id, text])])
    cuts = splitters(docs, text, doc_id, slice_bytes)
    bits = (cuts.select(F.size("cuts").alias("n")).first()["n"] + 1).bit_length()
    rows = _keyed(docs, text, doc_id).withColumn("row", F.struct(*[F.col(f"row.`{c}`") for c in carried], F.lit(0).alias("_mark_")))
    cut = rows.withColumn("cuts", cuts.select("cuts").scalar()).withColumn("slice", _slice_of(F.col("cuts"), F.col("key"), bits)).drop("cuts")

    inside = W.partitionBy("slice").orderBy("key.head", "key.sha", "body", "key.no_id", "key.id", "key.place")
    before = F.lag("body").over(inside)
    compared = cut.withColumn("starts", before.isNull() | (before != F.col("body"))).withColumn("edge", F.when(
        before.isNull() | F.lead(F.lit(1)).over(inside).isNull(), F.col("body")))
    numbered = compared.withColumn("run", F.sum(F.col("starts").cast("long")).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("slice", "run")
    runs = stored(numbered.select("row", "slice", "run", "starts", "edge", F.col("key.id").alias("id"), F.col("key.sha").alias("sha"))
                  .withColumn("least", F.min("id").over(run)).withColumn("size", F.count(F.lit(1)).over(run)).drop("id"))

    # At most two runs of a slice touch its ends, so `whole` has at most two rows for each slice.
    edges = runs.filter("edge is not null").groupBy("slice", "run").agg(*[F.first(c).alias(c) for c in ("edge", "sha", "least", "size")])
    joined = edges.groupBy("sha", "edge").agg(F.min("least").alias("all_least"), F.sum("size").alias("all_size"), F.min("slice").alias("first_slice"),
                                              F.collect_list(F.struct("slice", "run")).alias("parts")).filter(F.size("parts") > 1)
    whole = joined.select("all_least", "all_size", "first_slice", F.explode("parts").alias("part")).select("part.*", "all_least", "all_size", "first_slice")
    found = runs.join(F.broadcast(whole), ["slice", "run"], "left")
    first = F.col("first_slice").isNull() | (F.col("first_slice") == F.col("slice"))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in carried],
                        F.when(F.col("first_slice").isNull(), F.col("least")).otherwise(F.col("all_least")).alias("keep_id"),
                        F.coalesce("all_size", "size").alias("group_size"), (F.col("starts") & first).alias("kept"),
                        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs``; columns named like a result of ``exact_copies`` are not allowed."""
    taken = [c for c in docs.columns if c in RESULT]
    if taken:
        raise ValueError(f"rename the columns {taken}")
    return exact_copies(docs, text, doc_id, keep_text=True).filter("kept").select(*docs.columns)
