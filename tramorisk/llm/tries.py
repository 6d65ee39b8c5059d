"""Prefix trie of conversations by ROLLUP over columns of turn ids.

A turn id is the SHA-256 of a turn, so texts leave the job at once. A
conversation becomes rows of ``WIDTH`` positional columns, and one ROLLUP with
grouping_id aggregates all prefixes that end in a block together. A long
conversation goes on in further blocks of columns; each is keyed by the node at
which the block before it ends. That node is named by the turn ids of the path
to it (sums of one hash for each full block, 240 bits), so all blocks of all
conversations go through the same ROLLUP and no round waits for another.

Sums over subtrees are a second ROLLUP. Every node belongs to its smallest
member, its owner; a conversation owns the deepest part of its path and nothing
else. A node's subtree is then what its members own at or below its depth, which
each conversation knows for itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tramorisk.llm.store import id_hash, stored
from tramorisk.operators.ordered import running_sums

WIDTH = 8
ID_SPAN = 4096
WORDS = 4
_TURNS = [f"t{j}" for j in range(WIDTH)]
_SUMS = [f"w{i}" for i in range(WORDS)]


def turn_ids(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as (``conv_id``, ``pos`` from 1, ``t``: id and bytes of the text); rows without a conversation are left out.

    Turns go by ``turn``, null first; turns that tie go by their id. The rank is
    made in slices, so one conversation may hold most of the rows.
    """
    said, by = F.coalesce(rows[text], F.lit("")), F.coalesce(rows[role], F.lit(""))
    name = F.unhex(F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said), 256))
    flat = rows.filter(rows[conv_id].isNotNull()).select(
        rows[conv_id].alias("conv_id"), rows[turn].alias("turn"), F.struct(name.alias("id"), F.octet_length(said).cast("long").alias("bytes")).alias("t"))
    return running_sums(flat, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("t").asc()], {"pos": F.lit(1).cast("long")}).select("conv_id", "pos", "t")


def share_starts(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversations that share starts: (``conv_id``, ``n_turns``, ``pos``, ``t``); a conversation without turns has one row of null ``pos``.

    Conversation c takes the first h = crc32(c) % ``most`` turns of
    conversation c - c % ``group``, then its own turns after its first h.
    """
    held = F.pmod(id_hash("conv_id"), F.lit(most)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = turns.filter(F.col("pos") < most).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumn("base", base).withColumn("h", held).join(heads, "base", "left")
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<pos:bigint,t:struct<id:binary,bytes:bigint>>>"))
    convs = stored(convs.withColumn("head", taken).select("conv_id", "h", "head", (F.size("head") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).cast("long").alias("n_turns")))
    first = convs.select("conv_id", "n_turns", F.explode_outer("head").alias("x")).select("conv_id", "n_turns", "x.pos", "x.t").filter("pos is not null or n_turns = 0")
    later = turns.join(convs.select("conv_id", "n_turns", "h", F.size("head").alias("m")), "conv_id").filter("pos > h")
    return first.unionByName(later.select("conv_id", "n_turns", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "t"))


def _hash(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256))


def blocks(turns: DataFrame) -> DataFrame:
    """One row for each ``WIDTH`` turns: ``t0``, ``t1``, ... with ``prior``, the node before the block, and ``after``, the node behind a full one."""
    slot = F.pmod(F.col("pos") - 1, F.lit(WIDTH))
    rows = turns.groupBy("conv_id", F.coalesce(F.floor((F.col("pos") - 1) / WIDTH), F.lit(0)).alias("block")).agg(
        F.max("n_turns").alias("n_turns"), *[F.max(F.when(slot == j, F.col("t"))).alias(t) for j, t in enumerate(_TURNS)])
    digest = F.sha2(F.concat(F.col("block").cast("string"), F.lit(":"), *[F.coalesce(F.hex(f"{t}.id"), F.lit("-")) for t in _TURNS]), 256)
    rows = stored(rows.withColumn("_d", digest))
    words = {f"w{i}": F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(WORDS)}
    long = running_sums(rows.filter(F.col("n_turns") > WIDTH), ["conv_id"], [F.col("block").asc()], words)
    both = rows.filter(F.col("n_turns") <= WIDTH).withColumns(words).unionByName(long)
    node = lambda n, sums: _hash(n, *[s.cast("decimal(38,0)") for s in sums])
    ends = [F.col(w) for w in _SUMS]
    return both.withColumns(words | {"prior": node(F.col("block"), [e - v for e, v in zip(ends, words.values(), strict=True)]), "after": node(F.col("block") + 1, ends)}) \
        .drop("_d", *_SUMS)


def _path(level: Column, hidden: int = 0) -> Column:
    """Name of the node that ``level`` turns of the block lead to, or of the one ``hidden`` turns above it."""
    named = _hash(F.hex("prior"), *[F.when(level >= j + 1 + hidden, F.hex(f"{t}.id")) for j, t in enumerate(_TURNS)])
    ends = F.when(level == hidden, F.col("prior")).when(level > hidden, named)
    return ends if hidden else F.when(level == WIDTH, F.col("after")).otherwise(ends)


def _prefixes(rows: DataFrame, measures: dict[str, str]) -> DataFrame:
    """All prefixes of all blocks as (``block``, ``level``, ``key``, ``parent_key``, ``bytes`` of the last text, measures).

    A prefix that ends with its block is not counted again as the empty prefix
    of the next one, and a level behind the end of a conversation (null in its
    last column) is no prefix.
    """
    turns, wanted = ", ".join(_TURNS), ", ".join(f"{sql} AS {name}" for name, sql in measures.items())
    flat = rows.sparkSession.sql(f"SELECT block, prior, {turns}, {WIDTH} - bit_count(grouping_id()) AS level, max(after) AS after, {wanted} "
                                 f"FROM {{rows}} GROUP BY block, prior, ROLLUP({turns})", rows=rows)
    level = F.col("level")
    last = reduce(lambda found, j: F.when(level == j + 1, F.col(_TURNS[j])).otherwise(found), range(WIDTH), F.lit(None).cast(rows.schema["t0"].dataType))
    nodes = flat.withColumn("last", last).filter("(level = 0 and block = 0) or last is not null")
    return nodes.select("block", "level", _path(level).alias("key"), _path(level, 1).alias("parent_key"), F.coalesce("last.bytes", F.lit(0)).alias("bytes"), *measures)


def _owned(nodes: DataFrame) -> DataFrame:
    """What each conversation owns in each block: ``v1``, ... saved at each level (null: not owned), ``leaf``, and ``beyond``: the first level of the next block."""
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    own = nodes.select("conv_id", "block", "level", saved.alias("v"), (F.col("longest") == F.col("block") * WIDTH + F.col("level")).cast("long").alias("leaf"))
    beyond = own.filter("level = 1 and block > 0").select("conv_id", (F.col("block") - 1).alias("block"), F.lit(WIDTH + 1).alias("level"), F.lit(0).cast("long").alias("v"),
                                                          F.lit(0).cast("long").alias("leaf"))
    return own.unionByName(beyond).groupBy("conv_id", "block").agg(
        F.max("leaf").alias("leaf"), *[F.max(F.when(F.col("level") == j, F.col("v"))).alias(f"v{j}") for j in range(1, WIDTH + 2)])


def _with_own(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """Blocks with what their conversation owns at or below each level: ``s0``, ... bytes saved, ``c0``, ... children, ``leaves``."""
    zero = F.lit(0).cast("long")
    has = rows.join(owned, ["conv_id", "block"], "left").withColumn("leaf", F.coalesce("leaf", zero))
    values = [F.coalesce(f"v{j}", zero) for j in range(1, WIDTH + 1)]
    here = [reduce(Column.__add__, values[max(j - 1, 0):]) for j in range(WIDTH + 1)]
    has = stored(has.select(*rows.columns, "leaf", *[h.alias(f"s{j}") for j, h in enumerate(here)],
                            *[F.col(f"v{j + 1}").isNotNull().cast("long").alias(f"c{j}") for j in range(WIDTH + 1)]))
    sums = {"later_saved": F.col("s0"), "later_leaves": F.col("leaf")}
    long = running_sums(has.filter(F.col("n_turns") > WIDTH), ["conv_id"], [F.col("block").desc()], sums)
    both = has.filter(F.col("n_turns") <= WIDTH).withColumns(sums).unionByName(long)
    later = F.col("later_saved") - F.col("s0")
    return both.withColumns({f"s{j}": F.col(f"s{j}") + later for j in range(WIDTH + 1)} | {"leaves": F.col("later_leaves")})


def id_digests(ends: DataFrame) -> DataFrame:
    """(``key``, ``conv_id``) to (``key``, ``ends_sha256``) over the ascending ids joined by commas.

    Ids of one span of ``ID_SPAN`` numbers are joined first, in parallel; a
    span cannot hold more ids than that. SHA-256 takes its input in order, so the
    pieces of one node then stream through one task, a piece at a time.
    """
    span = F.shiftright("conv_id", ID_SPAN.bit_length() - 1).alias("span")
    pieces = ends.groupBy("key", span).agg(F.concat_ws(",", F.array_sort(F.collect_list("conv_id")).cast("array<string>")).alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(piece.encode())
            yield _digest_rows(done)
        if state:
            yield _digest_rows([(key, state.hexdigest())])

    return pieces.repartition("key").sortWithinPartitions("key", "span").select("key", "piece").mapInArrow(run, "key binary, ends_sha256 string")


def _digest_rows(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k for k, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], names=["key", "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Trie of (``conv_id``, ``n_turns``, ``pos``, ``t``) as one row for each distinct prefix.

    ``conv_id`` is the smallest member; together with ``depth`` it names the
    node. ``n_leaves`` and ``saved_tokens`` go over the node's subtree.
    A table without conversations gives no rows, not even a root.
    """
    rows = stored(blocks(turns))
    level = F.least(F.col("n_turns") - F.col("block") * WIDTH, F.lit(WIDTH))
    first = stored(_prefixes(rows, {"conv_id": "min(conv_id)", "n_convs": "count(*)", "longest": "max(n_turns)"}).drop("key", "parent_key"))
    own = _with_own(rows, _owned(first))
    picked = lambda name: F.get(F.array(*[F.col(f"{name}{j}") for j in range(WIDTH + 1)]), F.col("level"))
    nodes = stored(_prefixes(own, {"conv_id": "min(conv_id)", "n_convs": "count(*)", "n_leaves": "sum(leaves)"}
                             | {f"{x}{j}": f"sum({x}{j})" for x in "sc" for j in range(WIDTH + 1)}).select(
        "key", "parent_key", "conv_id", (F.col("block") * WIDTH + F.col("level")).alias("depth"), "n_convs", picked("c").alias("n_children"), "n_leaves",
        picked("s").alias("saved_tokens")))
    # Children of a crowded node are many rows of one key against one row; the join is left to AQE to split.
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    last = rows.filter((F.col("n_turns") <= (F.col("block") + 1) * WIDTH) & (F.col("n_turns") >= F.col("block") * WIDTH))
    digests = id_digests(last.select(_path(level).alias("key"), "conv_id"))
    return nodes.join(parents, "parent_key", "left").join(digests, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(rows: DataFrame) -> DataFrame:
    """Trie of the conversations (``conv_id``, ``turn``, ``role``, ``text``) after ``share_starts``; null roles and texts count as empty."""
    return prefix_trie(share_starts(turn_ids(rows)))
