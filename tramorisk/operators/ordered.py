"""Ranks, running sums, quantiles and picks that never hold one group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tramorisk.session import settle

HOT_ROWS = 500_000


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of every key by ``order``; a plain minimum, so it combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    ordering = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    best = df.groupBy(*keys).agg(F.min(F.struct(*ordering, F.struct(*rest).alias("_row"))).alias("_m"))
    return best.select(*keys, "_m._row.*").select(*df.columns)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last row of every key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    ordering = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    best = df.groupBy(*keys).agg(F.max(F.struct(*ordering, F.struct(*rest).alias("_row"))).alias("_m"))
    return best.select(*keys, "_m._row.*").select(*df.columns)


def salted_join(many: DataFrame, few: DataFrame, keys: Sequence[str], how: str = "inner",
                hot_rows: int = HOT_ROWS, hint: str | None = None) -> DataFrame:
    """Equi join on ``keys`` that spreads the crowded keys of ``many``.

    A key above ``hot_rows`` rows is cut into shares; ``few`` is repeated once
    per share of that key only. The list of crowded keys has at most
    ``rows / hot_rows`` entries, which bounds its broadcast. ``hint`` is a join
    hint for ``few``, for callers that know its size better than the planner.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins keep every row of the repeated side single")
    left, right = salted_sides(many, few, keys, hot_rows)
    return left.join(right.hint(hint) if hint else right, [*keys, "_share"], how).drop("_share")


def salted_sides(many: DataFrame, few: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides of ``salted_join`` with the share of a key (``_share``) that a row of ``many`` is in."""
    keys = list(keys)
    crowded = (many.groupBy(*keys).count().filter(F.col("count") > hot_rows)
               .select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias("_shares")))
    shares = F.coalesce(F.col("_shares"), F.lit(1))
    left = (many.join(F.broadcast(crowded), keys, "left")
            .withColumn("_share", F.pmod(F.xxhash64(*many.columns), shares).cast("int")).drop("_shares"))
    right = (few.join(F.broadcast(crowded), keys, "left")
             .withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares"))
    return left, right


def ordered_slices(df: DataFrame, order: Sequence[Column], slices: int | None = None) -> DataFrame:
    """Stored copy of ``df`` in range-partitioned slices, numbered by ``_slice``."""
    parts = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    return settle(parts.withColumn("_slice", F.spark_partition_id()))


def running_sums(df: DataFrame, groups: Sequence[str], order: Sequence[Column], sums: dict[str, Column],
                 slices: int | None = None) -> DataFrame:
    """Add inclusive running sums over ``order`` inside each group.

    Only the per-slice totals (slices x groups rows) meet in one window.
    """
    groups = list(groups)
    for name, value in sums.items():
        df = df.withColumn(f"_v_{name}", value)
    cut = ordered_slices(df, [*[F.col(g).asc() for g in groups], *order], slices)
    totals = cut.groupBy(*groups, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = W.partitionBy(*groups).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}")
                                                 for n in sums])
    inside = W.partitionBy(*groups, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = cut.join(offsets, [*groups, "_slice"]) if not groups else cut.alias("c").join(
        offsets.alias("o"), [F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*groups, "_slice"]]
    ).select("c.*", *[f"o._b_{n}" for n in sums])
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_b_{name}") + F.sum(f"_v_{name}").over(inside))
    return joined.drop("_slice", *[f"_v_{n}" for n in sums], *[f"_b_{n}" for n in sums])


def global_rank(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "puesto",
                slices: int | None = None) -> DataFrame:
    """Exact 1-based row number in each group; ``order`` must be total."""
    return running_sums(df, groups, order, {name: F.lit(1).cast("long")}, slices)


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float],
                    slices: int | None = None) -> DataFrame:
    """Linear-interpolated exact quantiles, one row per group and probability.

    Equal values are counted first, so a value shared by many rows is one row.
    """
    groups = list(groups)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(counts, groups, [F.col(value).asc()], {"_hasta": F.col("_n")}, slices)
    sizes = ranked.groupBy(*groups).agg(F.max("_hasta").alias("_total"))
    wanted = sizes.select(*groups, "_total", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    wanted = (wanted.withColumn("_pos", (F.col("_total") - 1) * F.col("prob"))
              .withColumn("_lo", F.floor("_pos")).withColumn("_hi", F.ceil("_pos")))
    match = [F.col(f"w.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups]
    inside = ((F.col("r._hasta") - F.col("r._n") <= F.col("w._hi")) & (F.col("r._hasta") > F.col("w._lo")))
    condition = inside
    for m in match:
        condition = condition & m
    # `wanted` holds one row per group and probability: the groups are closed
    # domains (classes, models, months), so its broadcast is bounded.
    hits = ranked.alias("r").join(F.broadcast(wanted.alias("w")), condition)
    covers_lo = (F.col("r._hasta") > F.col("w._lo")) & (F.col("r._hasta") - F.col("r._n") <= F.col("w._lo"))
    covers_hi = (F.col("r._hasta") > F.col("w._hi")) & (F.col("r._hasta") - F.col("r._n") <= F.col("w._hi"))
    picked = hits.groupBy(*[F.col(f"w.{g}") for g in groups], F.col("w.prob"), F.col("w._pos"), F.col("w._lo")).agg(
        F.max(F.when(covers_lo, F.col(f"r.{value}"))).alias("_a"),
        F.max(F.when(covers_hi, F.col(f"r.{value}"))).alias("_b"))
    return picked.select(*groups, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.col("_lo")))
                         .alias("valor"))


def quantile_values(df: DataFrame, value: str, probs: Sequence[float]) -> list[float | None]:
    """Exact quantiles of a whole column as Python numbers (a handful of rows)."""
    found = {r["prob"]: r["valor"] for r in exact_quantiles(df, [], value, probs).collect()}
    return [found.get(float(p)) for p in probs]


def keep_first(df: DataFrame, groups: Sequence[str], order: Sequence[Column], quota: Column | int,
               rows_per_cut: int = HOT_ROWS, constant: Sequence[str] = ()) -> DataFrame:
    """First ``quota`` rows of each group by a total ``order``; a null group is a group.

    ``quota`` may use the groups, the columns in ``constant`` (one value per
    group) and ``_tamano``, the size of the group, which stays in the result.
    Sizes are counted once, from the columns they need; the rows are then read
    once. Every cut of a crowded group keeps its own first rows and only those
    are ranked together, while groups within their quota stay in their cuts.
    Survivors too many for one task get the distributed rank. The groups are
    strata of closed domains (months, shifts, classes), which bounds their
    broadcast.
    """
    groups = list(groups)
    wanted = quota if isinstance(quota, Column) else F.lit(int(quota))
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    sizes = settle(df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_tamano"), *[F.first(c).alias(c) for c in constant])
                   .select(*keys, "_tamano", wanted.cast("long").alias("_cupo")))
    cuts, whole = F.ceil(F.col("_tamano") / rows_per_cut), F.col("_cupo") >= F.col("_tamano")
    alive = sizes.agg(F.max(F.when(~whole, cuts * F.least("_cupo", F.lit(rows_per_cut)))).alias("n"), F.max("_tamano").alias("rows")).first()
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    sized = df.join(F.broadcast(sizes), same).drop(*[f"_g{i}" for i in range(len(groups))]).filter("_cupo > 0")
    if not alive["n"]:  # no group is cut down to some of its rows
        return sized.filter(whole).drop("_cupo")
    if alive["n"] > rows_per_cut:
        return global_rank(sized, groups, order, "_rn").filter("_rn <= _cupo").drop("_rn", "_cupo")
    cut = F.pmod(F.xxhash64(*df.columns), cuts).cast("int")
    rank = lambda *by: F.row_number().over(W.partitionBy(*groups, *by).orderBy(*order))
    near = sized.withColumn("_corte", cut).withColumn("_rn", rank("_corte")).filter("_rn <= _cupo")
    if alive["rows"] > rows_per_cut:
        near = near.withColumn("_corte", F.when(whole, F.col("_corte")).otherwise(0)).withColumn("_rn", rank("_corte")).filter("_rn <= _cupo")
    return near.drop("_rn", "_corte", "_cupo")
