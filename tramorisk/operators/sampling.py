"""Stratified samples with inverse-inclusion weights.

Rows are taken in a given total order (a hash by default), so a lost executor
rebuilds the same sample. Quotas and weights are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tramorisk.operators.ordered import global_rank, keep_first


def hash_order(seed: int = 42, keys: Sequence[str] = ("tramo_id", "mes_idx", "turno_idx")) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *keys), *[F.col(k) for k in keys]]


def cap_low_class(df: DataFrame, order: Sequence[Column], label: str = "y", floor: int = 50_000, ceiling: int = 250_000) -> DataFrame:
    """All medium and high rows; lows up to min(max(floor, 2 x minority), ceiling)."""
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # three classes
    minority = sizes.get(1, 0) + sizes.get(2, 0)
    low_cap = min(max(floor, 2 * minority), ceiling)
    quota = F.when(F.col(label) == 0, F.lit(low_cap)).otherwise(F.col("_tamano"))
    return keep_first(df, [label], order, quota).drop("_tamano")


def cap_per_class(df: DataFrame, strata: Sequence[str], cap: int, order: Sequence[Column], label: str = "y",
                  low_factor: int = 1) -> DataFrame:
    """At most ``cap`` rows per stratum and class, ``low_factor`` times for low."""
    quota = F.when(F.col(label) == 0, F.lit(cap * low_factor)).otherwise(F.lit(cap))
    return keep_first(df, [*strata, label], order, quota).drop("_tamano")


def two_stratum(df: DataFrame, strata: Sequence[str], order: Sequence[Column], label: str = "y", active: str = "activo",
                ratio: float = 3.0, minimum: int = 900, active_share: float = 0.6) -> DataFrame:
    """All positives; lows from active and quiet histories within a budget.

    A short stratum hands its unused share to the other; ``peso_inclusion`` is
    population over sample, so weights add up to the population.
    """
    kind = F.when(F.col(label) > 0, 0).when(F.col(active), 1).otherwise(2)
    marked = df.withColumn("_tipo", kind)
    sizes = marked.groupBy(*strata).agg(*[F.count(F.when(F.col("_tipo") == i, 1)).alias(n) for i, n in enumerate(("_p", "_a", "_q"))])
    budget = F.least(F.col("_a") + F.col("_q"), F.greatest(F.lit(minimum), F.floor(F.col("_p") * float(ratio))))
    wanted = F.least(F.col("_a"), F.bround(budget * float(active_share)).cast("long"))
    quiet = F.least(F.col("_q"), budget - wanted)
    loud = F.least(F.col("_a"), budget - quiet)
    quotas = sizes.select(*strata, "_p", loud.cast("long").alias("_ca"), quiet.cast("long").alias("_cq"))
    quota = F.when(F.col("_tipo") == 0, F.col("_p")).when(F.col("_tipo") == 1, F.col("_ca")).otherwise(F.col("_cq"))
    # strata are calendar months x shifts, which bounds the broadcast
    named = quotas.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], "_p", "_ca", "_cq")
    same = [F.col(s).eqNullSafe(F.col(f"_s{i}")) for i, s in enumerate(strata)]
    joined = marked.join(F.broadcast(named), same).drop(*[f"_s{i}" for i in range(len(strata))])
    kept = keep_first(joined, [*strata, "_tipo"], order, quota, constant=("_p", "_ca", "_cq"))
    weight = F.when(F.col("_tipo") == 0, F.lit(1.0)).when(F.col("_tipo") == 1, F.col("_tamano") / F.col("_ca")).otherwise(
        F.col("_tamano") / F.col("_cq"))
    return kept.withColumn("peso_inclusion", weight).drop("_tipo", "_p", "_ca", "_cq", "_tamano")


def class_month_sample(df: DataFrame, order: Sequence[Column], cap: int = 18_000, max_rows: int = 90_000,
                       balance: float = 0.5, boost: Sequence[float] = (1, 1, 1), label: str = "y",
                       strata: Sequence[str] = ("mes_idx",)) -> DataFrame:
    """Capped rows per class and month with mean-one training weights.

    weight = population/kept x (total / (3 x class size)) ^ balance x boost.
    """
    sizes = df.groupBy(*strata, label).count().collect()  # calendar strata x three classes
    months = len({tuple(r[s] for s in strata) for r in sizes})
    limit = min(cap, max_rows // (3 * max(months, 1)))
    per_class: dict[int, int] = {}
    for r in sizes:
        per_class[r[label]] = per_class.get(r[label], 0) + r["count"]
    total = sum(per_class.values())
    factor = {c: (total / (3 * n)) ** balance * float(boost[c]) for c, n in per_class.items()}
    kept_rows = sum(min(limit, r["count"]) for r in sizes)
    mean = sum(r["count"] * factor[r[label]] for r in sizes) / max(kept_rows, 1)
    kept = keep_first(df, [*strata, label], order, limit)
    scale = F.create_map(*[F.lit(x) for c, v in factor.items() for x in (c, v / mean)])
    return kept.withColumn("peso", F.col("_tamano") / F.least(F.col("_tamano"), F.lit(limit)) * scale[F.col(label)]).drop("_tamano")


def sample_digest(df: DataFrame, keys: Sequence[str] = ("tramo_id", "mes_idx")) -> DataFrame:
    """Order-free identity of a sample: rows and wrapped sum of row hashes."""
    return df.agg(F.count(F.lit(1)).alias("filas"),
                  F.coalesce(F.sum(F.xxhash64(*keys).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("huella"))


def balanced_weights(df: DataFrame, label: str = "y", power: float = 1.0) -> DataFrame:
    """Weight n / (3 x class size), raised to ``power``."""
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # three classes
    total = sum(sizes.values())
    table = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, (total / (3 * n)) ** power)])
    return df.withColumn("peso_clase", table[F.col(label)])


def _require_positive(limit: int) -> None:
    if limit < 1:
        raise ValueError("limit must be at least 1")


def top_points(df: DataFrame, minimum: float = 0.0, limit: int = 15_000, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Best-scored points above a minimum, inside optional bounds."""
    _require_positive(limit)
    minimum = min(1.0, max(0.0, minimum))
    if bounds:
        south, west, north, east = bounds
        df = df.filter(F.col("latitud").between(south, north) & F.col("longitud").between(west, east))
    return df.filter(F.col("riesgo_score") >= minimum).orderBy(F.desc("riesgo_score"), "tramo_id").limit(limit)


def balanced_points(df: DataFrame, minimum: float = 0.0, limit: int = 15_000) -> DataFrame:
    """Evenly spaced ranks per level when the rows exceed the limit."""
    _require_positive(limit)
    rows = df.filter((F.col("riesgo_score") >= minimum) & F.col("nivel").isin("bajo", "medio", "alto"))
    sizes = {r["nivel"]: r["count"] for r in rows.groupBy("nivel").count().collect()}  # three levels
    if sum(sizes.values()) <= limit:
        return rows
    quota = max(1, limit // 3)
    ranked = global_rank(rows, ["nivel"], [F.desc("riesgo_score"), F.asc("tramo_id")], "_r")
    size = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("nivel")]
    at = F.col("_r") - 1
    if quota == 1:
        wanted = at == 0
    else:
        # rank i*(n-1)/(q-1) cut down; the step i that could give this rank
        step = F.ceil(at * F.lit(float(quota - 1)) / (size - 1))
        hit = lambda i: F.floor(i * (size - 1) / F.lit(float(quota - 1))) == at
        wanted = hit(step) | hit(step - 1) | hit(step + 1)
    return ranked.filter((size <= quota) | wanted).drop("_r")


def thin(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """Every n-th row in order, n = rows div limit, at most ``limit`` rows."""
    _require_positive(limit)
    total = df.count()
    if total <= limit:
        return df
    stride = max(1, total // limit)
    ranked = global_rank(df, [], order, "_r")
    kept = (F.pmod(F.col("_r") - 1, F.lit(stride)) == 0) & ((F.col("_r") - 1) / stride < limit)
    return ranked.filter(kept).drop("_r")
