"""Forecast tables: writing by shift, loading with repairs, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tramorisk.functions.calendar import SHIFTS, shift_name
from tramorisk.functions.risk import level, risk_score


def wide_forecast(scored: DataFrame) -> DataFrame:
    """One row per segment: mean score, its level and four shift columns.

    ``scored``: tramo_id, turno_idx, p1, p2, clase (0-2 by the cutoffs).
    """
    rows = scored.withColumn("_s", risk_score(F.col("p1"), F.col("p2"))).withColumn("_t", shift_name(F.col("turno_idx")))
    name = F.element_at(F.array(F.lit("bajo"), F.lit("medio"), F.lit("alto")), F.col("clase") + 1)
    wide = rows.withColumn("_n", name).groupBy("tramo_id").agg(
        F.avg("_s").alias("riesgo_score"),
        *[F.max(F.when(F.col("_t") == s, F.col("_s"))).alias(f"riesgo_score_{s}") for s in SHIFTS],
        *[F.max(F.when(F.col("_t") == s, F.col("_n"))).alias(f"nivel_riesgo_{s}") for s in SHIFTS])
    return wide.withColumn("nivel_riesgo", level(F.col("riesgo_score")))


def repaired_forecast(raw: DataFrame) -> DataFrame:
    """Loaded forecasts: scores cut to [0, 1], levels filled, bad rows dropped."""
    def cut(name: str) -> Column:
        value = F.trim(F.col(name).cast("string")).try_cast("double")
        return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))

    out = raw.withColumn("riesgo_score", cut("riesgo_score"))
    for c in ("latitud", "longitud"):
        out = out.withColumn(c, F.trim(F.col(c).cast("string")).try_cast("double"))
    out = out.filter("riesgo_score IS NOT NULL AND latitud IS NOT NULL AND longitud IS NOT NULL")
    own = F.when(F.coalesce("nivel_riesgo", F.lit("")) != "", F.col("nivel_riesgo"))
    out = out.withColumn("nivel_riesgo", F.coalesce(own, level(F.col("riesgo_score"))))
    for s in SHIFTS:
        if f"riesgo_score_{s}" in raw.columns:
            out = out.withColumn(f"riesgo_score_{s}", F.coalesce(cut(f"riesgo_score_{s}"), F.col("riesgo_score")))
            known = F.col(f"nivel_riesgo_{s}") if f"nivel_riesgo_{s}" in raw.columns else F.lit(None).cast("string")
            out = out.withColumn(f"nivel_riesgo_{s}", F.coalesce(F.when(known != "", known), level(F.col(f"riesgo_score_{s}"))))
    return out


def by_shift(wide: DataFrame) -> DataFrame:
    """Long view ``tramo_id, turno, score, nivel`` of a wide forecast."""
    rows = F.array(*[F.struct(F.lit(s).alias("turno"), F.col(f"riesgo_score_{s}").alias("score"), F.col(f"nivel_riesgo_{s}").alias("nivel")) for s in SHIFTS])
    return wide.select("tramo_id", F.explode(rows).alias("_r")).select("tramo_id", "_r.*")


def lookup(monthly: DataFrame, shifts: DataFrame, strict: bool = False) -> DataFrame:
    """Score of every segment and shift: its own, else the monthly one."""
    grid = monthly.withColumn("turno_idx", F.explode(F.sequence(F.lit(0), F.lit(len(SHIFTS) - 1))))
    both = grid.join(shifts.select("tramo_id", "turno_idx", F.col("score").alias("_t")), ["tramo_id", "turno_idx"], "left")
    score = F.coalesce("_t", "riesgo_score")
    if strict:
        score = F.when(score.isNull(), F.raise_error(F.concat(F.lit("no forecast for segment "), "tramo_id")).cast("double")).otherwise(score)
    return both.select("tramo_id", "turno_idx", score.alias("score"), F.when(F.col("_t").isNull(), "mensual").otherwise("turno").alias("fuente"))
