"""Segment x month (x shift) aggregates, dense panels and their audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tramorisk.functions.calendar import SHIFTS, Calendar
from tramorisk.session import spread

CATEGORIES = ("robo", "hurto", "extorsion", "homicidio")
CUBE_MEASURES = ("n", "peso", "grave", *CATEGORIES)
# Measures of the monthly panel in their published order.
MONTHLY_MEASURES = ("frecuencia", "suma_pesos", "graves", "hurtos", "robos", "extorsiones", "homicidios",
                    "manana", "tarde", "noche", "madrugada")
_PLURAL = {"hurtos": "hurto", "robos": "robo", "extorsiones": "extorsion", "homicidios": "homicidio"}


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def shift_cube(incidents: DataFrame) -> DataFrame:
    """Seven measures per segment, month and shift; absent cells mean zero."""
    return incidents.groupBy("tramo_id", "mes_idx", "turno_idx").agg(
        F.count(F.lit(1)).alias("n"), F.sum("peso").cast("double").alias("peso"), F.sum("grave").alias("grave"),
        *[count_where(F.col("categoria") == c).alias(c) for c in CATEGORIES])


def months_from_cube(cube: DataFrame) -> DataFrame:
    """Roll shifts up to months, keeping the four shift counts as columns."""
    return cube.groupBy("tramo_id", "mes_idx").agg(
        *[F.sum(m).alias(m) for m in CUBE_MEASURES],
        *[F.sum(F.when(F.col("turno_idx") == i, F.col("n")).otherwise(0)).alias(s) for i, s in enumerate(SHIFTS)])


def monthly_panel_measures(weight: Column, decay: Column | None = None, times: Column | None = None) -> list[Column]:
    """Eleven monthly measures over rows standing for ``times`` incidents."""
    times = F.lit(1) if times is None else times
    heavy = weight * times if decay is None else weight * times * decay
    out = [F.sum(times).cast("long").alias("frecuencia"), F.sum(heavy).cast("double").alias("suma_pesos"),
           F.sum(F.col("grave") * times).cast("long").alias("graves")]
    for name in MONTHLY_MEASURES[3:7]:
        out.append(F.sum(F.when(F.col("categoria") == _PLURAL[name], times).otherwise(0)).cast("long").alias(name))
    for name in MONTHLY_MEASURES[7:]:
        out.append(F.sum(F.when(F.col("turno_idx") == SHIFTS.index(name), times).otherwise(0)).cast("long").alias(name))
    return out


def dense(sparse: DataFrame, segments: DataFrame, calendar: Calendar, shifts: bool = False,
          keep: Sequence[str] = ("longitud_m",), measures: Sequence[str] | None = None) -> DataFrame:
    """Every segment x month (x shift) cell, zero where nothing happened.

    ``sparse`` has at most one row for each cell. The cells of a segment travel
    as one row (months x shifts entries at most), meet the segment in one join by
    its key and are laid out inside the row, so nothing above the explode moves.
    """
    keys = ["tramo_id", "mes_idx"] + (["turno_idx"] if shifts else [])
    measures = list(measures or [c for c in sparse.columns if c not in keys])
    each = len(SHIFTS) if shifts else 1
    place = F.col("mes_idx").cast("int") * each + (F.col("turno_idx").cast("int") if shifts else F.lit(0))
    inside = sparse.filter(F.col("mes_idx").between(0, calendar.size - 1) & (F.col("turno_idx").between(0, each - 1) if shifts else F.lit(True)))
    packed = inside.groupBy("tramo_id").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("i"), F.struct(*measures).alias("v")))).alias("_celdas"))
    rows = spread(segments.select("tramo_id", *keep), "tramo_id").join(packed, "tramo_id", "left")
    # Looked up before the explode, so that the exploded rows do not carry the map.
    cells = F.transform(F.sequence(F.lit(0), F.lit(calendar.size * each - 1)), lambda i: F.struct(i.alias("i"), F.try_element_at("_celdas", i).alias("v")))
    grid = rows.select("tramo_id", *keep, F.explode(cells).alias("_c"))
    where = [F.floor(F.col("_c.i") / each).cast("int").alias("mes_idx")] + ([(F.col("_c.i") % each).alias("turno_idx")] if shifts else [])
    return grid.select("tramo_id", *keep, *where, *[F.col("_c.v")[m].alias(m) for m in measures]).fillna(0, measures)


def coverage(incidents: DataFrame, located: str = "geo") -> DataFrame:
    """Total, located and share located of every month."""
    return incidents.groupBy("periodo").agg(
        F.count(F.lit(1)).alias("total"), count_where(F.col(located)).alias("geolocalizados")).withColumn(
        "cobertura", F.round(F.col("geolocalizados") / F.col("total"), 6))


def observed_months(coverage_by_month: DataFrame, calendar: Calendar, minimum: float = 0.8) -> DataFrame:
    """Month dimension with coverage (0 if absent) and the observed flag."""
    spark = coverage_by_month.sparkSession
    months = calendar.months(spark).join(coverage_by_month.select("periodo", "cobertura"), "periodo", "left")
    return months.withColumn("cobertura", F.coalesce("cobertura", F.lit(0.0))).withColumn(
        "observado", F.col("cobertura") >= minimum)


def eligible_months(months: DataFrame, history: int, minimum: float,
                    bounds: dict[str, tuple[str, str]]) -> DataFrame:
    """Target months whose own and preceding coverage suffices, by split.

    ``months`` is the calendar dimension: a few hundred rows at most.
    """
    lookback = W.orderBy("mes_idx").rowsBetween(-history, 0)
    split = F.lit(None).cast("string")
    for name, (first, last) in bounds.items():
        split = F.when(F.col("periodo").between(first, last), F.lit(name)).otherwise(split)
    return (months.withColumn("_min", F.min("cobertura").over(lookback))
            .filter((F.col("mes_idx") >= history) & (F.col("_min") >= minimum))
            .withColumn("particion", split).filter(F.col("particion").isNotNull())
            .select("mes_idx", "periodo", "particion"))


def require_splits(eligible: DataFrame, names: Sequence[str]) -> dict[str, list[int]]:
    """Month lists per split; an empty split is an error."""
    found: dict[str, list[int]] = {name: [] for name in names}
    for row in eligible.orderBy("mes_idx").collect():
        found[row["particion"]].append(row["mes_idx"])
    for name, months in found.items():
        if not months:
            raise ValueError(f"no eligible month for {name}; review coverage and cuts")
    return found


def require_order(*stages: Sequence[int]) -> None:
    """Stages must follow each other without overlap."""
    for earlier, later in zip(stages, stages[1:]):
        if max(earlier) >= min(later):
            raise ValueError("stages must be chronological and disjoint")


def require_coverage(months: DataFrame, targets: Sequence[int], minimum: float) -> None:
    poor = months.filter(F.col("mes_idx").isin(*targets) & (F.col("cobertura") < minimum)).limit(1).count()
    if poor:
        raise ValueError("an evaluated month lacks the minimum coverage")


def complete_months(incidents: DataFrame) -> DataFrame:
    """Months with records up to their last calendar day."""
    last = incidents.groupBy("periodo").agg(F.max("fecha").alias("fecha_maxima"))
    return last.withColumn("completo", F.to_date("fecha_maxima") == F.last_day("fecha_maxima"))


def continuous_months(incidents: DataFrame) -> tuple[list[str], list[str]]:
    """Complete and excluded months; a gap among the complete ones is an error."""
    rows = complete_months(incidents).orderBy("periodo").collect()
    complete = [r["periodo"] for r in rows if r["completo"]]
    excluded = [r["periodo"] for r in rows if not r["completo"]]
    if complete and Calendar(complete[0], complete[-1]).periods() != complete:
        raise ValueError("the complete months do not form a continuous series")
    return complete, excluded


def source_audit(incidents: DataFrame) -> DataFrame:
    """Per month: rows, distinct places and districts, mean severity, last date."""
    return incidents.groupBy("periodo").agg(
        F.count(F.lit(1)).alias("delitos"),
        F.countDistinct("latitud", "longitud").alias("coordenadas_distintas"),
        F.countDistinct("distrito").alias("distritos"),
        F.avg("peso").alias("peso_medio"), F.max("fecha").alias("max_fecha"))


def spatial_coverage(pairs: DataFrame, incidents: DataFrame, n_segments: int) -> DataFrame:
    """Incidents, pairs and share of segments with signal per month.

    ``pairs`` is the monthly panel of touched cells, so each segment counts once.
    """
    touched = pairs.groupBy("mes_idx").agg(F.sum("frecuencia").alias("pares"), F.count(F.lit(1)).alias("tramos_con_senal"))
    total = incidents.groupBy("mes_idx").agg(F.count(F.lit(1)).alias("delitos"))
    return total.join(touched, "mes_idx", "left").select(
        "mes_idx", "delitos", F.coalesce("pares", F.lit(0)).cast("long").alias("pares"),
        F.coalesce("tramos_con_senal", F.lit(0)).alias("tramos_con_senal"),
        F.round(F.coalesce("tramos_con_senal", F.lit(0)) / float(n_segments) * 100, 4).alias("porcentaje"))


def reconcile(monthly: DataFrame, cube: DataFrame) -> DataFrame:
    """Months where the shift roll-up differs from the monthly panel."""
    rolled = months_from_cube(cube).select("tramo_id", "mes_idx", F.col("n").alias("n_turnos"), F.col("peso").alias("peso_turnos"))
    both = monthly.select("tramo_id", "mes_idx", "n", "peso").join(rolled, ["tramo_id", "mes_idx"], "full")
    return both.groupBy("mes_idx").agg(
        F.max(F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("n_turnos", F.lit(0)))).alias("max_dif_conteo"),
        F.round(F.max(F.abs(F.coalesce("peso", F.lit(0.0)) - F.coalesce("peso_turnos", F.lit(0.0)))), 6).alias("max_dif_peso"))


def not_contained(inner: DataFrame, outer: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Count cells and violations of ``inner <= outer`` per month."""
    pair = inner.select(*keys, F.col(measure).alias("_i")).join(outer.select(*keys, F.col(measure).alias("_o")), keys, "left")
    return pair.groupBy("mes_idx").agg(
        F.count(F.lit(1)).alias("celdas"), count_where(F.col("_i") > F.coalesce("_o", F.lit(0))).alias("violaciones"))


def replace_shift_counts(monthly: DataFrame, cube: DataFrame) -> DataFrame:
    """Monthly panel whose four shift counts come from clock hours."""
    counts = cube.groupBy("tramo_id", "mes_idx").agg(
        *[F.sum(F.when(F.col("turno_idx") == i, F.col("n")).otherwise(0)).alias(f"_{s}") for i, s in enumerate(SHIFTS)])
    joined = monthly.join(counts, ["tramo_id", "mes_idx"], "left")
    return joined.select(*[F.coalesce(f"_{c}", F.lit(0)).alias(c) if c in SHIFTS else F.col(c) for c in monthly.columns])
