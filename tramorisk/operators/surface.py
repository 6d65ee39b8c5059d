"""Hotspots, the risk field they cast, coloured zones and heat grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tramorisk.functions import geo
from tramorisk.functions.risk import level, safe_cost, field_cost
from tramorisk.operators.ordered import exact_quantiles, quantile_values, salted_join
from tramorisk.operators.spatial import near_points, point_cells, polyline_cells
from tramorisk.session import spread, written

# Fixed values of the shared field.
SAMPLE_STEP_M, ROAD_STEP_M = 20.0, 10.0
CELL_M, RADIUS_M, SEPARATION_M = 100.0, 250.0, 450.0
MIN_SCORE, FLOOR, OPACITY, MIN_INFLUENCE, KERNEL = 0.66, 0.6, 2.0, 0.025, 4.5
RED_SCORE, ORANGE_SCORE, CLEARANCE_M = 0.80, 0.66, 20.0
BROADCAST_RINGS = 500_000


def road_samples(segments: DataFrame, step_m: float = SAMPLE_STEP_M, keep: tuple[str, ...] = ()) -> DataFrame:
    """Evenly spaced points of each polyline; ``metros`` is the share of each."""
    sized = spread(segments, "tramo_id").select("tramo_id", *keep, "piezas", geo.polyline_length(F.col("piezas")).alias("largo_m"))
    n = F.greatest(F.lit(1), F.ceil(F.col("largo_m") / step_m)).cast("int")
    cut = sized.withColumn("_n", n).withColumn("muestra", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = geo.point_along(F.col("piezas"), (F.col("muestra") + 0.5) / F.col("_n"))
    return cut.withColumn("_p", at).select("tramo_id", *keep, "muestra", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"),
                                              (F.col("largo_m") / F.col("_n")).alias("metros"))


def cell_peaks(samples: DataFrame, score: str = "riesgo_score", minimum: float = MIN_SCORE) -> DataFrame:
    """Highest score per 100 m cell among samples above the minimum."""
    cells = samples.filter(F.col(score) >= minimum).groupBy(
        F.floor(F.col("x") / CELL_M).alias("cx"), F.floor(F.col("y") / CELL_M).alias("cy")).agg(F.max(score).alias("pico"))
    return cells.select("cx", "cy", ((F.col("cx") + 0.5) * CELL_M).alias("x"), ((F.col("cy") + 0.5) * CELL_M).alias("y"), "pico")


def separated_peaks(peaks: DataFrame, separation: float = SEPARATION_M) -> DataFrame:
    """Greedy choice by (-peak, cx, cy) with a minimum separation.

    Each round keeps the cells that beat every open cell nearby and drops
    their neighbours; the outcome equals the one-by-one choice. A cell has a
    bounded number of neighbours, as cells lie on a 100 m grid. The cells are
    written first, so their scores are computed once and not in every round.
    """
    peaks = written(peaks)
    near = near_points(peaks.select("cx", "cy", "x", "y", "pico"),
                       peaks.select(F.col("cx").alias("ncx"), F.col("cy").alias("ncy"), F.col("pico").alias("npico"), "x", "y"), separation)
    near = near.filter((F.col("dist_m") < separation) & ((F.col("cx") != F.col("ncx")) | (F.col("cy") != F.col("ncy"))))
    better = F.struct(-F.col("npico"), "ncx", "ncy") < F.struct(-F.col("pico"), "cx", "cy")
    links = written(near.select("cx", "cy", "ncx", "ncy", better.alias("_mejor")))
    state = peaks.select("cx", "cy", F.lit("abierta").alias("estado"))
    while True:
        open_ = state.filter("estado = 'abierta'").select("cx", "cy")
        live = links.join(open_, ["cx", "cy"], "left_semi").join(open_.select(F.col("cx").alias("ncx"), F.col("cy").alias("ncy")), ["ncx", "ncy"], "left_semi")
        beaten = live.filter("_mejor").select("cx", "cy").distinct()
        winners = written(open_.join(beaten, ["cx", "cy"], "left_anti"))
        losers = live.join(winners, ["cx", "cy"], "left_semi").select(F.col("ncx").alias("cx"), F.col("ncy").alias("cy")).distinct()
        marks = winners.withColumn("_m", F.lit("elegida")).unionByName(losers.withColumn("_m", F.lit("descartada")))
        state = written(state.join(marks, ["cx", "cy"], "left").select("cx", "cy", F.coalesce("_m", "estado").alias("estado")))
        if state.filter("estado = 'abierta'").limit(1).count() == 0:
            break
    return peaks.join(state.filter("estado = 'elegida'").select("cx", "cy"), ["cx", "cy"], "left_semi")


def strength(score: Column) -> Column:
    base = F.least(F.greatest((score - FLOOR) / (1 - FLOOR), F.lit(0.0)), F.lit(1.0))
    return base * base


def field_at(points: DataFrame, hotspots: DataFrame, keys: list[str]) -> DataFrame:
    """Field score of each point: the strongest influence wins, ties to the larger score.

    ``points``: keys, x, y. ``hotspots``: x, y, pico. Hotspots are fewer, so
    they take the ring of cells and points stay in their own. Sizes are
    counted: planners guess samples by the files of their segments and would
    broadcast them.
    """
    few = hotspots.select("x", "y", "pico")
    hint = "broadcast" if few.count() * 9 <= BROADCAST_RINGS else "merge"
    near = near_points(few, points.select(*keys, "x", "y"), RADIUS_M, hint)
    kernel = F.exp(F.col("dist_m") * F.col("dist_m") * (-KERNEL / (RADIUS_M * RADIUS_M)))
    seen = near.withColumn("_i", strength(F.col("pico")) * kernel).filter(F.col("_i") > MIN_INFLUENCE)
    best = seen.groupBy(*keys).agg(F.max(F.struct("_i", (F.col("pico") * F.sqrt(kernel)).alias("_s"))).alias("_m"))
    out = points.select(*keys).join(best, keys, "left")
    return out.select(*keys, F.coalesce("_m._s", F.lit(0.0)).alias("campo"), F.coalesce("_m._i", F.lit(0.0)).alias("influencia"))


def zones(hotspots: DataFrame) -> DataFrame:
    """Red and orange discs of each hotspot with their clearance radius."""
    power = F.col("_fuerza")
    visible = F.sqrt(F.log(power / MIN_INFLUENCE) / KERNEL) * RADIUS_M
    base = hotspots.withColumn("_fuerza", strength(F.col("pico"))).filter(power > MIN_INFLUENCE).withColumn("radio_visible", visible)
    cut = F.explode(F.array(F.struct(F.lit("rojo").alias("color"), F.lit(RED_SCORE).alias("corte")),
                            F.struct(F.lit("naranja").alias("color"), F.lit(ORANGE_SCORE).alias("corte"))))
    rows = base.withColumn("_z", cut).filter(F.col("pico") > F.col("_z.corte"))
    own = F.sqrt(F.log(F.col("pico") / F.col("_z.corte")) * 2.0 / KERNEL) * RADIUS_M
    return rows.select(F.concat_ws(":", "_z.color", "cx", "cy").alias("zona"), F.col("_z.color").alias("color"), "x", "y", "pico",
                       F.least(F.lit(RADIUS_M), "radio_visible", own).alias("radio")).withColumn("radio_margen", F.col("radio") + CLEARANCE_M)


def segments_in_zones(segments: DataFrame, discs: DataFrame) -> DataFrame:
    """Metres of each segment inside each disc, and the clearance touch."""
    reach = RADIUS_M + CLEARANCE_M
    lines = polyline_cells(segments.select("tramo_id", "piezas"), reach, reach)
    spots = point_cells(discs, reach)
    pairs = salted_join(spots, lines, ["_cx", "_cy"])
    inside = F.aggregate(F.transform("piezas", lambda p: geo.chord_m(p, F.col("x"), F.col("y"), F.col("radio"))), F.lit(0.0), lambda a, v: a + v)
    pairs = pairs.withColumn("metros", inside).withColumn("dist_m", geo.distance_to_polyline(F.col("x"), F.col("y"), F.col("piezas")))
    return pairs.filter(F.col("dist_m") <= F.col("radio_margen")).select("tramo_id", "zona", "color", "metros", "dist_m")


def zone_metres(hits: DataFrame) -> DataFrame:
    """Red metres and orange metres net of red per segment.

    Discs of one colour are disjoint, as radii stay below half the separation,
    and each red disc lies inside its orange one.
    """
    red = F.sum(F.when(F.col("color") == "rojo", F.col("metros")).otherwise(0.0))
    orange = F.sum(F.when(F.col("color") == "naranja", F.col("metros")).otherwise(0.0))
    ids = lambda c, cond: F.array_sort(F.collect_set(F.when((F.col("color") == c) & cond, F.col("zona"))))
    real = F.col("metros") > 0.001
    return hits.groupBy("tramo_id").agg(
        red.alias("rojo_m"), F.greatest(orange - red, F.lit(0.0)).alias("naranja_m"),
        ids("rojo", real).alias("zonas_rojo"), ids("naranja", real).alias("zonas_naranja"),
        ids("rojo", F.lit(True)).alias("zonas_rojo_margen"), ids("naranja", F.lit(True)).alias("zonas_naranja_margen"))


def road_field(segments: DataFrame, hotspots: DataFrame, step_m: float = ROAD_STEP_M) -> DataFrame:
    """Mean and peak of the field along each segment."""
    samples = road_samples(segments, step_m)
    scored = field_at(samples, hotspots, ["tramo_id", "muestra"])
    return scored.groupBy("tramo_id").agg(F.avg("campo").alias("campo_medio"), F.max("campo").alias("campo_pico"))


def exempt_zones(ends: DataFrame, discs: DataFrame) -> DataFrame:
    """Zones that contain an end point of a request: ruta, zona, color."""
    near = near_points(ends.select("ruta", "x", "y"), discs.select("zona", "color", "radio", "x", "y"), RADIUS_M)
    return near.filter(F.col("dist_m") <= F.col("radio")).select("ruta", "zona", "color").distinct()


def edge_field(segments: DataFrame, field: DataFrame, metres: DataFrame) -> DataFrame:
    """Per-edge attributes scaled from projected to catalogued length."""
    none = F.array().cast("array<string>")
    full = segments.join(field, "tramo_id", "left").join(metres, "tramo_id", "left")
    scale = F.col("longitud_m") / F.greatest(geo.polyline_length(F.col("piezas")), F.lit(1e-9))
    red, orange = F.coalesce("rojo_m", F.lit(0.0)), F.coalesce("naranja_m", F.lit(0.0))
    out = full.select(
        "tramo_id", "u", "v", F.col("longitud_m").alias("largo"), F.coalesce("campo_medio", F.lit(0.0)).alias("riesgo"),
        F.coalesce("campo_pico", F.lit(0.0)).alias("campo_pico"), (red * scale).alias("rojo_m"), (orange * scale).alias("naranja_m"),
        F.when(red > 0, "alto").otherwise(level(F.coalesce("campo_pico", F.lit(0.0)))).alias("nivel"),
        *[F.coalesce(c, none).alias(c) for c in ("zonas_rojo", "zonas_naranja", "zonas_rojo_margen", "zonas_naranja_margen")])
    return out.withColumn("costo_exposicion", F.col("largo") * (F.col("riesgo") + 1e-6)).withColumn(
        "costo_foco", field_cost(F.col("largo"), F.col("riesgo"), F.col("rojo_m"), F.col("naranja_m"), 10.0)).withColumn(
        "costo_seguro", safe_cost(F.col("largo"), F.col("riesgo"), 10.0))


def viewport_summary(samples: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Segments and metres per level inside a viewport.

    ``samples``: tramo_id, lat, lon, metros, nivel (NULL without forecast).
    """
    seen = samples.filter(F.col("nivel").isNotNull() & F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return seen.groupBy("nivel").agg(F.countDistinct("tramo_id").alias("tramos"), F.round(F.sum("metros"), 2).alias("metros"))


def visible_hotspots(hotspots: DataFrame, south: float, west: float, north: float, east: float, project=geo.local_xy) -> DataFrame:
    """Hotspots inside the viewport widened by one radius and one cell."""
    xs = [project(F.lit(lon), F.lit(lat)) for lon in (west, east) for lat in (south, north)]
    pad = RADIUS_M + CELL_M
    lo_x, hi_x = F.least(*[p[0] for p in xs]) - pad, F.greatest(*[p[0] for p in xs]) + pad
    lo_y, hi_y = F.least(*[p[1] for p in xs]) - pad, F.greatest(*[p[1] for p in xs]) + pad
    return hotspots.filter(F.col("x").between(lo_x, hi_x) & F.col("y").between(lo_y, hi_y))


def raster(hotspots: DataFrame, cell_m: float = 50.0) -> DataFrame:
    """Field on a pixel grid around the hotspots, with its opacity.

    Only pixels within reach of a hotspot exist; the strongest influence wins.
    """
    span = int(math.ceil(RADIUS_M / cell_m)) + 1
    step = F.sequence(F.lit(-span), F.lit(span))
    cells = (hotspots.withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step))
             .withColumn("px", (F.floor(F.col("x") / cell_m) + F.col("_i")).cast("long"))
             .withColumn("py", (F.floor(F.col("y") / cell_m) + F.col("_j")).cast("long")))
    dx, dy = (F.col("px") + 0.5) * cell_m - F.col("x"), (F.col("py") + 0.5) * cell_m - F.col("y")
    d2 = dx * dx + dy * dy
    kernel = F.exp(d2 * (-KERNEL / (RADIUS_M * RADIUS_M)))
    lit = cells.filter(d2 <= RADIUS_M * RADIUS_M).select(
        "px", "py", (strength(F.col("pico")) * kernel).alias("_i"), (F.col("pico") * F.sqrt(kernel)).alias("_s"))
    best = lit.groupBy("px", "py").agg(F.max(F.struct("_i", "_s")).alias("_m")).filter(F.col("_m._i") > MIN_INFLUENCE)
    fade = F.least(F.lit(1.0), (F.col("_m._i") - MIN_INFLUENCE) / 0.065)
    return best.select("px", "py", F.col("_m._s").alias("campo"), F.col("_m._i").alias("influencia"),
                       F.round(F.sqrt("_m._i") * fade * 255 * 0.76).cast("int").alias("alfa"))


# ---------------------------------------------------------------- heat grids

def history_grid(incidents: DataFrame, cell_m: float = 100.0, latitude: float = geo.REFERENCE_LATITUDE) -> DataFrame:
    """Severity per cell scaled by its 90th percentile and cut to [0, 1]."""
    cell_m = max(cell_m, 40.0)
    x, y = geo.local_xy(F.col("longitud"), F.col("latitud"), latitude)
    cells = incidents.groupBy(F.floor(x / cell_m).alias("cx"), F.floor(y / cell_m).alias("cy")).agg(
        F.count(F.lit(1)).alias("total"), F.sum("peso").cast("double").alias("suma"))
    p90 = max(quantile_values(cells, "suma", [0.9])[0] or 0.0, 1e-9)
    return _centred(cells, cell_m, latitude).withColumn(
        "intensidad", F.least(F.greatest(F.col("suma") / p90, F.lit(0.0)), F.lit(1.0)))


def _centred(cells: DataFrame, cell_m: float, latitude: float) -> DataFrame:
    lon_m = geo.METERS_PER_DEGREE * math.cos(math.radians(latitude))
    return cells.withColumn("lat", (F.col("cy") + 0.5) * cell_m / geo.METERS_PER_DEGREE).withColumn(
        "lon", (F.col("cx") + 0.5) * cell_m / lon_m)


def forecast_grid(points: DataFrame, cell_m: float = 800.0, minimum: float = 0.66, latitude: float = geo.REFERENCE_LATITUDE) -> DataFrame:
    """Concentrated forecast cells at or above their 60th percentile."""
    x, y = geo.local_xy(F.col("longitud"), F.col("latitud"), latitude)
    cells = points.filter(F.col("riesgo_score") >= minimum).groupBy(F.floor(x / cell_m).alias("cx"), F.floor(y / cell_m).alias("cy")).agg(
        F.avg("riesgo_score").alias("_m"), F.max("riesgo_score").alias("_x"), F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("bruto", (F.col("_m") * 0.65 + F.col("_x") * 0.35) * F.log1p("n")).drop("_m", "_x")
    p60, p95 = quantile_values(cells, "bruto", [0.6, 0.95])
    if p60 is None:
        return _centred(cells, cell_m, latitude).withColumn("intensidad", F.col("bruto"))
    kept = _centred(cells, cell_m, latitude).filter(F.col("bruto") >= p60)
    return kept.withColumn("intensidad", F.least(F.greatest(F.col("bruto") / max(p95, 1e-9), F.lit(0.08)), F.lit(1.0)))


def level_counts(points: DataFrame, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Points per level, absent levels as 0."""
    if bounds:
        south, west, north, east = bounds
        points = points.filter(F.col("latitud").between(south, north) & F.col("longitud").between(west, east))
    agg = points.agg(*[F.count(F.when(F.col("nivel") == n, 1)).alias(n) for n in ("bajo", "medio", "alto")])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(n).alias("nivel"), F.col(n).alias("n")) for n in ("bajo", "medio", "alto")])).alias("_r")).select("_r.*")


def score_quantiles(points: DataFrame, probs: list[float]) -> DataFrame:
    return exact_quantiles(points, [], "riesgo_score", probs)


