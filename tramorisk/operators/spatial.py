"""Distance joins by grid cell: an equi join on the cell, then the exact distance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tramorisk.functions import geo
from tramorisk.operators.ordered import salted_join, salted_sides
from tramorisk.operators.panel import monthly_panel_measures
from tramorisk.session import settle, spread, spread_rows, written


#: Bytes of the cells of polylines that are broadcast at most.
BROADCAST_LINES = 32 << 20


def with_xy(df: DataFrame, project=geo.local_xy, lon: str = "longitud", lat: str = "latitud") -> DataFrame:
    x, y = project(F.col(lon), F.col(lat))
    return df.withColumn("x", x).withColumn("y", y)


def with_pieces(segments: DataFrame, project=geo.local_xy) -> DataFrame:
    return segments.withColumn("piezas", geo.metric_pieces(F.col("puntos"), project))


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / float(size)).cast("long")


def point_cells(df: DataFrame, size: float) -> DataFrame:
    return df.withColumn("_cx", _cell(F.col("x"), size)).withColumn("_cy", _cell(F.col("y"), size))


def ring_cells(df: DataFrame, size: float, reach: int = 1) -> DataFrame:
    """Repeat each point in its own and the surrounding cells."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    out = point_cells(df, size).withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
    return out.withColumn("_cx", F.col("_cx") + F.col("_dx")).withColumn("_cy", F.col("_cy") + F.col("_dy")).drop("_dx", "_dy")


def polyline_cells(df: DataFrame, size: float, reach: float) -> DataFrame:
    """Repeat each polyline in every cell its pieces may reach."""
    half = size * 0.7072

    def cells(p: Column) -> Column:
        low = lambda a, b: _cell(F.least(p[a], p[b]) - reach, size)
        high = lambda a, b: _cell(F.greatest(p[a], p[b]) + reach, size)
        box = F.flatten(F.transform(F.sequence(low("x1", "x2"), high("x1", "x2")), lambda i: F.transform(
            F.sequence(low("y1", "y2"), high("y1", "y2")), lambda j: F.struct(i.alias("i"), j.alias("j")))))
        near = lambda c: geo.distance_to_piece((c["i"] + 0.5) * size, (c["j"] + 0.5) * size, p) <= reach + half
        return F.filter(box, near)

    found = F.array_distinct(F.flatten(F.transform("piezas", cells)))
    return df.withColumn("_c", F.explode(found)).withColumn("_cx", F.col("_c.i")).withColumn("_cy", F.col("_c.j")).drop("_c")


def near_polylines(points: DataFrame, segments: DataFrame, radius: float, columns: Sequence[str] = ("tramo_id",)) -> DataFrame:
    """Points within ``radius`` of each polyline, with ``dist_m``; many to many.

    ``points`` carries x, y and whatever must travel; ``segments`` carries
    piezas. A point lies in one cell, so each pair appears once. Planners size the
    cells of the lines by the small files of their segments; they are measured here.
    """
    size = max(float(radius), 1.0)
    lines = polyline_cells(segments.select(*columns, "piezas"), size, float(radius))
    size_bytes = lines.agg(F.count(F.lit(1)) * 96 + F.coalesce(F.sum(F.size("piezas")), F.lit(0)) * 48).first()[0]
    pairs = salted_join(point_cells(points, size), lines, ["_cx", "_cy"], hint="broadcast" if size_bytes <= BROADCAST_LINES else "merge")
    measured = pairs.withColumn("dist_m", geo.distance_to_polyline(F.col("x"), F.col("y"), F.col("piezas")))
    return measured.filter(F.col("dist_m") <= radius).drop("_cx", "_cy", "piezas")


def snap(points: DataFrame, segments: DataFrame, cap: float) -> DataFrame:
    """Nearest polyline within ``cap`` of each distinct place (x, y)."""
    pairs = near_polylines(spread_rows(points.select("x", "y"), "x", "y").distinct(), segments, cap)
    best = pairs.groupBy("x", "y").agg(F.min(F.struct("dist_m", "tramo_id")).alias("_m"))
    return best.select("x", "y", F.col("_m.tramo_id").alias("tramo_id"), F.col("_m.dist_m").alias("dist_m"))


def snap_incidents(incidents: DataFrame, segments: DataFrame, cap: float) -> DataFrame:
    """Incidents with their segment; those beyond the cap drop out."""
    return salted_join(incidents, snap(incidents, segments, cap), ["x", "y"])


def buffer_panel(incidents: DataFrame, segments: DataFrame, radius: float, sigma: float | None = None) -> DataFrame:
    """Eleven measures per segment and month over incidents within ``radius``.

    Severity decays with distance, counts do not. Incidents of one place and
    month with equal traits travel as one row with their number.
    """
    sigma = max(radius / 2.0, 1.0) if sigma is None else sigma
    grouped = spread_rows(incidents, "x", "y", "mes_idx").groupBy("x", "y", "mes_idx", "turno_idx", "categoria", "peso", "grave").agg(F.count(F.lit(1)).alias("veces"))
    near = near_polylines(grouped, segments, radius)
    ratio = F.col("dist_m") / sigma
    return near.groupBy("tramo_id", "mes_idx").agg(
        *monthly_panel_measures(F.col("peso"), F.exp(ratio * ratio * -0.5), F.col("veces")))


def buffer_shift_panel(incidents: DataFrame, segments: DataFrame, radius: float, sigma: float = 100.0) -> DataFrame:
    """Count and decayed severity per segment, month and shift."""
    grouped = spread_rows(incidents, "x", "y", "mes_idx").groupBy("x", "y", "mes_idx", "turno_idx", "peso").agg(F.count(F.lit(1)).alias("veces"))
    near = near_polylines(grouped, segments, radius)
    ratio = F.col("dist_m") / sigma
    return near.groupBy("tramo_id", "mes_idx", "turno_idx").agg(
        F.sum("veces").alias("n"), F.sum(F.col("peso") * F.col("veces") * F.exp(ratio * ratio * -0.5)).alias("severidad"))


def near_points(queries: DataFrame, targets: DataFrame, radius: float, hint: str | None = None) -> DataFrame:
    """Pairs of points within ``radius`` with ``dist_m``.

    Both sides carry x, y; other column names must not clash. ``hint`` tells
    how the ring of cells around the queries joins.
    """
    size = max(float(radius), 1.0)
    right = point_cells(targets.withColumnRenamed("x", "_tx").withColumnRenamed("y", "_ty")
                        .withColumn("x", F.col("_tx")).withColumn("y", F.col("_ty")), size).drop("x", "y")
    pairs = salted_join(right, ring_cells(queries, size), ["_cx", "_cy"], hint=hint)
    dx, dy = F.col("x") - F.col("_tx"), F.col("y") - F.col("_ty")
    return pairs.withColumn("dist_m", F.sqrt(dx * dx + dy * dy)).filter(F.col("dist_m") <= radius).drop("_cx", "_cy", "_tx", "_ty")


def nearest_neighbors(points: DataFrame, k: int, max_m: float | None = None, start_m: float = 50.0,
                      cell_limit: int = 64) -> DataFrame:
    """The ``k`` nearest other points of each point, ranked by distance and id.

    ``points``: tramo_id, x, y. The search radius starts small, where the
    densest cell holds few distinct places, and doubles for the points that
    still lack neighbours, so dense areas settle before the circles grow.
    Points on one spot are one place that offers its first k + 1 members.
    """
    places = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_miembros"))
    radius = start_m
    while point_cells(places, radius).groupBy("_cx", "_cy").count().agg(F.max("count")).first()[0] > cell_limit and radius > 0.01:
        radius /= 2
    total = points.count()
    members = W.partitionBy("x", "y").orderBy("tramo_id")
    shares = F.pmod(F.xxhash64("tramo_id"), F.lit(64))
    split = W.partitionBy("x", "y", "_p").orderBy("tramo_id")
    few = points.withColumn("_p", shares).withColumn("_r", F.row_number().over(split)).filter(F.col("_r") <= k + 1)
    few = few.withColumn("_r", F.row_number().over(members)).filter(F.col("_r") <= k + 1)
    offered = settle(few.groupBy("x", "y").agg(F.sort_array(F.collect_list("tramo_id")).alias("_ids")))
    bounds = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    span = max(bounds[1] - bounds[0], bounds[3] - bounds[2], 1.0) * 1.5
    limit = span if max_m is None else max_m
    want = min(k, max(total - 1, 0))
    pending, done = places.select("x", "y"), None
    while True:
        radius = min(radius, limit)
        # Every place offers a member at least, so the nearest k + 1 places hold the nearest k + 1 members; the literal limit is pushed below the shuffle.
        ring = W.partitionBy("x", "y").orderBy("dist_m", F.get("_ids", F.lit(0)))
        near = near_points(pending, offered, radius).withColumn("_rn", F.row_number().over(ring)).filter(F.col("_rn") <= k + 1)
        reached = near.groupBy("x", "y").agg(
            F.sum(F.size("_ids")).alias("_n"),
            F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("_ids", lambda i: F.struct(F.col("dist_m").alias("d"), i.alias("v")))))), 1, k + 1).alias("_v"))
        last = radius >= limit
        reached = settle(reached.withColumn("_listo", F.lit(last) | (F.col("_n") >= want + 1)))
        ready = reached.filter("_listo").select("x", "y", "_v")
        done = ready if done is None else done.unionByName(ready)
        pending = reached.filter(~F.col("_listo")).select("x", "y")
        if last or pending.limit(1).count() == 0:
            break
        radius *= 2
    out = salted_join(points.select("tramo_id", "x", "y"), done, ["x", "y"])
    out = out.withColumn("_v", F.slice(F.filter("_v", lambda s: s["v"] != F.col("tramo_id")), 1, k))
    return out.select("tramo_id", F.posexplode("_v").alias("_p", "_s")).select(
        "tramo_id", F.col("_s.v").alias("vecino_id"), (F.col("_p") + 1).alias("puesto"), F.col("_s.d").alias("dist_m"))


def exponential_neighbors(points: DataFrame, k: int = 24, radius: float = 300.0, scale: float = 125.0) -> DataFrame:
    """Up to ``k`` neighbours strictly nearer than ``radius`` with exp(-d/scale)."""
    near = nearest_neighbors(points, k, radius).filter(F.col("dist_m") < radius)
    return near.withColumn("w", F.exp(-F.col("dist_m") / scale))


def nearest_by_haversine(queries: DataFrame, targets: DataFrame, key: str, cap_m: float, start_m: float = 125.0) -> DataFrame:
    """Nearest target of each query within ``cap_m`` on the sphere.

    Queries: key, lat, lon. Targets: destino, t_lat, t_lon. The reach starts
    small and doubles for the places that found nothing, so a place meets the
    targets about as far as its nearest one and not all within the cap.
    """
    pending, done, reach = written(queries.select("lat", "lon").distinct()), None, min(start_m, cap_m)
    offered = written(targets.select("destino", "t_lat", "t_lon"))
    while True:
        best = written(_within_haversine(pending, offered, reach))
        done = best if done is None else done.unionByName(best)
        if reach >= cap_m:
            break
        pending = written(salted_join(pending, best.withColumn("_hay", F.lit(True)).select("lat", "lon", "_hay"), ["lat", "lon"], "left")
                          .filter("_hay IS NULL AND lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon"))
        if pending.isEmpty():
            break
        reach = min(reach * 2, cap_m)
    return salted_join(queries, done, ["lat", "lon"], "left")


def _within_haversine(spots: DataFrame, targets: DataFrame, cap_m: float) -> DataFrame:
    """Nearest target of each spot ``lat, lon`` that has one within ``cap_m``.

    The grid is in degrees of latitude; longitude cells widen with the latitude
    band. Targets take the ring of cells, as there are fewer of them.
    """
    deg = cap_m / 110_000.0
    band = lambda c: F.floor(c / deg).cast("long")
    width = lambda b: F.lit(deg) / F.greatest(F.cos(F.radians((F.abs(b) + 2) * deg)), F.lit(0.02))
    cell = spots.withColumn("_cy", band(F.col("lat")))
    cell = cell.withColumn("_cx", F.floor(F.col("lon") / width(F.col("_cy"))).cast("long"))
    three = F.array(F.lit(-1), F.lit(0), F.lit(1))
    ring = targets.withColumn("_cy", F.explode(F.transform(three, lambda d: band(F.col("t_lat")) + d)))
    ring = ring.withColumn("_cx", F.explode(F.transform(three, lambda d: F.floor(F.col("t_lon") / width(F.col("_cy"))).cast("long") + d)))
    pairs = salted_join(cell, ring, ["_cx", "_cy"])
    pairs = pairs.withColumn("dist_m", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon")))
    best = pairs.filter(F.col("dist_m") <= cap_m).groupBy("lat", "lon").agg(F.min(F.struct("dist_m", "destino")).alias("_m"))
    return best.select("lat", "lon", F.col("_m.destino").alias("destino"), F.col("_m.dist_m").alias("dist_m"))


def light_exposure(points: DataFrame, lights: DataFrame, cap_m: float = 500.0) -> DataFrame:
    """Lights within 50 and 100 m, nearest distance capped, close flag.

    Lights on one spot travel as one row with their number.
    """
    spots = lights.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_k"))
    near = near_points(points.select("tramo_id", "x", "y"), spots, cap_m)
    seen = near.groupBy("tramo_id").agg(
        F.sum(F.when(F.col("dist_m") <= 50, F.col("_k")).otherwise(0)).alias("n50"),
        F.sum(F.when(F.col("dist_m") <= 100, F.col("_k")).otherwise(0)).alias("n100"), F.min("dist_m").alias("cerca"))
    return _light_columns(points.select("tramo_id").join(seen, "tramo_id", "left"), cap_m)


def _light_columns(df: DataFrame, cap_m: float) -> DataFrame:
    near = F.least(F.coalesce("cerca", F.lit(cap_m)), F.lit(cap_m))
    return (df.withColumn("n50", F.coalesce("n50", F.lit(0))).withColumn("n100", F.coalesce("n100", F.lit(0)))
            .withColumn("cerca_m", near).withColumn("luz_log50", F.log1p("n50")).withColumn("luz_log100", F.log1p("n100"))
            .withColumn("luz_log_dist", F.log1p("cerca_m")).withColumn("luz_30m", (F.col("cerca_m") <= 30).cast("int")).drop("cerca"))


def light_exposure_by_month(points: DataFrame, lights: DataFrame, first_month: str, n_months: int, cap_m: float = 500.0) -> DataFrame:
    """Light exposure of every month from lights in service on its first day.

    A light enters at one month and stays, so arrivals are aggregated by
    their first month and accumulated; pairs are measured once.
    """
    start = F.to_date(F.lit(first_month + "-01"))
    entry = F.ceil(F.months_between(F.trunc("servicio", "month"), start)
                   + F.when(F.dayofmonth("servicio") > 1, 1).otherwise(0)).cast("int")
    spots = lights.withColumn("mes_idx", F.greatest(entry, F.lit(0))).filter(F.col("mes_idx") < n_months).groupBy(
        "x", "y", "mes_idx").agg(F.count(F.lit(1)).alias("_k"))
    arrivals = near_points(points.select("tramo_id", "x", "y"), spots, cap_m).groupBy("tramo_id", "mes_idx").agg(
        F.sum(F.when(F.col("dist_m") <= 50, F.col("_k")).otherwise(0)).alias("a50"),
        F.sum(F.when(F.col("dist_m") <= 100, F.col("_k")).otherwise(0)).alias("a100"), F.min("dist_m").alias("ac"))
    grid = points.select("tramo_id", F.explode(F.sequence(F.lit(0), F.lit(n_months - 1))).alias("mes_idx"))
    so_far = W.partitionBy("tramo_id").orderBy("mes_idx").rowsBetween(W.unboundedPreceding, 0)
    filled = grid.join(arrivals, ["tramo_id", "mes_idx"], "left").select(
        "tramo_id", "mes_idx", F.sum(F.coalesce("a50", F.lit(0))).over(so_far).alias("n50"),
        F.sum(F.coalesce("a100", F.lit(0))).over(so_far).alias("n100"), F.min("ac").over(so_far).alias("cerca"))
    return _light_columns(filled, cap_m)


def night_lighting(lighting: DataFrame, rows: DataFrame) -> DataFrame:
    """Light columns and their night products joined to model rows."""
    names = ("luz_log50", "luz_log100", "luz_log_dist", "luz_30m")
    keys = [k for k in ("tramo_id", "mes_idx") if k in lighting.columns]
    night = F.col("turno_idx").isin(0, 3).cast("int")
    return rows.join(lighting.select(*keys, *names), keys, "left").select(
        *rows.columns, *names, *[(F.col(c) * night).alias(f"{c}_noche") for c in names])


def unique_lights(lights: DataFrame) -> DataFrame:
    """Latest record per owner and code; coded-less ones by place."""
    from tramorisk.operators.ordered import first_by, last_by

    coded = F.col("codemp").isNotNull() & F.col("codluminaria").isNotNull()
    known = last_by(lights.filter(coded), ["codemp", "codluminaria"], [F.col("fecha_corte"), F.col("lat"), F.col("lon")])
    rest = first_by(lights.filter(~coded), ["lat", "lon"], [F.col("fecha_corte")])
    return known.unionByName(rest)


def edge_samples(segments: DataFrame, fractions: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``edge``, ``longitud``, ``latitud``, ``x``, ``y``: both ends of each polyline and points at fractions of its length in degrees."""
    pieces = geo.metric_pieces(F.col("puntos"), lambda lon, lat: (lon, lat))
    ends = [F.struct(p["lon"].alias("x"), p["lat"].alias("y")) for p in (F.element_at("puntos", 1), F.element_at("puntos", -1))]
    between = [geo.point_along(pieces, F.lit(f)) for f in fractions]
    rows = segments.select(F.col("tramo_id").alias("edge"), F.explode(F.array(ends[0], *between, ends[1])).alias("p"))
    return with_xy(rows.select("edge", F.col("p.x").alias("longitud"), F.col("p.y").alias("latitud")))


def crimes_near_edges(samples: DataFrame, incidents: DataFrame, radius: float, unrolled: int = 5) -> DataFrame:
    """Distinct incidents near any sample point of an edge: number, sum, mean.

    ``samples``: edge, x, y. Incidents of one place and severity travel as one
    row. An edge travels with all its samples, once per cell they reach; a place
    lies in one cell, so an edge meets each place once and no pair is
    compared with another. The first samples are spelled out, which compiles.
    """
    size = max(float(radius), 1.0)
    places = incidents.groupBy("x", "y", "peso").agg(F.count(F.lit(1)).alias("_k"))
    known = samples.filter("x IS NOT NULL AND y IS NOT NULL")
    edges = spread(known, "edge").groupBy("edge").agg(F.collect_set(F.struct("x", "y")).alias("_p"))
    near = F.flatten(F.transform("_p", lambda p: F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(
        F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct((_cell(p["x"], size) + i).alias("i"), (_cell(p["y"], size) + j).alias("j")))))))
    cells = edges.withColumn("_c", F.explode(F.array_distinct(near))).withColumn("_cx", F.col("_c.i")).withColumn("_cy", F.col("_c.j")).drop("_c")

    def reached(p: Column) -> Column:
        dx, dy = p["x"] - F.col("x"), p["y"] - F.col("y")
        return F.coalesce(F.sqrt(dx * dx + dy * dy) <= radius, F.lit(False))

    hit = F.exists(F.slice("_p", unrolled + 1, F.greatest(F.size("_p"), F.lit(1))), reached)
    for i in reversed(range(unrolled)):
        hit = reached(F.get("_p", F.lit(i))) | hit
    hits = salted_join(point_cells(places, size), cells, ["_cx", "_cy"]).filter(hit)
    return hits.groupBy("edge").agg(F.sum("_k").alias("cantidad"), F.sum(F.col("_k") * F.col("peso")).cast("double").alias("suma_peso")).withColumn(
        "peso_medio", F.col("suma_peso") / F.col("cantidad"))


def in_viewport(segments: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Segments crossing the viewport, with their clipped metres."""
    lats, lons = F.transform("puntos", lambda p: p["lat"]), F.transform("puntos", lambda p: p["lon"])
    hit = ((F.array_max(lats) >= south) & (F.array_min(lats) <= north) & (F.array_max(lons) >= west) & (F.array_min(lons) <= east))
    pieces = F.zip_with(F.slice("puntos", 1, F.size("puntos") - 1), F.slice("puntos", 2, F.size("puntos") - 1),
                        lambda a, b: _clipped_m(a, b, south, west, north, east))
    inside = F.aggregate(pieces, F.lit(0.0), lambda acc, v: acc + v)
    return segments.filter(hit).withColumn("metros_visibles", inside).filter("metros_visibles > 0")


def _clipped_m(a: Column, b: Column, south: float, west: float, north: float, east: float) -> Column:
    """Metres of a straight piece inside a box (parametric clipping)."""
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    lo, hi = F.lit(0.0), F.lit(1.0)
    outside = F.lit(False)
    for delta, near, far in ((dx, west - a["lon"], east - a["lon"]), (dy, south - a["lat"], north - a["lat"])):
        flat = delta == 0
        step = F.when(flat, F.lit(1.0)).otherwise(delta)
        t1, t2 = near / step, far / step
        outside = outside | (flat & ((near > 0) | (far < 0)))
        lo = F.greatest(lo, F.when(flat, F.lit(0.0)).otherwise(F.least(t1, t2)))
        hi = F.least(hi, F.when(flat, F.lit(1.0)).otherwise(F.greatest(t1, t2)))
    ax, ay = geo.local_xy(a["lon"], a["lat"])
    bx, by = geo.local_xy(b["lon"], b["lat"])
    whole = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    return F.when(outside | (hi <= lo), F.lit(0.0)).otherwise((hi - lo) * whole)


def mismatched_ids(left: DataFrame, right: DataFrame, key: str = "tramo_id") -> DataFrame:
    """Identifiers present on one side only; empty when catalogues agree."""
    a, b = left.select(key), right.select(key)
    return a.exceptAll(b).withColumn("lado", F.lit("solo_izquierda")).unionByName(
        b.exceptAll(a).withColumn("lado", F.lit("solo_derecha")))


def _crossing_counts(key: str, boxes: pa.Table, places: pa.Table) -> pa.Table:
    """Incidents of one cell inside each box that crosses it; ``_lat`` and ``_lon`` tell which bounds lie in the cell."""
    if not boxes.num_rows or not places.num_rows:
        return pa.table({key: boxes.column(key).slice(0, 0), "_k": pa.array([], pa.int64())})
    col = lambda table, name: table.column(name).to_numpy()
    at, k = {"lat": col(places, "latitud"), "lon": col(places, "longitud")}, col(places, "_k")
    low, high = {"lat": col(boxes, "s"), "lon": col(boxes, "w")}, {"lat": col(boxes, "n"), "lon": col(boxes, "e")}
    first, last, sums, order = {}, {}, {}, {}
    for side in ("lat", "lon"):
        order[side] = np.argsort(at[side], kind="stable")
        line = at[side][order[side]]
        first[side] = np.searchsorted(line, low[side], "left")
        last[side] = np.maximum(np.searchsorted(line, high[side], "right"), first[side])
        sums[side] = np.concatenate([[0], np.cumsum(k[order[side]])])
    bound = {side: col(boxes, f"_{side}") for side in ("lat", "lon")}
    count = {side: sums[side][last[side]] - sums[side][first[side]] for side in ("lat", "lon")}
    found = np.where(bound["lat"], count["lat"], count["lon"])
    lon, kept = at["lon"][order["lat"]], k[order["lat"]]
    for i in np.flatnonzero(bound["lat"] & bound["lon"]):
        part = slice(first["lat"][i], last["lat"][i])
        found[i] = kept[part][(lon[part] >= low["lon"][i]) & (lon[part] <= high["lon"][i])].sum()
    found[(low["lat"] > high["lat"]) | (low["lon"] > high["lon"])] = 0
    return pa.table({key: boxes.column(key), "_k": pa.array(found, pa.int64())})


def count_in_boxes(boxes: DataFrame, incidents: DataFrame, key: str, pad: float, cell_deg: float = 0.01) -> DataFrame:
    """Incidents inside each padded box ``s, n, w, e`` (degrees).

    Incidents meet boxes through degree cells and travel as places with their
    number; cells wholly inside a box are added without their places. The places
    of a cell on an edge are sorted once for all boxes that cross it.
    """
    cell = lambda c: F.floor(c / cell_deg).cast("long")
    wide = boxes.select(key, (F.col("s") - pad).alias("s"), (F.col("n") + pad).alias("n"), (F.col("w") - pad).alias("w"), (F.col("e") + pad).alias("e"))
    grid = wide.withColumn("_cy", F.explode(F.sequence(cell(F.col("s")), cell(F.col("n"))))).withColumn(
        "_cx", F.explode(F.sequence(cell(F.col("w")), cell(F.col("e")))))
    whole = ((F.col("_cy") > cell(F.col("s"))) & (F.col("_cy") < cell(F.col("n"))) & (F.col("_cx") > cell(F.col("w"))) & (F.col("_cx") < cell(F.col("e"))))
    places = incidents.filter("latitud IS NOT NULL AND longitud IS NOT NULL").groupBy("latitud", "longitud").agg(F.count(F.lit(1)).alias("_k")).withColumn("_cy", cell(F.col("latitud"))).withColumn("_cx", cell(F.col("longitud")))
    cells = places.groupBy("_cx", "_cy").agg(F.sum("_k").alias("_k"))
    full = grid.filter(whole).join(cells, ["_cx", "_cy"]).select(key, "_k")
    spots, crossing = salted_sides(places, grid.filter(~whole), ["_cx", "_cy"])
    rows = crossing.withColumn("_lat", F.col("_cy").isin(cell(F.col("s")), cell(F.col("n")))).withColumn("_lon", F.col("_cx").isin(cell(F.col("w")), cell(F.col("e"))))
    at = ("_cx", "_cy", "_share")
    edge = rows.groupBy(*at).cogroup(spots.groupBy(*at)).applyInArrow(partial(_crossing_counts, key), T.StructType([boxes.schema[key], T.StructField("_k", T.LongType())]))
    hits = full.unionByName(edge).groupBy(key).agg(F.sum("_k").alias("delitos"))
    return boxes.select(key).join(hits, key, "left").fillna(0, ["delitos"])
