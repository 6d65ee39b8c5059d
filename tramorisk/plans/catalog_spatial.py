"""Spatial joins, imputation, lights, hotspots and the risk field."""

from pyspark.sql import functions as F

from tramorisk.functions import geo, risk
from tramorisk.operators import impute, panel, spatial, surface
from tramorisk.plans.oracle import (FORECAST, INC, KX, KY, LIGHTS, PIECES, SEG, haversine, lat, level, lon, piece_distance)
from tramorisk.plans.registry import query
from tramorisk.session import written


_XY = f"pto AS (SELECT *, longitud * {KX} AS x, latitud * {KY} AS y FROM inc WHERE geo)"
_GEO = f"{INC}, {SEG}, {PIECES}, {_XY}"
_PLACES = f"loc AS (SELECT DISTINCT x, y FROM pto)"
_NEAR = f"""{_PLACES}, par AS (SELECT loc.x, loc.y, p.tramo_id, min({piece_distance('loc.x', 'loc.y')}) AS dist_m FROM loc JOIN pieces p
 ON loc.x BETWEEN least(p.x1, p.x2) - {{r}} AND greatest(p.x1, p.x2) + {{r}} AND loc.y BETWEEN least(p.y1, p.y2) - {{r}} AND greatest(p.y1, p.y2) + {{r}}
 GROUP BY loc.x, loc.y, p.tramo_id HAVING min({piece_distance('loc.x', 'loc.y')}) <= {{r}})"""


def _near(r: float) -> str:
    return _NEAR.format(r=r)


@query("J03_buffer_pairs", "mes_idx:l pares:l suma_m:d3", f"""
WITH {_GEO}, {_near(150)} SELECT mes_idx, count(*) AS pares, sum(dist_m) AS suma_m FROM pto JOIN par USING (x, y) GROUP BY mes_idx""")
def _(t):
    grouped = t.placed().groupBy("x", "y", "mes_idx").agg(F.count(F.lit(1)).alias("k"))
    near = spatial.near_polylines(grouped, t.lines(), 150.0)
    return near.groupBy("mes_idx").agg(F.sum("k").alias("pares"), F.sum(F.col("k") * F.col("dist_m")).alias("suma_m"))


@query("J04_snap_nearest", "fila:s tramo_id:s dist_m:d4", f"""
WITH {_GEO}, {_near(60)}, m AS (SELECT x, y, tramo_id, dist_m FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY dist_m, tramo_id) AS rn FROM par) WHERE rn = 1)
SELECT fila, m.tramo_id, dist_m FROM pto JOIN m USING (x, y)""")
def _(t):
    return spatial.snap_incidents(t.placed().drop("tramo_id"), t.lines(), 60.0)


@query("A03_buffer_panel", "tramo_id:s mes_idx:l frecuencia:l suma_pesos:d5 graves:l hurtos:l robos:l extorsiones:l homicidios:l manana:l tarde:l noche:l madrugada:l", f"""
WITH {_GEO}, {_near(100)} SELECT par.tramo_id, mes_idx, count(*) AS frecuencia, sum(peso * exp(-0.5::DOUBLE * pow(dist_m / 50.0::DOUBLE, 2))) AS suma_pesos, sum(grave) AS graves, count(*) FILTER (categoria = 'hurto') AS hurtos,
 count(*) FILTER (categoria = 'robo') AS robos, count(*) FILTER (categoria = 'extorsion') AS extorsiones, count(*) FILTER (categoria = 'homicidio') AS homicidios, count(*) FILTER (turno_idx = 1) AS manana,
 count(*) FILTER (turno_idx = 2) AS tarde, count(*) FILTER (turno_idx = 3) AS noche, count(*) FILTER (turno_idx = 0) AS madrugada FROM pto JOIN par USING (x, y) GROUP BY par.tramo_id, mes_idx""")
def _(t):
    return spatial.buffer_panel(t.placed(), t.lines(), 100.0)


@query("A05_buffer_shift_panel", "tramo_id:s mes_idx:l turno_idx:l n:l severidad:d5", f"""
WITH {_GEO}, {_near(100)} SELECT par.tramo_id, mes_idx, turno_idx, count(*) AS n, sum(peso * exp(-0.5::DOUBLE * pow(dist_m / 100.0::DOUBLE, 2))) AS severidad FROM pto JOIN par USING (x, y) GROUP BY par.tramo_id, mes_idx, turno_idx""")
def _(t):
    return spatial.buffer_shift_panel(t.placed(), t.lines(), 100.0)


@query("A07_spatial_coverage", "mes_idx:l delitos:l pares:l tramos_con_senal:l porcentaje:d", f"""
WITH {_GEO}, {_near(100)}, c AS (SELECT mes_idx, count(*) AS pares, count(DISTINCT par.tramo_id) AS tramos_con_senal FROM pto JOIN par USING (x, y) GROUP BY mes_idx)
SELECT d.mes_idx, d.delitos, pares, tramos_con_senal, round(tramos_con_senal / (SELECT count(*) FROM seg)::DOUBLE * 100, 4) AS porcentaje FROM (SELECT mes_idx, count(*) AS delitos FROM pto GROUP BY mes_idx) d JOIN c USING (mes_idx)""")
def _(t):
    return panel.spatial_coverage(spatial.buffer_panel(t.placed(), t.lines(), 100.0), t.placed(), t.segments().count())


_MID = f"pt AS (SELECT tramo_id, longitud * {KX} AS x, latitud * {KY} AS y FROM seg)"


@query("J05_nearest_neighbors", "tramo_id:s vecino_id:s puesto:l dist_m:d4", f"""
WITH {SEG}, {_MID} SELECT * FROM (SELECT a.tramo_id, b.tramo_id AS vecino_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist_m,
 row_number() OVER (PARTITION BY a.tramo_id ORDER BY round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 12), b.tramo_id) AS puesto FROM pt a JOIN pt b ON a.tramo_id <> b.tramo_id) WHERE puesto <= 32""")
def _(t):
    return spatial.nearest_neighbors(spatial.with_xy(t.segments()).select("tramo_id", "x", "y"), 32)


@query("J05_weighted_neighbors", "tramo_id:s vecino_id:s w:d", f"""
WITH {SEG}, {_MID} SELECT tramo_id, vecino_id, exp(-dist_m / 125.0::DOUBLE) AS w FROM (SELECT a.tramo_id, b.tramo_id AS vecino_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist_m,
 row_number() OVER (PARTITION BY a.tramo_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.tramo_id) AS puesto FROM pt a JOIN pt b ON a.tramo_id <> b.tramo_id) WHERE puesto <= 24 AND dist_m < 300""")
def _(t):
    return spatial.exponential_neighbors(spatial.with_xy(t.segments()).select("tramo_id", "x", "y"))


@query("J06_nearest_forecast", "fila:s tramo_id:s dist_m:d3 score:d", f"""
WITH {INC}, {SEG}, {FORECAST}, loc AS (SELECT DISTINCT latitud, longitud FROM inc WHERE NOT geo), d AS (SELECT loc.*, tramo_id, riesgo_score, {haversine('loc.latitud', 'loc.longitud', 'pron.latitud', 'pron.longitud')} AS dist_m
 FROM loc JOIN pron ON abs(loc.latitud - pron.latitud) < 0.01), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY latitud, longitud ORDER BY dist_m, tramo_id) AS rn FROM d) WHERE rn = 1 AND dist_m <= 1000)
SELECT fila, m.tramo_id, dist_m, riesgo_score AS score FROM inc JOIN m USING (latitud, longitud) WHERE NOT geo""")
def _(t):
    asked = t.raw().filter("NOT geo").select("fila", F.col("latitud").alias("lat"), F.col("longitud").alias("lon"))
    targets = t.forecasts().select(F.col("tramo_id").alias("destino"), F.col("latitud").alias("t_lat"), F.col("longitud").alias("t_lon"), "riesgo_score")
    near = spatial.nearest_by_haversine(asked, targets, "fila", 1000.0).filter("destino IS NOT NULL")
    return near.join(targets.select("destino", F.col("riesgo_score").alias("score")), "destino").select("fila", F.col("destino").alias("tramo_id"), "dist_m", "score")


@query("J07_trip_nodes", "od:l nodo:l dist_m:d3", f"""
WITH {SEG}, nod AS (SELECT u AS nodo FROM seg UNION SELECT v FROM seg), q AS (SELECT c_custkey AS od, {lat('(c_custkey % (SELECT count(*) FROM supplier))')} + ((c_custkey % 13) - 6)::DOUBLE * 0.0001::DOUBLE AS la,
 {lon('(c_custkey % (SELECT count(*) FROM supplier))')} + ((c_custkey % 17) - 8)::DOUBLE * 0.0001::DOUBLE AS lo FROM customer),
d AS (SELECT od, nodo, {haversine('la', 'lo', lat('nodo'), lon('nodo'))} AS dist_m FROM q, nod) SELECT od, nodo, dist_m FROM (SELECT *, row_number() OVER (PARTITION BY od ORDER BY dist_m, nodo) AS rn FROM d) WHERE rn = 1 AND dist_m <= 3000""")
def _(t):
    asked = t.trips().selectExpr("od", "-12.20D + 0.0018D * (origen div 32) + ((od % 13) - 6) * 0.0001D AS lat", "-77.10D + 0.0018D * (origen % 32) + ((od % 17) - 8) * 0.0001D AS lon")
    targets = t.nodes().select(F.col("nodo").alias("destino"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    return spatial.nearest_by_haversine(asked, targets, "od", 3000.0).filter("destino IS NOT NULL").withColumnRenamed("destino", "nodo")


_LUX = f"lx AS (SELECT *, lon * {KX} AS x, lat * {KY} AS y FROM luces)"


def _lights(t):
    return spatial.with_xy(t.lights(), lon="lon", lat="lat")


def _mid(t):
    return spatial.with_xy(t.segments()).select("tramo_id", "x", "y")


_LIGHT_COLS = "n50:l n100:l cerca_m:d4 luz_log50:d luz_log100:d luz_log_dist:d luz_30m:l"


@query("J08_light_exposure", "tramo_id:s " + _LIGHT_COLS, f"""
WITH {SEG}, {_MID}, {LIGHTS}, {_LUX}, d AS (SELECT pt.tramo_id, count(*) FILTER (dd <= 50) AS n50, count(*) FILTER (dd <= 100) AS n100, least(min(dd), 500.0::DOUBLE) AS cerca_m FROM pt, LATERAL (SELECT sqrt(pow(pt.x - lx.x, 2) + pow(pt.y - lx.y, 2)) AS dd FROM lx) GROUP BY pt.tramo_id)
SELECT *, ln(1 + n50) AS luz_log50, ln(1 + n100) AS luz_log100, ln(1 + cerca_m) AS luz_log_dist, (cerca_m <= 30)::INTEGER AS luz_30m FROM d""")
def _(t):
    return spatial.light_exposure(_mid(t), _lights(t))


@query("J09_light_by_month", "tramo_id:s mes_idx:l " + _LIGHT_COLS, f"""
WITH {SEG}, {_MID}, {LIGHTS}, {_LUX}, pares AS (SELECT pt.tramo_id, servicio, sqrt(pow(pt.x - lx.x, 2) + pow(pt.y - lx.y, 2)) AS dd FROM pt JOIN lx ON abs(pt.x - lx.x) <= 500 AND abs(pt.y - lx.y) <= 500),
m AS (SELECT mes_idx, (DATE '1995-01-01' + to_months(mes_idx::INTEGER))::DATE AS ini FROM (SELECT unnest(range(84)) AS mes_idx)),
d AS (SELECT pt.tramo_id, m.mes_idx, count(*) FILTER (dd <= 50) AS n50, count(*) FILTER (dd <= 100) AS n100, least(coalesce(min(dd), 500.0), 500.0::DOUBLE) AS cerca_m FROM pt CROSS JOIN m LEFT JOIN pares p ON p.tramo_id = pt.tramo_id AND p.servicio <= m.ini GROUP BY pt.tramo_id, m.mes_idx)
SELECT *, ln(1 + n50) AS luz_log50, ln(1 + n100) AS luz_log100, ln(1 + cerca_m) AS luz_log_dist, (cerca_m <= 30)::INTEGER AS luz_30m FROM d""")
def _(t):
    return spatial.light_exposure_by_month(_mid(t), _lights(t), "1995-01", t.calendar.size)


@query("M13_night_lighting", "tramo_id:s mes_idx:l turno_idx:l luz_log50:d luz_30m:d luz_log50_noche:d luz_30m_noche:d", f"""
WITH {INC}, {SEG}, {_MID}, {LIGHTS}, {_LUX}, d AS (SELECT pt.tramo_id, count(*) FILTER (dd <= 50) AS n50, least(min(dd), 500.0::DOUBLE) AS c FROM pt, LATERAL (SELECT sqrt(pow(pt.x - lx.x, 2) + pow(pt.y - lx.y, 2)) AS dd FROM lx) GROUP BY pt.tramo_id),
k AS (SELECT DISTINCT tramo_id, mes_idx, turno_idx FROM inc WHERE geo) SELECT k.*, ln(1 + n50) AS luz_log50, (c <= 30)::INTEGER AS luz_30m, ln(1 + n50) * (turno_idx IN (0, 3))::INTEGER AS luz_log50_noche, (c <= 30)::INTEGER * (turno_idx IN (0, 3))::INTEGER AS luz_30m_noche FROM k LEFT JOIN d USING (tramo_id)""")
def _(t):
    cells = t.raw().filter("geo").select("tramo_id", "mes_idx", "turno_idx").distinct()
    return spatial.night_lighting(spatial.light_exposure(_mid(t), _lights(t)), cells)


@query("S09_light_inventory", "fecha_corte:s filas:l en_zona:l unicas:l", f"""
WITH {LIGHTS}, z AS (SELECT * FROM luces WHERE lat BETWEEN -12.199 AND -11.0 AND lon BETWEEN -77.095 AND -76.0), u AS (SELECT fecha_corte, codemp FROM z WHERE codemp <> 0 UNION ALL (SELECT min(fecha_corte), 0 FROM z WHERE codemp = 0 GROUP BY lat, lon))
SELECT fecha_corte, count(*) AS filas, count(*) FILTER (lat BETWEEN -12.199 AND -11.0 AND lon BETWEEN -77.095 AND -76.0) AS en_zona, (SELECT count(*) FROM u WHERE u.fecha_corte = luces.fecha_corte) AS unicas FROM luces GROUP BY fecha_corte""")
def _(t):
    lights = t.lights().withColumn("codemp", F.when(F.col("codemp") != 0, F.col("codemp")))
    inside = F.col("lat").between(-12.199, -11.0) & F.col("lon").between(-77.095, -76.0)
    unique = spatial.unique_lights(lights.filter(inside)).groupBy("fecha_corte").agg(F.count(F.lit(1)).alias("unicas"))
    scan = lights.groupBy("fecha_corte").agg(F.count(F.lit(1)).alias("filas"), panel.count_where(inside).alias("en_zona"))
    return scan.join(unique, "fecha_corte", "left").fillna(0, ["unicas"])


@query("A19_light_audit", "medida:s valor:d4", f"""
WITH {SEG}, {_MID}, {LIGHTS}, {_LUX}, n AS (SELECT tramo_id, min(sqrt(pow(pt.x - lx.x, 2) + pow(pt.y - lx.y, 2))) AS d FROM pt, lx GROUP BY tramo_id)
SELECT 'anio_' || year(servicio) AS medida, count(*)::DOUBLE AS valor FROM luces GROUP BY ALL UNION ALL SELECT 'mediana', quantile_cont(least(d, 500.0), 0.5) FROM n UNION ALL SELECT 'p90', quantile_cont(least(d, 500.0), 0.9) FROM n
UNION ALL SELECT * FROM (SELECT 'dia_' || servicio AS medida, count(*)::DOUBLE FROM luces GROUP BY servicio ORDER BY count(*) DESC, servicio LIMIT 10)""")
def _(t):
    from tramorisk.operators.ordered import exact_quantiles

    lights = t.lights()
    years = lights.groupBy(F.concat(F.lit("anio_"), F.year("servicio")).alias("medida")).agg(F.count(F.lit(1)).cast("double").alias("valor"))
    days = lights.groupBy("servicio").agg(F.count(F.lit(1)).cast("double").alias("valor")).orderBy(F.desc("valor"), "servicio").limit(10)
    q = exact_quantiles(spatial.light_exposure(_mid(t), _lights(t)), [], "cerca_m", [0.5, 0.9])
    return years.unionByName(days.select(F.concat(F.lit("dia_"), F.col("servicio").cast("string")).alias("medida"), "valor")).unionByName(
        q.select(F.when(F.col("prob") == 0.5, "mediana").otherwise("p90").alias("medida"), "valor"))


# ---------------------------------------------------------------- imputation

_DEN = f"""den AS (SELECT *, fecha + to_hours(hora::INTEGER) AS momento, year(fecha) AS anio, month(fecha) AS mes, l_partkey % 4 AS tipo FROM inc)"""


def _reports(t):
    inc = t.raw()
    return inc.withColumn("momento", F.expr("timestampadd(HOUR, hora, fecha)")).withColumn("anio", F.year("fecha")).withColumn("mes", F.month("fecha")).withColumn(
        "tipo", F.col("l_partkey") % 4).withColumn("turno", F.col("turno_idx")).withColumn("reporte", F.date_format("fecha", "yyyyMMdd"))


@query("J10_donor_semi_join", "distrito:s donantes:l", f"""
WITH {INC}, {_DEN} SELECT distrito, count(*) AS donantes FROM den d WHERE geo AND EXISTS (SELECT 1 FROM den m WHERE NOT m.geo AND m.distrito = d.distrito AND m.fecha = d.fecha) GROUP BY distrito""")
def _(t):
    r = _reports(t)
    return impute.donors_for(r.filter("NOT geo"), r.filter("geo"), ["distrito", "reporte"]).groupBy("distrito").agg(F.count(F.lit(1)).alias("donantes"))


def _apart(a: str, b: str) -> str:
    return f"111195.0::DOUBLE * sqrt(pow({a}.latitud - {b}.latitud, 2) + pow(({a}.longitud - {b}.longitud) * cos(radians(({a}.latitud + {b}.latitud) / 2)), 2))"


_SAME = f"""cand AS (SELECT m.fila, d.fila AS fila_donante, abs(epoch(d.momento) - epoch(m.momento)) / 3600.0 AS horas, d.latitud, d.longitud FROM den m JOIN den d ON d.geo AND NOT m.geo AND d.distrito = m.distrito AND d.fecha = m.fecha),
c6 AS (SELECT * FROM cand WHERE horas <= 6), elr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fila ORDER BY horas, fila_donante) AS rn FROM c6) WHERE rn = 1),
disp AS (SELECT elr.fila, max({_apart('elr', 'c6')}) AS dispersion_m, count(*) AS donantes FROM elr JOIN c6 USING (fila) GROUP BY elr.fila),
rec AS (SELECT m.fila, CASE WHEN e.fila IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM cand c WHERE c.fila = m.fila) THEN 'fuera_de_6h' ELSE 'sin_donante' END WHEN dispersion_m > 20000 THEN 'ambiguo' ELSE 'recuperado' END AS estado,
 e.fila_donante, e.horas, e.latitud AS lat_rec, e.longitud AS lon_rec, dispersion_m, donantes FROM den m LEFT JOIN elr e USING (fila) LEFT JOIN disp USING (fila) WHERE NOT m.geo)"""


def _rec(limit: str) -> str:
    return _SAME.replace("20000", limit)


def _same(t, limit):
    r = _reports(t)
    missing = r.filter("NOT geo").select("fila", "distrito", "reporte", "momento")
    donors = impute.donors_for(missing, r.filter("geo").select("fila", "distrito", "reporte", "momento", "latitud", "longitud"), ["distrito", "reporte"])
    return impute.same_report(missing, written(donors), ["distrito", "reporte"], max_spread_m=limit)


@query("J11_same_report_donor", "fila:s estado:s fila_donante:s horas:d dispersion_m:d3 donantes:l", f"""
WITH {INC}, {_DEN}, {_rec('50')} SELECT fila, estado, CASE WHEN estado = 'recuperado' THEN fila_donante END AS fila_donante, CASE WHEN estado = 'recuperado' THEN horas END AS horas,
 CASE WHEN estado = 'recuperado' THEN dispersion_m END AS dispersion_m, CASE WHEN estado = 'recuperado' THEN donantes END AS donantes FROM rec""")
def _(t):
    return _same(t, 50.0)


_LEVELS = ("anio, distrito, mes, subtipo, turno_idx", "anio, distrito, mes, subtipo", "anio, distrito, mes, tipo, turno_idx", "anio, distrito, mes, tipo", "anio, distrito, mes, turno_idx", "anio, distrito, mes", "anio, distrito")
_DECK = f"""falta AS (SELECT * FROM den WHERE NOT geo), dona AS (SELECT * FROM den WHERE geo), op AS ({" UNION ALL ".join(
    f"SELECT m.fila, {i} AS nivel, d.fila AS fila_donante, d.latitud, d.longitud, d.pos, d.n, (m.l_orderkey * 31 + m.l_partkey * 7) % d.n AS idx FROM falta m JOIN (SELECT *, row_number() OVER (PARTITION BY {cols} ORDER BY fila) - 1 AS pos, count(*) OVER (PARTITION BY {cols}) AS n FROM dona) d USING ({cols})"
    for i, cols in enumerate(_LEVELS))}), el AS (SELECT * FROM op WHERE pos = idx QUALIFY nivel = min(nivel) OVER (PARTITION BY fila))"""
_NAMES = "(['mes_subtipo_turno','mes_subtipo','mes_tipo_turno','mes_tipo','mes_turno','mes','anio_distrito'])[nivel + 1]"


def _deck(t):
    r = _reports(t)
    return impute.hot_deck(r.filter("NOT geo"), r.filter("geo"), F.col("l_orderkey") * 31 + F.col("l_partkey") * 7, order="fila")


@query("J12_hot_deck", "fila:s nivel_coincidencia:s fila_donante:s lat_sim:d7 lon_sim:d7", f"WITH {INC}, {_DEN}, {_DECK} SELECT fila, {_NAMES} AS nivel_coincidencia, fila_donante, latitud AS lat_sim, longitud AS lon_sim FROM el")
def _(t):
    return _deck(t)


@query("J13_overlay", "origen_ubi:s n:l lat:d4 lon:d4", f"""
WITH {INC}, {_DEN}, {_rec('50')}, {_DECK}, z AS (SELECT d.fila, CASE WHEN geo THEN 'OBSERVADA' WHEN estado = 'recuperado' THEN 'MISMA_DENUNCIA' WHEN el.fila IS NOT NULL THEN 'SIMULADA' ELSE 'SIN_UBI' END AS origen_ubi,
 CASE WHEN geo THEN d.latitud WHEN estado = 'recuperado' THEN lat_rec ELSE el.latitud END AS la, CASE WHEN geo THEN d.longitud WHEN estado = 'recuperado' THEN lon_rec ELSE el.longitud END AS lo FROM den d LEFT JOIN rec USING (fila) LEFT JOIN el USING (fila))
SELECT origen_ubi, count(*) AS n, sum(la) AS lat, sum(lo) AS lon FROM z GROUP BY origen_ubi""")
def _(t):
    r = _reports(t).withColumn("latitud", F.when(F.col("geo"), F.col("latitud"))).withColumn("longitud", F.when(F.col("geo"), F.col("longitud")))
    filled = impute.overlay(r, impute.require_unique(written(_same(t, 50.0).select("fila", "lat_rec", "lon_rec"))), _deck(t))
    return filled.groupBy("origen_ubi").agg(F.count(F.lit(1)).alias("n"), F.sum("latitud").alias("lat"), F.sum("longitud").alias("lon"))


@query("J14_manifest_matches", "periodo:s delitos:l coinciden:l", f"""
WITH {INC} SELECT periodo, count(*) AS delitos, count(*) FILTER (EXISTS (SELECT 1 FROM inc0 m WHERE NOT m.geo AND m.id_hecho = i.id_hecho AND m.periodo = i.periodo)) AS coinciden FROM inc0 i GROUP BY periodo""")
def _(t):
    return impute.manifest_matches(t.raw(), t.raw().filter("NOT geo"))


# ---------------------------------------------------------------- geometry on segments

@query("P23_points_along", "tramo_id:s muestra:l x:d3 y:d3 metros:d4", f"""
WITH {SEG}, {PIECES}, l AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM pieces), s AS (SELECT tramo_id, sum(len) AS total, sum(len) FILTER (pieza = 1) AS l1 FROM l GROUP BY tramo_id),
g AS (SELECT tramo_id, total, l1, n, unnest(range(n)) AS muestra FROM (SELECT *, greatest(1, ceil(total / 20))::BIGINT AS n FROM s)),
p AS (SELECT *, (muestra + 0.5::DOUBLE) / n * total AS pos FROM g)
SELECT p.tramo_id, muestra, total / n AS metros, q.x1 + (pos - CASE WHEN q.pieza = 1 THEN 0 ELSE l1 END) / q.len * (q.x2 - q.x1) AS x, q.y1 + (pos - CASE WHEN q.pieza = 1 THEN 0 ELSE l1 END) / q.len * (q.y2 - q.y1) AS y
 FROM p JOIN l q ON q.tramo_id = p.tramo_id AND q.pieza = CASE WHEN pos <= l1 THEN 1 ELSE 2 END""")
def _(t):
    return surface.road_samples(t.lines())


@query("P33_oriented_geometry", "tramo_id:s vertices:l lat0:d lon2:d", f"""
WITH {SEG} SELECT tramo_id, 3 AS vertices, lat_v AS lat0, lon_u AS lon2 FROM seg""")
def _(t):
    far = t.segments().withColumn("v_lat", F.col("puntos")[2]["lat"]).withColumn("v_lon", F.col("puntos")[2]["lon"])
    turned = geo.drop_near_repeats(F.concat(F.array(F.struct(F.col("v_lon").alias("lon"), F.col("v_lat").alias("lat"))), geo.orient(F.col("puntos"), F.col("v_lat"), F.col("v_lon"))))
    return far.withColumn("g", turned).select("tramo_id", F.size("g").alias("vertices"), F.col("g")[0]["lat"].alias("lat0"), F.col("g")[2]["lon"].alias("lon2"))


_QUARTERS = f"""qp AS (SELECT *, sqrt(pow(lon_c - lon_u, 2) + pow(lat_c - lat_u, 2)) AS d1, sqrt(pow(lon_v - lon_c, 2) + pow(lat_v - lat_c, 2)) AS d2, unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS f FROM seg),
mu AS (SELECT tramo_id AS edge, 0.0::DOUBLE AS f, lon_u * {KX} AS sx, lat_u * {KY} AS sy FROM seg UNION ALL SELECT tramo_id, 1.0::DOUBLE, lon_v * {KX}, lat_v * {KY} FROM seg
 UNION ALL SELECT tramo_id, f, (CASE WHEN f * (d1 + d2) <= d1 THEN lon_u + f * (d1 + d2) / d1 * (lon_c - lon_u) ELSE lon_c + (f * (d1 + d2) - d1) / d2 * (lon_v - lon_c) END) * {KX},
 (CASE WHEN f * (d1 + d2) <= d1 THEN lat_u + f * (d1 + d2) / d1 * (lat_c - lat_u) ELSE lat_c + (f * (d1 + d2) - d1) / d2 * (lat_v - lat_c) END) * {KY} FROM qp)"""


@query("P23_edge_samples", "edge:s x:d3 y:d3", f"""
WITH {SEG}, {_QUARTERS} SELECT edge, sx AS x, sy AS y FROM mu""")
def _(t):
    return spatial.edge_samples(t.segments())


@query("J15_edge_incidents", "edge:s cantidad:l suma_peso:d peso_medio:d", f"""
WITH {_GEO}, {_QUARTERS},
{_PLACES}, h AS (SELECT DISTINCT edge, loc.x, loc.y FROM mu JOIN loc ON loc.x BETWEEN sx - 80 AND sx + 80 AND loc.y BETWEEN sy - 80 AND sy + 80 WHERE sqrt(pow(loc.x - sx, 2) + pow(loc.y - sy, 2)) <= 80)
SELECT edge, count(*) AS cantidad, sum(peso)::DOUBLE AS suma_peso, avg(peso) AS peso_medio FROM h JOIN pto USING (x, y) WHERE turno_idx = 3 GROUP BY edge""")
def _(t):
    return spatial.crimes_near_edges(spatial.edge_samples(t.segments()), t.placed().filter("turno = 'noche'"), 80.0)


@query("J18_viewport_clip", "tramo_id:s metros_visibles:d3", None)
def _(t):
    return spatial.in_viewport(t.segments(), -12.1975, -77.0925, -12.1955, -77.0575)


@query("J18_viewport_segments", "tramo_id:s", f"""
WITH {SEG}, pz AS (SELECT tramo_id, lon_u AS a, lat_u AS b, lon_c AS c, lat_c AS d FROM seg UNION ALL SELECT tramo_id, lon_c, lat_c, lon_v, lat_v FROM seg),
k AS (SELECT tramo_id, unnest(range(2001)) / 2000.0::DOUBLE AS f, a, b, c, d FROM pz) SELECT DISTINCT tramo_id FROM k WHERE a + f * (c - a) BETWEEN -77.0925 AND -77.0575 AND b + f * (d - b) BETWEEN -12.1975 AND -12.1955""")
def _(t):
    return spatial.in_viewport(t.segments(), -12.1975, -77.0925, -12.1955, -77.0575)


# ---------------------------------------------------------------- hotspots

def _hotspots(t):
    scored = t.forecasts()
    lines = spatial.with_pieces(scored)
    peaks = surface.cell_peaks(surface.road_samples(lines, keep=("riesgo_score",)))
    return lines, peaks


def foci(t):
    """Separated hotspots, shared by the field queries."""
    return t.once("focos", lambda: surface.separated_peaks(_hotspots(t)[1]))


_SAMPLES = f"""{INC}, {SEG}, {PIECES}, {FORECAST}, l AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS len FROM pieces), s AS (SELECT tramo_id, sum(len) AS total, sum(len) FILTER (pieza = 1) AS l1 FROM l GROUP BY tramo_id),
g AS (SELECT tramo_id, total, l1, n, unnest(range(n)) AS muestra FROM (SELECT *, greatest(1, ceil(total / {{step}}))::BIGINT AS n FROM s)), p AS (SELECT *, (muestra + 0.5::DOUBLE) / n * total AS pos FROM g),
mu AS (SELECT p.tramo_id, muestra, q.x1 + (pos - CASE WHEN q.pieza = 1 THEN 0 ELSE l1 END) / q.len * (q.x2 - q.x1) AS x, q.y1 + (pos - CASE WHEN q.pieza = 1 THEN 0 ELSE l1 END) / q.len * (q.y2 - q.y1) AS y
 FROM p JOIN l q ON q.tramo_id = p.tramo_id AND q.pieza = CASE WHEN pos <= l1 THEN 1 ELSE 2 END)"""
_PEAKS = """pk AS (SELECT floor(x / 100)::BIGINT AS cx, floor(y / 100)::BIGINT AS cy, max(riesgo_score) AS pico FROM mu JOIN (SELECT tramo_id, riesgo_score FROM pron) USING (tramo_id) WHERE riesgo_score >= 0.66 GROUP BY ALL)"""
# Peaks that beat every other peak nearby: the first round of the greedy choice
# is exact in SQL; later rounds follow the recursion below.
_GREEDY = """ord AS (SELECT *, row_number() OVER (ORDER BY pico DESC, cx, cy) AS i FROM pk),
gr(i, sel) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT g.i + 1, CASE WHEN EXISTS (SELECT 1 FROM ord o JOIN ord c ON c.i = g.i + 1 WHERE list_contains(g.sel, o.i) AND pow((o.cx - c.cx) * 100.0, 2) + pow((o.cy - c.cy) * 100.0, 2) < 202500) THEN g.sel ELSE list_append(g.sel, g.i + 1) END FROM gr g WHERE g.i < (SELECT count(*) FROM ord)),
foco AS (SELECT cx, cy, (cx + 0.5::DOUBLE) * 100 AS x, (cy + 0.5::DOUBLE) * 100 AS y, pico FROM ord WHERE list_contains((SELECT sel FROM gr ORDER BY gr.i DESC LIMIT 1), ord.i))"""
_FOCI = "WITH RECURSIVE " + _SAMPLES + ", " + _PEAKS + ", " + _GREEDY


@query("H01_road_samples", "tramo_id:s muestras:l x:d3 y:d3", f"WITH {_SAMPLES.format(step=10)} SELECT tramo_id, count(*) AS muestras, sum(x) AS x, sum(y) AS y FROM mu GROUP BY tramo_id")
def _(t):
    return surface.road_samples(t.lines(), surface.ROAD_STEP_M).groupBy("tramo_id").agg(F.count(F.lit(1)).alias("muestras"), F.sum("x").alias("x"), F.sum("y").alias("y"))


@query("H02_cell_peaks", "cx:l cy:l pico:d", f"WITH {_SAMPLES.format(step=20)}, {_PEAKS} SELECT * FROM pk")
def _(t):
    return _hotspots(t)[1]


@query("H03_separated_peaks", "cx:l cy:l pico:d", f"{_FOCI.format(step=20)} SELECT cx, cy, pico FROM foco")
def _(t):
    return surface.separated_peaks(_hotspots(t)[1])


_POW = "pow(least(greatest((pico - 0.6) / 0.4, 0), 1), 2)"


@query("H04_field_at_points", "tramo_id:s campo:d influencia:d", f"""
{_FOCI.format(step=20)}, q AS (SELECT tramo_id, longitud * {KX} AS px, latitud * {KY} AS py FROM seg), d AS (SELECT tramo_id, pico, exp(-4.5 * (pow(px - x, 2) + pow(py - y, 2)) / 62500.0) AS k FROM q JOIN foco ON pow(px - x, 2) + pow(py - y, 2) <= 62500),
i AS (SELECT tramo_id, {_POW} * k AS inf, pico * sqrt(k) AS s FROM d), b AS (SELECT tramo_id, max((inf, s)) AS m FROM (SELECT * FROM i WHERE inf > 0.025) GROUP BY tramo_id)
SELECT q.tramo_id, coalesce(m[2], 0) AS campo, coalesce(m[1], 0) AS influencia FROM q LEFT JOIN b USING (tramo_id)""".replace("max((inf, s)) AS m", "arg_max(s, inf) AS m2, max(inf) AS m1").replace("m[2]", "m2").replace("m[1]", "m1"))
def _(t):
    return surface.field_at(_mid(t), foci(t), ["tramo_id"])


_ZONES = f"""zn AS (SELECT color || ':' || cx || ':' || cy AS zona, color, x, y, pico, least(250.0::DOUBLE, 250 * sqrt(ln({_POW} / 0.025) / 4.5), 250 * sqrt(2 * ln(pico / corte) / 4.5)) AS radio
 FROM foco, (VALUES ('rojo', 0.80::DOUBLE), ('naranja', 0.66::DOUBLE)) v(color, corte) WHERE {_POW} > 0.025 AND pico > corte)"""


@query("H05_zones", "zona:s color:s pico:d radio:d4 radio_margen:d4", f"{_FOCI.format(step=20)}, {_ZONES} SELECT zona, color, pico, radio, radio + 20 AS radio_margen FROM zn")
def _(t):
    return surface.zones(foci(t))


_CHORD = """ab AS (SELECT p.tramo_id, z.zona, z.color, pow(p.x2 - p.x1, 2) + pow(p.y2 - p.y1, 2) AS a, (p.x1 - z.x) * (p.x2 - p.x1) + (p.y1 - z.y) * (p.y2 - p.y1) AS b, pow(p.x1 - z.x, 2) + pow(p.y1 - z.y, 2) - radio * radio AS c, {dist} AS dd, radio + 20 AS rm FROM pieces p, zn z),
cu AS (SELECT tramo_id, zona, color, sum(CASE WHEN b * b - a * c > 0 THEN greatest(least((-b + sqrt(greatest(b * b - a * c, 0))) / a, 1) - greatest((-b - sqrt(greatest(b * b - a * c, 0))) / a, 0), 0) * sqrt(a) ELSE 0 END) AS metros, min(dd) AS dist_m, any_value(rm) AS rm FROM ab GROUP BY tramo_id, zona, color)""".format(dist=piece_distance("z.x", "z.y"))


@query("J17_metres_in_zones", "tramo_id:s zona:s metros:d3 dist_m:d3", f"{_FOCI.format(step=20)}, {_ZONES}, {_CHORD} SELECT tramo_id, zona, metros, dist_m FROM cu WHERE dist_m <= rm")
def _(t):
    lines = _hotspots(t)[0]
    return surface.segments_in_zones(lines, surface.zones(foci(t)))


@query("J16_strongest_influence", "tramo_id:s campo_medio:d campo_pico:d", f"""
{_FOCI.format(step=20)}, g2 AS (SELECT tramo_id, total, l1, n, unnest(range(n)) AS m2 FROM (SELECT *, greatest(1, ceil(total / 10))::BIGINT AS n FROM s)), p2 AS (SELECT *, (m2 + 0.5::DOUBLE) / n * total AS pos FROM g2),
mu2 AS (SELECT p2.tramo_id, m2, q.x1 + (pos - CASE WHEN q.pieza = 1 THEN 0 ELSE l1 END) / q.len * (q.x2 - q.x1) AS px, q.y1 + (pos - CASE WHEN q.pieza = 1 THEN 0 ELSE l1 END) / q.len * (q.y2 - q.y1) AS py FROM p2 JOIN l q ON q.tramo_id = p2.tramo_id AND q.pieza = CASE WHEN pos <= l1 THEN 1 ELSE 2 END),
i AS (SELECT tramo_id, m2, {_POW} * exp(-4.5 * (pow(px - x, 2) + pow(py - y, 2)) / 62500.0) AS inf, pico * sqrt(exp(-4.5 * (pow(px - x, 2) + pow(py - y, 2)) / 62500.0)) AS sc FROM mu2 JOIN foco ON pow(px - x, 2) + pow(py - y, 2) <= 62500),
b AS (SELECT tramo_id, m2, arg_max(sc, inf) AS c FROM i WHERE inf > 0.025 GROUP BY tramo_id, m2)
SELECT mu2.tramo_id, avg(coalesce(c, 0)) AS campo_medio, max(coalesce(c, 0)) AS campo_pico FROM mu2 LEFT JOIN b USING (tramo_id, m2) GROUP BY mu2.tramo_id""")
def _(t):
    lines = _hotspots(t)[0]
    return surface.road_field(lines, foci(t))


@query("H06_road_zone_metres", "tramo_id:s rojo_m:d3 naranja_m:d3 rojas:l naranjas:l", f"""
{_FOCI.format(step=20)}, {_ZONES}, {_CHORD} SELECT tramo_id, coalesce(sum(metros) FILTER (color = 'rojo'), 0) AS rojo_m, greatest(coalesce(sum(metros) FILTER (color = 'naranja'), 0) - coalesce(sum(metros) FILTER (color = 'rojo'), 0), 0) AS naranja_m,
 count(*) FILTER (color = 'rojo') AS rojas, count(*) FILTER (color = 'naranja') AS naranjas FROM cu WHERE dist_m <= rm GROUP BY tramo_id""")
def _(t):
    lines = _hotspots(t)[0]
    hits = surface.segments_in_zones(lines, surface.zones(foci(t)))
    return surface.zone_metres(hits).withColumn("rojas", F.size("zonas_rojo_margen")).withColumn("naranjas", F.size("zonas_naranja_margen"))


@query("H07_endpoint_zones", "od:l zona:s", f"""
{_FOCI.format(step=20)}, {_ZONES}, n AS (SELECT count(*) AS k FROM supplier), e AS (SELECT c_custkey AS od, c_custkey % k AS nodo FROM customer, n UNION SELECT c_custkey, (c_custkey * 17 + 5) % k FROM customer, n)
SELECT DISTINCT od, zona FROM e JOIN zn ON pow({lon('nodo')} * {KX} - x, 2) + pow({lat('nodo')} * {KY} - y, 2) <= radio * radio""")
def _(t):
    discs = surface.zones(foci(t))
    ends = t.trips().select(F.col("od").alias("ruta"), F.explode(F.array("origen", "destino")).alias("nodo")).join(t.nodes(), "nodo")
    return surface.exempt_zones(spatial.with_xy(ends, lon="lon", lat="lat"), discs).withColumnRenamed("ruta", "od")


@query("H08_edge_field", "tramo_id:s largo:d riesgo:d campo_pico:d rojo_m:d3 naranja_m:d3 nivel:s costo_exposicion:d3 costo_foco:d2 costo_seguro:d3")
def _(t):
    return field_edges(t)


def field_edges(t):
    """Edges with field, zones and costs (used by the route queries)."""
    lines = _hotspots(t)[0]
    hits = surface.segments_in_zones(lines, surface.zones(foci(t)))
    return surface.edge_field(lines, surface.road_field(lines, foci(t)), surface.zone_metres(hits))


_VIEW = (-12.2, -77.1, -12.196, -77.06)


@query("H09_viewport_summary", "nivel:s tramos:l metros:d2", f"""
WITH {_SAMPLES.format(step=20)} SELECT {level('riesgo_score')} AS nivel, count(DISTINCT mu.tramo_id) AS tramos, sum(total / n) AS metros FROM mu JOIN g USING (tramo_id, muestra) JOIN (SELECT tramo_id, riesgo_score FROM pron) USING (tramo_id)
 WHERE y / {KY} BETWEEN -12.2 AND -12.196 AND x / {KX} BETWEEN -77.1 AND -77.06 GROUP BY ALL""")
def _(t):
    lines = spatial.with_pieces(t.forecasts().withColumn("nivel", risk.level(F.col("riesgo_score"))))
    x_m, y_m = geo.local_xy(F.lit(1.0), F.lit(1.0))
    samples = surface.road_samples(lines, keep=("nivel",)).withColumn("lat", F.col("y") / y_m).withColumn("lon", F.col("x") / x_m)
    return surface.viewport_summary(samples, *_VIEW)


@query("H09_visible_hotspots", "cx:l cy:l pico:d", f"""
{_FOCI.format(step=20)} SELECT cx, cy, pico FROM foco WHERE x BETWEEN -77.095 * {KX} - 350 AND -77.08 * {KX} + 350 AND y BETWEEN -12.2 * {KY} - 350 AND -12.198 * {KY} + 350""")
def _(t):
    return surface.visible_hotspots(foci(t), -12.2, -77.095, -12.198, -77.08)


@query("H10_raster", "px:l py:l campo:d influencia:d alfa:l", f"""
{_FOCI.format(step=20)}, c AS (SELECT (floor(x / 50) + i)::BIGINT AS px, (floor(y / 50) + j)::BIGINT AS py, x, y, pico FROM foco, (SELECT unnest(range(-6, 7)) AS i), (SELECT unnest(range(-6, 7)) AS j)),
k AS (SELECT px, py, pico, pow((px + 0.5) * 50 - x, 2) + pow((py + 0.5) * 50 - y, 2) AS d2 FROM c), v AS (SELECT px, py, {_POW} * exp(-4.5 * d2 / 62500.0) AS inf, pico * sqrt(exp(-4.5 * d2 / 62500.0)) AS sc FROM k WHERE d2 <= 62500),
b AS (SELECT px, py, max(inf) AS influencia, arg_max(sc, inf) AS campo FROM v GROUP BY px, py) SELECT px, py, campo, influencia, round(sqrt(influencia) * least(1, (influencia - 0.025) / 0.065) * 255 * 0.76)::BIGINT AS alfa FROM b WHERE influencia > 0.025""")
def _(t):
    return surface.raster(foci(t))


@query("A22_length_by_level", "nivel:s tramos:l metros:d muy_bajo:l", f"""
WITH {INC}, {SEG}, {FORECAST} SELECT {level('riesgo_score')} AS nivel, count(*) AS tramos, sum(longitud_m) AS metros, count(*) FILTER (riesgo_score <= 0.12) AS muy_bajo FROM pron GROUP BY ALL""")
def _(t):
    return t.forecasts().groupBy(risk.level(F.col("riesgo_score")).alias("nivel")).agg(
        F.count(F.lit(1)).alias("tramos"), F.sum("longitud_m").alias("metros"), panel.count_where(F.col("riesgo_score") <= 0.12).alias("muy_bajo"))
