"""Network distances, kernels and batch routes."""

from pyspark.sql import functions as F

from tramorisk.functions import risk
from tramorisk.operators import network as net, panel, spatial, surface, windows
from tramorisk.plans.catalog_spatial import field_edges, foci
from tramorisk.plans.oracle import COVER, CUBE, DENSE, FORECAST, INC, SEG, haversine, lat, lon
from tramorisk.plans.registry import query

_LIMIT = 500.0
_ADJ = """ady AS (SELECT desde, hasta, min(largo) AS largo FROM (SELECT u AS desde, v AS hasta, greatest(longitud_m, 1.0) AS largo FROM seg UNION ALL SELECT v, u, greatest(longitud_m, 1.0) FROM seg) GROUP BY desde, hasta),
fin AS (SELECT tramo_id, u AS nodo, greatest(longitud_m, 1.0) / 2 AS mitad FROM seg UNION SELECT tramo_id, v, greatest(longitud_m, 1.0) / 2 FROM seg)"""
# Bounded relaxation: each round keeps only shorter arrivals.
_DIST = f"""{_ADJ}, alc(origen, nodo, dist) USING KEY (origen, nodo) AS (SELECT tramo_id, nodo, min(mitad) FROM fin WHERE mitad < 500 GROUP BY tramo_id, nodo UNION
 SELECT a.origen, e.hasta, min(a.dist + e.largo) FROM alc a JOIN ady e ON e.desde = a.nodo LEFT JOIN recurring.alc k ON k.origen = a.origen AND k.nodo = e.hasta WHERE a.dist + e.largo < 500 AND (k.dist IS NULL OR a.dist + e.largo < k.dist) GROUP BY a.origen, e.hasta),
dst AS (SELECT origen, destino, min(d) AS dist_m FROM (SELECT origen, tramo_id AS destino, dist + mitad AS d FROM alc JOIN fin USING (nodo) UNION ALL SELECT tramo_id, tramo_id, 0.0 FROM seg) WHERE d < 500 GROUP BY origen, destino)"""
_NET = f"WITH RECURSIVE {INC}, {SEG}, {_DIST}"


def _distances(t):
    return t.once("distancias", lambda: net.midpoint_distances(t.segments(), t.segments().select("tramo_id"), _LIMIT))


@query("G01_adjacency", "desde:l hasta:l largo:d", f"WITH {SEG}, {_ADJ} SELECT * FROM ady")
def _(t):
    return net.adjacency(t.segments())


@query("G02_network_distances", "origen:s destino:s dist_m:d", f"{_NET} SELECT * FROM dst")
def _(t):
    return net.midpoint_distances(t.segments(), t.segments().select("tramo_id"), _LIMIT)


_K = """ker AS (SELECT origen, destino, dist_m, 1 - dist_m / {h}.0 AS k, largo FROM dst JOIN (SELECT tramo_id AS destino, greatest(longitud_m, 1.0) AS largo FROM seg) USING (destino) WHERE dist_m < {h}),
kw AS (SELECT origen, destino, dist_m, 100 * k / greatest(sum(k * largo) OVER (PARTITION BY origen), 1e-9) AS w FROM ker)"""


@query("G03_triangular_kernel", "origen:s destino:s dist_m:d w:d", f"{_NET}, {_K.format(h=250)} SELECT * FROM kw")
def _(t):
    return net.triangular_kernel(_distances(t), t.segments(), 250)


@query("G04_plain_kernels", "origen:s destino:s w_bin:d w_gauss:d", f"{_NET} SELECT origen, destino, 1.0 AS w_bin, exp(-0.5 * pow(dist_m / 100.0, 2)) AS w_gauss FROM dst WHERE dist_m < 300")
def _(t):
    return net.plain_kernels(_distances(t), 300)


@query("G05_projected_history", "tramo_id:s mes_idx:l turno_idx:l densidad:d", f"{_NET}, {CUBE}, {_K.format(h=250)} SELECT destino AS tramo_id, mes_idx, turno_idx, sum(w * peso) AS densidad FROM cubo JOIN kw ON kw.origen = cubo.tramo_id GROUP BY destino, mes_idx, turno_idx")
def _(t):
    return net.project(t.cube(), net.triangular_kernel(_distances(t), t.segments(), 250), "peso")


@query("G06_kernel_panel", "tramo_id:s mes_idx:l n:d robo:d noche:d peso:d5", f"""
{_NET}, {CUBE}, kb AS (SELECT *, exp(-0.5 * pow(dist_m / 100.0, 2)) AS g FROM dst WHERE dist_m < 200) SELECT destino AS tramo_id, mes_idx, sum(n) AS n, sum(robo) AS robo, sum(n) FILTER (turno_idx = 3) AS noche_, coalesce(sum(n) FILTER (turno_idx = 3), 0) AS noche, sum(g * peso) AS peso
 FROM cubo JOIN kb ON kb.origen = cubo.tramo_id GROUP BY destino, mes_idx""")
def _(t):
    return net.kernel_panel(t.cube(), net.plain_kernels(_distances(t), 200), ("n", "robo"))


def _w11(e: str, w: int) -> str:
    o = f"OVER (PARTITION BY tramo_id, turno_idx ORDER BY mes_idx ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"coalesce(sum({e}) {o}, 0) / greatest(coalesce(sum(obs) {o}, 0), 1)::DOUBLE"


@query("W11_density_history", "tramo_id:s mes_idx:l turno_idx:l nkde_250m_ultimo_mes_turno:d nkde_250m_tres_meses_turno:d nkde_250m_tres_meses_total:d nkde_250m_seis_meses_total:d", f"""
{_NET}, {CUBE}, {DENSE}, {COVER}, {_K.format(h=250)}, pj AS (SELECT destino AS tramo_id, mes_idx, turno_idx, sum(w * peso) AS densidad FROM cubo JOIN kw ON kw.origen = cubo.tramo_id GROUP BY destino, mes_idx, turno_idx),
d AS (SELECT x.tramo_id, x.mes_idx, x.turno_idx, m.observado::INTEGER AS obs, CASE WHEN observado THEN coalesce(densidad, 0) ELSE 0 END AS d FROM denso x JOIN meses m USING (mes_idx) LEFT JOIN pj USING (tramo_id, mes_idx, turno_idx)),
d2 AS (SELECT *, sum(d) OVER (PARTITION BY tramo_id, mes_idx) AS dt FROM d)
SELECT tramo_id, mes_idx, turno_idx, {_w11('d', 1)} AS nkde_250m_ultimo_mes_turno, {_w11('d', 3)} AS nkde_250m_tres_meses_turno, {_w11('dt', 3)} AS nkde_250m_tres_meses_total, {_w11('dt', 6)} AS nkde_250m_seis_meses_total FROM d2""")
def _(t):
    density = net.project(t.cube(), net.triangular_kernel(_distances(t), t.segments(), 250), "peso")
    return windows.density_history(panel.dense(density, t.segments(), t.calendar, shifts=True), t.months(), "nkde_250m")


@query("W11_monthly_density_history", "tramo_id:s mes_idx:l densidad_lag1:d densidad_media3:d densidad_media6:d", f"""
{_NET}, {CUBE}, {_K.format(h=250)}, pj AS (SELECT destino AS tramo_id, mes_idx, sum(w * peso) AS densidad FROM cubo JOIN kw ON kw.origen = cubo.tramo_id GROUP BY destino, mes_idx),
d AS (SELECT s.tramo_id, m.mes_idx, coalesce(densidad, 0) AS d FROM seg s CROSS JOIN (SELECT unnest(range(84)) AS mes_idx) m LEFT JOIN pj USING (tramo_id, mes_idx))
SELECT tramo_id, mes_idx, lag(d) OVER w AS densidad_lag1, avg(d) OVER (PARTITION BY tramo_id ORDER BY mes_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS densidad_media3, avg(d) OVER (PARTITION BY tramo_id ORDER BY mes_idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS densidad_media6 FROM d WINDOW w AS (PARTITION BY tramo_id ORDER BY mes_idx)""")
def _(t):
    monthly = t.cube().groupBy("tramo_id", "mes_idx").agg(F.sum("peso").alias("peso"))
    density = net.project(monthly, net.triangular_kernel(_distances(t), t.segments(), 250), "peso", ("mes_idx",))
    return windows.monthly_density_history(panel.dense(density, t.segments(), t.calendar), ["densidad"])


# ---------------------------------------------------------------- routes

def _requests(t):
    """Distinct pairs of nodes that some trip asks for."""
    pairs = t.trips().select("origen", "destino").distinct().filter("origen <> destino")
    return pairs.select(F.concat_ws(">", "origen", "destino").alias("ruta"), "origen", "destino")


def _edges(t):
    """Edges with forecast risk, level and length (no field)."""
    f = t.forecasts()
    return f.select("tramo_id", "u", "v", F.col("longitud_m").alias("largo"), F.col("riesgo_score").alias("riesgo"), risk.level(F.col("riesgo_score")).alias("nivel"),
                    F.lit(0.0).alias("rojo_m"), F.lit(0.0).alias("naranja_m"))


def _cost_columns():
    d, r = F.col("largo"), F.col("riesgo")
    costs = {"rapida": d, "exposicion": d * r, "foco": risk.hotspot_cost(d, r, F.col("nivel"))}
    return costs | {f"beta_{b:03d}": risk.safe_cost(d, r, b) for b in (1, 3, 5, 10, 20, 50, 100)}


def _asked(t):
    """Requests with the places of both ends."""
    at = _node_xy(t)
    end = lambda name, k: at.select(F.col("nodo").alias(name), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    return _requests(t).join(end("origen", "o"), "origen").join(end("destino", "d"), "destino").withColumn("acceso_m", F.lit(0.0))


def _paths(t):
    def build():
        places = t.nodes().select(F.col("nodo").alias("hasta"), F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon"))
        return net.route_variants(_asked(t), net.directed_edges(_edges(t)).join(places, "hasta"), _cost_columns(), "rapida")
    return t.once("rutas", build)


_REQ = """req AS (SELECT DISTINCT c_custkey % n AS origen, (c_custkey * 17 + 5) % n AS destino FROM customer, (SELECT count(*) AS n FROM supplier) WHERE c_custkey % n <> (c_custkey * 17 + 5) % n),
ari AS (SELECT tramo_id, u AS desde, v AS hasta, longitud_m AS largo, riesgo_score AS riesgo FROM pron UNION ALL SELECT tramo_id, v, u, longitud_m, riesgo_score FROM pron)"""


_ROUTES = f"WITH RECURSIVE {INC}, {SEG}, {FORECAST}, {_REQ}"
_EXCESS = "greatest((riesgo - 0.66::DOUBLE) / 0.34::DOUBLE, 0.0::DOUBLE)"
_SQL_COSTS = {"rapida": "largo", "exposicion": "largo * riesgo",
              "foco": f"largo * (riesgo + {_EXCESS} * {_EXCESS} * 2.0::DOUBLE + CASE WHEN riesgo >= 0.66::DOUBLE THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END)",
              **{f"beta_{b:03d}": f"largo * (1.0::DOUBLE + {b}.0::DOUBLE * riesgo)" for b in (1, 3, 5, 10, 20, 50, 100)}}
_ZERO = "{'c': 0.0::DOUBLE, 'e': 0.0::DOUBLE, 'l': 0.0::DOUBLE, 'p': NULL::BIGINT, 't': NULL::VARCHAR}"
_GROWN = "min({'c': b.m.c + s.c, 'e': b.m.e + s.riesgo * s.largo, 'l': b.m.l + s.largo, 'p': b.n, 't': s.tramo_id})"
_FAST = f"""rut AS (SELECT origen || '>' || destino AS ruta, origen, destino FROM req),
pv AS (SELECT ari.*, v, c FROM ari, LATERAL (VALUES {", ".join(f"('{k}', {c})" for k, c in _SQL_COSTS.items())}) x(v, c)),
l0(o, n, m) USING KEY (o, n) AS (SELECT DISTINCT origen, origen, {_ZERO} FROM req UNION SELECT q.o, q.n, q.m FROM (
 SELECT b.o, s.hasta AS n, {_GROWN} AS m FROM l0 b JOIN pv s ON s.v = 'rapida' AND s.desde = b.n GROUP BY b.o, s.hasta) q LEFT JOIN recurring.l0 k USING (o, n) WHERE k.m IS NULL OR q.m < k.m),
tope AS (SELECT ruta, origen, destino, 1.5 * m.l + 1.0 AS tope FROM rut JOIN l0 ON o = origen AND n = destino),
nod AS (SELECT u AS nodo FROM seg UNION SELECT v FROM seg),
abre AS MATERIALIZED (SELECT ruta, nodo FROM tope, nod WHERE {haversine(lat('origen'), lon('origen'), lat('nodo'), lon('nodo'))} + {haversine(lat('nodo'), lon('nodo'), lat('destino'), lon('destino'))} <= tope)"""
# Every other variant searches the nodes of the ellipse only; then the path is walked back from the destination.
_LABELS = f"""{_FAST}, l1(ruta, v, n, m) USING KEY (ruta, v, n) AS (SELECT ruta, v, origen, {_ZERO} FROM rut, (SELECT DISTINCT v FROM pv WHERE v <> 'rapida') UNION SELECT q.ruta, q.v, q.n, q.m FROM (
 SELECT b.ruta, b.v, s.hasta AS n, {_GROWN} AS m FROM l1 b JOIN pv s ON s.v = b.v AND s.desde = b.n JOIN abre a ON a.ruta = b.ruta AND a.nodo = s.hasta GROUP BY b.ruta, b.v, s.hasta) q
 LEFT JOIN recurring.l1 k USING (ruta, v, n) WHERE k.m IS NULL OR q.m < k.m),
lab AS MATERIALIZED (SELECT ruta, 'rapida' AS v, n, m FROM rut JOIN l0 ON o = origen UNION ALL SELECT ruta, v, n, m FROM l1),
fin AS (SELECT ruta, v AS variante, m.c AS costo, m.e AS expo, m.l AS largo FROM lab JOIN rut USING (ruta) WHERE n = destino)"""
_WALK = f"""{_LABELS}, camino(ruta, v, n, atras) AS (SELECT ruta, v, n, 0 FROM lab JOIN rut USING (ruta) WHERE n = destino UNION ALL SELECT ruta, v, m.p, atras + 1 FROM camino JOIN lab USING (ruta, v, n) WHERE m.p IS NOT NULL),
paso AS MATERIALIZED (SELECT ruta, v AS variante, atras, m.t AS tramo_id, round(longitud_m, 2) AS d, round(riesgo_score, 6) AS r, u, pron.v AS w FROM camino JOIN lab USING (ruta, v, n) JOIN pron ON pron.tramo_id = m.t WHERE m.p IS NOT NULL),
tot AS (SELECT ruta, variante, round(sum(d) / 1000, 3) AS distancia_km, round(sum(d) / (25000 / 60.0::DOUBLE), 1) AS tiempo_min, round(sum(r::DECIMAL(9,6) * d::DECIMAL(18,2))::DOUBLE / 1000, 6) AS riesgo_total, round(sum(r::DECIMAL(9,6) * d::DECIMAL(18,2))::DOUBLE / sum(d), 6) AS riesgo_promedio,
 round(coalesce(sum(d) FILTER (r >= 0.66), 0), 2) AS metros_alto, string_agg(tramo_id, '>' ORDER BY atras DESC) AS firma FROM paso GROUP BY ruta, variante)"""
_SAVED = "CASE WHEN {a} <= 1e-12 THEN 0.0 ELSE round(greatest(({a} - {b}) / {a} * 100, 0.0), 2) END"


def _shared_sql(other: str) -> str:
    return (f"comun AS (SELECT a.ruta, count(*) AS tramos_compartidos, round(sum(a.d), 2) AS metros_compartidos FROM paso a WHERE a.variante = 'rapida' AND "
            f"EXISTS (SELECT 1 FROM paso b WHERE b.ruta = a.ruta AND b.variante = '{other}' AND b.tramo_id = a.tramo_id) GROUP BY a.ruta)")


@query("G08_shortest_paths", "ruta:s costo:d3 expo:d3 largo:d3", f"""
{_ROUTES}, {_FAST} SELECT ruta, m.c AS costo, m.e AS expo, m.l AS largo FROM rut JOIN l0 ON o = origen AND n = destino""")
def _(t):
    return _paths(t).filter("variante = 'rapida'")


@query("G09_cost_variants", "ruta:s variante:s costo:d3", f"{_ROUTES}, {_LABELS} SELECT ruta, variante, costo FROM fin")
def _(t):
    return _paths(t)


def _node_xy(t):
    return spatial.with_xy(t.nodes(), lon="lon", lat="lat")


@query("G07_candidate_nodes", "ruta:s nodos:l suma:l", f"{_ROUTES}, {_FAST} SELECT ruta, count(*) AS nodos, sum(nodo) AS suma FROM abre GROUP BY ruta")
def _(t):
    found = _candidates(t)
    return found.groupBy("ruta").agg(F.count(F.lit(1)).alias("nodos"), F.sum("nodo").alias("suma"))


def _candidates(t):
    return net.candidate_nodes(_asked(t), _node_xy(t), _paths(t).filter("variante = 'rapida'"))


_KEYS = ("ruta", "variante")


def _totals(t):
    return t.once("totales", lambda: net.route_totals(net.explode_route(_paths(t).select("ruta", "variante", "tramos")), _edges(t), _KEYS))


@query("A23_route_totals", "ruta:s variante:s distancia_km:d tiempo_min:d riesgo_total:d riesgo_promedio:d", f"""
{_ROUTES}, {_WALK} SELECT ruta, variante, distancia_km, tiempo_min, riesgo_total, riesgo_promedio FROM tot""")
def _(t):
    return _totals(t)


def _candidate_table(t):
    sig = _paths(t).select("ruta", "variante", net.route_signature(F.col("tramos")).alias("firma"))
    return _totals(t).join(sig, list(_KEYS)).withColumn("rojo_ev", F.col("rojo_m")).withColumn("naranja_ev", F.col("naranja_m"))


@query("G11_route_choice", "ruta:s variante:s distancia_km:d riesgo_total:d reduccion:d mismo_recorrido_final:l rechazo_desvio_excesivo:l rechazo_mismo_recorrido:l rechazo_mejora_insuficiente:l", f"""
{_ROUTES}, {_WALK}, base AS (SELECT ruta, distancia_km AS bk, riesgo_total AS br, firma AS bf FROM tot WHERE variante = 'rapida'),
c AS (SELECT tot.*, bk, br, bf, {_SAVED.format(a='br', b='riesgo_total')} AS reduccion FROM tot JOIN base USING (ruta) WHERE variante <> 'rapida'),
j AS (SELECT *, CASE WHEN distancia_km > bk * 1.5 + 1e-9 THEN 'desvio' WHEN firma = bf THEN 'mismo' WHEN reduccion < 0.5 THEN 'poco' END AS motivo FROM c),
mejor AS (SELECT * FROM j WHERE motivo IS NULL QUALIFY row_number() OVER (PARTITION BY ruta ORDER BY metros_alto, -reduccion, distancia_km, variante) = 1),
cuenta AS (SELECT ruta, count(*) FILTER (motivo = 'desvio') AS x, count(*) FILTER (motivo = 'mismo') AS y, count(*) FILTER (motivo = 'poco') AS z FROM j GROUP BY ruta)
SELECT base.ruta, coalesce(variante, 'recorrido_base') AS variante, coalesce(distancia_km, base.bk) AS distancia_km, coalesce(riesgo_total, base.br) AS riesgo_total, coalesce(reduccion, 0.0) AS reduccion,
 (variante IS NULL)::INTEGER AS mismo_recorrido_final, coalesce(x, 0) AS rechazo_desvio_excesivo, coalesce(y, 0) AS rechazo_mismo_recorrido, coalesce(z, 0) AS rechazo_mejora_insuficiente
 FROM base LEFT JOIN mejor USING (ruta) LEFT JOIN cuenta USING (ruta)""")
def _(t):
    rows = _candidate_table(t)
    return net.choose_route(rows.filter("variante <> 'rapida'"), rows.filter("variante = 'rapida'"), with_field=False)


@query("G11_route_choice_field", "ruta:s variante:s distancia_km:d riesgo_total:d reduccion:d mismo_recorrido_final:l rechazo_desvio_excesivo:l rechazo_mismo_recorrido:l rechazo_mejora_insuficiente:l")
def _(t):
    # With the field on, edges cost their metres in coloured zones and the choice goes by zones that can be avoided.
    edges = field_edges(t)
    places = t.nodes().select(F.col("nodo").alias("hasta"), F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon"))
    costs = {"rapida": F.col("largo")} | {f"beta_{b:03d}": risk.field_cost(F.col("largo"), F.col("riesgo"), F.col("rojo_m"), F.col("naranja_m"), b) for b in (1, 3, 5, 10, 20, 50, 100)}
    paths = t.once("rutas_campo", lambda: net.route_variants(_asked(t), net.directed_edges(edges).join(places, "hasta"), costs, "rapida"))
    steps = net.explode_route(paths.select("ruta", "variante", "tramos"))
    lines = spatial.with_xy(spatial.with_pieces(t.forecasts()))
    discs = surface.zones(foci(t))
    ends = _requests(t).select("ruta", F.explode(F.array("origen", "destino")).alias("nodo")).join(t.nodes(), "nodo")
    free = surface.exempt_zones(spatial.with_xy(ends, lon="lon", lat="lat"), discs)
    avoid = net.avoidable_metres(steps.select(*_KEYS, "tramo_id"), surface.segments_in_zones(lines, discs), free, _KEYS)
    rows = net.route_totals(steps, edges, _KEYS).join(avoid, list(_KEYS)).join(paths.select(*_KEYS, net.route_signature(F.col("tramos")).alias("firma")), list(_KEYS))
    rows = t.once("totales_campo", lambda: rows)
    return net.choose_route(rows.filter("variante <> 'rapida'"), rows.filter("variante = 'rapida'"), with_field=True)


@query("G12_risk_reduction", "ruta:s reduccion:d compartidos:l metros:d", f"""
{_ROUTES}, {_WALK}, {_shared_sql('beta_010')} SELECT a.ruta, {_SAVED.format(a='a.riesgo_total', b='b.riesgo_total')} AS reduccion, coalesce(tramos_compartidos, 0) AS compartidos, coalesce(metros_compartidos, 0) AS metros
 FROM tot a JOIN tot b ON a.ruta = b.ruta AND a.variante = 'rapida' AND b.variante = 'beta_010' LEFT JOIN comun ON comun.ruta = a.ruta""")
def _(t):
    totals, paths = _totals(t), _paths(t)
    fast = totals.filter("variante = 'rapida'").select("ruta", F.col("riesgo_total").alias("a"))
    safe = totals.filter("variante = 'beta_010'").select("ruta", F.col("riesgo_total").alias("b"))
    shared = net.shared_metres(paths.filter("variante = 'rapida'"), paths.filter("variante = 'beta_010'"), _edges(t))
    joined = fast.join(safe, "ruta").join(shared, "ruta", "left")
    return joined.select("ruta", risk.risk_reduction(F.col("a"), F.col("b")).alias("reduccion"), F.coalesce("tramos_compartidos", F.lit(0)).alias("compartidos"), F.coalesce("metros_compartidos", F.lit(0.0)).alias("metros"))


@query("U03_shared_segments", "ruta:s tramos_compartidos:l metros_compartidos:d", f"{_ROUTES}, {_WALK}, {_shared_sql('exposicion')} SELECT ruta, tramos_compartidos, metros_compartidos FROM comun")
def _(t):
    paths = _paths(t)
    return net.shared_metres(paths.filter("variante = 'rapida'"), paths.filter("variante = 'exposicion'"), _edges(t))


@query("U05_distinct_routes", "ruta:s distintas:l", f"{_ROUTES}, {_WALK} SELECT ruta, count(DISTINCT firma) AS distintas FROM tot GROUP BY ruta")
def _(t):
    return net.distinct_routes(_paths(t)).groupBy("ruta").agg(F.count(F.lit(1)).alias("distintas"))


@query("G13_edge_annotation", "tramo_id:s cantidad:l bruto:d historico:d hibrido:d nivel:s costo_seguro:d3")
def _(t):
    from tramorisk.operators.ordered import quantile_values

    near = spatial.crimes_near_edges(spatial.edge_samples(t.segments()), t.placed(), 200.0).withColumnRenamed("edge", "tramo_id")
    rows = t.forecasts().join(near, "tramo_id", "left").fillna(0, ["cantidad", "suma_peso"]).withColumn("bruto", F.col("suma_peso") / risk.length_factor(F.col("longitud_m")))
    p95 = quantile_values(rows.filter("bruto > 0"), "bruto", [0.95])[0] or 1.0
    hist = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("bruto") / p95))
    blend = hist * risk.HISTORY_SHARE + F.col("riesgo_score") * risk.FORECAST_SHARE
    return rows.select("tramo_id", "cantidad", "bruto", hist.alias("historico"), blend.alias("hibrido"), risk.level(blend).alias("nivel"), risk.safe_cost(F.col("longitud_m"), blend, 10).alias("costo_seguro"))


def _ladder(t):
    def build():
        edges = field_edges(t)
        discs = surface.zones(foci(t))
        req = _requests(t)
        ends = req.select("ruta", F.explode(F.array("origen", "destino")).alias("nodo")).join(t.nodes(), "nodo")
        free = surface.exempt_zones(spatial.with_xy(ends, lon="lon", lat="lat"), discs).groupBy("ruta").agg(F.collect_set("zona").alias("exentas"))
        none = F.array().cast("array<string>")
        asked = req.join(free, "ruta", "left").withColumn("exentas", F.coalesce("exentas", none))
        return net.shortest_paths(asked, net.directed_edges(edges), {k: F.col("largo") for k in net.LADDER}, blocked=net.ladder_block(), reads=net.ZONES)
    return t.once("escalera", build)


@query("G10_avoidance_ladder", "ruta:s distancia_libre_km:d rojo:s naranja:s margen_aplicado:l variante_activa:s distancia_activa_km:d")
def _(t):
    paths = _ladder(t).select("ruta", "variante", F.round(F.col("largo") / 1000, 3).alias("distancia_km"))
    return net.ladder_policy(paths)


@query("G14_trip_results", "od:l ruta:s variante:s distancia_km:d delta_km:d delta_min:d cambio_exposicion:d cortes:l", f"""
{_ROUTES}, {_WALK}, k AS (SELECT ruta, variante, u, w, lag(u) OVER q AS pu, lag(w) OVER q AS pw FROM paso WINDOW q AS (PARTITION BY ruta, variante ORDER BY atras DESC)),
corte AS (SELECT ruta, variante, count(*) FILTER (pu IS NOT NULL AND u <> pu AND u <> pw AND w <> pu AND w <> pw) AS cortes FROM k GROUP BY ruta, variante),
viaje AS (SELECT c_custkey AS od, (c_custkey % n) || '>' || ((c_custkey * 17 + 5) % n) AS ruta FROM customer, (SELECT count(*) AS n FROM supplier))
SELECT od, a.ruta, a.variante, a.distancia_km, round(a.distancia_km - b.distancia_km, 3) AS delta_km, round(a.tiempo_min - b.tiempo_min, 1) AS delta_min,
 round(CASE WHEN b.riesgo_total > 0 THEN (a.riesgo_total - b.riesgo_total) / b.riesgo_total ELSE 0.0 END * 100, 4) AS cambio_exposicion, cortes
 FROM viaje JOIN tot a USING (ruta) JOIN tot b ON b.ruta = a.ruta AND b.variante = 'rapida' JOIN corte ON corte.ruta = a.ruta AND corte.variante = a.variante WHERE a.variante IN ('beta_010', 'exposicion')""")
def _(t):
    totals, paths = _totals(t), _paths(t)
    breaks = net.continuity_breaks(paths, _edges(t), _KEYS)
    base = totals.filter("variante = 'rapida'").select("ruta", F.col("distancia_km").alias("_d"), F.col("tiempo_min").alias("_t"), F.col("riesgo_total").alias("_r"))
    rows = totals.filter("variante IN ('beta_010', 'exposicion')").join(base, "ruta").join(breaks, list(_KEYS)).select(
        "ruta", "variante", "distancia_km", F.round(F.col("distancia_km") - F.col("_d"), 3).alias("delta_km"), F.round(F.col("tiempo_min") - F.col("_t"), 1).alias("delta_min"),
        F.round(risk.ratio(F.col("riesgo_total") - F.col("_r"), F.col("_r")) * 100, 4).alias("cambio_exposicion"), "cortes")
    return t.trips().withColumn("ruta", F.concat_ws(">", "origen", "destino")).join(rows, "ruta").select("od", *rows.columns)


@query("A29_incidents_around_route", "ruta:s delitos:l", f"""
{_ROUTES}, {_WALK}, caja AS (SELECT ruta, min(least(lat_u, lat_c, lat_v)) - 0.002::DOUBLE AS s, max(greatest(lat_u, lat_c, lat_v)) + 0.002::DOUBLE AS n, min(least(lon_u, lon_c, lon_v)) - 0.002::DOUBLE AS o, max(greatest(lon_u, lon_c, lon_v)) + 0.002::DOUBLE AS e
 FROM paso JOIN seg USING (tramo_id) WHERE variante = 'rapida' GROUP BY ruta)
SELECT ruta, count(fila) AS delitos FROM caja LEFT JOIN inc ON geo AND inc.latitud BETWEEN s AND n AND inc.longitud BETWEEN o AND e GROUP BY ruta""")
def _(t):
    steps = net.explode_route(_paths(t).filter("variante = 'rapida'").select("ruta", "tramos")).join(t.segments().select("tramo_id", "puntos"), "tramo_id")
    box = steps.select("ruta", F.explode("puntos").alias("p")).groupBy("ruta").agg(
        F.min("p.lat").alias("s"), F.max("p.lat").alias("n"), F.min("p.lon").alias("w"), F.max("p.lon").alias("e"))
    return spatial.count_in_boxes(box, t.raw().filter("geo"), key="ruta", pad=0.002)
