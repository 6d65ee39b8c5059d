"""SQL fragments shared by the oracle texts. They restate the derived tables
in plain SQL and use none of the Spark code."""

LAT = "(-12.20::DOUBLE + 0.0018::DOUBLE * (({k}) // 32)::DOUBLE)"
LON = "(-77.10::DOUBLE + 0.0018::DOUBLE * (({k}) % 32)::DOUBLE)"


def lat(k: str) -> str:
    return LAT.format(k=k)


def lon(k: str) -> str:
    return LON.format(k=k)


INC = f"""inc0 AS (SELECT l_orderkey * 10 + l_linenumber AS id_hecho,
 concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS fila,
 l_shipdate AS fecha, strftime(l_shipdate, '%Y-%m') AS periodo,
 (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS mes_idx,
 (l_partkey * 7 + l_linenumber * 5) % 24 AS hora, ((l_partkey * 7 + l_linenumber * 5) % 24) // 6 AS turno_idx,
 {lat('l_suppkey')} + (((l_orderkey % 41) - 20)::DOUBLE * 0.00002::DOUBLE) AS latitud,
 {lon('l_suppkey')} + (((l_partkey % 41) - 20)::DOUBLE * 0.00002::DOUBLE) AS longitud,
 (['Robo agravado','HURTO','Extorsión','HOMICIDIO SIMPLE','robo de celular','SECUESTRO','lesiones','Hurto agravado'])[l_partkey % 8 + 1] AS modalidad,
 (['ROBO','HURTO','EXTORSION','OTROS'])[l_orderkey % 4 + 1] AS subtipo,
 NOT (l_partkey % 11 = 0 OR (month(l_shipdate) = 2 AND l_partkey % 2 = 0)) AS geo,
 (CASE WHEN l_suppkey % 32 = 31 OR l_orderkey % 2 = 0 THEN 'V' ELSE 'H' END) || l_suppkey AS tramo_id,
 l_suppkey::VARCHAR AS distrito, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
 l_partkey % 8 AS m8, l_orderkey % 4 AS s4 FROM lineitem),
inc AS (SELECT *, (['madrugada','manana','tarde','noche'])[turno_idx + 1] AS turno,
 CASE m8 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 3 WHEN 5 THEN 5 WHEN 7 THEN 2
  ELSE (CASE s4 WHEN 0 THEN 3 WHEN 2 THEN 4 ELSE 1 END) END AS peso,
 CASE WHEN m8 = 3 THEN 'homicidio' WHEN m8 = 2 OR s4 = 2 THEN 'extorsion' WHEN m8 IN (0, 4) OR s4 = 0 THEN 'robo'
  WHEN m8 IN (1, 7) OR s4 = 1 THEN 'hurto' ELSE 'otro' END AS categoria,
 CASE WHEN m8 IN (0, 2, 3, 5) OR (m8 = 6 AND s4 = 2) THEN 1 ELSE 0 END AS grave FROM inc0)"""

SEG = f"""seg0 AS (SELECT 'H' || s_suppkey AS tramo_id, s_suppkey AS u, s_suppkey + 1 AS v, s_suppkey AS k FROM supplier WHERE s_suppkey % 32 <> 31
 UNION ALL SELECT 'V' || s_suppkey, s_suppkey, s_suppkey + 32, s_suppkey FROM supplier),
seg1 AS (SELECT *, (60 + (k * 37) % 240)::DOUBLE AS longitud_m, {lat('u')} AS lat_u, {lon('u')} AS lon_u, {lat('v')} AS lat_v, {lon('v')} AS lon_v FROM seg0),
seg AS (SELECT *, (lat_u + lat_v) / 2.0::DOUBLE AS latitud, (lon_u + lon_v) / 2.0::DOUBLE AS longitud,
 (lat_u + lat_v) / 2.0::DOUBLE + ((k * 7) % 11 - 5)::DOUBLE * 0.00003::DOUBLE AS lat_c,
 (lon_u + lon_v) / 2.0::DOUBLE + ((k * 13) % 11 - 5)::DOUBLE * 0.00003::DOUBLE AS lon_c,
 greatest(longitud_m / 100.0::DOUBLE, 1.0::DOUBLE) AS factor FROM seg1)"""

KX = "(111320.0::DOUBLE * cos(radians(-12.0::DOUBLE)))"
KY = "111320.0::DOUBLE"

PIECES = f"""pieces AS (SELECT tramo_id, lon_u * {KX} AS x1, lat_u * {KY} AS y1, lon_c * {KX} AS x2, lat_c * {KY} AS y2, 1 AS pieza FROM seg
 UNION ALL SELECT tramo_id, lon_c * {KX}, lat_c * {KY}, lon_v * {KX}, lat_v * {KY}, 2 FROM seg)"""


def piece_distance(px: str, py: str, p: str = "p") -> str:
    t = (f"least(greatest((({px} - {p}.x1) * ({p}.x2 - {p}.x1) + ({py} - {p}.y1) * ({p}.y2 - {p}.y1)) / "
         f"nullif(({p}.x2 - {p}.x1) * ({p}.x2 - {p}.x1) + ({p}.y2 - {p}.y1) * ({p}.y2 - {p}.y1), 0), 0.0::DOUBLE), 1.0::DOUBLE)")
    return (f"sqrt(pow({px} - ({p}.x1 + {t} * ({p}.x2 - {p}.x1)), 2) + pow({py} - ({p}.y1 + {t} * ({p}.y2 - {p}.y1)), 2))")


CUBE = """cubo AS (SELECT tramo_id, mes_idx, turno_idx, count(*) AS n, sum(peso)::DOUBLE AS peso, sum(grave) AS grave,
 count(*) FILTER (categoria = 'robo') AS robo, count(*) FILTER (categoria = 'hurto') AS hurto,
 count(*) FILTER (categoria = 'extorsion') AS extorsion, count(*) FILTER (categoria = 'homicidio') AS homicidio
 FROM inc WHERE geo GROUP BY tramo_id, mes_idx, turno_idx)"""

DENSE = """denso AS (SELECT s.tramo_id, s.latitud, s.longitud, s.longitud_m, s.factor, m.mes_idx, t.turno_idx,
 coalesce(c.n, 0)::BIGINT AS n, coalesce(c.peso, 0.0)::DOUBLE AS peso, coalesce(c.grave, 0)::BIGINT AS grave, coalesce(c.robo, 0)::BIGINT AS robo,
 coalesce(c.hurto, 0)::BIGINT AS hurto, coalesce(c.extorsion, 0)::BIGINT AS extorsion, coalesce(c.homicidio, 0)::BIGINT AS homicidio
 FROM seg s CROSS JOIN (SELECT unnest(range(84)) AS mes_idx) m CROSS JOIN (SELECT unnest(range(4)) AS turno_idx) t
 LEFT JOIN cubo c ON c.tramo_id = s.tramo_id AND c.mes_idx = m.mes_idx AND c.turno_idx = t.turno_idx)"""

MONTHLY = """mensual AS (SELECT tramo_id, mes_idx, count(*) AS frecuencia, sum(peso)::DOUBLE AS suma_pesos, sum(grave) AS graves,
 count(*) FILTER (categoria = 'hurto') AS hurtos, count(*) FILTER (categoria = 'robo') AS robos,
 count(*) FILTER (categoria = 'extorsion') AS extorsiones, count(*) FILTER (categoria = 'homicidio') AS homicidios,
 count(*) FILTER (turno_idx = 1) AS manana, count(*) FILTER (turno_idx = 2) AS tarde, count(*) FILTER (turno_idx = 3) AS noche,
 count(*) FILTER (turno_idx = 0) AS madrugada FROM inc WHERE geo GROUP BY tramo_id, mes_idx)"""

MEASURES = ("frecuencia", "suma_pesos", "graves", "hurtos", "robos", "extorsiones", "homicidios", "manana", "tarde", "noche", "madrugada")

DENSE_MONTHS = ("panel AS (SELECT s.tramo_id, s.latitud, s.longitud, s.longitud_m, s.factor, m.mes_idx, "
                + ", ".join(f"coalesce(c.{x}, 0)::DOUBLE AS {x}" for x in MEASURES)
                + ", coalesce(c.suma_pesos, 0.0)::DOUBLE / s.factor AS riesgo FROM seg s CROSS JOIN (SELECT unnest(range(84)) AS mes_idx) m "
                  "LEFT JOIN mensual c ON c.tramo_id = s.tramo_id AND c.mes_idx = m.mes_idx)")

COVER = """cob AS (SELECT periodo, count(*) AS total, count(*) FILTER (geo) AS geolocalizados,
 round(count(*) FILTER (geo) / count(*)::DOUBLE, 6) AS cobertura FROM inc0 GROUP BY periodo),
dim AS (SELECT m.mes_idx, strftime(DATE '1995-01-01' + to_months(m.mes_idx::INTEGER), '%Y-%m') AS periodo FROM (SELECT unnest(range(84)) AS mes_idx) m),
meses AS (SELECT d.mes_idx, d.periodo, coalesce(c.cobertura, 0.0)::DOUBLE AS cobertura, coalesce(c.cobertura, 0.0) >= 0.8 AS observado FROM dim d LEFT JOIN cob c USING (periodo))"""

PROBA = """proba0 AS (SELECT o_orderkey AS id, o_custkey, strftime(o_orderdate, '%Y-%m') AS periodo,
 (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS mes_idx, o_orderkey % 4 AS turno_idx, 'T' || o_custkey AS tramo_id,
 (o_orderkey * 37) % 101 + 1 AS a, (o_orderkey * 53) % 97 + 1 AS b, (o_orderkey * 71) % 89 + 1 AS c FROM orders),
proba AS (SELECT id, tramo_id, periodo, mes_idx, turno_idx, (100 - (b * 100) // (a + b + c) - (c * 100) // (a + b + c))::DOUBLE / 100.0::DOUBLE AS p0,
 ((b * 100) // (a + b + c))::DOUBLE / 100.0::DOUBLE AS p1, ((c * 100) // (a + b + c))::DOUBLE / 100.0::DOUBLE AS p2,
 CASE WHEN c * 2 > a + b - 20 + (o_custkey % 60) THEN 2 WHEN b > a - (o_custkey % 40) THEN 1 ELSE 0 END AS y FROM proba0)"""

FORECAST = """hist AS (SELECT tramo_id, sum(peso) AS s, count(*) AS n, sum(grave) AS g FROM inc GROUP BY tramo_id),
pron AS (SELECT seg.*, ((coalesce(s, 0) * 31 + coalesce(n, 0) * 17 + coalesce(g, 0) * 7 + u * 13) % 1001)::DOUBLE / 1000.0::DOUBLE AS riesgo_score
 FROM seg LEFT JOIN hist USING (tramo_id))"""

LIGHTS = f"""luces AS (SELECT p_partkey AS codluminaria, p_partkey % 3 AS codemp, {lat('k')} + ((p_partkey * 13) % 61 - 30)::DOUBLE * 0.00001::DOUBLE AS lat,
 {lon('k')} + ((p_partkey * 13) % 61 - 30)::DOUBLE * 0.00001::DOUBLE AS lon, DATE '1995-01-01' + ((p_partkey * 13) % 2500)::INTEGER AS servicio,
 'corte-' || (p_size % 3) AS fecha_corte FROM (SELECT *, p_partkey % (SELECT count(*) FROM supplier) AS k FROM part))"""


def haversine(la1: str, lo1: str, la2: str, lo2: str) -> str:
    a = (f"(pow(sin(radians({la2} - {la1}) / 2), 2) + cos(radians({la1})) * cos(radians({la2})) * pow(sin(radians({lo2} - {lo1}) / 2), 2))")
    return f"(2 * 6371000.0::DOUBLE * asin(sqrt(least({a}, 1.0::DOUBLE))))"


LEVEL = "CASE WHEN {s} >= 0.66 THEN 'alto' WHEN {s} >= 0.34 THEN 'medio' ELSE 'bajo' END"


def level(s: str) -> str:
    return LEVEL.format(s=s)
