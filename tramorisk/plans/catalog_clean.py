"""Projections, predicates, cleaning and sources."""

from pyspark.sql import functions as F

from tramorisk.functions import calendar as cal, geo, risk, severity, text
from tramorisk.operators import clean, ordered, panel
from tramorisk.plans.oracle import (COVER, CUBE, FORECAST, INC, KX, KY, LIGHTS, MONTHLY, PROBA, SEG, haversine, lat, level, lon)
from tramorisk.plans.registry import query


@query("P01_first_non_empty", "id:l valor:s", """
SELECT o_orderkey AS id, coalesce(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE o_orderstatus END), ''),
 nullif(trim(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END), '')) AS valor FROM orders""")
def _(t):
    a = F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")).otherwise(F.col("o_orderstatus"))
    b = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))
    return t.table("orders").select(F.col("o_orderkey").alias("id"), text.first_non_empty(a, b).alias("valor"))


@query("P02_identifier", "event_id:l id_hecho:s", """
SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'G' || event_id WHEN event_id % 8 <> 0 THEN 'O' || event_id
 ELSE 'FILA-' || event_id END AS id_hecho FROM events""")
def _(t):
    e = t.table("events").withColumn("GlobalID", F.when(F.col("event_id") % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" G"), "event_id"))).withColumn(
        "OBJECTID", F.when(F.col("event_id") % 8 != 0, F.concat(F.lit("O"), "event_id")))
    return e.select("event_id", clean.identifier(e, F.col("event_id")).alias("id_hecho"))


@query("P03_decimal_number", "fila:s valor:d", """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS fila,
 CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE try_cast('-' || l_partkey || '.' || (l_orderkey % 100) AS DOUBLE) END AS valor FROM lineitem""")
def _(t):
    raw = F.when(F.col("l_partkey") % 7 == 0, F.lit("s/n")).otherwise(F.concat(F.lit(" -"), "l_partkey", F.lit(","), F.col("l_orderkey") % 100))
    return t.raw().select("fila", text.decimal_number(raw).alias("valor"))


@query("P04_normalize_text", "doc_id:l normal:s", """
SELECT doc_id, CASE WHEN n = '' THEN 'NO ESPECIFICADO' ELSE n END AS normal FROM (SELECT doc_id,
 trim(regexp_replace(regexp_replace(strip_accents(upper(replace(text, 'ß', 'SS'))), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g')) AS n FROM documents)""")
def _(t):
    return t.table("documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


_SHIFTS = "(['Mañana ', 'TARDE', 'noche', ' Madrugada', 'otro'])[event_id % 5 + 1]"


@query("P05_shift_name", "event_id:l turno:s", """
SELECT event_id, (['manana','tarde','noche','madrugada','noche'])[event_id % 5 + 1] AS turno FROM events""")
def _(t):
    raw = F.expr("element_at(array('Mañana ', 'TARDE', 'noche', ' Madrugada', 'otro'), CAST(event_id % 5 + 1 AS INT))")
    return t.table("events").select("event_id", cal.lenient_shift(raw).alias("turno"))


@query("P06_event_dates", "event_id:l fecha:s", """
SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d') || ' 00:00:00' END AS fecha FROM events""")
def _(t):
    months = "element_at(array('enero','febrero','marzo','abril','mayo','junio','julio','agosto','setiembre','octubre','noviembre','diciembre'), month(ts))"
    raw = F.expr(f"""CASE event_id % 5 WHEN 0 THEN date_format(ts, 'yyyy/MM/dd HH:mm:ss') WHEN 1 THEN concat({months}, ' ', day(ts), ', ', year(ts))
      WHEN 2 THEN date_format(ts, 'yyyy-MM-dd') WHEN 3 THEN 'sin fecha' END""")
    e = t.table("events").withColumn("y", F.expr("CASE WHEN event_id % 5 = 4 THEN concat('2,', date_format(ts, 'yyy') % 1000) END")).withColumn(
        "y", F.when(F.col("event_id") % 5 == 4, F.concat(F.lit("2,0"), F.year("ts") % 1000)))
    parts = cal.date_from_parts(F.col("y"), F.month("ts"), F.dayofmonth("ts"))
    return e.select("event_id", F.date_format(F.coalesce(parts, cal.date_from_text(raw)), "yyyy-MM-dd HH:mm:ss").alias("fecha"))


@query("P07_clock_hour", "event_id:l hora:l", """
SELECT event_id, least(CASE event_id % 3 WHEN 0 THEN hour(ts) WHEN 1 THEN event_id % 40 ELSE ([9, 15, 21, 2])[event_id % 4 + 1] END, 23) AS hora FROM events""")
def _(t):
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN date_format(ts, 'HH:mm') WHEN 1 THEN concat('h ', event_id % 40) ELSE 'ND' END")
    shift = F.expr("element_at(array('manana', 'tarde', 'noche', 'madrugada'), CAST(event_id % 4 + 1 AS INT))")
    return t.table("events").select("event_id", cal.clock_hour(raw, shift).alias("hora"))


@query("P08_calendar_names", "fila:s anio:l mes:l mes_nombre:s dia:l periodo:s dia_semana:s", f"""
WITH {INC} SELECT fila, year(fecha) AS anio, month(fecha) AS mes,
 (['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'])[month(fecha)] AS mes_nombre,
 day(fecha) AS dia, periodo, (['lunes','martes','miercoles','jueves','viernes','sabado','domingo'])[isodow(fecha)] AS dia_semana FROM inc0""")
def _(t):
    return clean.with_calendar(t.raw().drop("periodo"))


@query("P09_city_box", "distrito:s dentro:l amplio:l total:l", f"""
WITH {INC} SELECT distrito, count(*) FILTER (latitud BETWEEN -12.60 AND -11.45 AND longitud - 0.05 BETWEEN -77.10 AND -76.60) AS dentro,
 count(*) FILTER (latitud BETWEEN -13.5 AND -10.5 AND longitud BETWEEN -78.0 AND -76.0) AS amplio, count(*) AS total FROM inc0 GROUP BY distrito""")
def _(t):
    near = geo.inside_box(F.col("latitud"), F.col("longitud") - 0.05, (-12.60, -11.45, -77.10, -76.60))
    wide = geo.inside_box(F.col("latitud"), F.col("longitud"), geo.WIDE_BOX)
    return t.raw().groupBy("distrito").agg(panel.count_where(near).alias("dentro"), panel.count_where(wide).alias("amplio"), F.count(F.lit(1)).alias("total"))


def _order():
    return [F.col(c) for c in ("fecha", "l_partkey", "l_suppkey", "l_extendedprice")]


@query("P10_first_per_id", "id_hecho:l fila:s fecha:s", f"""
WITH {INC} SELECT id_hecho, fila, strftime(fecha, '%Y-%m-%d') AS fecha FROM (SELECT *, row_number() OVER (PARTITION BY id_hecho
 ORDER BY fecha, l_partkey, l_suppkey, l_extendedprice) AS rn FROM inc0) WHERE rn = 1""")
def _(t):
    return clean.keep_first_by_id(t.raw(), "id_hecho", _order()).withColumn("fecha", F.date_format("fecha", "yyyy-MM-dd"))


@query("P10_last_per_id", "id_hecho:l fila:s", f"""
WITH {INC} SELECT id_hecho, fila FROM (SELECT *, row_number() OVER (PARTITION BY id_hecho
 ORDER BY fecha DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM inc0) WHERE rn = 1""")
def _(t):
    return ordered.last_by(t.raw(), ["id_hecho"], _order())


@query("P10_first_per_content", "periodo:s distrito:s modalidad:s subtipo:s fila:s", f"""
WITH {INC} SELECT periodo, distrito, modalidad, subtipo, min(fila) AS fila FROM inc0 GROUP BY periodo, distrito, modalidad, subtipo""")
def _(t):
    return clean.keep_first_by_content(t.raw().select("periodo", "distrito", "modalidad", "subtipo", "fila"),
                                       ["periodo", "distrito", "modalidad", "subtipo"], [F.col("fila")])


_CODES = """SELECT *, (['10101','10103','10401','10409','10501','10502','10508','11201','13002','13003','50801','99999','88888'])[l_partkey % 13 + 1] AS sub_cod,
 (['1140109','5040124','0000000','1234567'])[l_orderkey % 4 + 1] AS mod_cod FROM inc0"""


def _coded(t):
    return t.raw().withColumn("sub_cod", F.expr("element_at(array('10101','10103','10401','10409','10501','10502','10508','11201','13002','13003','50801','99999','88888'), CAST(l_partkey % 13 + 1 AS INT))")).withColumn(
        "mod_cod", F.expr("element_at(array('1140109','5040124','0000000','1234567'), CAST(l_orderkey % 4 + 1 AS INT))"))


@query("P11_relevant_codes", "sub_cod:s mod_cod:s n:l", f"""
WITH {INC} SELECT sub_cod, mod_cod, count(*) AS n FROM ({_CODES}) WHERE sub_cod NOT IN ('99999', '88888') OR mod_cod IN ('1140109', '5040124') GROUP BY sub_cod, mod_cod""")
def _(t):
    return _coded(t).filter(clean.relevant(F.col("sub_cod"), F.col("mod_cod"))).groupBy("sub_cod", "mod_cod").agg(F.count(F.lit(1)).alias("n"))


_PLACES = """(CASE l_partkey % 6 WHEN 0 THEN '-12' || lpad((l_orderkey % 100000)::VARCHAR, 6, '0') WHEN 1 THEN '-12,' || lpad((l_orderkey % 100000)::VARCHAR, 6, '0')
 WHEN 2 THEN 'NA' WHEN 3 THEN '-9.5' ELSE '-12.' || lpad((l_orderkey % 100000)::VARCHAR, 6, '0') END)"""


@query("P12_repaired_places", "fila:s lat_txt:s lon_txt:s estado:s", f"""
WITH {INC} SELECT fila, CASE WHEN l_partkey % 6 IN (2, 3) THEN '' ELSE '-12.' || lpad((l_orderkey % 100000)::VARCHAR, 6, '0') || '0' END AS lat_txt,
 CASE WHEN l_partkey % 6 IN (2, 3) THEN '' ELSE '-77.0400000' END AS lon_txt,
 CASE l_partkey % 6 WHEN 0 THEN 'decimal_recovered' WHEN 2 THEN 'missing' WHEN 3 THEN 'outside_lima_callao' ELSE 'valid' END AS estado FROM inc0""")
def _(t):
    raw = F.expr("""CASE l_partkey % 6 WHEN 0 THEN concat('-12', lpad(CAST(l_orderkey % 100000 AS STRING), 6, '0'))
      WHEN 1 THEN concat('-12,', lpad(CAST(l_orderkey % 100000 AS STRING), 6, '0')) WHEN 2 THEN ' na' WHEN 3 THEN '-9.5'
      ELSE concat('-12.', lpad(CAST(l_orderkey % 100000 AS STRING), 6, '0')) END""")
    la, lo, st = clean.repaired_place(raw, F.lit("-77,04"))
    return t.raw().select("fila", la.alias("lat_txt"), lo.alias("lon_txt"), st.alias("estado"))


@query("P13_valid_event", "anio:l validos:l total:l", """
SELECT year(l_shipdate) AS anio, count(*) FILTER (l_partkey % 5 NOT IN (0, 1)) AS validos, count(*) AS total FROM lineitem GROUP BY year(l_shipdate)""")
def _(t):
    raw = F.expr("CASE l_partkey % 5 WHEN 0 THEN 'NULL' WHEN 1 THEN concat(year(fecha) + 1, '/01/01 00:00:00') WHEN 2 THEN date_format(fecha, 'yyyy/MM/dd HH:mm:ss') WHEN 3 THEN date_format(fecha, 'yyyy-MM-dd') ELSE concat(' ', date_format(fecha, 'yyyy-MM-dd HH:mm:ss')) END")
    ok = clean.valid_event(raw, F.year("fecha"))
    return t.raw().groupBy(F.year("fecha").alias("anio")).agg(panel.count_where(ok).alias("validos"), F.count(F.lit(1)).alias("total"))


@query("P14_severity", "fila:s peso:l", f"WITH {INC} SELECT fila, peso FROM inc")
def _(t):
    return t.incidents()


@query("P15_configured_severity", "fila:s peso:l", f"""
WITH {INC} SELECT c.fila, greatest(i.peso, 1, CASE c.sub_cod WHEN '10101' THEN 5 WHEN '10103' THEN 3 WHEN '10401' THEN 2 WHEN '10409' THEN 5 WHEN '10501' THEN 1 WHEN '10502' THEN 3
 WHEN '10508' THEN 4 WHEN '11201' THEN 2 WHEN '13002' THEN 1 WHEN '13003' THEN 1 WHEN '50801' THEN 5 ELSE 0 END,
 CASE c.mod_cod WHEN '1140109' THEN 3 WHEN '5040124' THEN 2 ELSE 0 END, CASE WHEN c.l_orderkey % 9 = 0 THEN 4 ELSE 0 END) AS peso FROM ({_CODES}) c JOIN inc i USING (fila)""")
def _(t):
    name = F.when(F.col("l_orderkey") % 9 == 0, F.concat("modalidad", F.lit(" con arma de fuego"))).otherwise(F.col("modalidad"))
    return _coded(t).select("fila", severity.configured_severity(F.col("sub_cod"), F.col("mod_cod"), F.col("subtipo"), name).alias("peso"))


@query("P16_category", "fila:s categoria:s plural:s", f"""
WITH {INC} SELECT fila, categoria, CASE categoria WHEN 'homicidio' THEN 'homicidios' WHEN 'extorsion' THEN 'extorsiones' WHEN 'robo' THEN 'robos' WHEN 'hurto' THEN 'hurtos' ELSE 'otros' END AS plural FROM inc""")
def _(t):
    return t.incidents().withColumn("plural", severity.category(F.col("subtipo"), F.col("modalidad"), plural=True))


@query("P17_severe_flag", "grave:l peso:l n:l", f"WITH {INC} SELECT CASE WHEN peso >= 4 THEN 1 ELSE 0 END AS grave, peso, count(*) AS n FROM inc GROUP BY peso")
def _(t):
    return t.incidents().groupBy("grave", "peso").agg(F.count(F.lit(1)).alias("n"))


@query("P18_shift_at_clock", "event_id:l turno:s", """
SELECT event_id, (['madrugada','manana','tarde','noche'])[hour(ts - INTERVAL 5 HOUR) // 6 + 1] AS turno FROM events""")
def _(t):
    return t.table("events").select("event_id", cal.shift_at(F.col("ts")).alias("turno"))


@query("P19_segment_id", "tramo_id:s osm:s", f"""
WITH {SEG} SELECT tramo_id, 'OSM-' || least(u::VARCHAR, v::VARCHAR) || '-' || greatest(u::VARCHAR, v::VARCHAR) || '-' || least((k * 7)::VARCHAR, (k * 3 + 1)::VARCHAR) || '-' || greatest((k * 7)::VARCHAR, (k * 3 + 1)::VARCHAR) AS osm FROM seg""")
def _(t):
    return t.segments().withColumn("osm", geo.segment_id(F.col("v"), F.col("u"), F.array(F.col("u") * 7, F.col("u") * 3 + 1)))


@query("P20_longest_edge", "tramo_id:s largo:d fila:s", f"""
WITH {INC} SELECT tramo_id, largo, fila FROM (SELECT tramo_id, fila, l_extendedprice AS largo, row_number() OVER (PARTITION BY tramo_id ORDER BY l_extendedprice DESC, fila DESC) AS rn FROM inc0) WHERE rn = 1""")
def _(t):
    rows = t.raw().select("tramo_id", "fila", F.col("l_extendedprice").alias("largo"))
    return ordered.last_by(rows, ["tramo_id"], [F.col("largo"), F.col("fila")])


def _utm_sql(lo: str, la: str) -> str:
    radius, ecc, alpha = geo._krueger()
    dl = f"radians({lo} + 75.0::DOUBLE)"
    t = f"sinh(atanh(sin(radians({la}))) - {ecc!r}::DOUBLE * atanh({ecc!r}::DOUBLE * sin(radians({la}))))"
    e = "eta0" + "".join(f" + {a!r}::DOUBLE * cos({2 * j} * xi0) * sinh({2 * j} * eta0)" for j, a in enumerate(alpha, 1))
    n = "xi0" + "".join(f" + {a!r}::DOUBLE * sin({2 * j} * xi0) * cosh({2 * j} * eta0)" for j, a in enumerate(alpha, 1))
    return (f"SELECT fila, {lo} * {KX} AS lx, {la} * {KY} AS ly, 500000.0::DOUBLE + {0.9996 * radius!r}::DOUBLE * ({e}) AS este, 10000000.0::DOUBLE + {0.9996 * radius!r}::DOUBLE * ({n}) AS norte "
            f"FROM (SELECT *, atan2(tt, cos({dl})) AS xi0, atanh(sin({dl}) / sqrt(1 + tt * tt)) AS eta0 FROM (SELECT *, {t} AS tt FROM inc0))")


@query("P21_projections", "fila:s este:d3 norte:d3 lx:d3 ly:d3", f"WITH {INC} {_utm_sql('longitud', 'latitud')}")
def _(t):
    e, n = geo.utm_xy(F.col("longitud"), F.col("latitud"))
    x, y = geo.local_xy(F.col("longitud"), F.col("latitud"))
    return t.raw().select("fila", e.alias("este"), n.alias("norte"), x.alias("lx"), y.alias("ly"))


@query("P22_distances", "fila:s esfera_m:d4 plano_m:d4", f"""
WITH {INC} SELECT fila, {haversine('latitud', 'longitud', lat('l_suppkey'), lon('l_suppkey'))} AS esfera_m,
 111195.0::DOUBLE * sqrt(pow(latitud - {lat('l_suppkey')}, 2) + pow((longitud - {lon('l_suppkey')}) * cos(radians((latitud + {lat('l_suppkey')}) / 2)), 2)) AS plano_m FROM inc0""")
def _(t):
    la, lo = F.expr("-12.20D + 0.0018D * (l_suppkey div 32)"), F.expr("-77.10D + 0.0018D * (l_suppkey % 32)")
    return t.raw().select("fila", geo.haversine_m(F.col("latitud"), F.col("longitud"), la, lo).alias("esfera_m"),
                          geo.separation_m(F.col("latitud"), F.col("longitud"), la, lo).alias("plano_m"))


@query("P24_length_density", "tramo_id:s factor:d n:l densidad:d", f"""
WITH {INC}, {SEG} SELECT tramo_id, factor, coalesce(n, 0) AS n, coalesce(n, 0) / factor AS densidad FROM seg LEFT JOIN (SELECT tramo_id, count(*) AS n FROM inc GROUP BY tramo_id) USING (tramo_id)""")
def _(t):
    n = t.raw().groupBy("tramo_id").agg(F.count(F.lit(1)).alias("n"))
    f = risk.length_factor(F.col("longitud_m"))
    return t.segments().join(n, "tramo_id", "left").select("tramo_id", f.alias("factor"), F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / f).alias("densidad"))


@query("P25_cyclic_encoding", "fila:s turno_sin:d turno_cos:d mes_sin:d mes_cos:d", f"""
WITH {INC} SELECT fila, sin(2 * pi() * turno_idx / 4) AS turno_sin, cos(2 * pi() * turno_idx / 4) AS turno_cos, sin(2 * pi() * (mes_idx % 12) / 12) AS mes_sin, cos(2 * pi() * (mes_idx % 12) / 12) AS mes_cos FROM inc0""")
def _(t):
    a, b = cal.cyclic(F.col("turno_idx"), 4), cal.cyclic(F.col("mes_idx") % 12, 12)
    return t.raw().select("fila", a[0].alias("turno_sin"), a[1].alias("turno_cos"), b[0].alias("mes_sin"), b[1].alias("mes_cos"))


@query("P26_risk_classes", "tramo_id:s mes_idx:l turno_idx:l riesgo:d clase_turno:l clase_buffer:l", f"""
WITH {INC}, {SEG}, {CUBE} SELECT tramo_id, mes_idx, turno_idx, peso / factor AS riesgo, CASE WHEN peso / factor >= 3.0 THEN 2 WHEN peso > 0 THEN 1 ELSE 0 END AS clase_turno,
 CASE WHEN peso / factor >= 2.3442396250791653::DOUBLE THEN 2 WHEN peso > 0 THEN 1 ELSE 0 END AS clase_buffer FROM cubo JOIN seg USING (tramo_id)""")
def _(t):
    r = F.col("peso") / risk.length_factor(F.col("longitud_m"))
    return t.cube().join(t.segments(), "tramo_id").withColumn("riesgo", r).withColumn("clase_turno", risk.risk_class(r, risk.HIGH_FROM_SHIFT)).withColumn(
        "clase_buffer", risk.risk_class(r, risk.HIGH_FROM_BUFFER))


@query("P27_score_level", "id:l score:d nivel:s", f"""
WITH {PROBA} SELECT id, score, {level('score')} AS nivel FROM (SELECT id, least(greatest(p1 * 0.5::DOUBLE + p2, 0.0::DOUBLE), 1.0::DOUBLE) AS score FROM proba)""")
def _(t):
    s = risk.risk_score(F.col("p1"), F.col("p2"))
    return t.proba().select("id", s.alias("score"), risk.level(s).alias("nivel"))


@query("P28_optional_filters", "fila:s turno:s modalidad:s", f"WITH {INC} SELECT fila, turno, modalidad FROM inc WHERE turno = 'noche' AND modalidad = 'HURTO'")
def _(t):
    return clean.filter_records(t.incidents(), turno="noche", modalidad="HURTO", subtipo="todos", distrito=None)


_RISKY = f"{FORECAST}, arista AS (SELECT tramo_id, longitud_m AS largo, riesgo_score AS riesgo, {level('riesgo_score')} AS nivel, (k % 7)::DOUBLE AS rojo_m, (k % 11)::DOUBLE AS naranja_m FROM pron)"


@query("P29_edge_costs", "tramo_id:s seguro:d exposicion:d foco:d campo:d prospectivo:d minutos:d", f"""
WITH {INC}, {SEG}, {_RISKY} SELECT tramo_id, largo * (1 + 10.0::DOUBLE * riesgo) AS seguro, largo * riesgo AS exposicion,
 largo * (riesgo + 2 * pow(greatest((riesgo - 0.66) / 0.34, 0), 2) + CASE WHEN nivel = 'alto' THEN 0.25 ELSE 0 END) AS foco,
 largo * (1 + 20.0::DOUBLE * riesgo) + 200 * rojo_m + 20 * naranja_m AS campo, largo * (1 + 10.0::DOUBLE * riesgo) AS prospectivo, largo / (25000 / 60.0::DOUBLE) AS minutos FROM arista""")
def _(t):
    d, r = F.col("longitud_m"), F.col("riesgo_score")
    red, orange = (F.col("u") % 7).cast("double"), (F.col("u") % 11).cast("double")
    return t.forecasts().select("tramo_id", risk.safe_cost(d, r, 10).alias("seguro"), (d * r).alias("exposicion"), risk.hotspot_cost(d, r, risk.level(r)).alias("foco"),
                                risk.field_cost(d, r, red, orange, 20).alias("campo"), risk.safe_cost(d, r, 10).alias("prospectivo"), risk.travel_minutes(d).alias("minutos"))


@query("P30_risk_blend", "tramo_id:s historico:d hibrido:d", f"""
WITH {INC}, {SEG}, {FORECAST}, h AS (SELECT pron.*, coalesce(s, 0) / greatest(longitud_m / 100, 1) AS bruto FROM pron LEFT JOIN (SELECT tramo_id, sum(peso)::DOUBLE AS s FROM inc WHERE geo GROUP BY tramo_id) USING (tramo_id)),
q AS (SELECT quantile_cont(bruto, 0.95) AS p95 FROM h WHERE bruto > 0)
SELECT tramo_id, least(1.0::DOUBLE, bruto / p95) AS historico, 0.7::DOUBLE * least(1.0::DOUBLE, bruto / p95) + 0.3::DOUBLE * riesgo_score AS hibrido FROM h, q""")
def _(t):
    sums = t.incidents().filter("geo").groupBy("tramo_id").agg(F.sum("peso").cast("double").alias("s"))
    rows = t.forecasts().join(sums, "tramo_id", "left").withColumn("bruto", F.coalesce("s", F.lit(0.0)) / risk.length_factor(F.col("longitud_m")))
    p95 = ordered.quantile_values(rows.filter("bruto > 0"), "bruto", [0.95])[0] or 1.0
    hist = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("bruto") / p95))
    return rows.select("tramo_id", hist.alias("historico"), (hist * risk.HISTORY_SHARE + F.col("riesgo_score") * risk.FORECAST_SHARE).alias("hibrido"))


@query("P34_spanish_aliases", "od:l distancia_km:d tiempo_min:d nivel_riesgo:s", f"""
SELECT o_orderkey AS od, round(o_totalprice / 1000, 3) AS distancia_km, round(o_totalprice / (25000 / 60.0::DOUBLE), 1) AS tiempo_min, {level('((o_orderkey % 100) / 100.0::DOUBLE)')} AS nivel_riesgo FROM orders""")
def _(t):
    return t.table("orders").select(F.col("o_orderkey").alias("od"), F.round(F.col("o_totalprice") / 1000, 3).alias("distancia_km"),
                                    F.round(risk.travel_minutes(F.col("o_totalprice")), 1).alias("tiempo_min"), risk.level((F.col("o_orderkey") % 100) / 100.0).alias("nivel_riesgo"))


@query("A16_filter_funnel", "anio:l source_rows:l selected_crimes:l excluded_other_typification:l excluded_invalid:l geo_valid:l geo_decimal_recovered:l geo_missing:l geo_outside_lima_callao:l output_rows:l excluded_duplicate:l", f"""
WITH {INC}, r AS (SELECT year(fecha) AS anio, id_hecho, l_partkey % 5 AS v5, {_PLACES} AS la, sub_cod, mod_cod, fecha, l_orderkey,
  sub_cod NOT IN ('99999', '88888') OR mod_cod IN ('1140109', '5040124') AS sel, l_partkey % 5 NOT IN (0, 1) AS ok, l_partkey % 6 AS g6 FROM ({_CODES})),
k AS (SELECT anio, count(*) AS output_rows FROM (SELECT DISTINCT anio, id_hecho, fecha, v5, la, sub_cod, mod_cod FROM r WHERE sel AND ok) GROUP BY anio),
f AS (SELECT anio, count(*) AS source_rows, count(*) FILTER (sel) AS selected_crimes, count(*) FILTER (NOT sel) AS excluded_other_typification, count(*) FILTER (sel AND NOT ok) AS excluded_invalid,
 count(*) FILTER (sel AND ok AND g6 IN (1, 4, 5)) AS geo_valid, count(*) FILTER (sel AND ok AND g6 = 0) AS geo_decimal_recovered, count(*) FILTER (sel AND ok AND g6 = 2) AS geo_missing,
 count(*) FILTER (sel AND ok AND g6 = 3) AS geo_outside_lima_callao FROM r GROUP BY anio)
SELECT anio, sum(source_rows) AS source_rows, sum(selected_crimes) AS selected_crimes, sum(excluded_other_typification) AS excluded_other_typification, sum(excluded_invalid) AS excluded_invalid,
 sum(geo_valid) AS geo_valid, sum(geo_decimal_recovered) AS geo_decimal_recovered, sum(geo_missing) AS geo_missing, sum(geo_outside_lima_callao) AS geo_outside_lima_callao,
 sum(output_rows) AS output_rows, sum(selected_crimes - excluded_invalid - output_rows) AS excluded_duplicate FROM f JOIN k USING (anio) GROUP BY ROLLUP (anio)""")
def _(t):
    when = F.expr("CASE l_partkey % 5 WHEN 0 THEN 'NULL' WHEN 1 THEN concat(year(fecha) + 1, '/01/01 00:00:00') WHEN 2 THEN date_format(fecha, 'yyyy/MM/dd HH:mm:ss') WHEN 3 THEN date_format(fecha, 'yyyy-MM-dd') ELSE concat(' ', date_format(fecha, 'yyyy-MM-dd HH:mm:ss')) END")
    place = F.expr("CASE l_partkey % 6 WHEN 0 THEN concat('-12', lpad(CAST(l_orderkey % 100000 AS STRING), 6, '0')) WHEN 1 THEN concat('-12,', lpad(CAST(l_orderkey % 100000 AS STRING), 6, '0')) WHEN 2 THEN 'NA' WHEN 3 THEN '-9.5' ELSE concat('-12.', lpad(CAST(l_orderkey % 100000 AS STRING), 6, '0')) END")
    rows = _coded(t).select(F.year("fecha").alias("anio"), F.col("fila").alias("orden"), F.col("id_hecho").cast("string").alias("id"), F.lit("").alias("fecha_registro"),
                            when.alias("fecha_hecho"), place.alias("lat"), F.lit("-77.04").alias("lon"), F.col("sub_cod").alias("subtipo"), F.col("mod_cod").alias("modalidad"))
    return clean.filter_with_funnel(rows)[1]
