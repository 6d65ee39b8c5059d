"""Sources and sinks: every query here writes or reads through the I/O layer."""

from pyspark.sql import functions as F

from tramorisk.functions.calendar import SHIFTS
from tramorisk.operators import clean, panel, spatial
from tramorisk.plans.oracle import COVER, CUBE, DENSE, FORECAST, INC, MONTHLY, DENSE_MONTHS, PROBA, SEG, level
from tramorisk.plans.registry import query
from tramorisk.session import ensure_checkpoint_dir
from tramorisk.sources import forecast, readers

_RUNS = {"n": 0}


def _folder(t, name):
    """Fresh folder of this run under the shared checkpoint folder."""
    _RUNS["n"] += 1
    return f"{ensure_checkpoint_dir(t.spark)}/fuentes/{t.spark.sparkContext.applicationId}/{name}-{_RUNS['n']}"


def _yearly(t):
    """Incidents as the raw text columns of a yearly source."""
    shift = F.initcap(F.element_at(F.array(*[F.lit(s) for s in SHIFTS]), F.col("turno_idx") + 1))
    place = lambda c: F.when(F.col("geo"), F.format_string("%.7f", F.col(c))).otherwise(F.lit(""))
    code = F.element_at(F.array(F.lit("10101"), F.lit("10502"), F.lit("99999")), (F.col("l_partkey") % 3 + 1).cast("int"))
    return t.raw().select(
        F.col("id_hecho").cast("string").alias("id_doc_denuncia"), F.date_format(F.expr("timestampadd(HOUR, hora, fecha)"), "yyyy/MM/dd HH:mm:ss").alias("FECHA_HORA_HECHO"),
        F.col("distrito").alias("DIST_HECHO"), place("latitud").alias("xx"), place("longitud").alias("yy"), F.lit("PATRIMONIO").alias("TIPO"), code.alias("ID_SUBTIPO"),
        F.col("subtipo").alias("SUB_TIPO"), F.lit("0000000").alias("ID_MODALIDAD"), F.col("modalidad").alias("MODALIDAD"), shift.alias("TURNO"), F.year("fecha").alias("anio"))


_NORM = "greatest(peso, CASE l_partkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 1 END)"


@query("S01_delimited_reader", "distrito:s filas:l peso:l", f"WITH {INC} SELECT distrito, count(*) AS filas, sum(l_linenumber) AS peso FROM inc0 GROUP BY distrito")
def _(t):
    path = _folder(t, "s01")
    t.raw().select("fila", "distrito", "modalidad", "l_linenumber").write.csv(path, sep=";", header=True)
    back = readers.read_delimited(t.spark, path, ["distrito", "l_linenumber"])
    return back.groupBy("distrito").agg(F.count(F.lit(1)).alias("filas"), F.sum(F.col("l_linenumber").cast("long")).alias("peso"))


def _year_files(t):
    """Yearly files with what goes wrong in such files: a byte-order mark, commas in one year, rows of another year, lines with extra fields, rows without a date."""
    rows, paths = _yearly(t), {}
    key = F.col("id_doc_denuncia").cast("long")
    bad = rows.withColumn("MODALIDAD", F.when(key % 97 == 5, F.lit("robo|de|mas")).otherwise(F.col("MODALIDAD"))).withColumn(
        "FECHA_HORA_HECHO", F.when(key % 89 == 7, F.lit("ayer")).when(key % 83 == 11, F.concat(F.lit("1980"), F.substring("FECHA_HORA_HECHO", 5, 20))).otherwise(F.col("FECHA_HORA_HECHO")))
    for year in sorted({int(p[:4]) for p in t.calendar.periods()}):
        sep = "," if year == 1997 else ";"
        own = bad.filter(F.col("anio") == year).drop("anio").withColumn("MODALIDAD", F.translate("MODALIDAD", "|", sep))
        named = own.withColumnRenamed("id_doc_denuncia", "\ufeffid_doc_denuncia") if year == 1998 else own
        paths[year] = _folder(t, f"s02-{year}")
        named.write.option("quote", "").csv(paths[year], sep=sep, header=True)
    return readers.read_years(t.spark, paths)


_FAULT = "CASE WHEN id_hecho % 97 = 5 THEN 'malformada' WHEN id_hecho % 89 = 7 THEN 'sin fecha' WHEN id_hecho % 83 = 11 THEN 'otro anio' END"


@query("S02_yearly_sources", "periodo:s filas:l ubicados:l peso:l", f"WITH {INC} SELECT periodo, count(*) AS filas, count(*) FILTER (geo) AS ubicados, sum({_NORM}) AS peso FROM inc WHERE {_FAULT} IS NULL GROUP BY periodo")
def _(t):
    rows = clean.normalize_yearly(_year_files(t)[0], F.col("anio"))
    return rows.groupBy("periodo").agg(F.count(F.lit(1)).alias("filas"), F.count("latitud").alias("ubicados"), F.sum("peso_delito").alias("peso"))


@query("S02_yearly_rejected", "anio:l motivo:s lineas:l aceptadas:l", f"""WITH {INC}, f AS (SELECT year(fecha) AS anio, {_FAULT} AS motivo FROM inc)
SELECT anio, motivo, count(*) AS lineas, any_value(aceptadas) AS aceptadas FROM f JOIN (SELECT anio, count(*) FILTER (motivo IS NULL) AS aceptadas FROM f GROUP BY anio) USING (anio) WHERE motivo IS NOT NULL GROUP BY anio, motivo""")
def _(t):
    rows, rejected = _year_files(t)
    return rejected.groupBy("anio", "motivo").agg(F.count(F.lit(1)).alias("lineas")).join(rows.groupBy("anio").agg(F.count(F.lit(1)).alias("aceptadas")), "anio")


@query("S03_required_headers", "encabezado:s filas:l", f"WITH {INC} SELECT unnest({list(clean.REQUIRED_HEADERS)!r}) AS encabezado, (SELECT count(*) FROM inc0) AS filas")
def _(t):
    rows = clean.require_headers(_yearly(t))
    names = F.explode(F.array(*[F.lit(c) for c in clean.REQUIRED_HEADERS])).alias("encabezado")
    return rows.select(names).groupBy("encabezado").agg(F.count(F.lit(1)).alias("filas"))


@query("S04_normalised_sink", "periodo:s categoria_delito:s filas:l peso:l", f"WITH {INC} SELECT periodo, categoria AS categoria_delito, count(*) AS filas, sum({_NORM}) AS peso FROM inc WHERE geo GROUP BY periodo, categoria")
def _(t):
    path = _folder(t, "s04")
    rows = clean.normalize_yearly(_yearly(t), F.col("anio")).filter("latitud IS NOT NULL").select(*clean.NORMAL_FIELDS)
    readers.write_partitioned(rows, path, "periodo")
    back = t.spark.read.parquet(path)
    return back.groupBy("periodo", "categoria_delito").agg(F.count(F.lit(1)).alias("filas"), F.sum("peso_delito").alias("peso"))


@query("S05_pruned_segments", "tramo_id:s latitud:d longitud:d longitud_m:d", f"WITH {SEG} SELECT * FROM seg")
def _(t):
    return t.segments().select("tramo_id", "latitud", "longitud", "longitud_m")


@query("S06_period_scan", "periodo:s n:l", f"WITH {INC} SELECT periodo, count(*) AS n FROM inc0 WHERE periodo BETWEEN '1998-03' AND '1999-02' GROUP BY periodo")
def _(t):
    scan = t.table("lineitem").filter((F.col("l_shipdate") >= "1998-03-01") & (F.col("l_shipdate") < "1999-03-01"))
    return scan.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("periodo")).agg(F.count(F.lit(1)).alias("n"))


@query("S07_cube_store", "mes_idx:l celdas:l n:l peso:d", f"WITH {INC}, {CUBE} SELECT mes_idx, count(*) AS celdas, sum(n) AS n, sum(peso) AS peso FROM cubo GROUP BY mes_idx")
def _(t):
    path = _folder(t, "s07")
    readers.write_partitioned(t.cube(), path, "mes_idx")
    return t.spark.read.parquet(path).groupBy("mes_idx").agg(F.count(F.lit(1)).alias("celdas"), F.sum("n").alias("n"), F.sum("peso").alias("peso"))


@query("S08_panel_store", "periodo:s celdas:l n:d", f"WITH {INC}, {SEG}, {MONTHLY}, {DENSE_MONTHS} SELECT strftime(DATE '1995-01-01' + to_months(mes_idx::INTEGER), '%Y-%m') AS periodo, count(*) AS celdas, sum(frecuencia) AS n FROM panel GROUP BY mes_idx")
def _(t):
    path = _folder(t, "s08")
    readers.write_partitioned(t.dense_months().withColumn("periodo", t.calendar.period_of(F.col("mes_idx"))), path, "periodo")
    return t.spark.read.parquet(path).groupBy("periodo").agg(F.count(F.lit(1)).alias("celdas"), F.sum("frecuencia").alias("n"))


_WIDE = f"""WITH {PROBA}, s AS (SELECT tramo_id, turno_idx, avg(p1) AS p1, avg(p2) AS p2 FROM proba GROUP BY tramo_id, turno_idx), w AS (SELECT tramo_id, turno_idx, least(0.5 * p1 + p2, 1.0) AS sc,
 CASE WHEN p2 >= 0.4 THEN 'alto' WHEN p1 >= 0.34 THEN 'medio' ELSE 'bajo' END AS nv FROM s)"""


def _scored(t):
    s = t.proba().groupBy("tramo_id", "turno_idx").agg(F.avg("p1").alias("p1"), F.avg("p2").alias("p2"))
    return s.withColumn("clase", F.when(F.col("p2") >= 0.4, 2).when(F.col("p1") >= 0.34, 1).otherwise(0))


@query("S10_wide_forecast", "tramo_id:s riesgo_score:d9 riesgo_score_madrugada:d9 riesgo_score_noche:d9 nivel_riesgo_tarde:s", f"""
{_WIDE} SELECT tramo_id, avg(sc) AS riesgo_score, max(sc) FILTER (turno_idx = 0) AS riesgo_score_madrugada, max(sc) FILTER (turno_idx = 3) AS riesgo_score_noche, max(nv) FILTER (turno_idx = 2) AS nivel_riesgo_tarde FROM w GROUP BY tramo_id""")
def _(t):
    return forecast.wide_forecast(_scored(t))


@query("S11_forecast_load", "tramo_id:s turno:s score:d nivel:s", f"""
WITH {PROBA}, w AS (SELECT id AS tramo_id, p2 * 2 - 0.1 AS raw, id % 7 = 0 AS malo, id % 3 = 0 AS sin_turno, p1, p2 FROM proba), b AS (SELECT tramo_id, least(greatest(raw, 0), 1) AS base, sin_turno, p1 FROM w WHERE NOT malo)
SELECT tramo_id, t.turno, CASE WHEN sin_turno THEN base ELSE p1 END AS score, {level('(CASE WHEN sin_turno THEN base ELSE p1 END)')} AS nivel FROM b, (VALUES ('madrugada'), ('manana'), ('tarde'), ('noche')) t(turno)""")
def _(t):
    p = t.proba()
    raw = p.select(F.col("id").cast("string").alias("tramo_id"), F.when(F.col("id") % 7 == 0, F.lit("n/d")).otherwise((F.col("p2") * 2 - 0.1).cast("string")).alias("riesgo_score"),
                   F.lit("-12.1").alias("latitud"), F.lit("-77.0").alias("longitud"), F.lit("").alias("nivel_riesgo"),
                   *[F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.col("p1").cast("string")).alias(f"riesgo_score_{s}") for s in SHIFTS])
    return forecast.by_shift(forecast.repaired_forecast(raw))


@query("S12_model_catalog", "clave:s nombre:s por_defecto:l")
def _(t):
    path = _folder(t, "s12")
    for key in ("random_forest", "xgboost"):
        t.proba().agg(F.avg(F.when(F.col("y") == 2, 1.0).otherwise(0.0)).alias("accuracy")).withColumn("modelo", F.lit(key)).coalesce(1).write.csv(f"{path}/metricas_{key}.csv", header=True)
    return readers.model_catalog(t.spark, path, {"random_forest": "Bosque", "xgboost": "Impulso", "lstm": "Secuencia"}, "xgboost")


@query("S13_audit_sink", "periodo:s total:l geolocalizados:l cobertura:d", f"WITH {INC}, {COVER} SELECT * FROM cob")
def _(t):
    path = _folder(t, "s13")
    readers.write_audit(panel.coverage(t.raw()), path)
    return t.spark.read.json(path)


@query("S15_input_fingerprint", "igual:l distinto:l reutiliza:l archivos:l")
def _(t):
    path = _folder(t, "s15")
    a, b = readers.fingerprint(t.table("lineitem"), {"radio": 300}), readers.fingerprint(t.table("lineitem"), {"radio": 200})
    again = readers.fingerprint(t.table("lineitem"), {"radio": 300})
    readers.store_fingerprint(t.spark, path, a)
    ok = readers.reusable(t.spark, path, again)
    return readers.file_manifest(t.table("lineitem")).agg(F.count(F.lit(1)).alias("archivos")).select(F.lit(int(a == again)).alias("igual"), F.lit(int(a != b)).alias("distinto"), F.lit(int(ok)).alias("reutiliza"), "archivos")


@query("S16_tagged_sources", "fuente:s periodo:s n:l", f"""
WITH {INC}, u AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS fuente, * FROM inc0), d AS (SELECT *, row_number() OVER (PARTITION BY id_hecho ORDER BY fecha DESC, fila DESC) AS rn FROM u)
SELECT fuente, periodo, count(*) AS n FROM d WHERE rn = 1 AND periodo BETWEEN '1996-01' AND '2000-12' GROUP BY fuente, periodo""")
def _(t):
    from tramorisk.operators.ordered import last_by

    raw = t.raw().select("id_hecho", "fila", "fecha", "periodo", "l_orderkey")
    both = readers.tagged_union({"a": raw.filter("l_orderkey % 3 = 0"), "b": raw.filter("l_orderkey % 3 <> 0")})
    latest = last_by(both, ["id_hecho"], [F.col("fecha"), F.col("fila")])
    return readers.only_periods(latest, "1996-01", "2000-12").groupBy("fuente", "periodo").agg(F.count(F.lit(1)).alias("n"))


@query("S17_assignment_table", "nivel_coincidencia:s filas:l")
def _(t):
    from tramorisk.plans.catalog_spatial import _deck

    path = _folder(t, "s17")
    _deck(t).write.parquet(path)
    return t.spark.read.parquet(path).groupBy("nivel_coincidencia").agg(F.count(F.lit(1)).alias("filas"))


@query("S18_registered_forecast", "periodo:s filas:l repetido:l")
def _(t):
    path = _folder(t, "s18")
    readers.register_forecast(t.spark, _scored(t), path, "2001-12", ["tramo_id", "turno_idx", "p1", "p2"])
    try:
        readers.register_forecast(t.spark, _scored(t), path, "2001-12", ["tramo_id", "turno_idx", "p1", "p2"])
        refused = 0
    except ValueError:
        refused = 1
    return readers.registered_forecasts(t.spark, path).select("periodo", "filas", F.lit(refused).alias("repetido"))
