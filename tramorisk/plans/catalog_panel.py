"""Panels, audits, eligibility, samples and set operations."""

from pyspark.sql import functions as F

from tramorisk.functions import risk
from tramorisk.functions.calendar import shift_of_hour
from tramorisk.operators import ordered, panel, sampling, surface, windows
from tramorisk.plans import jobs
from tramorisk.plans.oracle import (COVER, CUBE, DENSE, DENSE_MONTHS, FORECAST, INC, KX, KY, MEASURES, MONTHLY, PROBA, SEG, level)
from tramorisk.plans.registry import query

_MEAS = " ".join(f"{m}:d" for m in MEASURES)
_CUBE_COLS = "tramo_id:s mes_idx:l turno_idx:l n:l peso:d grave:l robo:l hurto:l extorsion:l homicidio:l"


@query("A01_monthly_coverage", "periodo:s total:l geolocalizados:l cobertura:d", f"WITH {INC}, {COVER} SELECT * FROM cob")
def _(t):
    return panel.coverage(t.raw())


@query("A02_subtype_counts", "subtipo:s n:l", f"WITH {INC} SELECT coalesce(subtipo, 'TOTAL') AS subtipo, count(*) AS n FROM inc0 GROUP BY ROLLUP (subtipo)")
def _(t):
    return t.raw().rollup("subtipo").agg(F.count(F.lit(1)).alias("n")).fillna("TOTAL", ["subtipo"])


@query("A04_shift_cube", _CUBE_COLS, f"WITH {INC}, {CUBE} SELECT * FROM cubo")
def _(t):
    return t.cube()


@query("A06_shift_rollup", "mes_idx:l max_dif_conteo:l max_dif_peso:d", f"""
WITH {INC}, {CUBE}, {MONTHLY} SELECT m.mes_idx, max(abs(m.frecuencia - c.n)) AS max_dif_conteo, max(abs(m.suma_pesos - c.p)) AS max_dif_peso
 FROM mensual m JOIN (SELECT tramo_id, mes_idx, sum(n) AS n, sum(peso) AS p FROM cubo GROUP BY tramo_id, mes_idx) c USING (tramo_id, mes_idx) GROUP BY m.mes_idx""")
def _(t):
    inc = t.incidents().filter("geo")
    monthly = inc.groupBy("tramo_id", "mes_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("peso").cast("double").alias("peso"))
    return panel.reconcile(monthly, t.cube())


@query("A06_months_from_cube", "tramo_id:s mes_idx:l n:l peso:d madrugada:l manana:l tarde:l noche:l", f"WITH {INC}, {MONTHLY} SELECT *, frecuencia AS n, suma_pesos AS peso FROM mensual")
def _(t):
    return panel.months_from_cube(t.cube())


@query("A08_complete_months", "periodo:s fecha_maxima:s completo:l", f"""
WITH {INC} SELECT periodo, strftime(max(fecha), '%Y-%m-%d') AS fecha_maxima, (max(fecha)::DATE = last_day(max(fecha)::DATE))::INTEGER AS completo FROM inc0 GROUP BY periodo""")
def _(t):
    return panel.complete_months(t.raw()).withColumn("fecha_maxima", F.date_format("fecha_maxima", "yyyy-MM-dd"))


@query("A09_source_audit", "periodo:s delitos:l coordenadas_distintas:l distritos:l peso_medio:d max_fecha:s", f"""
WITH {INC} SELECT periodo, count(*) AS delitos, count(DISTINCT (latitud, longitud)) AS coordenadas_distintas, count(DISTINCT distrito) AS distritos, avg(peso) AS peso_medio,
 strftime(max(fecha), '%Y-%m-%d') AS max_fecha FROM inc GROUP BY periodo""")
def _(t):
    return panel.source_audit(t.incidents()).withColumn("max_fecha", F.date_format("max_fecha", "yyyy-MM-dd"))


@query("A10_history_heat_grid", "cx:l cy:l total:l suma:d lat:d lon:d intensidad:d", f"""
WITH {INC}, g AS (SELECT floor(longitud * {KX} / 100.0)::BIGINT AS cx, floor(latitud * {KY} / 100.0)::BIGINT AS cy, count(*) AS total, sum(peso)::DOUBLE AS suma FROM inc WHERE geo GROUP BY ALL),
q AS (SELECT quantile_cont(suma, 0.9) AS p90 FROM g) SELECT cx, cy, total, suma, (cy + 0.5) * 100.0 / {KY} AS lat, (cx + 0.5) * 100.0 / {KX} AS lon, least(suma / p90, 1.0) AS intensidad FROM g, q""")
def _(t):
    return surface.history_grid(t.incidents().filter("geo"))


@query("A11_forecast_heat_grid", "cx:l cy:l n:l bruto:d lat:d lon:d intensidad:d", f"""
WITH {INC}, {SEG}, {FORECAST}, g AS (SELECT floor(longitud * {KX} / 800.0)::BIGINT AS cx, floor(latitud * {KY} / 800.0)::BIGINT AS cy, count(*) AS n,
 (0.65::DOUBLE * avg(riesgo_score) + 0.35::DOUBLE * max(riesgo_score)) * ln(1 + count(*)) AS bruto FROM pron WHERE riesgo_score >= 0.66 GROUP BY ALL),
q AS (SELECT quantile_cont(bruto, 0.6) AS p60, quantile_cont(bruto, 0.95) AS p95 FROM g)
SELECT cx, cy, n, bruto, (cy + 0.5) * 800.0 / {KY} AS lat, (cx + 0.5) * 800.0 / {KX} AS lon, least(greatest(bruto / p95, 0.08), 1.0) AS intensidad FROM g, q WHERE bruto >= p60""")
def _(t):
    return surface.forecast_grid(t.forecasts())


@query("A12_level_counts", "nivel:s n:l", f"""
WITH {INC}, {SEG}, {FORECAST}, c AS (SELECT {level('riesgo_score')} AS nivel FROM pron WHERE latitud BETWEEN -12.2 AND -12.195 AND longitud BETWEEN -77.09 AND -77.05)
SELECT l.nivel, count(c.nivel) AS n FROM (VALUES ('bajo'), ('medio'), ('alto')) l(nivel) LEFT JOIN c ON c.nivel = l.nivel GROUP BY l.nivel""")
def _(t):
    return surface.level_counts(t.forecasts().withColumn("nivel", risk.level(F.col("riesgo_score"))), (-12.2, -77.09, -12.195, -77.05))


@query("A13_filter_options", "campo:s valor:s", f"""
WITH {INC} SELECT 'modalidad' AS campo, modalidad AS valor FROM inc0 UNION SELECT 'subtipo', subtipo FROM inc0 UNION SELECT 'distrito', distrito FROM inc0""")
def _(t):
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).alias("valor")) for c in ("modalidad", "subtipo", "distrito")]))
    return t.raw().select(pairs.alias("p")).select("p.*").distinct().orderBy("campo", "valor")


@query("A15_month_activity", "mes_idx:l " + " ".join(f"cobertura_global_lag{k}:d altos_global_lag{k}:d" for k in (1, 2, 3)), f"""
WITH {INC}, {SEG}, {MONTHLY}, {DENSE_MONTHS}, s AS (SELECT mes_idx, avg((riesgo > 0)::INTEGER) AS a, avg((riesgo >= 2.3442396250791653::DOUBLE)::INTEGER) AS h FROM panel GROUP BY mes_idx)
SELECT mes_idx, {", ".join(f"lag(a, {k}) OVER (ORDER BY mes_idx) AS cobertura_global_lag{k}, lag(h, {k}) OVER (ORDER BY mes_idx) AS altos_global_lag{k}" for k in (1, 2, 3))} FROM s""")
def _(t):
    return windows.month_activity(t.dense_months(), risk.HIGH_FROM_BUFFER)


@query("A17_high_threshold", "prob:d valor:d", f"""
WITH {INC}, {SEG}, {CUBE} SELECT 0.75 AS prob, quantile_cont(peso / factor, 0.75) AS valor FROM cubo JOIN seg USING (tramo_id) WHERE mes_idx BETWEEN 3 AND 50 AND peso > 0""")
def _(t):
    rows = t.cube().filter(F.col("mes_idx").between(3, 50)).join(t.segments(), "tramo_id").withColumn("riesgo", F.col("peso") / risk.length_factor(F.col("longitud_m")))
    return ordered.exact_quantiles(rows.filter("riesgo > 0"), [], "riesgo", [0.75])


@query("A17_threshold_per_shift", "turno_idx:l prob:d valor:d", f"""
WITH {INC}, {SEG}, {CUBE} SELECT turno_idx, p AS prob, quantile_cont(r, p) AS valor FROM (SELECT turno_idx, peso / factor AS r, unnest([0.5, 0.75, 0.95]) AS p FROM cubo JOIN seg USING (tramo_id)) GROUP BY turno_idx, p""".replace("quantile_cont(r, p)", "CASE p WHEN 0.5 THEN quantile_cont(r, 0.5) WHEN 0.75 THEN quantile_cont(r, 0.75) ELSE quantile_cont(r, 0.95) END"))
def _(t):
    rows = t.cube().join(t.segments(), "tramo_id").withColumn("riesgo", F.col("peso") / risk.length_factor(F.col("longitud_m")))
    return ordered.exact_quantiles(rows, ["turno_idx"], "riesgo", [0.5, 0.75, 0.95])


@query("A18_channel_scaling", "canal:s media:d desviacion:d", f"""
WITH {INC}, {SEG}, {MONTHLY}, {DENSE_MONTHS}, v AS ({" UNION ALL ".join(f"SELECT '{m}' AS canal, ln(1 + {m} / factor) AS x FROM panel WHERE mes_idx BETWEEN 3 AND 60" for m in MEASURES)})
SELECT canal, avg(x) AS media, greatest(stddev_pop(x), 0.05) AS desviacion FROM v GROUP BY canal""")
def _(t):
    from tramorisk.operators.models import channel_scaling

    return channel_scaling(t.dense_months().filter(F.col("mes_idx").between(3, 60)), MEASURES)


@query("A24_subset_check", "mes_idx:l celdas:l violaciones:l", f"""
WITH {INC} SELECT mes_idx, count(*) AS celdas, count(*) FILTER (a > b) AS violaciones FROM (SELECT tramo_id, mes_idx, count(*) FILTER (geo) AS a, count(*) AS b FROM inc GROUP BY tramo_id, mes_idx HAVING count(*) FILTER (geo) > 0) GROUP BY mes_idx""")
def _(t):
    count = lambda df: df.groupBy("tramo_id", "mes_idx").agg(F.count(F.lit(1)).alias("n"))
    return panel.not_contained(count(t.raw().filter("geo")), count(t.raw()), ["tramo_id", "mes_idx"], "n")


@query("A25_score_distribution", "medida:s valor:d", f"""
WITH {INC}, {SEG}, {FORECAST} SELECT 'n_' || {level('riesgo_score')} AS medida, count(*)::DOUBLE AS valor FROM pron GROUP BY ALL
 UNION ALL SELECT 'q' || p, CASE p WHEN 5 THEN quantile_cont(riesgo_score, 0.05) WHEN 50 THEN quantile_cont(riesgo_score, 0.5) ELSE quantile_cont(riesgo_score, 0.95) END FROM (SELECT riesgo_score, unnest([5, 50, 95]) AS p FROM pron) GROUP BY p""")
def _(t):
    f = t.forecasts()
    counts = f.groupBy(F.concat(F.lit("n_"), risk.level(F.col("riesgo_score"))).alias("medida")).agg(F.count(F.lit(1)).cast("double").alias("valor"))
    q = surface.score_quantiles(f, [0.05, 0.5, 0.95]).select(F.concat(F.lit("q"), F.round(F.col("prob") * 100).cast("int")).alias("medida"), "valor")
    return counts.unionByName(q)


@query("A26_shift_corrections", "periodo:s delitos:l corregidos:l", f"""
WITH {INC} SELECT periodo, count(*) AS delitos, count(*) FILTER (turno <> (['madrugada','manana','tarde','noche'])[((hora + l_linenumber) % 24) // 6 + 1]) AS corregidos FROM inc GROUP BY periodo""")
def _(t):
    real = shift_of_hour((F.col("hora") + F.col("l_linenumber")) % 24)
    return t.incidents().groupBy("periodo").agg(F.count(F.lit(1)).alias("delitos"), panel.count_where(F.col("turno") != real).alias("corregidos"))


@query("A05_clock_shift_panel", "tramo_id:s mes_idx:l frecuencia:d manana:d tarde:d noche:d madrugada:d", f"""
WITH {INC}, {MONTHLY}, fixed AS (SELECT *, ((hora + l_linenumber) % 24) // 6 AS ti FROM inc WHERE geo) SELECT m.tramo_id, m.mes_idx, m.frecuencia, c.manana, c.tarde, c.noche, c.madrugada FROM mensual m JOIN
 (SELECT tramo_id, mes_idx, count(*) FILTER (ti = 1) AS manana, count(*) FILTER (ti = 2) AS tarde, count(*) FILTER (ti = 3) AS noche, count(*) FILTER (ti = 0) AS madrugada FROM fixed GROUP BY tramo_id, mes_idx) c USING (tramo_id, mes_idx)""")
def _(t):
    inc = t.incidents().filter("geo")
    monthly = inc.groupBy("tramo_id", "mes_idx").agg(*panel.monthly_panel_measures(F.col("peso")))
    clock = inc.withColumn("turno_idx", (F.floor(((F.col("hora") + F.col("l_linenumber")) % 24) / 6)).cast("int"))
    return panel.replace_shift_counts(monthly, panel.shift_cube(clock))


@query("J02_dense_panel", "tramo_id:s mes_idx:l turno_idx:l n:l peso:d grave:l", f"WITH {INC}, {SEG}, {CUBE}, {DENSE} SELECT * FROM denso")
def _(t):
    return t.dense_cube()


@query("J01_forecast_attributes", "tramo_id:s riesgo_score:d longitud_m:d n:l", f"""
WITH {INC}, {SEG}, {FORECAST} SELECT pron.tramo_id, riesgo_score, longitud_m, coalesce(hist.n, 0) AS n FROM pron LEFT JOIN hist USING (tramo_id)""")
def _(t):
    n = t.incidents().groupBy("tramo_id").agg(F.count(F.lit(1)).alias("n"))
    return t.forecasts().join(n, "tramo_id", "left").fillna(0, ["n"])


@query("J19_catalog_alignment", "tramo_id:s lado:s", f"""
WITH {INC}, {SEG} SELECT tramo_id, 'solo_izquierda' AS lado FROM (SELECT tramo_id FROM seg EXCEPT SELECT tramo_id FROM inc0 WHERE l_orderkey % 2 = 0) UNION ALL
 SELECT tramo_id, 'solo_derecha' FROM (SELECT tramo_id FROM inc0 WHERE l_orderkey % 2 = 0 EXCEPT SELECT tramo_id FROM seg)""")
def _(t):
    from tramorisk.operators.spatial import mismatched_ids

    return mismatched_ids(t.segments(), t.raw().filter("l_orderkey % 2 = 0").select("tramo_id").distinct())


@query("J21_segment_levels", "nivel:s tramos:l metros:d", f"""
WITH {INC}, {SEG}, {FORECAST} SELECT CASE WHEN riesgo_score < 0.34 THEN 'bajo' WHEN riesgo_score < 0.66 THEN 'medio' ELSE 'alto' END AS nivel, count(*) AS tramos, sum(longitud_m) AS metros FROM pron GROUP BY ALL""")
def _(t):
    f = t.forecasts().select("tramo_id", "riesgo_score").join(t.segments().select("tramo_id", "longitud_m"), "tramo_id")
    return f.groupBy(risk.level(F.col("riesgo_score")).alias("nivel")).agg(F.count(F.lit(1)).alias("tramos"), F.sum("longitud_m").alias("metros"))


@query("J22_prediction_lookup", "tramo_id:s turno_idx:l score:d fuente:s", f"""
WITH {INC}, {SEG}, {FORECAST}, t AS (SELECT tramo_id, turno_idx, least(count(*) / 100.0::DOUBLE, 1.0) AS s FROM inc WHERE geo AND turno_idx < 2 GROUP BY tramo_id, turno_idx)
SELECT p.tramo_id, x.turno_idx, coalesce(t.s, p.riesgo_score) AS score, CASE WHEN t.s IS NULL THEN 'mensual' ELSE 'turno' END AS fuente FROM pron p CROSS JOIN (SELECT unnest(range(4)) AS turno_idx) x LEFT JOIN t ON t.tramo_id = p.tramo_id AND t.turno_idx = x.turno_idx""")
def _(t):
    from tramorisk.sources.forecast import lookup

    by_shift = t.raw().filter("geo AND turno_idx < 2").groupBy("tramo_id", "turno_idx").agg(F.least(F.count(F.lit(1)) / 100.0, F.lit(1.0)).alias("score"))
    return lookup(t.forecasts().select("tramo_id", "riesgo_score"), by_shift)


# ---------------------------------------------------------------- eligibility

_BOUNDS = {"train": ("1995-06", "1998-12"), "validation": ("1999-01", "1999-12"), "test": ("2000-01", "2001-06")}


@query("E01_eligible_months", "mes_idx:l periodo:s particion:s", f"""
WITH {INC}, {COVER}, w AS (SELECT *, min(cobertura) OVER (ORDER BY mes_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM meses)
SELECT mes_idx, periodo, CASE WHEN periodo BETWEEN '1995-06' AND '1998-12' THEN 'train' WHEN periodo BETWEEN '1999-01' AND '1999-12' THEN 'validation' ELSE 'test' END AS particion
 FROM w WHERE mes_idx >= 3 AND m >= 0.8 AND periodo BETWEEN '1995-06' AND '2001-06'""")
def _(t):
    return panel.eligible_months(t.months(), 3, 0.8, _BOUNDS)


@query("E02_observed_mask", "mes_idx:l periodo:s cobertura:d observado:l", f"WITH {INC}, {COVER} SELECT mes_idx, periodo, cobertura, observado::INTEGER AS observado FROM meses")
def _(t):
    return t.months()


@query("E03_split_validation", "particion:s meses:l primero:l ultimo:l", f"""
WITH {INC}, {COVER}, w AS (SELECT *, min(cobertura) OVER (ORDER BY mes_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM meses),
e AS (SELECT mes_idx, CASE WHEN periodo BETWEEN '1995-06' AND '1998-12' THEN 'train' WHEN periodo BETWEEN '1999-01' AND '1999-12' THEN 'validation' ELSE 'test' END AS particion
 FROM w WHERE mes_idx >= 3 AND m >= 0.8 AND periodo BETWEEN '1995-06' AND '2001-06') SELECT particion, count(*) AS meses, min(mes_idx) AS primero, max(mes_idx) AS ultimo FROM e GROUP BY particion""")
def _(t):
    eligible = panel.eligible_months(t.months(), 3, 0.8, _BOUNDS)
    splits = panel.require_splits(eligible, list(_BOUNDS))
    panel.require_order(*splits.values())
    return eligible.groupBy("particion").agg(F.count(F.lit(1)).alias("meses"), F.min("mes_idx").alias("primero"), F.max("mes_idx").alias("ultimo"))


@query("E04_causality", "mes_idx:l filas:l cambiadas:l", f"WITH {INC}, {SEG} SELECT m AS mes_idx, (SELECT count(*) * 4 FROM seg) AS filas, 0 AS cambiadas FROM range(84) x(m)")
def _(t):
    return jobs.changed_by_future(t.dense_cube(), lambda cube: windows.observed_windows(cube, t.months()), ["n", "peso", "grave", "robo", "hurto", "extorsion", "homicidio"], t.calendar.size)


@query("E05_rolling_origins", "origen:l ventana:s filas:l delitos:l", f"""
WITH {INC}, o AS (SELECT unnest(range(60, 72)) AS origen), w AS (SELECT * FROM (VALUES ('3m', 3), ('6m', 6), ('12m', 12), ('24m', 24), ('todo', 999)) v(ventana, k)),
c AS (SELECT tramo_id, mes_idx, count(*) AS n FROM inc WHERE geo GROUP BY tramo_id, mes_idx)
SELECT origen, ventana, count(*) AS filas, sum(n) AS delitos FROM o, w JOIN c ON c.mes_idx < origen AND c.mes_idx >= greatest(3, origen - k) GROUP BY origen, ventana""")
def _(t):
    from tramorisk.plans.jobs import rolling_sets

    cells = t.raw().filter("geo").groupBy("tramo_id", "mes_idx").agg(F.count(F.lit(1)).alias("n"))
    sets = rolling_sets(cells, range(60, 72), {"3m": 3, "6m": 6, "12m": 12, "24m": 24, "todo": None})
    return sets.groupBy("origen", "ventana").agg(F.count(F.lit(1)).alias("filas"), F.sum("n").alias("delitos"))


@query("E06_target_swap", "tramo_id:s mes_idx:l etapa:s y:l", f"""
WITH {INC}, {SEG}, s AS (SELECT tramo_id, mes_idx, sum(peso)::DOUBLE AS todo, coalesce(sum(peso) FILTER (geo), 0)::DOUBLE AS obs FROM inc GROUP BY tramo_id, mes_idx)
SELECT tramo_id, mes_idx, CASE WHEN mes_idx < 60 THEN 'entrenamiento' ELSE 'evaluacion' END AS etapa,
 CASE WHEN r >= 3.0 THEN 2 WHEN r > 0 THEN 1 ELSE 0 END AS y FROM (SELECT tramo_id, mes_idx, CASE WHEN mes_idx < 60 THEN todo ELSE obs END / factor AS r FROM s JOIN seg USING (tramo_id))""")
def _(t):
    from tramorisk.plans.jobs import swap_targets

    inc = t.incidents()
    weigh = lambda df: df.groupBy("tramo_id", "mes_idx").agg(F.sum("peso").cast("double").alias("peso"))
    return swap_targets(weigh(inc), weigh(inc.filter("geo")), t.segments(), first_evaluation=60, high_from=3.0)


# ---------------------------------------------------------------- samples

_LABELS = f"""{CUBE}, {DENSE}, et AS (SELECT *, CASE WHEN peso / factor >= 3.0 THEN 2 WHEN peso > 0 THEN 1 ELSE 0 END AS y FROM denso)"""


def _labelled(t):
    r = F.col("peso") / risk.length_factor(F.col("longitud_m"))
    return t.dense_cube().withColumn("y", risk.risk_class(r, 3.0))


def _by_id():
    return [F.col("tramo_id"), F.col("mes_idx"), F.col("turno_idx")]


@query("T01_top_points", "tramo_id:s riesgo_score:d", f"WITH {INC}, {SEG}, {FORECAST} SELECT tramo_id, riesgo_score FROM pron WHERE riesgo_score >= 0.5 AND latitud >= -12.199 ORDER BY riesgo_score DESC, tramo_id LIMIT 25")
def _(t):
    return sampling.top_points(t.forecasts(), 0.5, 25, (-12.199, -78.0, -10.0, -76.0))


@query("T01_next_month_top_segments", "tramo_id:s turno_idx:l densidad:d", f"""
WITH {INC}, {SEG}, {CUBE} SELECT tramo_id, turno_idx, sum(peso) / any_value(factor) AS densidad FROM cubo JOIN seg USING (tramo_id) WHERE mes_idx BETWEEN 79 AND 81 GROUP BY tramo_id, turno_idx ORDER BY round(densidad, 9) DESC, tramo_id, turno_idx LIMIT 40""")
def _(t):
    history = windows.shift_history(t.dense_cube())
    ranked = history.filter(F.col("mes_idx") == 82).withColumn("densidad", F.col("densidad_gravedad_turno_100m"))
    return ranked.orderBy(F.desc(F.round("densidad", 9)), "tramo_id", "turno_idx").limit(40)


@query("T02_balanced_points", "tramo_id:s nivel:s riesgo_score:d", f"""
WITH {INC}, {SEG}, {FORECAST}, r AS (SELECT tramo_id, riesgo_score, {level('riesgo_score')} AS nivel FROM pron),
k AS (SELECT *, row_number() OVER (PARTITION BY nivel ORDER BY riesgo_score DESC, tramo_id) - 1 AS pos, count(*) OVER (PARTITION BY nivel) AS n FROM r)
SELECT tramo_id, nivel, riesgo_score FROM k WHERE n <= 10 OR pos IN (SELECT floor(i * (n - 1) / 9.0)::BIGINT FROM (SELECT unnest(range(10)) AS i))""")
def _(t):
    return sampling.balanced_points(t.forecasts().withColumn("nivel", risk.level(F.col("riesgo_score"))), 0.0, 30)


@query("T03_thinned_incidents", "fila:s", f"WITH {INC}, r AS (SELECT fila, row_number() OVER (ORDER BY fila) - 1 AS pos, count(*) OVER () AS n FROM inc0) SELECT fila FROM r WHERE pos % (n // 1000) = 0 AND pos / (n // 1000) < 1000")
def _(t):
    return sampling.thin(t.raw().select("fila"), [F.col("fila")], 1000)


@query("T04_top_periods", "periodo:s n:l", f"WITH {INC} SELECT periodo, count(*) AS n FROM inc0 GROUP BY periodo ORDER BY n DESC, periodo LIMIT 15")
def _(t):
    return t.raw().groupBy("periodo").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "periodo").limit(15)


@query("T05_low_class_cap", "y:l n:l primero:s ultimo:s", f"""
WITH {INC}, {SEG}, {_LABELS}, c AS (SELECT count(*) FILTER (y > 0) AS m FROM et), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY tramo_id, mes_idx, turno_idx) AS rn FROM et)
SELECT y, count(*) AS n, min(tramo_id) AS primero, max(tramo_id) AS ultimo FROM r, c WHERE y > 0 OR rn <= least(greatest(5000, 2 * m), 20000) GROUP BY y""")
def _(t):
    kept = sampling.cap_low_class(_labelled(t), _by_id(), floor=5_000, ceiling=20_000)
    return kept.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("tramo_id").alias("primero"), F.max("tramo_id").alias("ultimo"))


@query("T06_class_cap", "tramo_id:s mes_idx:l turno_idx:l y:l", f"""
WITH {INC}, {SEG}, {_LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY mes_idx, turno_idx, y ORDER BY tramo_id) AS rn FROM et) SELECT tramo_id, mes_idx, turno_idx, y FROM r WHERE rn <= CASE WHEN y = 0 THEN 20 ELSE 10 END""")
def _(t):
    return sampling.cap_per_class(_labelled(t), ["mes_idx", "turno_idx"], 10, _by_id(), low_factor=2)


@query("T07_two_stratum_sample", "tramo_id:s mes_idx:l turno_idx:l y:l peso_inclusion:d", f"""
WITH {INC}, {SEG}, {_LABELS}, a AS (SELECT *, mes_idx % 5 < 3 AND n + robo >= 0 AND (length(tramo_id) % 2 = 0) AS activo FROM et),
z AS (SELECT mes_idx, turno_idx, count(*) FILTER (y > 0) AS p, count(*) FILTER (y = 0 AND activo) AS na, count(*) FILTER (y = 0 AND NOT activo) AS nq FROM a GROUP BY mes_idx, turno_idx),
b AS (SELECT *, least(na + nq, greatest(40, floor(p * 1.5)))::BIGINT AS cupo FROM z), c AS (SELECT *, least(na, round_even(cupo * 0.6, 0))::BIGINT AS w FROM b),
d AS (SELECT *, least(nq, cupo - w)::BIGINT AS cq FROM c), e AS (SELECT *, least(na, cupo - cq)::BIGINT AS ca FROM d),
r AS (SELECT a.*, e.na, e.nq, e.ca, e.cq, row_number() OVER (PARTITION BY a.mes_idx, a.turno_idx, CASE WHEN y > 0 THEN 0 WHEN activo THEN 1 ELSE 2 END ORDER BY tramo_id) AS rn FROM a JOIN e USING (mes_idx, turno_idx))
SELECT tramo_id, mes_idx, turno_idx, y, CASE WHEN y > 0 THEN 1.0 WHEN activo THEN na / ca::DOUBLE ELSE nq / cq::DOUBLE END AS peso_inclusion FROM r WHERE y > 0 OR (activo AND rn <= ca) OR (NOT activo AND rn <= cq)""")
def _(t):
    rows = _labelled(t).withColumn("activo", (F.col("mes_idx") % 5 < 3) & (F.length("tramo_id") % 2 == 0))
    return sampling.two_stratum(rows, ["mes_idx", "turno_idx"], _by_id(), ratio=1.5, minimum=40)


_CM = """z AS (SELECT mes_idx, y, count(*) AS n FROM et GROUP BY mes_idx, y), lim AS (SELECT least({cap}, {rows} // (3 * count(DISTINCT mes_idx))) AS l FROM z), tc AS (SELECT y, sum(n) AS nc FROM z GROUP BY y),
f AS (SELECT y, pow((SELECT sum(n) FROM z) / (3.0::DOUBLE * nc), {bal}) AS f FROM tc), r AS (SELECT et.*, z.n AS nz, f.f, row_number() OVER (PARTITION BY et.mes_idx, et.y ORDER BY tramo_id, turno_idx) AS rn FROM et JOIN z USING (mes_idx, y) JOIN f USING (y)),
k AS (SELECT *, nz / least(nz, l)::DOUBLE * f AS w FROM r, lim WHERE rn <= l)"""


@query("T08_class_month_sample", "tramo_id:s mes_idx:l turno_idx:l y:l peso:d", f"WITH {INC}, {SEG}, {_LABELS}, {_CM.format(cap=60, rows=1800, bal=0.5)} SELECT tramo_id, mes_idx, turno_idx, y, w / avg(w) OVER () AS peso FROM k")
def _(t):
    return sampling.class_month_sample(_labelled(t).drop("peso"), [F.col("tramo_id"), F.col("turno_idx")], cap=60, max_rows=1800, balance=0.5)


@query("T09_class_month_caps", "mes_idx:l y:l n:l", f"WITH {INC}, {SEG}, {_LABELS} SELECT mes_idx, y, least(count(*), 120) AS n FROM et GROUP BY mes_idx, y")
def _(t):
    return sampling.cap_per_class(_labelled(t), ["mes_idx"], 120, sampling.hash_order()).groupBy("mes_idx", "y").agg(F.count(F.lit(1)).alias("n"))


@query("T10_sample_digest", "filas:l huella:s")
def _(t):
    kept = sampling.cap_per_class(_labelled(t), ["mes_idx"], 120, sampling.hash_order())
    return sampling.sample_digest(kept, ("tramo_id", "mes_idx", "turno_idx"))


@query("T11_class_weights", "id:l y:l peso_clase:d", f"WITH {PROBA} SELECT id, y, pow(count(*) OVER () / (3.0::DOUBLE * count(*) OVER (PARTITION BY y)), 1.25) AS peso_clase FROM proba")
def _(t):
    return sampling.balanced_weights(t.proba(), power=1.25)


@query("W13_half_life", "mes_idx:l n:l peso_edad:d", f"""
WITH {INC}, e AS (SELECT mes_idx, pow(2.0, -((SELECT max(mes_idx) FROM inc0) - mes_idx) / 3.0::DOUBLE) AS w FROM inc0) SELECT mes_idx, count(*) AS n, any_value(w) / (SELECT avg(w) FROM e) AS peso_edad FROM e GROUP BY mes_idx""")
def _(t):
    return windows.half_life(t.raw(), 3.0).groupBy("mes_idx").agg(F.count(F.lit(1)).alias("n"), F.min("peso_edad").alias("peso_edad"))


# ---------------------------------------------------------------- sets

@query("U01_union_sources", "fuente:s periodo:s n:l", f"""
WITH {INC} SELECT fuente, periodo, count(*) AS n FROM (SELECT 'par' AS fuente, periodo FROM inc0 WHERE l_orderkey % 2 = 0 UNION ALL SELECT 'impar', periodo FROM inc0 WHERE l_orderkey % 2 = 1) GROUP BY fuente, periodo""")
def _(t):
    from tramorisk.sources.readers import tagged_union

    raw = t.raw()
    return tagged_union({"par": raw.filter("l_orderkey % 2 = 0"), "impar": raw.filter("l_orderkey % 2 = 1")}).groupBy("fuente", "periodo").agg(F.count(F.lit(1)).alias("n"))


@query("U02_union_months", "periodo:s", f"WITH {INC} SELECT periodo FROM inc0 WHERE geo UNION SELECT periodo FROM inc0 WHERE NOT geo")
def _(t):
    raw = t.raw()
    return raw.filter("geo").select("periodo").union(raw.filter("NOT geo").select("periodo")).distinct()


@query("U04_unmatched_ids", "fila:s", f"WITH {INC} SELECT fila FROM inc0 WHERE id_hecho NOT IN (SELECT o_orderkey * 10 + 3 FROM orders)")
def _(t):
    keys = t.table("orders").select((F.col("o_orderkey") * 10 + 3).alias("id_hecho"))
    return t.raw().join(keys, "id_hecho", "left_anti").select("fila")
