"""Window features of the dense panels."""

from pyspark.sql import functions as F

from tramorisk.functions import risk
from tramorisk.functions.risk import HIGH_FROM_BUFFER
from tramorisk.operators import evaluate, ordered, panel, spatial, windows
from tramorisk.plans.oracle import COVER, CUBE, DENSE, DENSE_MONTHS, INC, KX, KY, MEASURES, MONTHLY, PROBA, SEG
from tramorisk.plans.registry import query

_PANEL = f"{INC}, {SEG}, {MONTHLY}, {DENSE_MONTHS}"
_SHIFT = f"{INC}, {SEG}, {CUBE}, {DENSE}"
_H = "2.3442396250791653::DOUBLE"



def _over(f: str, by: str = "tramo_id") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY mes_idx {f})"


def _rows(a: int, b: int = 1) -> str:
    return f"ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING"


_PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("W01_previous_totals", "tramo_id:s mes_idx:l " + " ".join(f"{m}_hist:d" for m in MEASURES), f"""
WITH {_PANEL} SELECT tramo_id, mes_idx, {", ".join(f"CASE WHEN mes_idx >= 3 THEN sum({m}) {_over(_rows(3))} END AS {m}_hist" for m in MEASURES)} FROM panel""")
def _(t):
    return windows.previous_totals(t.dense_months(), MEASURES, 3)


@query("W01_previous_maxima", "tramo_id:s mes_idx:l frecuencia_hist:d suma_pesos_hist:d", f"""
WITH {_PANEL} SELECT tramo_id, mes_idx, {", ".join(f"CASE WHEN mes_idx >= 6 THEN max({m}) {_over(_rows(6))} END AS {m}_hist" for m in MEASURES[:2])} FROM panel""")
def _(t):
    return windows.previous_totals(t.dense_months(), MEASURES[:2], 6, "max")


_T = "tramo_id, turno_idx"
_SH = {"frecuencia_turno_3m": "n", "gravedad_turno_3m": "peso", "graves_turno_3m": "grave", "robos_turno_3m": "robo", "hurtos_turno_3m": "hurto",
       "extorsiones_turno_3m": "extorsion", "homicidios_turno_3m": "homicidio", "frecuencia_total_3m": "n_total", "gravedad_total_3m": "peso_total"}


@query("W02_shift_history", "tramo_id:s mes_idx:l turno_idx:l turno_sin:d mes_cos:d " + " ".join(f"{k}:d" for k in _SH) + " densidad_turno_100m:d densidad_gravedad_turno_100m:d riesgo:d", f"""
WITH {_SHIFT}, x AS (SELECT *, sum(n) OVER (PARTITION BY tramo_id, mes_idx) AS n_total, sum(peso) OVER (PARTITION BY tramo_id, mes_idx) AS peso_total FROM denso),
h AS (SELECT tramo_id, mes_idx, turno_idx, factor, sin(2 * pi() * turno_idx / 4) AS turno_sin, cos(2 * pi() * (mes_idx % 12) / 12) AS mes_cos, peso / factor AS riesgo,
 {", ".join(f"coalesce(sum({c}) {_over(_rows(3), _T)}, 0) AS {k}" for k, c in _SH.items())} FROM x)
SELECT *, frecuencia_turno_3m / factor AS densidad_turno_100m, gravedad_turno_3m / factor AS densidad_gravedad_turno_100m FROM h""")
def _(t):
    return windows.shift_history(t.dense_cube())


@query("W02b_monthly_history", "tramo_id:s mes_idx:l frecuencia_hist:d suma_pesos_hist:d densidad_delictiva_100m:d densidad_gravedad_100m:d riesgo:d", f"""
WITH {_PANEL}, h AS (SELECT *, CASE WHEN mes_idx >= 3 THEN sum(frecuencia) {_over(_rows(3))} END AS frecuencia_hist, CASE WHEN mes_idx >= 3 THEN sum(suma_pesos) {_over(_rows(3))} END AS suma_pesos_hist FROM panel)
SELECT *, frecuencia_hist / factor AS densidad_delictiva_100m, suma_pesos_hist / factor AS densidad_gravedad_100m FROM h""")
def _(t):
    return windows.panel_history(t.dense_months())


_OBS = f"""{COVER}, o AS (SELECT d.tramo_id, d.mes_idx, d.turno_idx, d.factor, d.peso AS peso0, m.observado::INTEGER AS obs, CASE WHEN observado THEN cobertura END AS cov,
 n * observado::INTEGER AS n, peso * observado::INTEGER AS peso, grave * observado::INTEGER AS grave, robo * observado::INTEGER AS robo, hurto * observado::INTEGER AS hurto,
 extorsion * observado::INTEGER AS extorsion, homicidio * observado::INTEGER AS homicidio FROM denso d JOIN meses m USING (mes_idx)),
o2 AS (SELECT *, sum(n) OVER (PARTITION BY tramo_id, mes_idx) AS tn, sum(peso) OVER (PARTITION BY tramo_id, mes_idx) AS tp, (n > 0)::INTEGER AS a, (peso / factor >= 3.0)::INTEGER AS alto FROM o),
o3 AS (SELECT *, (tn > 0)::INTEGER AS ta FROM o2)"""
_FIELDS = ("n", "peso", "tn", "tp", "grave", "robo", "hurto", "extorsion", "homicidio", "a", "ta")


def _window_sql(w: int) -> str:
    by = _over(_rows(w), _T)
    per = f"greatest(coalesce(sum(obs) {by}, 0), 1)"
    names = windows.WINDOW_FIELDS
    out = [f"coalesce(sum({c}) {by}, 0) / {per}::DOUBLE AS ventana_{w}m_{n}" for c, n in zip(_FIELDS, names)]
    out += [f"coalesce(sum(n) {by}, 0) / {per}::DOUBLE / factor AS ventana_{w}m_{names[11]}", f"coalesce(sum(tn) {by}, 0) / {per}::DOUBLE / factor AS ventana_{w}m_{names[12]}",
            f"coalesce(sum(obs) {by}, 0) / {w}.0::DOUBLE AS ventana_{w}m_{names[13]}", f"coalesce(avg(cov) {by}, 0) AS ventana_{w}m_{names[14]}"]
    return ", ".join(out)


@query("W03_observed_windows", "tramo_id:s mes_idx:l turno_idx:l riesgo:d " + " ".join(f"ventana_{w}m_{f}:d" for w in (1, 3, 6, 12) for f in windows.WINDOW_FIELDS), f"""
WITH {_SHIFT}, {_OBS} SELECT tramo_id, mes_idx, turno_idx, peso0 / factor AS riesgo, {", ".join(_window_sql(w) for w in (1, 3, 6, 12))} FROM o3""")
def _(t):
    return windows.observed_windows(t.dense_cube(), t.months())


def _past(e: str) -> str:
    return f"coalesce(sum({e}) {_over(_PAST, _T)}, 0)"


_PER = f"greatest({_past('obs')}, 1)::DOUBLE"


@query("W04_expanding_history", "tramo_id:s mes_idx:l turno_idx:l " + " ".join(f"{f}:d" for f in windows.HISTORY_FIELDS), f"""
WITH {_SHIFT}, {_OBS} SELECT tramo_id, mes_idx, turno_idx, {_past('n')} / {_PER} AS historico_frecuencia_turno, {_past('tn')} / {_PER} AS historico_frecuencia_total, {_past('peso')} / {_PER} AS historico_gravedad_turno,
 ({_past('a')} - {_past('alto')}) / {_PER} AS historico_fraccion_medio, {_past('alto')} / {_PER} AS historico_fraccion_alto, {_past('a')} / {_PER} AS historico_fraccion_activo,
 {_past('n')} / greatest({_past('tn')}, 1)::DOUBLE AS historico_cuota_turno, coalesce(mes_idx - max(CASE WHEN n > 0 THEN mes_idx END) {_over(_PAST, _T)}, mes_idx + 1) AS meses_desde_ultimo_turno,
 coalesce(mes_idx - max(CASE WHEN tn > 0 THEN mes_idx END) {_over(_PAST, _T)}, mes_idx + 1) AS meses_desde_ultimo_total, {_past('obs')} AS meses_observados_historico FROM o3""")
def _(t):
    return windows.observed_windows(t.dense_cube(), t.months(), windows=(1,))


@query("W05_lags", "tramo_id:s mes_idx:l " + " ".join(f"lag{k}_{m}:d" for k in (1, 2, 3) for m in MEASURES), f"""
WITH {_PANEL}, l AS (SELECT tramo_id, mes_idx, {", ".join(f"lag({m}, {k}) {_over('')} / factor AS lag{k}_{m}" for k in (1, 2, 3) for m in MEASURES)} FROM panel) SELECT * FROM l WHERE mes_idx >= 3""")
def _(t):
    return windows.monthly_context(t.dense_months(), HIGH_FROM_BUFFER)


def _stats(w: int) -> str:
    by = _over(_rows(w))
    return (f"avg(frecuencia) {by} / factor AS conteo_media{w}, avg(riesgo) {by} AS riesgo_media{w}, stddev_pop(riesgo) {by} AS riesgo_std{w}, max(riesgo) {by} AS riesgo_max{w}, "
            f"avg((riesgo > 0)::INTEGER) {by} AS meses_activos{w}, avg((riesgo >= {_H})::INTEGER) {by} AS meses_altos{w}")


_STAT = ("conteo_media", "riesgo_media", "riesgo_std", "riesgo_max", "meses_activos", "meses_altos")


@query("W06_rolling_statistics", "tramo_id:s mes_idx:l " + " ".join(f"{s}{w}:d5" for w in (3, 6, 12) for s in _STAT), f"""
WITH {_PANEL}, l AS (SELECT tramo_id, mes_idx, {", ".join(_stats(w) for w in (3, 6, 12))} FROM panel) SELECT * FROM l WHERE mes_idx >= 3""")
def _(t):
    return windows.monthly_context(t.dense_months(), HIGH_FROM_BUFFER)


@query("W07_trends", "tramo_id:s mes_idx:l riesgo_lag6:d riesgo_lag12:d tendencia1_2:d tendencia3_6:d ratio1_6:d mes_sin:d", f"""
WITH {_PANEL}, l AS (SELECT tramo_id, mes_idx, lag(riesgo, 6) {_over('')} AS riesgo_lag6, lag(riesgo, 12) {_over('')} AS riesgo_lag12, lag(riesgo, 1) {_over('')} - lag(riesgo, 2) {_over('')} AS tendencia1_2,
 avg(riesgo) {_over(_rows(3))} - CASE WHEN mes_idx <= 3 THEN first(riesgo) OVER (PARTITION BY tramo_id ORDER BY mes_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE avg(riesgo) {_over(_rows(6, 4))} END AS tendencia3_6,
 (lag(riesgo, 1) {_over('')} + 0.05::DOUBLE) / (avg(riesgo) {_over(_rows(6))} + 0.05::DOUBLE) AS ratio1_6, sin(2 * pi() * (mes_idx % 12) / 12) AS mes_sin FROM panel) SELECT * FROM l WHERE mes_idx >= 3""")
def _(t):
    return windows.monthly_context(t.dense_months(), HIGH_FROM_BUFFER)


_MID = f"pt AS (SELECT tramo_id, longitud * {KX} AS x, latitud * {KY} AS y FROM seg)"


def _knn(k: int, where: str = "true") -> str:
    return f"""{_MID}, vec AS MATERIALIZED (SELECT * FROM (SELECT a.tramo_id, b.tramo_id AS vecino_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist_m,
 row_number() OVER (PARTITION BY a.tramo_id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.tramo_id) AS puesto FROM pt a JOIN pt b ON a.tramo_id <> b.tramo_id) WHERE puesto <= {k} AND {where})"""


def _points(t):
    return spatial.with_xy(t.segments().select("tramo_id", "latitud", "longitud"))


@query("W08_neighbor_means", "tramo_id:s mes_idx:l " + " ".join(f"vecinos{k}_{c}:d5" for k in (8, 32) for c in ("riesgo_lag1", "riesgo_media3", "activos_lag1")), f"""
WITH {_PANEL}, {_knn(32)}, f AS (SELECT tramo_id AS vecino_id, mes_idx, lag(riesgo, 1) {_over('')} AS l1, avg(riesgo) {_over(_rows(3))} AS m3 FROM panel)
SELECT v.tramo_id, mes_idx, {", ".join(f"avg(l1) FILTER (puesto <= {k}) AS vecinos{k}_riesgo_lag1, avg(m3) FILTER (puesto <= {k}) AS vecinos{k}_riesgo_media3, avg((l1 > 0)::INTEGER) FILTER (puesto <= {k}) AS vecinos{k}_activos_lag1" for k in (8, 32))}
 FROM vec v JOIN f USING (vecino_id) WHERE mes_idx >= 3 GROUP BY v.tramo_id, mes_idx""")
def _(t):
    feats = windows.monthly_context(t.dense_months(), HIGH_FROM_BUFFER).withColumn("_act", F.when(F.col("_lag1") > 0, 1.0).otherwise(0.0))
    near = spatial.nearest_neighbors(_points(t), 32)
    return windows.neighbor_means(feats, near, {"riesgo_lag1": "_lag1", "riesgo_media3": "_media3", "activos_lag1": "_act"}, (8, 32))


@query("W09_neighbor_sums", "tramo_id:s mes_idx:l turno_idx:l vecinos_frecuencia_turno_3m:d5 vecinos_gravedad_turno_3m:d5 vecinos_frecuencia_total_3m:d5 vecinos_gravedad_total_3m:d5", f"""
WITH {_SHIFT}, {_knn(24, 'dist_m < 300')}, x AS (SELECT *, sum(n) OVER (PARTITION BY tramo_id, mes_idx) AS n_total, sum(peso) OVER (PARTITION BY tramo_id, mes_idx) AS peso_total FROM denso),
h AS (SELECT tramo_id AS vecino_id, mes_idx, turno_idx, {", ".join(f"coalesce(sum({_SH[k]}) {_over(_rows(3), _T)}, 0) AS {k}" for k in ("frecuencia_turno_3m", "gravedad_turno_3m", "frecuencia_total_3m", "gravedad_total_3m"))} FROM x)
SELECT v.tramo_id, mes_idx, turno_idx, {", ".join(f"sum(exp(-dist_m / 125.0::DOUBLE) * {k}) AS vecinos_{k}" for k in ("frecuencia_turno_3m", "gravedad_turno_3m", "frecuencia_total_3m", "gravedad_total_3m"))} FROM vec v JOIN h USING (vecino_id) GROUP BY v.tramo_id, mes_idx, turno_idx""")
def _(t):
    feats = windows.shift_history(t.dense_cube())
    near = spatial.exponential_neighbors(_points(t))
    return windows.neighbor_sums(feats, near, ["frecuencia_turno_3m", "gravedad_turno_3m", "frecuencia_total_3m", "gravedad_total_3m"])


@query("W10_shift_context", "tramo_id:s mes_idx:l turno_idx:l turno_es_2:d turno_lag1:d turno_lag3:d turno_media3:d5 turno_std3:d5 turno_max3:d turno_activos3:d turno_altos3:d turno_conteo3:d turno_cuota3:d5 vecinos8_turno_lag1:d5 vecinos8_turno_media3:d5", f"""
WITH {_SHIFT}, {_knn(8)}, r AS (SELECT *, peso / factor AS r FROM denso), r2 AS (SELECT *, sum(r) OVER (PARTITION BY tramo_id, mes_idx) AS tr FROM r),
f AS MATERIALIZED (SELECT tramo_id, mes_idx, turno_idx, (turno_idx = 2)::INTEGER AS turno_es_2, lag(r, 1) {_over('', _T)} AS turno_lag1, lag(r, 3) {_over('', _T)} AS turno_lag3, avg(r) {_over(_rows(3), _T)} AS turno_media3,
 stddev_pop(r) {_over(_rows(3), _T)} AS turno_std3, max(r) {_over(_rows(3), _T)} AS turno_max3, avg((r > 0)::INTEGER) {_over(_rows(3), _T)} AS turno_activos3, avg((r >= {_H})::INTEGER) {_over(_rows(3), _T)} AS turno_altos3,
 avg(n) {_over(_rows(3), _T)} / factor AS turno_conteo3, avg(r) {_over(_rows(3), _T)} / (avg(tr) {_over(_rows(3), _T)} + 0.05::DOUBLE) AS turno_cuota3 FROM r2),
v AS (SELECT vec.tramo_id, mes_idx, turno_idx, avg(turno_lag1) AS vecinos8_turno_lag1, avg(turno_media3) AS vecinos8_turno_media3 FROM vec JOIN f ON f.tramo_id = vec.vecino_id WHERE mes_idx >= 3 GROUP BY vec.tramo_id, mes_idx, turno_idx)
SELECT f.*, v.vecinos8_turno_lag1, v.vecinos8_turno_media3 FROM f LEFT JOIN v USING (tramo_id, mes_idx, turno_idx) WHERE mes_idx >= 3""")
def _(t):
    return windows.shift_context(t.dense_cube(), spatial.nearest_neighbors(_points(t), 8), HIGH_FROM_BUFFER)


@query("W12_sequences", "tramo_id:s mes_idx:l meses:l observados:d primero:d ultimo:d suma:d5", f"""
WITH {_PANEL}, s AS (SELECT *, ln(1 + frecuencia / factor) + ln(1 + suma_pesos / factor) AS v, ln(1 + frecuencia / factor) AS c0 FROM panel)
SELECT tramo_id, mes_idx, 12 AS meses, count(*) {_over(_rows(12))} AS observados, CASE WHEN mes_idx >= 12 THEN lag(c0, 12) {_over('')} ELSE 0 END AS primero, coalesce(lag(c0, 1) {_over('')}, 0) AS ultimo, coalesce(sum(v) {_over(_rows(12))}, 0) AS suma FROM s""")
def _(t):
    seq = windows.sequences(t.dense_months(), ["frecuencia", "suma_pesos"])
    add = lambda k: F.aggregate("secuencia", F.lit(0.0), lambda acc, v: acc + v[k])
    return seq.select("tramo_id", "mes_idx", F.size("secuencia").alias("meses"), add(2).alias("observados"), F.col("secuencia")[0][0].alias("primero"),
                      F.col("secuencia")[11][0].alias("ultimo"), (add(0) + add(1)).alias("suma"))


@query("W14_prior_adaptation", "id:l mes_idx:l p0:d p1:d p2:d", f"""
WITH {PROBA}, s AS (SELECT mes_idx + 1 AS mes_idx, avg((y = 0)::INTEGER) AS s0, avg((y = 1)::INTEGER) AS s1, avg((y = 2)::INTEGER) AS s2 FROM proba GROUP BY mes_idx),
q AS (SELECT id, p.mes_idx, {", ".join(f"p{c} * coalesce(pow((s{c} + 0.000001::DOUBLE) / ({v}::DOUBLE + 0.000001::DOUBLE), 0.5), 1.0) AS q{c}" for c, v in enumerate((0.3, 0.3, 0.4)))} FROM proba p LEFT JOIN s USING (mes_idx))
SELECT id, mes_idx, {", ".join(f"q{c} / (q0 + q1 + q2) AS p{c}" for c in range(3))} FROM q""")
def _(t):
    return evaluate.adapt_prior(t.proba(), (0.3, 0.3, 0.4), 0.5)


@query("W15_feature_groups", "grupo:s columnas:l filas:l suma:d3", f"""
WITH {_SHIFT}, {_OBS}, w AS (SELECT tramo_id, mes_idx, turno_idx, {_window_sql(3)}, {_window_sql(6)} FROM o3)
SELECT '3m' AS grupo, 15 AS columnas, count(*) AS filas, sum({" + ".join(f"ventana_3m_{f}" for f in windows.WINDOW_FIELDS)}) AS suma FROM w UNION ALL
SELECT '6m', 15, count(*), sum({" + ".join(f"ventana_6m_{f}" for f in windows.WINDOW_FIELDS)}) FROM w""")
def _(t):
    feats = windows.observed_windows(t.dense_cube(), t.months(), windows=(3, 6))
    groups = windows.feature_groups()
    out = None
    for name in ("3m", "6m"):
        cols = [c for c in groups[name] if c.startswith("ventana")]
        total = F.sum(sum((F.col(c) for c in cols[1:]), F.col(cols[0])))
        row = feats.select(*cols).agg(F.count(F.lit(1)).alias("filas"), total.alias("suma")).select(F.lit(name).alias("grupo"), F.lit(len(cols)).alias("columnas"), "filas", "suma")
        out = row if out is None else out.unionByName(row)
    return out


@query("W16_latest_row", "tramo_id:s mes_idx:l frecuencia:d", f"""
WITH {INC}, {MONTHLY} SELECT tramo_id, max(mes_idx) AS mes_idx, arg_max(frecuencia, mes_idx) AS frecuencia FROM mensual GROUP BY tramo_id""")
def _(t):
    monthly = t.raw().filter("geo").groupBy("tramo_id", "mes_idx").agg(F.count(F.lit(1)).alias("frecuencia"))
    return ordered.last_by(monthly, ["tramo_id"], [F.col("mes_idx")])
