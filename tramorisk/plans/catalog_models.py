"""Model operators and the experiment jobs, on the published settings and all labelled months."""

from dataclasses import replace

from pyspark.sql import functions as F

from tramorisk.functions.risk import HIGH_FROM_BUFFER, HIGH_FROM_SHIFT, length_factor, risk_class
from tramorisk.operators import evaluate as ev, impute, models, network as net, ordered, panel, sampling, spatial, windows
from tramorisk.plans import catalog_spatial as cs, experiments as ex, jobs
from tramorisk.plans.registry import query
from tramorisk.sources.forecast import wide_forecast
from tramorisk.sources.readers import table_digest

_RF, _RF_WINDOWS, _RF_MONTHLY, _ = models.FOREST_SPECS
_GBT, _GBT_MONTHLY, _HURDLE, _ORDINAL = models.BOOSTED_SPECS
_FIRST, _LAST = 3, 82
_SPLIT = jobs.Split((_FIRST, 63), (64, 69), (70, _LAST))
_SPANS = {"3m": 3, "6m": 6, "12m": 12, "24m": 24, "todo": None}
_G = windows.feature_groups()
_ROWS = "nombre:s n:l accuracy:d f1_macro:d f1_medio_alto:d recall_alto:d average_precision:d"


def _shift_rows(t):
    """Shift features with label by the fixed cut."""
    return t.once("rasgos_turno", lambda: windows.shift_history(t.dense_cube()).withColumn("y", risk_class(F.col("riesgo"), HIGH_FROM_SHIFT)))


def _window_rows(t):
    """Observed-window features plus place and calendar columns."""
    def build():
        place = windows.shift_history(t.dense_cube()).select("tramo_id", "mes_idx", "turno_idx", *_G["legacy"][:7])
        feats = windows.observed_windows(t.dense_cube(), t.months())
        rows = feats.join(place, ["tramo_id", "mes_idx", "turno_idx"])
        return rows.withColumn("y", risk_class(F.col("riesgo"), HIGH_FROM_SHIFT)).withColumn("activo", F.col("ventana_12m_frecuencia_total") > 0)
    return t.once("rasgos_ventana", build)


def _monthly_rows(t, dense=None, high=HIGH_FROM_BUFFER):
    feats = windows.monthly_context(dense if dense is not None else t.dense_months(), high)
    return feats.withColumn("y", risk_class(F.col("riesgo"), high))


def _legacy_rows(dense, high):
    return windows.panel_history(dense).filter(F.col("mes_idx") >= 3).withColumn("y", risk_class(F.col("riesgo"), high))


def _context(t):
    return t.once("rasgos_mes", lambda: _monthly_rows(t))


_TEMPORAL = _G["temporal"]


@query("M01_imputed_pipeline", "columna:s media:d")
def _(t):
    rows = jobs.months(_context(t), (_FIRST, _LAST))
    ready = models.Pipeline(stages=models._assembled(["riesgo_lag6", "riesgo_lag12"])).fit(models._numeric(rows, ["riesgo_lag6", "riesgo_lag12"])).transform(models._numeric(rows, ["riesgo_lag6", "riesgo_lag12"]))
    means = ready.agg(F.avg("riesgo_lag6__lleno").alias("a"), F.avg("riesgo_lag12__lleno").alias("b"))
    return means.select(F.explode(F.array(F.struct(F.lit("riesgo_lag6").alias("columna"), F.col("a").alias("media")), F.struct(F.lit("riesgo_lag12").alias("columna"), F.col("b").alias("media")))).alias("r")).select("r.*")


def _score_query(t, spec, sampler=None):
    arm = jobs.run_arm(spec.name, _shift_rows(t), _G["legacy"], spec, _SPLIT, sampler or jobs.capped())
    return arm.test


_PC = "tramo_id:s mes_idx:l turno_idx:l y:l p0:d p1:d p2:d"


@query("M02_random_forest", _PC)
def _(t):
    return _score_query(t, _RF)


@query("M03_boosted_trees", _PC)
def _(t):
    return _score_query(t, _GBT)


@query("M04_hurdle", _PC)
def _(t):
    return _score_query(t, _HURDLE)


@query("M05_ordinal", _PC)
def _(t):
    return _score_query(t, _ORDINAL)


@query("M06_high_specialist", _PC)
def _(t):
    rows = _shift_rows(t)
    base = t.once("bosque_prueba", lambda: _score_query(t, _RF))
    train = jobs.capped()(jobs.months(rows, _SPLIT.train))
    full = base.join(rows.select("tramo_id", "mes_idx", "turno_idx", *_G["legacy"]), ["tramo_id", "mes_idx", "turno_idx"])
    return models.high_specialist(full, train, _G["legacy"], _GBT, "peso_muestra")


@query("M07_sequence_network", "tramo_id:s mes_idx:l y:l p0:d p1:d p2:d")
def _(t):
    seq = windows.sequences(t.dense_months(), list(windows.MONTHLY_MEASURES)).join(_context(t).select("tramo_id", "mes_idx", "y", "mes_sin", "mes_cos"), ["tramo_id", "mes_idx"])
    train = sampling.cap_per_class(jobs.months(seq, _SPLIT.train), ["mes_idx"], 450, sampling.hash_order(keys=("tramo_id", "mes_idx")))
    return models.sequence_network(train, jobs.months(seq, _SPLIT.test), "secuencia", ["mes_sin", "mes_cos"]).select("tramo_id", "mes_idx", "y", "p0", "p1", "p2")


@query("M08_probability_invariants", "filas:l fallas:l")
def _(t):
    return models.probability_faults(t.once("bosque_prueba", lambda: _score_query(t, _RF)))


@query("P32_class_expansion", "filas:l fallas:l sin_alto:l")
def _(t):
    rows = _shift_rows(t)
    low = jobs.months(rows, _SPLIT.train).filter("y < 2")
    model = models.fit(_RF, low, _G["legacy"])
    scored = model.score(jobs.months(rows, (64, _LAST)))
    return models.probability_faults(scored).join(scored.agg(F.count(F.when(F.col("p2") == 0, 1)).alias("sin_alto")))


@query("M09_calibration", "id:l p0:d p1:d p2:d")
def _(t):
    p = t.proba()
    return models.calibrate(p.filter("mes_idx < 40"), p.filter("mes_idx >= 40"))


@query("M10_importances", "variable:s importancia:d")
def _(t):
    arm_train = jobs.capped()(jobs.months(_shift_rows(t), _SPLIT.train))
    model = models.fit(_RF, arm_train, _G["legacy"], weight="peso_muestra")
    return t.spark.createDataFrame(model.importances()[:15], "variable string, importancia double")


@query("M11_reload_equality", "filas:l distintas:l")
def _(t):
    from tramorisk.session import ensure_checkpoint_dir

    rows = _shift_rows(t)
    model = models.fit(_RF, jobs.capped()(jobs.months(rows, _SPLIT.train)), _G["legacy"], weight="peso_muestra")
    path = f"{ensure_checkpoint_dir(t.spark)}/modelos/{t.spark.sparkContext.applicationId}"
    model.save(path)
    again = models.RiskClassifier.load(path, _RF, _G["legacy"])
    probe = jobs.months(rows, (64, _LAST))
    a, b = (m.score(probe).select("tramo_id", "mes_idx", "turno_idx", "p0", "p1", "p2") for m in (model, again))
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("distintas")).withColumn("filas", F.lit(probe.count()))


@query("M12_next_month_forecast", "tramo_id:s riesgo_score:d nivel_riesgo:s riesgo_score_noche:d nivel_riesgo_noche:s")
def _(t):
    scored = jobs.refit_and_forecast(_shift_rows(t), _G["legacy"], _RF, (_FIRST, _LAST), _LAST + 1, jobs.capped(), {"medio": 0.34, "alto": 0.4})
    return wide_forecast(scored)


# ---------------------------------------------------------------- experiments

def _buffer_dense(t, radius, sigma=None):
    def build():
        cells = spatial.buffer_panel(t.placed(), t.lines(), radius, sigma)
        return panel.dense(cells, t.segments(), t.calendar, keep=("latitud", "longitud", "longitud_m"))
    return t.once(f"panel_{radius:.0f}_{sigma}", build)


@query("X01_radius_comparison", _ROWS)
def _(t):
    arms, split = [], _SPLIT
    for radius in (100.0, 150.0, 200.0):
        dense = _buffer_dense(t, radius)
        train_risk = jobs.months(dense, split.train).withColumn("r", F.col("suma_pesos") / length_factor(F.col("longitud_m"))).filter("r > 0")
        high = max(ordered.quantile_values(train_risk, "r", [0.75])[0], 1e-9)
        arms.append(jobs.run_arm(f"radio_{radius:.0f}", _legacy_rows(dense, high), _G["mensual_legacy"], _RF_MONTHLY, split, jobs.minority_bound()))
    return jobs.compare_arms(arms).orderBy(F.desc("f1_macro"), F.desc("recall_alto"), F.desc("average_precision"), F.desc("balanced_accuracy"))


_STAGED = "nombre:s etapa:s variante:s n:l accuracy:d f1_macro:d f1_medio_alto:d recall_alto:d average_precision:d elegido:l"
_LOOK = {"calibracion": (64, 66), "seleccion": (67, 69), "retrospectiva": (70, _LAST)}


@query("X02_shift_pipeline", "nombre:s etapa:s n:l accuracy:d f1_macro:d f1_medio_alto:d recall_alto:d average_precision:d elegido:l pronosticados_medio:l pronosticados_alto:l")
def _(t):
    # Validation gives the cutoffs and the choice, the test months are read after it, and both models are then refitted on all months to forecast the next.
    eligible = panel.eligible_months(t.months(), 3, 0.8, {"train": ("1995-04", "2000-04"), "validation": ("2000-05", "2000-10"), "test": ("2000-11", "2001-11")})
    specs = {s.name: s for s in (_RF, _GBT)}
    store = ex.Store(t, "X02", (specs, _G["legacy"], _SPLIT, "450 y 2"))
    known = _shift_rows(t).join(F.broadcast(eligible), "mes_idx")  # calendar rows only
    rows = store.once("rasgos", lambda: known.unionByName(_shift_rows(t).filter(F.col("mes_idx") == _LAST + 1), True))
    first = [ex.Candidate(n, rows, _G["legacy"], s, jobs.capped(), "capped", _SPLIT.train, {"validacion": _SPLIT.validation, "prueba": _SPLIT.test}) for n, s in specs.items()]
    final = [ex.refit(c, f"{c.name}_final", (_FIRST, _LAST), {"pronostico": (_LAST + 1, _LAST + 1)}) for c in first]
    store.run(first + final)
    scored = store.scores(specs)
    cuts = ex.cuts_of(scored.filter("etapa = 'validacion'"), list(specs), ex.two_stage_cuts)
    table = jobs.settle(ex.metric_table(*ex.with_cuts(scored, cuts)))
    best = table.filter("etapa = 'validacion'").orderBy(F.desc("f1_macro"), F.desc("recall_alto"), F.desc("average_precision"), "ajuste").first()["ajuste"]
    ahead, decision = ex.with_cuts(store.scores(f"{n}_final" for n in specs), {f"{n}_final": c for n, c in cuts.items()})
    counts = ahead.withColumn("_c", decision).groupBy("ajuste", "etapa").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_c") == 1, 1)).alias("pronosticados_medio"),
                                                                            F.count(F.when(F.col("_c") == 2, 1)).alias("pronosticados_alto"))
    both = table.unionByName(counts.withColumn("ajuste", F.regexp_replace("ajuste", "_final$", "")), True)
    return both.withColumn("nombre", F.col("ajuste")).withColumn("elegido", (F.col("ajuste") == best).cast("int"))


def _recent(half_life):
    """Strata at the power 0.5, halved in weight for every ``half_life`` months before the last training month."""
    age = F.lit(_SPLIT.train[1]) - F.col("mes_idx")
    return lambda df: jobs.two_strata(0.5)(df).withColumn("peso_muestra", F.col("peso_muestra") * F.pow(F.lit(0.5), age / half_life))


def window_candidates():
    """Name, features, settings and sampler of the 16 published candidates."""
    boosted = lambda trees, depth: replace(_GBT, trees=trees, depth=depth)
    forest = replace(_RF_WINDOWS, trees=120, depth=16)
    return [("base_rf", "legacy", _RF, jobs.capped()), ("base_xgb", "legacy", _GBT, jobs.capped()),
            *[(f"xgb_{w}", w, boosted(240, 4), jobs.two_strata()) for w in ("1m", "3m", "6m", "12m")],
            *[(f"rf_{w}", w, forest, jobs.two_strata()) for w in ("1m", "3m", "6m", "12m")],
            ("xgb_multi", "multi", boosted(360, 4), jobs.two_strata()), ("xgb_multi_depth6", "multi", boosted(260, 6), jobs.two_strata()),
            ("xgb_multi_weighted", "multi", boosted(360, 4), jobs.two_strata(0.5)), ("xgb_multi_recent", "multi", boosted(360, 4), _recent(24)),
            ("rf_multi", "multi", replace(forest, subset="sqrt"), jobs.two_strata()), ("hurdle_multi", "multi", replace(_HURDLE, trees=300, depth=4), jobs.two_strata())]


def _wide_rows(t):
    """Window features with the short ones of the first pipeline."""
    keys = ["tramo_id", "mes_idx", "turno_idx"]
    return t.once("rasgos_candidatos", lambda: _window_rows(t).join(_shift_rows(t).select(*keys, *_G["legacy"][7:]), keys))


@query("X03_window_candidates", _STAGED)
def _(t):
    plans = window_candidates()
    store = ex.Store(t, "X03", ([(n, g, s) for n, g, s, _ in plans], _SPLIT.train, _LOOK))
    rows = store.once("rasgos", lambda: _wide_rows(t))
    candidates = [ex.Candidate(name, rows, _G[group], spec, sampler, name, _SPLIT.train, _LOOK) for name, group, spec, sampler in plans]
    return ex.staged_comparison(store, candidates, ("base_rf", "base_xgb"))


def _distances(t):
    return t.once("distancias", lambda: net.midpoint_distances(t.segments(), t.segments().select("tramo_id"), 500.0))


@query("X04_network_density_ablation", _STAGED)
def _(t):
    boosted = replace(_GBT, trees=360, depth=4)
    plans = [(f"xgb_{group}", group, boosted) for group in ("multi_base", "multi_nkde_100m", "multi_nkde_250m", "multi_nkde_500m", "multi_nkde_all")]
    store = ex.Store(t, "X04", (plans, _SPLIT.train, _LOOK, "semivida 24"))

    def build():
        rows = _wide_rows(t)
        for band in (100, 250, 500):
            density = net.project(t.cube(), net.triangular_kernel(_distances(t), t.segments(), band), "peso")
            history = windows.density_history(panel.dense(density, t.segments(), t.calendar, shifts=True), t.months(), f"nkde_{band}m")
            rows = rows.join(history, ["tramo_id", "mes_idx", "turno_idx"])
        return rows

    rows = store.once("rasgos", build)
    return ex.staged_comparison(store, [ex.Candidate(n, rows, _G[g], s, _recent(24), "semivida 24", _SPLIT.train, _LOOK) for n, g, s in plans])


@query("X05_completed_places", "nombre:s n:l accuracy:d f1_macro:d recall_alto:d completados:l")
def _(t):
    r = cs._reports(t).withColumn("latitud", F.when(F.col("geo"), F.col("latitud"))).withColumn("longitud", F.when(F.col("geo"), F.col("longitud")))
    filled = impute.overlay(r, cs._same(t, 50.0), cs._deck(t))
    placed = spatial.with_xy(filled.filter("latitud IS NOT NULL").drop("tramo_id")).join(t.incidents().select("fila", "peso", "categoria", "grave"), "fila")
    snapped = t.once("completo", lambda: spatial.snap_incidents(placed, t.lines(), 60.0).select("fila", "tramo_id", "mes_idx", "turno_idx", "peso", "categoria", "grave", "origen_ubi"))
    measure = lambda df: panel.dense(df.groupBy("tramo_id", "mes_idx").agg(*panel.monthly_panel_measures(F.col("peso"))), t.segments(), t.calendar, keep=("latitud", "longitud", "longitud_m"))
    full, seen = measure(snapped), measure(snapped.filter("origen_ubi = 'OBSERVADA'"))
    truth = jobs.swap_targets(full.select("tramo_id", "mes_idx", F.col("suma_pesos").alias("peso")), seen.select("tramo_id", "mes_idx", F.col("suma_pesos").alias("peso")), t.segments(), 64, HIGH_FROM_SHIFT)
    rows = windows.panel_history(full).filter("mes_idx >= 3").join(truth.select("tramo_id", "mes_idx", "y"), ["tramo_id", "mes_idx"])
    arm = jobs.run_arm("escenario", t.once("rasgos_completo", lambda: rows), _G["mensual_legacy"], _RF_MONTHLY, _SPLIT, jobs.per_class_month())
    return jobs.compare_arms([arm]).withColumn("completados", F.lit(snapped.filter("origen_ubi <> 'OBSERVADA'").count()))


_SPECIALIST = models.ModelSpec("alto_binario", "alto", trees=450, depth=3, step=0.05, min_rows=5)


@query("X06_neighbourhood_and_specialist", "nombre:s etapa:s n:l accuracy:d f1_macro:d f1_medio_alto:d f1_alto:d recall_alto:d average_precision:d")
def _(t):
    # Cutoffs come from the validation months; the last month is held out and judged by refits on all months before it.
    keys, near_columns = ["tramo_id", "mes_idx", "turno_idx"], [f"vecinos_{c}" for c in _G["legacy"][7:11]]
    plans = {"base": ("legacy", _RF), "base_xgb": ("legacy", _GBT), "vecindad": ("vecindad", _RF), "alto": ("legacy", _SPECIALIST)}
    stages, held = {"validacion": _SPLIT.validation, "prueba": (_SPLIT.test[0], _LAST - 1)}, {"reserva": (_LAST, _LAST)}
    store = ex.Store(t, "X06", (plans, _SPLIT.train, stages, held))

    def build():
        base = _shift_rows(t)
        near = spatial.exponential_neighbors(spatial.with_xy(t.segments()).select("tramo_id", "x", "y"))
        return base.join(windows.neighbor_sums(base, near, _G["legacy"][7:11]), keys, "left").fillna(0.0, near_columns)

    rows = store.once("rasgos", build)
    first = [ex.Candidate(n, rows, _G[g], s, jobs.capped(), "capped", _SPLIT.train, stages) for n, (g, s) in plans.items()]
    store.run(first + [ex.refit(c, f"{c.name}_reserva", (_FIRST, _LAST - 1), held) for c in first])
    scored = store.scores([f"{n}{end}" for n in plans for end in ("", "_reserva")]).withColumn("ajuste", F.regexp_replace("ajuste", "_reserva$", ""))
    high = scored.filter("ajuste = 'alto'").select("etapa", *keys, F.col("p2").alias("_alto"))
    special = scored.filter("ajuste = 'vecindad'").join(high, ["etapa", *keys]).withColumn("p2", F.col("_alto")).drop("_alto").withColumn("ajuste", F.lit("especialista"))
    arms = store.once("brazos", lambda: scored.filter("ajuste <> 'alto'").unionByName(special))
    cuts = ex.cuts_of(arms.filter("etapa = 'validacion'"), ["base", "base_xgb", "vecindad", "especialista"], ex.two_stage_cuts)
    return ex.metric_table(*ex.with_cuts(arms, cuts)).withColumnRenamed("ajuste", "nombre")


@query("X07_guarded_search", _ROWS)
def _(t):
    rows = _context(t)
    arms = [jobs.run_arm(s.name, rows, _TEMPORAL, s, _SPLIT, jobs.per_class_month(0.5)) for s in (_RF_MONTHLY, _ORDINAL)]
    arms.append(jobs.with_prior(arms[0], jobs.months(rows, _SPLIT.train), 0.5))
    table = jobs.compare_arms(arms, jobs.multiplier_decision)
    return ev.guarded_choice(table, table.filter(F.col("nombre") == _RF_MONTHLY.name))


@query("X08_monthly_retraining", "nombre:s origen:l n:l accuracy:d f1_macro:d")
def _(t):
    store = ex.Store(t, "X08", (_RF_MONTHLY, _TEMPORAL, _SPANS, _FIRST, _LAST))
    rows = store.once("rasgos", lambda: _context(t))
    fits = [ex.Candidate(f"{w}_{o}", rows, _TEMPORAL, _RF_MONTHLY, jobs.per_class_month(), "por clase y mes", (max(_FIRST, o - size) if size else _FIRST, o - 1), {"mes": (o, o)})
            for o in range(60, _LAST + 1) for w, size in _SPANS.items()]
    store.run(fits)
    parts = F.split("ajuste", "_")
    return ex.metric_table(store.scores(c.name for c in fits), ex.by_argmax()).withColumn("nombre", parts[0]).withColumn("origen", parts[1])


def _full_context(t):
    """Monthly features with those of the neighbours and of the whole network."""
    feats = _context(t).withColumn("_act", F.when(F.col("_lag1") > 0, 1.0).otherwise(0.0))
    near = spatial.nearest_neighbors(spatial.with_xy(t.segments()).select("tramo_id", "x", "y"), 32)
    around = windows.neighbor_means(feats, near, {"riesgo_lag1": "_lag1", "riesgo_media3": "_media3", "activos_lag1": "_act"}, (8, 32))
    network = windows.month_activity(t.dense_months(), HIGH_FROM_BUFFER)
    return feats.join(around, ["tramo_id", "mes_idx"], "left").join(F.broadcast(network), "mes_idx")  # calendar rows only


def monthly_protocol():
    """Three windows and four origins a year over three years for the choice, then twenty months in a row, then one month ahead."""
    return ex.Protocol({"bosque": _RF_MONTHLY, "impulso": _GBT_MONTHLY}, {"3m": 3, "12m": 12, "inicio": None},
                       tuple(12 * (year - 1995) + month - 1 for year in range(1997, 2000) for month in (3, 6, 9, 12)), tuple(range(60, 80)), 81)


@query("X09_registered_phases", "nombre:s fase:s n:l accuracy:d f1_macro:d f1_medio_alto:d recall_alto:d puntaje:d elegido:l huella:s")
def _(t):
    plan = monthly_protocol()
    store = ex.Store(t, "X09", (plan, _G["contexto"], "por clase y mes 1.25"))
    rows = store.once("rasgos", lambda: _full_context(t))
    state = ex.MonthlyProtocol(store, plan, rows, _G["contexto"], jobs.per_class_month(), "por clase y mes")
    window, period = state.frozen(), t.calendar.period(plan.month_d)
    mark = F.lit(0)
    for family, chosen in window.items():
        mark = F.when((F.col("familia") == family) & (F.col("ventana") == chosen), 1).otherwise(mark)
    phase_b = state.phase_b().withColumn("fase", F.lit("B")).withColumn("elegido", mark).withColumn("nombre", F.concat_ws("_", "familia", "ventana"))
    months = state.phase_c()
    year = F.when(F.col("mes_idx") < 72, "C primer año").otherwise("C segundo año")
    periods = F.explode(F.array(F.lit("C"), year))
    phase_c = ex.metric_table(months.withColumn("fase", periods), ex.by_argmax(), ("familia", "fase"))
    phase_d = state.evaluation_d(period).withColumn("fase", F.lit("D"))
    late = phase_c.unionByName(phase_d, True).withColumn("elegido", F.lit(1)).withColumn("nombre", F.col("familia"))
    return phase_b.unionByName(late, True)


@query("X10_lighting_ablation", "nombre:s delta_accuracy:d delta_f1_medio_alto:d")
def _(t):
    # Without lights, with the lights that stand today, with those in service that month, and with these counted for the night shifts alone.
    near = ("luz_log50", "luz_log100", "luz_log_dist", "luz_30m")
    plans = {"sin_alumbrado": [], "estatico": [f"{n}_hoy" for n in near], "fechado": list(near), "por_turno": [*near, *[f"{n}_noche" for n in near]]}
    store = ex.Store(t, "X10", (plans, _RF, _SPLIT))

    def build():
        month = spatial.light_exposure_by_month(cs._mid(t), cs._lights(t), "1995-01", t.calendar.size).withColumn("luz_30m", F.col("luz_30m").cast("double"))
        today = spatial.light_exposure(cs._mid(t), cs._lights(t)).select("tramo_id", *[F.col(n).cast("double").alias(f"{n}_hoy") for n in near])
        return spatial.night_lighting(month, _shift_rows(t)).join(today, "tramo_id", "left")

    rows = store.once("rasgos", build)
    store.run([ex.Candidate(n, rows, _G["legacy"] + extra, _RF, jobs.capped(), "capped", _SPLIT.train, {"prueba": _SPLIT.test}) for n, extra in plans.items()])
    table = ex.metric_table(store.scores(plans), ex.by_argmax()).withColumnRenamed("ajuste", "nombre")
    return ev.metric_deltas(jobs.settle(table), "nombre", "sin_alumbrado", ["accuracy", "f1_medio_alto"])


@query("X11_association_ladder", _ROWS)
def _(t):
    # Nearest segment against buffers of growing radius, then one to five years of training on the 150 m panel.
    years = {f"anios_{n}": (max(_FIRST, _SPLIT.train[1] + 1 - 12 * n), _SPLIT.train[1]) for n in (1, 2, 3, 5)}
    store = ex.Store(t, "X11", (_RF_MONTHLY, years, _SPLIT))
    panels = {"asignacion": lambda: _legacy_rows(t.dense_months(), HIGH_FROM_BUFFER), **{f"buffer_{r}": lambda r=r: _legacy_rows(_buffer_dense(t, float(r)), HIGH_FROM_BUFFER) for r in (100, 150, 200, 300)}}
    rows = {n: store.once(f"rasgos_{n}", build) for n, build in panels.items()}
    fits = {**{n: (n, _SPLIT.train) for n in panels}, **{n: ("buffer_150", span) for n, span in years.items()}}
    store.run([ex.Candidate(n, rows[p], _G["mensual_legacy"], _RF_MONTHLY, jobs.per_class_month(), "por clase y mes", span, {"prueba": _SPLIT.test}) for n, (p, span) in fits.items()])
    return ex.metric_table(store.scores(fits), ex.by_argmax()).withColumnRenamed("ajuste", "nombre")


@query("X12_network_kernel_arms", _ROWS)
def _(t):
    arms = []
    for radius in (200, 300):
        cells = net.kernel_panel(t.cube(), net.plain_kernels(_distances(t), radius), ("n", "grave", "hurto", "robo", "extorsion", "homicidio"))
        cells = cells.select("tramo_id", "mes_idx", F.col("n").alias("frecuencia"), F.col("peso").alias("suma_pesos"), F.col("grave").alias("graves"), F.col("hurto").alias("hurtos"), F.col("robo").alias("robos"),
                             F.col("extorsion").alias("extorsiones"), F.col("homicidio").alias("homicidios"), "manana", "tarde", "noche", "madrugada")
        dense = panel.dense(cells, t.segments(), t.calendar, keep=("latitud", "longitud", "longitud_m"))
        arms.append(jobs.run_arm(f"red_{radius}", _legacy_rows(dense, HIGH_FROM_BUFFER), _G["mensual_legacy"], _RF_MONTHLY, _SPLIT, jobs.per_class_month()))
    return jobs.compare_arms(arms)


@query("X13_original_places", _ROWS)
def _(t):
    recent = (_SPLIT.train[1] - 32, _SPLIT.train[1])
    families = {"bosque": _RF_MONTHLY, "impulso": _GBT_MONTHLY}
    store = ex.Store(t, "X13", (families, recent, _SPLIT))
    rows = {r: store.once(f"rasgos_{r}", lambda r=r: _legacy_rows(_buffer_dense(t, float(r), 100.0), HIGH_FROM_BUFFER)) for r in (200, 300)}
    fits = {f"{f}_{r}{end}": (s, r, span) for f, s in families.items() for r, end, span in ((200, "", _SPLIT.train), (300, "", _SPLIT.train), (300, "_reciente", recent))}
    store.run([ex.Candidate(n, rows[r], _G["mensual_legacy"], s, jobs.per_class_month(), "por clase y mes", span, {"prueba": _SPLIT.test}) for n, (s, r, span) in fits.items()])
    return ex.metric_table(store.scores(fits), ex.by_argmax()).withColumnRenamed("ajuste", "nombre")


def tuning_grid():
    """Settings and strength of the class weights of the six published configurations."""
    forest = lambda name, trees, depth, leaf: models.ModelSpec(name, "bosque", trees=trees, depth=depth, min_rows=leaf)
    boosted = lambda name, trees, depth, step, leaf=1: models.ModelSpec(name, "impulso", trees=trees, depth=depth, step=step, min_rows=leaf)
    return {"rf_base": (forest("rf_base", 160, 14, 2), 1.0), "rf_deep": (forest("rf_deep", 220, 18, 2), 1.0), "rf_regularized": (forest("rf_regularized", 220, 12, 5), 1.0),
            "xgb_base": (boosted("xgb_base", 260, 6, 0.06), 1.0), "xgb_regularized": (boosted("xgb_regularized", 420, 5, 0.04, 3), 0.85), "xgb_shallow": (boosted("xgb_shallow", 520, 4, 0.035, 2), 0.75)}


@query("X14_external_evaluation", "nombre:s etapa:s regla:s corte_medio:d corte_alto:d n:l accuracy:d f1_macro:d f1_medio_alto:d recall_alto:d puntaje:d")
def _(t):
    # Eight months, the ninth to choose configuration and rule by, then the best of each family refitted on all nine for the five months after.
    grid, train, check, ahead = tuning_grid(), (63, 70), (71, 71), (72, 76)
    store = ex.Store(t, "X14", (grid, train, check, ahead))
    rows = store.once("rasgos", lambda: _legacy_rows(_buffer_dense(t, 150.0), HIGH_FROM_BUFFER))
    weighted = lambda power: lambda df: jobs.minority_bound()(df).withColumn("peso_muestra", F.pow("peso_muestra", F.lit(power)))
    fits = {n: ex.Candidate(n, rows, _G["mensual_legacy"], s, weighted(power), f"potencia {power}", train, {"validacion": check}) for n, (s, power) in grid.items()}
    store.run(list(fits.values()))
    found = store.scores(fits)

    def rules(name):
        table = ev.fixed_rule_search(found.filter(F.col("ajuste") == name)).withColumn("ajuste", F.lit(name)).withColumn("regla", F.when(F.col("celda") == 0, "argmax").otherwise("cortes"))
        return table.orderBy(F.desc(F.round("puntaje", 12)), F.desc("f1_macro"), F.desc("recall_alto"), "celda")

    best_cuts = lambda name: rules(name).filter("regla = 'cortes'").limit(1)
    judged = store.once("reglas", lambda: jobs.union_all(ex.together([lambda n=n: jobs.settle(rules(n).filter("regla = 'argmax'").unionByName(best_cuts(n))) for n in grid])))
    choices = [r.asDict() for r in judged.collect()]  # two rows for each configuration
    order = lambda r: (-round(r["puntaje"], 12), -r["f1_macro"], -r["recall_alto"], r["celda"])
    best = [min((r for r in choices if grid[r["ajuste"]][0].family == family), key=order) for family in ("bosque", "impulso")]
    store.run([ex.refit(fits[r["ajuste"]], f"{r['ajuste']}_final", (train[0], check[1]), {"externa": ahead}) for r in best])
    final = []
    for r in best:
        decision = ex.by_argmax() if r["regla"] == "argmax" else jobs.by_cutoffs({"medio": r["corte_medio"], "alto": r["corte_alto"]})
        table = ex.metric_table(store.scores([f"{r['ajuste']}_final"]), decision).withColumn("ajuste", F.lit(r["ajuste"]))
        final.append(table.withColumn("regla", F.lit(r["regla"])).withColumn("corte_medio", F.lit(r["corte_medio"]).cast("double")).withColumn("corte_alto", F.lit(r["corte_alto"]).cast("double")))
    both = judged.withColumn("etapa", F.lit("validacion")).unionByName(jobs.union_all(final), True)
    return both.withColumn("nombre", F.col("ajuste"))
