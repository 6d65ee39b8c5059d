"""Lagged features of the dense panel. No feature reads its own month or later.

Panels are clustered by segment once; every window below is then local. A
segment holds months x shifts rows, so no window group grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tramorisk.functions.calendar import cyclic
from tramorisk.functions.risk import length_factor
from tramorisk.operators.panel import CUBE_MEASURES, MONTHLY_MEASURES
from tramorisk.session import spread

WINDOW_FIELDS = (
    "frecuencia_turno", "gravedad_turno", "frecuencia_total", "gravedad_total", "graves_turno", "robos_turno",
    "hurtos_turno", "extorsiones_turno", "homicidios_turno", "meses_activos_turno", "meses_activos_total",
    "densidad_turno", "densidad_total", "fraccion_meses_observados", "cobertura_media")
HISTORY_FIELDS = (
    "historico_frecuencia_turno", "historico_frecuencia_total", "historico_gravedad_turno",
    "historico_fraccion_medio", "historico_fraccion_alto", "historico_fraccion_activo", "historico_cuota_turno",
    "meses_desde_ultimo_turno", "meses_desde_ultimo_total", "meses_observados_historico")
_SUFFIX = {"n": "frecuencia", "peso": "gravedad", "grave": "graves", "robo": "robos", "hurto": "hurtos",
           "extorsion": "extorsiones", "homicidio": "homicidios"}


def by_segment(shifts: bool = False):
    return W.partitionBy("tramo_id", "turno_idx") if shifts else W.partitionBy("tramo_id")


def cluster(panel: DataFrame) -> DataFrame:
    """One shuffle by segment that all windows below reuse."""
    return panel.repartition("tramo_id")


def previous_totals(panel: DataFrame, columns: Sequence[str], months: int, how: str = "sum") -> DataFrame:
    """Sum (or maximum) of the previous ``months``; NULL until they all exist."""
    frame = by_segment().orderBy("mes_idx").rowsBetween(-months, -1)
    agg = {"sum": F.sum, "max": F.max}[how]
    full = F.col("mes_idx") >= months
    return cluster(panel).select("*", *[F.when(full, agg(c).over(frame)).alias(f"{c}_hist") for c in columns])


def with_month_totals(cube: DataFrame) -> DataFrame:
    """Add count and severity of all shifts of the month to each shift row."""
    whole = W.partitionBy("tramo_id", "mes_idx")
    return cube.withColumn("n_total", F.sum("n").over(whole)).withColumn("peso_total", F.sum("peso").over(whole))


def shift_history(cube: DataFrame, months: int = 3) -> DataFrame:
    """Short history of a shift and of all shifts, cut at the series start.

    ``cube`` is dense by segment, month and shift, with place and length.
    """
    frame = by_segment(True).orderBy("mes_idx").rangeBetween(-months, -1)
    base = with_month_totals(cluster(cube))
    past = lambda c: F.coalesce(F.sum(c).over(frame), F.lit(0))
    turn = cyclic(F.col("turno_idx"), 4)
    month = cyclic(F.pmod(F.col("mes_idx"), F.lit(12)), 12)
    out = base.select(
        *[c for c in base.columns if c not in (*CUBE_MEASURES, "n_total", "peso_total")],
        turn[0].alias("turno_sin"), turn[1].alias("turno_cos"), month[0].alias("mes_sin"), month[1].alias("mes_cos"),
        past("n").alias(f"frecuencia_turno_{months}m"), past("peso").alias(f"gravedad_turno_{months}m"),
        past("n_total").alias(f"frecuencia_total_{months}m"), past("peso_total").alias(f"gravedad_total_{months}m"),
        *[past(c).alias(f"{_SUFFIX[c]}_turno_{months}m") for c in CUBE_MEASURES[2:]],
        (F.col("peso") / length_factor(F.col("longitud_m"))).alias("riesgo"))
    return (out.withColumn("densidad_turno_100m", F.col(f"frecuencia_turno_{months}m") / length_factor(F.col("longitud_m")))
            .withColumn("densidad_gravedad_turno_100m",
                        F.col(f"gravedad_turno_{months}m") / length_factor(F.col("longitud_m"))))


def panel_history(panel: DataFrame, months: int = 3) -> DataFrame:
    """Sixteen monthly columns: place, eleven summed measures, two densities."""
    out = previous_totals(panel, MONTHLY_MEASURES, months)
    factor = length_factor(F.col("longitud_m"))
    return out.withColumn("densidad_delictiva_100m", F.col("frecuencia_hist") / factor).withColumn(
        "densidad_gravedad_100m", F.col("suma_pesos_hist") / factor).withColumn(
        "riesgo", F.col("suma_pesos") / factor)


def _month_window_stats(months: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Observed months and mean coverage before each month, per window.

    The month dimension is a few hundred rows, so its global window is small.
    """
    seen = F.when(F.col("observado"), 1).otherwise(0)
    cover = F.when(F.col("observado"), F.col("cobertura"))
    out = months
    for w in windows:
        frame = W.orderBy("mes_idx").rowsBetween(-w, -1)
        out = out.withColumn(f"_obs_{w}", F.coalesce(F.sum(seen).over(frame), F.lit(0))).withColumn(
            f"_cob_{w}", F.coalesce(F.avg(cover).over(frame), F.lit(0.0)))
    whole = W.orderBy("mes_idx").rowsBetween(W.unboundedPreceding, -1)
    return out.withColumn("_obs_h", F.coalesce(F.sum(seen).over(whole), F.lit(0)))


def observed_windows(cube: DataFrame, months: DataFrame, windows: Sequence[int] = (1, 3, 6, 12),
                     high_from: float = 3.0) -> DataFrame:
    """Per-observed-month statistics over several windows and the whole past.

    Months below the coverage minimum are missing, not zero: they leave both
    the sums and the denominators.
    """
    dim = _month_window_stats(months, windows).drop("periodo", "mes_num", "cobertura")
    base = cluster(cube).join(F.broadcast(dim), "mes_idx")  # calendar rows only
    whole = W.partitionBy("tramo_id", "mes_idx")
    seen = F.when(F.col("observado"), 1).otherwise(0)
    factor = length_factor(F.col("longitud_m"))
    for c in CUBE_MEASURES:
        base = base.withColumn(f"_o_{c}", F.col(c) * seen)
    base = (base.withColumn("_t_n", F.sum("_o_n").over(whole)).withColumn("_t_peso", F.sum("_o_peso").over(whole))
            .withColumn("_a", F.when(F.col("_o_n") > 0, 1).otherwise(0))
            .withColumn("_ta", F.when(F.col("_t_n") > 0, 1).otherwise(0))
            .withColumn("_alto", F.when(F.col("_o_peso") / factor >= high_from, 1).otherwise(0))
            .withColumn("_factor", factor))
    sources = ("_o_n", "_o_peso", "_t_n", "_t_peso", "_o_grave", "_o_robo", "_o_hurto", "_o_extorsion",
               "_o_homicidio", "_a", "_ta")
    order = by_segment(True).orderBy("mes_idx")
    out = []
    for w in windows:
        frame = order.rowsBetween(-w, -1)
        per = F.greatest(F.col(f"_obs_{w}"), F.lit(1))
        rates = [F.coalesce(F.sum(s).over(frame), F.lit(0)) / per for s in sources]
        rates += [rates[0] / F.col("_factor"), rates[2] / F.col("_factor"),
                  F.col(f"_obs_{w}") / float(w), F.col(f"_cob_{w}")]
        out += [r.alias(f"ventana_{w}m_{name}") for r, name in zip(rates, WINDOW_FIELDS)]
    past = order.rowsBetween(W.unboundedPreceding, -1)
    per = F.greatest(F.col("_obs_h"), F.lit(1))
    total = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0))
    last = lambda c: F.max(F.when(F.col(c) > 0, F.col("mes_idx"))).over(past)
    long_run = [total("_o_n") / per, total("_t_n") / per, total("_o_peso") / per, (total("_a") - total("_alto")) / per,
                total("_alto") / per, total("_a") / per, total("_o_n") / F.greatest(total("_t_n"), F.lit(1)),
                F.coalesce(F.col("mes_idx") - last("_o_n"), F.col("mes_idx") + 1).cast("double"),
                F.coalesce(F.col("mes_idx") - last("_t_n"), F.col("mes_idx") + 1).cast("double"),
                F.col("_obs_h").cast("double")]
    out += [c.alias(name) for c, name in zip(long_run, HISTORY_FIELDS)]
    return base.select("tramo_id", "mes_idx", "turno_idx", (F.col("peso") / F.col("_factor")).alias("riesgo"), *out)


def monthly_context(panel: DataFrame, high_from: float) -> DataFrame:
    """Lags, rolling statistics and trends of the monthly risk."""
    factor = length_factor(F.col("longitud_m"))
    order = by_segment().orderBy("mes_idx")
    base = cluster(panel).withColumn("_f", factor).withColumn("riesgo", F.col("suma_pesos") / factor)
    span = lambda a, b: order.rowsBetween(a, b)
    cols: list[Column] = [F.log1p("longitud_m").alias("log_longitud"),
                          F.least(F.col("mes_idx"), F.lit(12)).alias("meses_historia_disponible")]
    for lag in (1, 2, 3):
        cols += [(F.lag(m, lag).over(order) / F.col("_f")).alias(f"lag{lag}_{m}") for m in MONTHLY_MEASURES]
    for w in (3, 6, 12):
        frame = span(-w, -1)
        cols += [(F.avg("frecuencia").over(frame) / F.col("_f")).alias(f"conteo_media{w}"),
                 F.avg("riesgo").over(frame).alias(f"riesgo_media{w}"),
                 F.stddev_pop("riesgo").over(frame).alias(f"riesgo_std{w}"),
                 F.max("riesgo").over(frame).alias(f"riesgo_max{w}"),
                 F.avg(F.when(F.col("riesgo") > 0, 1.0).otherwise(0.0)).over(frame).alias(f"meses_activos{w}"),
                 F.avg(F.when(F.col("riesgo") >= high_from, 1.0).otherwise(0.0)).over(frame).alias(f"meses_altos{w}")]
    one, two = F.lag("riesgo", 1).over(order), F.lag("riesgo", 2).over(order)
    recent, older = F.avg("riesgo").over(span(-3, -1)), F.avg("riesgo").over(span(-6, -4))
    # With three months of history the older block is the first month alone.
    older = F.when(F.col("mes_idx") <= 3, F.first("riesgo").over(span(W.unboundedPreceding, -1))).otherwise(older)
    mes = cyclic(F.pmod(F.col("mes_idx"), F.lit(12)), 12)
    cols += [F.lag("riesgo", 6).over(order).alias("riesgo_lag6"), F.lag("riesgo", 12).over(order).alias("riesgo_lag12"),
             (one - two).alias("tendencia1_2"), (recent - older).alias("tendencia3_6"),
             ((one + 0.05) / (F.avg("riesgo").over(span(-6, -1)) + 0.05)).alias("ratio1_6"),
             mes[0].alias("mes_sin"), mes[1].alias("mes_cos"), one.alias("_lag1"), recent.alias("_media3")]
    kept = [c for c in ("latitud", "longitud") if c in panel.columns]
    return base.select("tramo_id", "mes_idx", *kept, "riesgo", *cols).filter(F.col("mes_idx") >= 3)


def month_activity(panel: DataFrame, high_from: float, lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Share of active and of high segments in each of the last months."""
    risk = F.col("suma_pesos") / length_factor(F.col("longitud_m"))
    shares = panel.groupBy("mes_idx").agg(
        F.avg(F.when(risk > 0, 1.0).otherwise(0.0)).alias("_act"),
        F.avg(F.when(risk >= high_from, 1.0).otherwise(0.0)).alias("_alt"))
    order = W.orderBy("mes_idx")  # one row per calendar month
    return shares.select("mes_idx", *[F.lag("_act", k).over(order).alias(f"cobertura_global_lag{k}") for k in lags],
                         *[F.lag("_alt", k).over(order).alias(f"altos_global_lag{k}") for k in lags])


def _around(features: DataFrame, neighbors: DataFrame, columns: Sequence[str], keys: Sequence[str], carried: str) -> DataFrame:
    """Rows of all neighbours beside each segment: ``tramo_id``, ``carried``, keys and columns, clustered by segment.

    A segment's months travel as one row, once to its neighbours and once to the
    segment that asks, and are unpacked only there; the sums above need no
    further shuffle.
    """
    packed = features.select("tramo_id", *keys, *columns).groupBy(F.col("tramo_id").alias("vecino_id")).agg(F.collect_list(F.struct(*keys, *columns)).alias("_m"))
    pairs = spread(neighbors.select("tramo_id", "vecino_id", carried).join(packed, "vecino_id"), "tramo_id")
    return pairs.select("tramo_id", carried, F.explode("_m").alias("_v")).select("tramo_id", carried, "_v.*")


def neighbor_means(features: DataFrame, neighbors: DataFrame, columns: dict[str, str], ranks: Sequence[int],
                   keys: Sequence[str] = ("mes_idx",)) -> DataFrame:
    """Mean of neighbours' values over the nearest ``ranks``.

    ``columns`` maps an output stem to an input column of ``features``.
    """
    near = neighbors.filter(F.col("puesto") <= max(ranks))
    rows = _around(features, near, sorted(set(columns.values())), keys, "puesto")
    aggs = [F.avg(F.when(F.col("puesto") <= k, F.col(c))).alias(f"vecinos{k}_{stem}")
            for k in ranks for stem, c in columns.items()]
    return rows.groupBy("tramo_id", *keys).agg(*aggs)


def neighbor_sums(features: DataFrame, neighbors: DataFrame, columns: Sequence[str],
                  keys: Sequence[str] = ("mes_idx", "turno_idx")) -> DataFrame:
    """Distance-weighted sums of neighbours' history columns."""
    return _around(features, neighbors, columns, keys, "w").groupBy("tramo_id", *keys).agg(
        *[F.sum(F.col("w") * F.col(c)).alias(f"vecinos_{c}") for c in columns])


def shift_context(cube: DataFrame, neighbors: DataFrame, high_from: float) -> DataFrame:
    """Shift block: one-hot, lags, three-month statistics, share, neighbours."""
    factor = length_factor(F.col("longitud_m"))
    order = by_segment(True).orderBy("mes_idx")
    last3 = order.rowsBetween(-3, -1)
    base = cluster(cube).withColumn("_r", F.col("peso") / factor)
    base = base.withColumn("_total", F.sum("_r").over(W.partitionBy("tramo_id", "mes_idx")))
    lag = [F.lag("_r", k).over(order) for k in (1, 2, 3)]
    mean3 = F.avg("_r").over(last3)
    rows = base.select(
        "tramo_id", "mes_idx", "turno_idx",
        *[F.when(F.col("turno_idx") == k, 1.0).otherwise(0.0).alias(f"turno_es_{k}") for k in range(4)],
        *[c.alias(f"turno_lag{k}") for k, c in enumerate(lag, 1)],
        mean3.alias("turno_media3"), F.stddev_pop("_r").over(last3).alias("turno_std3"),
        F.max("_r").over(last3).alias("turno_max3"),
        F.avg(F.when(F.col("_r") > 0, 1.0).otherwise(0.0)).over(last3).alias("turno_activos3"),
        F.avg(F.when(F.col("_r") >= high_from, 1.0).otherwise(0.0)).over(last3).alias("turno_altos3"),
        (F.avg("n").over(last3) / factor).alias("turno_conteo3"),
        (mean3 / (F.avg("_total").over(last3) + 0.05)).alias("turno_cuota3")).filter(F.col("mes_idx") >= 3)
    near = neighbor_means(rows, neighbors, {"turno_lag1": "turno_lag1", "turno_media3": "turno_media3"}, (8,),
                          ("mes_idx", "turno_idx"))
    return rows.join(near, ["tramo_id", "mes_idx", "turno_idx"], "left")


def density_history(density: DataFrame, months: DataFrame, name: str) -> DataFrame:
    """Network-density history: 1 and 3 months by shift, 3 and 6 over all shifts."""
    dim = _month_window_stats(months, (1, 3, 6)).select("mes_idx", "observado", "_obs_1", "_obs_3", "_obs_6")
    base = cluster(density).join(F.broadcast(dim), "mes_idx")  # calendar rows only
    base = base.withColumn("_d", F.when(F.col("observado"), F.col("densidad")).otherwise(0.0))
    base = base.withColumn("_dt", F.sum("_d").over(W.partitionBy("tramo_id", "mes_idx")))
    order = by_segment(True).orderBy("mes_idx")
    mean = lambda c, w: (F.coalesce(F.sum(c).over(order.rowsBetween(-w, -1)), F.lit(0.0))
                         / F.greatest(F.col(f"_obs_{w}"), F.lit(1)))
    return base.select("tramo_id", "mes_idx", "turno_idx",
                       mean("_d", 1).alias(f"{name}_ultimo_mes_turno"), mean("_d", 3).alias(f"{name}_tres_meses_turno"),
                       mean("_dt", 3).alias(f"{name}_tres_meses_total"), mean("_dt", 6).alias(f"{name}_seis_meses_total"))


def monthly_density_history(density: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lag 1 and means of 3 and 6 months of monthly densities."""
    order = by_segment().orderBy("mes_idx")
    out = []
    for c in columns:
        out += [F.lag(c, 1).over(order).alias(f"{c}_lag1"), F.avg(c).over(order.rowsBetween(-3, -1)).alias(f"{c}_media3"),
                F.avg(c).over(order.rowsBetween(-6, -1)).alias(f"{c}_media6")]
    return cluster(density).select("tramo_id", "mes_idx", *out)


def sequences(panel: DataFrame, channels: Sequence[str], months: int = 12) -> DataFrame:
    """Last ``months`` as an array of arrays: log of each channel and a mask.

    Missing months at the series start are zero vectors with mask 0.
    """
    order = by_segment().orderBy("mes_idx").rowsBetween(-months, -1)
    factor = length_factor(F.col("longitud_m"))
    step = F.array(*[F.log1p(F.greatest(F.col(c) / factor, F.lit(0.0))) for c in channels], F.lit(1.0))
    empty = F.array(*[F.lit(0.0)] * (len(channels) + 1))
    known = F.transform(F.array_sort(F.collect_list(F.struct("mes_idx", step.alias("v"))).over(order)), lambda s: s["v"])
    padded = F.concat(F.array_repeat(empty, F.lit(months) - F.size(known)), known)
    return cluster(panel).select("tramo_id", "mes_idx", padded.alias("secuencia"))


def half_life(df: DataFrame, months: float, month: str = "mes_idx", name: str = "peso_edad") -> DataFrame:
    """Weight halving every ``months``, scaled to mean 1."""
    sizes = {r[month]: r["count"] for r in df.groupBy(month).count().collect()}  # calendar rows only
    last, rows = max(sizes), sum(sizes.values())
    mean = sum(n * 2.0 ** (-(last - m) / months) for m, n in sizes.items()) / rows
    return df.withColumn(name, F.pow(F.lit(2.0), -(F.lit(last) - F.col(month)) / float(months)) / mean)


def feature_groups(windows: Sequence[int] = (1, 3, 6, 12), bands: Sequence[int] = (100, 250, 500)) -> dict[str, list[str]]:
    """Named column lists of the shift and the monthly feature sets."""
    place = ["latitud", "longitud", "longitud_m", "turno_sin", "turno_cos", "mes_sin", "mes_cos"]
    short = [f"{s}_turno_3m" for s in ("frecuencia", "gravedad")] + [f"{s}_total_3m" for s in ("frecuencia", "gravedad")] + [
        f"{s}_turno_3m" for s in ("graves", "robos", "hurtos", "extorsiones", "homicidios")] + [
        "densidad_turno_100m", "densidad_gravedad_turno_100m"]
    groups = {"legacy": place + short}
    every = []
    for w in windows:
        block = [f"ventana_{w}m_{f}" for f in WINDOW_FIELDS]
        groups[f"{w}m"] = place + block
        every += block
    groups["multi"] = place + every + list(HISTORY_FIELDS)
    groups["multi_base"] = list(groups["multi"])
    kernel_fields = ("ultimo_mes_turno", "tres_meses_turno", "tres_meses_total", "seis_meses_total")
    kernels = []
    for b in bands:
        block = [f"nkde_{b}m_{f}" for f in kernel_fields]
        groups[f"multi_nkde_{b}m"] = groups["multi"] + block
        kernels += block
    groups["multi_nkde_all"] = groups["multi"] + kernels
    groups["vecindad"] = groups["legacy"] + [f"vecinos_{c}" for c in short[:4]]
    temporal = ["latitud", "longitud", "log_longitud", "meses_historia_disponible"]
    temporal += [f"lag{k}_{m}" for k in (1, 2, 3) for m in MONTHLY_MEASURES]
    for w in (3, 6, 12):
        temporal += [f"conteo_media{w}"] + [f"riesgo_{s}{w}" for s in ("media", "std", "max")] + [
            f"meses_activos{w}", f"meses_altos{w}"]
    temporal += ["riesgo_lag6", "riesgo_lag12", "tendencia1_2", "tendencia3_6", "ratio1_6", "mes_sin", "mes_cos"]
    around = [f"vecinos{k}_{f}" for k in (8, 32) for f in ("riesgo_lag1", "riesgo_media3", "activos_lag1")]
    around += [f"{f}_lag{k}" for k in (1, 2, 3) for f in ("cobertura_global", "altos_global")]
    base16 = ["latitud", "longitud", "longitud_m"] + [f"{m}_hist" for m in MONTHLY_MEASURES] + [
        "densidad_delictiva_100m", "densidad_gravedad_100m"]
    groups["mensual_legacy"] = base16
    groups["temporal"] = temporal
    groups["contexto"] = temporal + around
    groups["sin_geografia"] = temporal[2:] + around
    groups["aumentado"] = base16 + temporal[3:]
    groups["aumentado_contexto"] = base16 + temporal[3:] + around
    return groups
