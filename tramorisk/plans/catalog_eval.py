"""Evaluation tables, threshold searches and candidate selection."""

from pyspark.sql import functions as F

from tramorisk.functions.risk import argmax3, decide, risk_class
from tramorisk.operators import evaluate as ev
from tramorisk.plans.oracle import PROBA
from tramorisk.plans.registry import query
from tramorisk.sources.readers import metric_rows

_AM = "CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END"


def _argmax(a="p0", b="p1", c="p2"):
    return _AM.format(a=a, b=b, c=c)


_DEC = "CASE WHEN p2 >= 0.4 THEN 2 WHEN p1 >= 0.34 THEN 1 ELSE 0 END"
_CELLS = ", ".join(f"count(*) FILTER (y = {t} AND pred = {p}) AS c{t}{p}" for t in range(3) for p in range(3))
_PRED = f"{PROBA}, pr AS (SELECT *, {_DEC} AS pred FROM proba)"
_CC = " ".join(f"c{t}{p}:l" for t in range(3) for p in range(3))


def _metrics_sql(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    r = "CASE WHEN {b} > 0 THEN {a} / ({b})::DOUBLE ELSE 0 END"
    q = lambda a, b: r.format(a=a, b=b)
    act = [f"(c{i}0 + c{i}1 + c{i}2)" for i in range(3)]
    gue = [f"(c0{i} + c1{i} + c2{i})" for i in range(3)]
    pre = [q(f"c{i}{i}", gue[i]) for i in range(3)]
    rec = [q(f"c{i}{i}", act[i]) for i in range(3)]
    f1 = [q(f"2 * c{i}{i}", f"{act[i]} + {gue[i]}") for i in range(3)]
    tot = " + ".join(act)
    cols = [f"{tot} AS n", f"{q('c00 + c11 + c22', tot).replace('THEN c00 + c11 + c22', 'THEN (c00 + c11 + c22)')} AS accuracy", f"({' + '.join(rec)}) / 3 AS balanced_accuracy",
            f"({' + '.join(pre)}) / 3 AS precision_macro", f"({' + '.join(rec)}) / 3 AS recall_macro", f"({' + '.join(f1)}) / 3 AS f1_macro", f"({f1[1]} + {f1[2]}) / 2 AS f1_medio_alto"]
    for i, n in enumerate(("bajo", "medio", "alto")):
        cols += [f"{pre[i]} AS precision_{n}", f"{rec[i]} AS recall_{n}", f"{f1[i]} AS f1_{n}", f"{act[i]} AS reales_{n}", f"{gue[i]} AS predichos_{n}"]
    cols = [c.replace("CASE WHEN", "(CASE WHEN").replace(" END", " END)") for c in cols]
    return f"SELECT {k}{', '.join(cols)} FROM ({source})"


_MC = "n:l accuracy:d balanced_accuracy:d precision_macro:d recall_macro:d f1_macro:d f1_medio_alto:d " + " ".join(
    f"precision_{n}:d recall_{n}:d f1_{n}:d reales_{n}:l predichos_{n}:l" for n in ("bajo", "medio", "alto"))


def _pred(t):
    return t.proba().withColumn("pred", decide(F.col("p1"), F.col("p2"), 0.34, 0.4))


@query("V01_confusion", _CC, f"WITH {_PRED} SELECT {_CELLS} FROM pr")
def _(t):
    return ev.confusion(_pred(t))


@query("A14_class_distribution", "mes_idx:l " + _CC, f"WITH {_PRED} SELECT mes_idx, {_CELLS} FROM pr GROUP BY mes_idx")
def _(t):
    return ev.confusion(_pred(t), ["mes_idx"])


@query("V02_metrics", _MC, f"WITH {_PRED} {_metrics_sql(f'SELECT {_CELLS} FROM pr')}")
def _(t):
    return ev.metrics(ev.confusion(_pred(t)))


@query("V12_metrics_by_month", "mes_idx:l " + _MC, f"WITH {_PRED} {_metrics_sql(f'SELECT mes_idx, {_CELLS} FROM pr GROUP BY mes_idx', 'mes_idx')}")
def _(t):
    return ev.metrics(ev.confusion(_pred(t), ["mes_idx"]))


@query("A20_metrics_by_shift_sets", "mes_idx:l turno_idx:l accuracy:d f1_macro:d recall_alto:d", f"""
WITH {_PRED} {_metrics_sql(f'SELECT coalesce(mes_idx, -1) AS mes_idx, coalesce(turno_idx, -1) AS turno_idx, {_CELLS} FROM pr GROUP BY GROUPING SETS ((mes_idx, turno_idx), (mes_idx), (turno_idx), ())', 'mes_idx, turno_idx')}""")
def _(t):
    return ev.metrics(ev.confusion_sets(ev.confusion(_pred(t), ["mes_idx", "turno_idx"])))


@query("A20_night_metrics", _MC, f"WITH {_PRED} {_metrics_sql(f'SELECT {_CELLS} FROM pr WHERE turno_idx IN (0, 3)')}")
def _(t):
    return ev.metrics(ev.night_confusion(ev.confusion(_pred(t), ["turno_idx"])))


@query("A21_subperiod_metrics", "grupo:s " + _MC, f"WITH {_PRED} {_metrics_sql(f'SELECT substr(periodo, 1, 4) AS grupo, {_CELLS} FROM pr GROUP BY ALL', 'grupo')}")
def _(t):
    monthly = ev.confusion(_pred(t), ["periodo"]).withColumn("grupo", F.substring("periodo", 1, 4))
    return ev.metrics(ev.add_confusions(monthly, ["grupo"]))


@query("A27_row_shares", "y:l pred:l n:l porcentaje:d", f"WITH {_PRED}, g AS (SELECT y, pred, count(*) AS n FROM pr GROUP BY y, pred) SELECT y, pred, n, n / (sum(n) OVER (PARTITION BY y))::DOUBLE * 100 AS porcentaje FROM g")
def _(t):
    return ev.row_shares(ev.confusion(_pred(t)))


@query("A27_class_report", "clase:s precision:d recall:d f1:d soporte:l", f"""
WITH {_PRED}, m AS ({_metrics_sql(f'SELECT {_CELLS} FROM pr')}) {" UNION ALL ".join(f"SELECT '{n}' AS clase, precision_{n} AS precision, recall_{n} AS recall, f1_{n} AS f1, reales_{n} AS soporte FROM m" for n in ("bajo", "medio", "alto"))}""")
def _(t):
    return ev.class_report(ev.confusion(_pred(t)))


@query("A28_metric_rows", "periodo:s metrica:s valor:d", f"""
WITH {_PRED}, m AS ({_metrics_sql(f'SELECT periodo, {_CELLS} FROM pr GROUP BY periodo', 'periodo')}) SELECT periodo, metrica, valor FROM (SELECT periodo, n::DOUBLE AS n, accuracy, f1_macro FROM m) UNPIVOT (valor FOR metrica IN (n, accuracy, f1_macro))""")
def _(t):
    return metric_rows(ev.metrics(ev.confusion(_pred(t), ["periodo"])).select("periodo", "n", "accuracy", "f1_macro"), "periodo")


def _curve(cls: int, score: str, key: str = "") -> str:
    k, part = (f"{key}, ", f"PARTITION BY {key} ") if key else ("", "")
    return (f"st AS (SELECT {k}{score} AS s, count(*) AS n, count(*) FILTER (y = {cls}) AS p FROM proba GROUP BY {k}{score}), "
            f"cu AS (SELECT *, sum(n) OVER ({part}ORDER BY s DESC) AS filas, sum(p) OVER ({part}ORDER BY s DESC) AS ac, sum(p) OVER ({part.strip()}) AS todos FROM st)")


@query("V03_average_precision", "filas:l positivos:l average_precision:d", f"WITH {PROBA}, {_curve(2, 'p2')} SELECT sum(n) AS filas, sum(p) AS positivos, sum(p * ac / filas::DOUBLE) / sum(p) AS average_precision FROM cu")
def _(t):
    return ev.average_precision(t.proba(), F.col("y") == 2, "p2")


@query("V03_average_precision_by_month", "mes_idx:l filas:l positivos:l average_precision:d", f"""
WITH {PROBA}, {_curve(1, 'p1', 'mes_idx')} SELECT mes_idx, sum(n) AS filas, sum(p) AS positivos, sum(p * ac / filas::DOUBLE) / sum(p) AS average_precision FROM cu GROUP BY mes_idx""")
def _(t):
    return ev.average_precision(t.proba(), F.col("y") == 1, "p1", ["mes_idx"])


@query("V04_precision_recall", "corte:d precision:d recall:d f1:d", f"WITH {PROBA}, {_curve(2, 'p2')} SELECT s AS corte, ac / filas::DOUBLE AS precision, ac / todos::DOUBLE AS recall, 2 * ac / (todos + filas)::DOUBLE AS f1 FROM cu")
def _(t):
    return ev.precision_recall(t.proba(), F.col("y") == 2, "p2")


@query("V04_best_cutoff", "turno_idx:l corte:d precision:d recall:d f1:d", f"""
WITH {PROBA}, {_curve(2, 'p2', 'turno_idx')}, f AS (SELECT turno_idx, s AS corte, ac / filas::DOUBLE AS precision, ac / todos::DOUBLE AS recall, 2 * ac / (todos + filas)::DOUBLE AS f1 FROM cu)
SELECT turno_idx, corte, precision, recall, f1 FROM (SELECT *, row_number() OVER (PARTITION BY turno_idx ORDER BY round(f1, 12) DESC, corte) AS rn FROM f) WHERE rn = 1""")
def _(t):
    return ev.best_cutoff(t.proba(), F.col("y") == 2, "p2", ["turno_idx"])


@query("V05_two_stage_cutoffs", "alto:d medio:d", f"""
WITH {PROBA}, {_curve(2, 'p2')}, a AS (SELECT s AS alto FROM cu ORDER BY round(2 * ac / (todos + filas)::DOUBLE, 12) DESC, s LIMIT 1), r AS (SELECT * FROM proba WHERE p2 < (SELECT alto FROM a)),
s2 AS (SELECT p1 AS s, count(*) AS n, count(*) FILTER (y = 1) AS p FROM r GROUP BY p1), c2 AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS filas, sum(p) OVER (ORDER BY s DESC) AS ac, sum(p) OVER () AS todos FROM s2)
SELECT (SELECT alto FROM a) AS alto, (SELECT s FROM c2 ORDER BY round(2 * ac / (todos + filas)::DOUBLE, 12) DESC, s LIMIT 1) AS medio""")
def _(t):
    cuts = ev.two_stage_cutoffs(t.proba())
    return t.proba().agg(F.lit(cuts["alto"]).alias("alto"), F.lit(cuts["medio"]).alias("medio"))


def _grid_sql(cls: int, score: str) -> str:
    own = ", ".join(repr(i / 54) for i in range(55))
    out = ", ".join(repr(0.9 + i * (0.9999 - 0.9) / 34) for i in range(35))
    return (f"SELECT DISTINCT unnest(list_concat(list_concat((SELECT quantile_cont({score}, [{own}]) FROM proba WHERE y = {cls}), (SELECT quantile_cont({score}, [{out}]) FROM proba)), [0.0, 1.000001]))::DOUBLE AS v")


@query("V06_joint_cutoffs", "medio:d alto:d objetivo:d", f"""
WITH {PROBA}, gm AS ({_grid_sql(1, 'p1')}), gh AS ({_grid_sql(2, 'p2')}), c AS (SELECT p1, p2, y, count(*) AS n FROM proba GROUP BY p1, p2, y),
o AS (SELECT gm.v AS medio, gh.v AS alto, (2 * coalesce(sum(n) FILTER (y = 1 AND p1 >= gm.v AND p2 < gh.v), 0) / greatest((SELECT count(*) FROM proba WHERE y = 1) + coalesce(sum(n) FILTER (p1 >= gm.v AND p2 < gh.v), 0), 1)::DOUBLE
 + 2 * coalesce(sum(n) FILTER (y = 2 AND p2 >= gh.v), 0) / greatest((SELECT count(*) FROM proba WHERE y = 2) + coalesce(sum(n) FILTER (p2 >= gh.v), 0), 1)::DOUBLE) / 2 AS objetivo FROM gm, gh, c GROUP BY gm.v, gh.v)
SELECT * FROM o ORDER BY round(objetivo, 12) DESC, medio, alto LIMIT 1""")
def _(t):
    return ev.best_joint_cutoffs(t.proba())


def _search_sql(medium, high) -> str:
    ms, hs = ", ".join(f"({i}, {m!r}::DOUBLE)" for i, m in enumerate(medium)), ", ".join(f"({i}, {h!r}::DOUBLE)" for i, h in enumerate(high))
    return (f"gr AS (SELECT mi * {len(high)} + hi AS celda, m AS mult_medio, h AS mult_alto FROM (VALUES {ms}) a(mi, m), (VALUES {hs}) b(hi, h)), "
            f"cc AS (SELECT celda, mult_medio, mult_alto, {_CELLS} FROM (SELECT gr.*, y, {_argmax('p0', 'p1 * mult_medio', 'p2 * mult_alto')} AS pred FROM proba, gr) GROUP BY celda, mult_medio, mult_alto), "
            f"mm AS ({_metrics_sql('SELECT * FROM cc', 'celda, mult_medio, mult_alto')})")


_M1, _H1 = ev.MULTIPLIERS["base"]
_M2 = tuple(round(0.75 + 0.05 * i, 2) for i in range(12))
_H2 = tuple(round(0.80 + 0.05 * i, 2) for i in range(12))


@query("V07_multiplier_search", "celda:l mult_medio:d mult_alto:d accuracy:d f1_medio_alto:d puntaje:d", f"WITH {PROBA}, {_search_sql(_M1, _H1)} SELECT *, 0.4 * accuracy + 0.6 * f1_medio_alto AS puntaje FROM mm")
def _(t):
    return ev.multiplier_search(t.proba(), _M1, _H1)


@query("V07_wide_multiplier_search", "celda:l mult_medio:d mult_alto:d puntaje:d", f"WITH {PROBA}, {_search_sql(_M2, _H2)} SELECT *, 0.4 * accuracy + 0.6 * f1_medio_alto AS puntaje FROM mm ORDER BY round(puntaje, 12) DESC, celda LIMIT 1")
def _(t):
    return ev.best_multiplier(ev.multiplier_search(t.proba(), _M2, _H2))


@query("V08_fixed_rule_search", "celda:l corte_alto:d corte_medio:d puntaje:d", f"""
WITH {PROBA}, {_curve(2, 'p2')}, ap AS (SELECT sum(p * ac / filas::DOUBLE) / sum(p) AS ap FROM cu), gr AS (SELECT 0 AS celda, NULL::DOUBLE AS ca, NULL::DOUBLE AS cm UNION ALL SELECT hi * 7 + mi + 1, h, m FROM
 (VALUES {", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(ev.RULE_HIGH))}) a(hi, h), (VALUES {", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(ev.RULE_MEDIUM))}) b(mi, m)),
cc AS (SELECT celda, ca AS corte_alto, cm AS corte_medio, {_CELLS} FROM (SELECT gr.*, y, CASE WHEN ca IS NULL THEN {_argmax()} WHEN p2 >= ca THEN 2 WHEN p1 >= cm THEN 1 ELSE 0 END AS pred FROM proba, gr) GROUP BY celda, ca, cm),
mm AS ({_metrics_sql('SELECT * FROM cc', 'celda, corte_alto, corte_medio')}) SELECT *, 0.45 * f1_macro + 0.25 * balanced_accuracy + 0.20 * recall_alto + 0.10 * (SELECT ap FROM ap) AS puntaje FROM mm""")
def _(t):
    return ev.fixed_rule_search(t.proba())


_GUARD = f"""WITH {PROBA}, {_search_sql(_M1, _H1)}, r AS (SELECT *, 0.4 * accuracy + 0.6 * f1_medio_alto AS puntaje, 'c' || lpad(celda::VARCHAR, 2, '0') AS nombre FROM mm), ctl AS (SELECT * FROM r WHERE celda = 14),
g AS (SELECT r.*, CASE WHEN r.precision_alto >= 0.9 * c.precision_alto AND r.recall_alto >= 0.9 * c.recall_alto THEN CASE WHEN r.accuracy >= c.accuracy AND r.f1_medio_alto >= c.f1_medio_alto THEN 2 ELSE 1 END ELSE 0 END AS nivel_guarda FROM r, ctl c)"""


@query("V09_guarded_choice", "nombre:s nivel_guarda:l puntaje:d", f"{_GUARD} SELECT * FROM g ORDER BY nivel_guarda DESC, puntaje DESC, nombre LIMIT 1")
def _(t):
    rows = ev.multiplier_search(t.proba(), _M1, _H1).withColumn("nombre", F.concat(F.lit("c"), F.lpad(F.col("celda").cast("string"), 2, "0")))
    return ev.guarded_choice(rows, rows.filter("celda = 14"))


_BLENDS = (0.0, 0.25, 0.5, 0.75, 1.0)
_MEDS = tuple(round(0.70 + 0.025 * i, 3) for i in range(29))


@query("V10_frozen_high", "celda:l mezcla:d multiplicador:d accuracy:d f1_medio:d precision_alto:d recall_alto:d", f"""
WITH {PROBA}, gr AS (SELECT bi * 29 + mi AS celda, b AS mezcla, m AS multiplicador FROM (VALUES {", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(_BLENDS))}) x(bi, b), (VALUES {", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(_MEDS))}) z(mi, m)),
cc AS (SELECT celda, mezcla, multiplicador, {_CELLS} FROM (SELECT gr.*, y, CASE WHEN {_argmax()} = 2 THEN 2 WHEN (p1 * (1 - mezcla) + p2 * mezcla) * multiplicador > p0 * (1 - mezcla) + p1 * mezcla THEN 1 ELSE 0 END AS pred FROM proba, gr) GROUP BY celda, mezcla, multiplicador)
{_metrics_sql('SELECT * FROM cc', 'celda, mezcla, multiplicador')}""")
def _(t):
    return ev.frozen_high_search(t.proba(), ("p0", "p1", "p2"), ("p1", "p2", "p0"), _BLENDS, _MEDS)


@query("V11_best_variant", "turno_idx:l celda:l puntaje:d", f"""
WITH {PROBA}, g AS (SELECT turno_idx, v AS celda, {_CELLS} FROM (SELECT turno_idx, y, v, CASE v WHEN 0 THEN {_argmax()} ELSE {_DEC} END AS pred FROM proba, (VALUES (0), (1)) x(v)) GROUP BY turno_idx, v), m AS ({_metrics_sql('SELECT * FROM g', 'turno_idx, celda')})
SELECT turno_idx, celda, f1_medio_alto AS puntaje FROM (SELECT *, row_number() OVER (PARTITION BY turno_idx ORDER BY f1_medio_alto DESC, celda) AS rn FROM m) WHERE rn = 1""")
def _(t):
    raw = ev._grid_confusion(t.proba(), [argmax3(F.col("p0"), F.col("p1"), F.col("p2")), decide(F.col("p1"), F.col("p2"), 0.34, 0.4)], ["turno_idx"])
    rows = ev.metrics(raw).withColumn("puntaje", F.col("f1_medio_alto"))
    return ev.best_per_group(rows, ["turno_idx"], [F.desc("puntaje"), F.col("celda")])


@query("V13_log_loss", "mes_idx:l log_loss:d prevalencia_alto:d linea_base_mayoria:d", f"""
WITH {PROBA} SELECT mes_idx, avg(-ln(greatest(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-15))) AS log_loss, avg((y = 2)::INTEGER) AS prevalencia_alto,
 greatest(avg((y = 0)::INTEGER), avg((y = 1)::INTEGER), avg((y = 2)::INTEGER)) AS linea_base_mayoria FROM proba GROUP BY mes_idx""")
def _(t):
    return ev.log_loss(t.proba(), ["mes_idx"])


@query("V14_metric_deltas", "brazo:s delta_accuracy:d delta_f1_macro:d", f"""
WITH {PROBA}, g AS (SELECT brazo, {_CELLS} FROM (SELECT y, brazo, CASE brazo WHEN 'base' THEN {_argmax()} WHEN 'cortes' THEN {_DEC} ELSE 0 END AS pred FROM proba, (VALUES ('base'), ('cortes'), ('bajo')) x(brazo)) GROUP BY brazo), m AS ({_metrics_sql('SELECT * FROM g', 'brazo')})
SELECT m.brazo, m.accuracy - b.accuracy AS delta_accuracy, m.f1_macro - b.f1_macro AS delta_f1_macro FROM m, (SELECT * FROM m WHERE brazo = 'base') b WHERE m.brazo <> 'base'""")
def _(t):
    preds = [argmax3(F.col("p0"), F.col("p1"), F.col("p2")), decide(F.col("p1"), F.col("p2"), 0.34, 0.4), F.lit(0)]
    rows = ev.metrics(ev._grid_confusion(t.proba(), preds)).withColumn("brazo", F.element_at(F.array(F.lit("base"), F.lit("cortes"), F.lit("bajo")), F.col("celda") + 1))
    return ev.metric_deltas(rows, "brazo", "base", ["accuracy", "f1_macro"])


@query("V15_changed_labels", "celdas:l cambiadas:l", f"""
WITH {PROBA}, s AS (SELECT id, CASE WHEN p2 * 10 >= 3.0 THEN 2 WHEN p2 > 0 THEN 1 ELSE 0 END AS a, CASE WHEN p2 * 10 >= 2.3442396250791653::DOUBLE THEN 2 WHEN p2 > 0 THEN 1 ELSE 0 END AS b FROM proba)
SELECT count(*) AS celdas, count(*) FILTER (a <> b) AS cambiadas FROM s""")
def _(t):
    label = lambda cut: t.proba().select("id", risk_class(F.col("p2") * 10, cut).alias("y"))
    return ev.changed_labels(label(3.0), label(2.3442396250791653), ["id"])
