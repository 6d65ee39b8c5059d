"""Stored, resumable experiments on a small panel."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from tramorisk.operators.models import ModelSpec
from tramorisk.plans import catalog_models, experiments as ex, jobs
from tramorisk.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"
FOREST, BOOST = ModelSpec("bosque", trees=4, depth=3), ModelSpec("impulso", "impulso", trees=4, depth=2, step=0.3)


def panel(spark, months=24, segments=40):
    grid = spark.range(months).select(F.col("id").cast("int").alias("mes_idx")).crossJoin(spark.range(segments).select(F.col("id").alias("k")))
    rows = grid.withColumn("tramo_id", F.concat(F.lit("t"), "k")).withColumn("a", F.pmod(F.col("k") * 7 + F.col("mes_idx") * 3, F.lit(10)).cast("double")).withColumn("b", (F.col("k") % 4).cast("double"))
    return rows.withColumn("y", F.when(F.col("a") > 7, 2).when(F.col("a") + F.col("b") > 6, 1).otherwise(0)).drop("k")


@pytest.fixture()
def rows(spark):
    return jobs.settle(panel(spark))


def weighted(df):
    return df.withColumn("peso_muestra", F.lit(1.0))


def store(spark, name, settings="a"):
    return ex.Store(Tables(spark, FOLDER), f"prueba_{name}_{time.time_ns()}", settings)


def candidates(rows):
    stages = {"calibracion": (14, 16), "seleccion": (17, 19), "retrospectiva": (20, 23)}
    return [ex.Candidate(n, rows, ["a", "b"], s, weighted, "todo", (0, 13), stages) for n, s in (("bosque_ab", FOREST), ("impulso_ab", BOOST))]


def test_together_runs_side_by_side_in_order(spark):
    seen, barrier = [], threading.Barrier(3, timeout=20)

    def job(i):
        def run():
            barrier.wait()
            seen.append(i)
            return i * i
        return run

    assert ex.together([job(i) for i in range(3)]) == [0, 1, 4] and sorted(seen) == [0, 1, 2]
    with pytest.raises(ZeroDivisionError):
        ex.together([lambda: 1, lambda: 1 // 0])


def test_scores_hold_every_asked_row_and_a_rerun_fits_nothing(spark, rows, monkeypatch):
    kept = store(spark, "resumen")
    kept.run(candidates(rows))
    found = kept.scores(["bosque_ab", "impulso_ab"])
    assert {(r["ajuste"], r["etapa"]): r["count"] for r in found.groupBy("ajuste", "etapa").count().collect()} == {
        (n, e): 40 * m for n in ("bosque_ab", "impulso_ab") for e, m in (("calibracion", 3), ("seleccion", 3), ("retrospectiva", 4))}
    assert found.filter(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-9).isEmpty()

    def refuse(*_args, **_kwargs):
        raise AssertionError("fitted again")

    monkeypatch.setattr(ex.models, "fit", refuse)
    monkeypatch.setattr(ex.boosting, "fit_many", refuse)
    kept.run(candidates(rows))
    with pytest.raises(AssertionError, match="fitted again"):
        kept.run([ex.refit(candidates(rows)[0], "otro", (0, 10), {"x": (11, 11)})])


def test_an_interrupted_run_goes_on_where_it_stopped(spark, rows, monkeypatch):
    kept, fits = store(spark, "corte"), []
    fit = ex.models.fit
    monkeypatch.setattr(ex.boosting, "fit_many", lambda *_: (_ for _ in ()).throw(RuntimeError("executor lost")))
    with pytest.raises(RuntimeError):
        kept.run(candidates(rows))
    assert kept.done("bosque_ab") and not kept.done("impulso_ab")
    monkeypatch.undo()
    monkeypatch.setattr(ex.models, "fit", lambda *a, **k: fits.append(1) or fit(*a, **k))
    kept.run(candidates(rows))
    assert kept.done("impulso_ab") and not fits


def test_settings_and_inputs_are_part_of_the_fingerprint(spark):
    tables = Tables(spark, FOLDER)
    first, again, other = ex.Store(tables, "n", ("a", 1)), ex.Store(tables, "n", ("a", 1)), ex.Store(tables, "n", ("a", 2))
    assert first.root == again.root != other.root
    assert ex.Store(Tables(spark, "/root/testdata/sf0.01"), "n", ("a", 1)).root != first.root


def test_staged_comparison_freezes_on_selection(spark, rows):
    found = [r.asDict() for r in ex.staged_comparison(store(spark, "etapas"), candidates(rows)).collect()]
    assert sorted((r["nombre"], r["variante"]) for r in found if r["etapa"] == "seleccion") == [
        (n, v) for n in ("bosque_ab", "impulso_ab") for v in ("calibrado", "directo")]
    late = {r["nombre"]: r["variante"] for r in found if r["etapa"] == "retrospectiva"}
    for name, variant in late.items():
        mine = {r["variante"]: round(r["f1_medio_alto"], 12) for r in found if r["nombre"] == name and r["etapa"] == "seleccion"}
        assert mine[variant] == max(mine.values())
    assert set(late) == {"bosque_ab", "impulso_ab"} and len({r["nombre"] for r in found if r["elegido"]}) == 1


def protocol():
    return ex.Protocol({"bosque": FOREST, "impulso": BOOST}, {"3m": 3, "inicio": None}, (8, 11, 14), (15, 16, 17, 18), 20)


def test_protocol_phases(spark, rows):
    kept = store(spark, "protocolo")
    state = ex.MonthlyProtocol(kept, protocol(), rows, ["a", "b"], weighted, "todo")
    table = state.phase_b().collect()
    assert sorted((r["familia"], r["ventana"], r["n"]) for r in table) == [(f, w, 120) for f in ("bosque", "impulso") for w in ("3m", "inicio")]
    assert set(state.frozen()) == {"bosque", "impulso"} and state.phase_c().count() == 2 * 4 * 40
    digests = state.register_d("1996-09")
    assert state.register_d("1996-09") == digests  # a rerun reads what is registered
    first = state.evaluate_d("1996-09").collect()
    assert sorted(r["huella"] for r in first) == sorted(digests.values()) and all(r["n"] == 40 for r in first)
    with pytest.raises(ValueError, match="already evaluated"):
        state.evaluate_d("1996-09")
    assert sorted(state.evaluation_d("1996-09").collect()) == sorted(first)


def test_no_fit_sees_its_target_month(spark, rows):
    state = ex.MonthlyProtocol(store(spark, "causal"), protocol(), rows, ["a"], weighted, "todo")
    for window, first in (("3m", 12), ("inicio", 3)):
        plan = state._candidate("C", "bosque", window, 15)
        assert plan.train == (first, 14) and plan.stages == {"C": (15, 15)}


def test_a_changed_choice_and_a_changed_forecast_are_errors(spark, rows, monkeypatch):
    kept = store(spark, "fijo")
    state = ex.MonthlyProtocol(kept, protocol(), rows, ["a", "b"], weighted, "todo")
    frozen, digests = state.frozen(), state.register_d("1996-09")
    monkeypatch.setattr(ex, "registered_forecasts", lambda *_: spark.createDataFrame([(1, "other", "1996-09")], "filas long, huella string, periodo string"))
    with pytest.raises(ValueError, match="has changed"):
        state.evaluate_d("1996-09")
    monkeypatch.setattr(ex.MonthlyProtocol, "choose", lambda self, table: [{"familia": f, "ventana": "nunca"} for f in frozen])
    with pytest.raises(ValueError, match="cannot change"):
        state.frozen()
    assert digests


def test_phases_must_be_chronological():
    with pytest.raises(ValueError):
        ex.Protocol({"bosque": FOREST}, {"3m": 3}, (8, 16), (15,), 20)


def test_published_plans():
    plan = catalog_models.monthly_protocol()
    assert list(plan.windows.values()) == [3, 12, None] and len(plan.origins_b) == 12 and {o % 12 for o in plan.origins_b} == {2, 5, 8, 11}
    assert plan.origins_c == tuple(range(60, 80)) and plan.month_d == 81
    names = [n for n, *_ in catalog_models.window_candidates()]
    assert len(names) == len(set(names)) == 16
