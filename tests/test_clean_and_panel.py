import datetime as dt

import pytest
from pyspark.sql import functions as F

from tramorisk.functions import severity
from tramorisk.functions.calendar import Calendar, strict_shift
from tramorisk.functions.text import normalize_text
from tramorisk.operators import clean, panel, windows
from tramorisk.operators.panel import require_order, require_splits


def test_months_in_two_languages(spark):
    rows = [("a", "-12.05", "-77.04", "October 31, 2025", "Mañana", "Robo"), ("b", "-12,06", "-77,03", "diciembre 1, 2025", "x", "Hurto"),
            ("b", "-12.07", "-77.03", "diciembre 2, 2025", "tarde", "Hurto"), ("c", "0", "0", "enero 3, 2025", "noche", "Hurto")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "GlobalID string, lat_hecho string, long_hecho string, fecha_hora_hecho string, turno_hecho string, tipo_hecho string, n int")
    out = {r["id_hecho"]: r for r in clean.clean_legacy(df, F.col("n")).collect()}
    assert set(out) == {"a", "b"}
    assert (out["a"]["periodo"], out["a"]["mes_nombre"], out["a"]["turno"], out["a"]["hora"]) == ("2025-10", "octubre", "manana", 9)
    assert (out["b"]["periodo"], out["b"]["latitud"], out["b"]["turno"]) == ("2025-12", -12.06, "noche")


def test_fold_spells_rare_characters(spark):
    df = spark.createDataFrame([("  ﬁn  ½ día …ñ☃ ",), (None,), ("☃",)], "t string")
    assert [r[0] for r in df.select(normalize_text(F.col("t"))).collect()] == ["FIN 12 DIA ...N", "NO ESPECIFICADO", "NO ESPECIFICADO"]


@pytest.mark.parametrize("modality,subtype,expected", [
    ("Robo agravado", "", 4), ("asesinato por encargo", "hurto", 1), ("asesinato por encargo", "asesinato", 5), ("Homicidio raro", "", 5),
    ("lesiones", "EXTORSIÓN", 4), ("", "", 1), ("hurto agravado en mercado", "", 2)])
def test_severity_ladder(spark, modality, subtype, expected):
    df = spark.createDataFrame([(modality, subtype)], "m string, s string")
    assert df.select(severity.severity(F.col("m"), F.col("s"))).first()[0] == expected


def test_strict_shift_stops_the_job(spark):
    df = spark.createDataFrame([("mediodia",)], "t string")
    with pytest.raises(Exception, match="unexpected shift"):
        df.select(strict_shift(F.col("t"))).collect()


def test_missing_header_is_an_error(spark):
    with pytest.raises(ValueError, match="missing columns"):
        clean.require_headers(spark.createDataFrame([("x",)], "TURNO string"))


def test_yearly_source_rejects_wrong_year(spark):
    row = ("1", "2019/05/04 10:00:00", "d", "", "", "t", "1", "s", "2", "m", "noche")
    df = spark.createDataFrame([row], "id_doc_denuncia string, FECHA_HORA_HECHO string, DIST_HECHO string, xx string, yy string, TIPO string, ID_SUBTIPO string, SUB_TIPO string, ID_MODALIDAD string, MODALIDAD string, TURNO string")
    assert clean.normalize_yearly(df, 2019).count() == 1
    with pytest.raises(Exception, match="bad event date"):
        clean.normalize_yearly(df, 2020).collect()


def _panel(spark):
    days = [dt.datetime(2025, m, d) for m, d in ((1, 31), (2, 28), (3, 31), (4, 30), (5, 31), (6, 30), (7, 17))]
    return spark.createDataFrame([(f"i{k}", d, d.strftime("%Y-%m"), k, "A", 3) for k, d in enumerate(days)], "id string, fecha timestamp, periodo string, mes_idx int, tramo_id string, peso int")


def test_complete_months_exclude_the_open_one(spark):
    complete, excluded = panel.continuous_months(_panel(spark))
    assert complete == [f"2025-0{m}" for m in range(1, 7)] and excluded == ["2025-07"]
    with pytest.raises(ValueError, match="continuous"):
        panel.continuous_months(_panel(spark).filter("periodo <> '2025-03'"))


def test_history_of_next_month(spark):
    calendar = Calendar("2025-01", "2025-07")
    counts = _panel(spark).filter("mes_idx < 6").groupBy("tramo_id", "mes_idx").agg(F.count(F.lit(1)).alias("frecuencia"))
    segments = spark.createDataFrame([("A", 80.0), ("B", 250.0)], "tramo_id string, longitud_m double")
    dense = panel.dense(counts, segments, calendar)
    assert dense.count() == 14
    got = {(r["tramo_id"], r["mes_idx"]): r["frecuencia_hist"] for r in windows.previous_totals(dense, ["frecuencia"], 3).collect()}
    assert got["A", 6] == 3 and got["B", 6] == 0 and got["A", 2] is None


def _cube(spark, months=8):
    rows = [(s, m, t, (m + t + len(s)) % 3, float((m * t) % 5)) for s in ("A", "BB") for m in range(months) for t in range(4)]
    df = spark.createDataFrame(rows, "tramo_id string, mes_idx int, turno_idx int, n int, peso double")
    for c in ("grave", "robo", "hurto", "extorsion", "homicidio"):
        df = df.withColumn(c, F.lit(0))
    return df.withColumn("longitud_m", F.lit(150.0))


def _months(spark, poor=()):
    cal = Calendar("2024-01", "2024-08")
    return cal.months(spark).withColumn("cobertura", F.when(F.col("mes_idx").isin(*poor) if poor else F.lit(False), 0.2).otherwise(0.9)).withColumn("observado", F.col("cobertura") >= 0.8)


def test_future_edits_leave_features_alone(spark):
    cube = _cube(spark)
    edited = cube.withColumn("n", F.when(F.col("mes_idx") >= 5, F.col("n") + 7).otherwise(F.col("n")))
    build = lambda c: windows.observed_windows(c, _months(spark)).filter("mes_idx = 5").drop("riesgo")
    assert build(cube).exceptAll(build(edited)).count() == 0
    later = lambda c: windows.observed_windows(c, _months(spark)).filter("mes_idx = 6").drop("riesgo")
    assert later(cube).exceptAll(later(edited)).count() > 0


def test_missing_month_leaves_the_denominator(spark):
    rows = {(r["tramo_id"], r["turno_idx"]): r for r in windows.observed_windows(_cube(spark), _months(spark, poor=(3,)), windows=(3,)).filter("mes_idx = 5").collect()}
    n = {m: (m + 1 + 1) % 3 for m in (2, 4)}
    assert rows["A", 1]["ventana_3m_frecuencia_turno"] == pytest.approx((n[2] + n[4]) / 2)
    assert rows["A", 1]["ventana_3m_fraccion_meses_observados"] == pytest.approx(2 / 3)


def test_split_checks():
    with pytest.raises(ValueError, match="chronological"):
        require_order([1, 2], [2, 3])


def test_empty_split_is_an_error(spark):
    eligible = spark.createDataFrame([(3, "2024-04", "train")], "mes_idx int, periodo string, particion string")
    with pytest.raises(ValueError, match="validation"):
        require_splits(eligible, ["train", "validation"])


@pytest.mark.parametrize("hot_rows", [2, 500_000])
def test_hot_deck_matches_a_plain_search(spark, hot_rows):
    from tramorisk.operators import impute

    columns = ["anio", "distrito", "mes", "turno", "tipo", "subtipo"]
    row = lambda i: (i % 2, [None, "", "a", "b", "c"][i * 7 % 5], i % 3, None if i % 11 == 0 else i * 5 % 4, i * 3 % 2, "xyz"[i % 13 % 3])
    located, lost = [(f"d{i:03d}", *row(i), -12.0 - i / 1e4, -77.0 + i / 1e4) for i in range(120) if i % 2 == 0 or i % 5], [(f"m{i:03d}", *row(i * 3 + 1), i * 17) for i in range(90)]
    lost += [(f"n{i}", i % 2, "abc"[i % 3], i % 4, i % 6, i % 5, "w", i * 29) for i in range(40)] + [("m900", 7, "a", 1, 1, 1, "x", 3), lost[0]]
    kinds = "fila string, anio int, distrito string, mes int, turno int, tipo int, subtipo string"
    donors = spark.createDataFrame(located, f"{kinds}, latitud double, longitud double")
    missing = spark.createDataFrame(lost, f"{kinds}, k int")
    text = lambda r, cols: tuple("" if r[1 + columns.index(c)] is None else str(r[1 + columns.index(c)]) for c in cols)
    want = set()
    for m in lost:
        for name, cols in impute.DONOR_LEVELS:
            pool = sorted(d for d in located if text(d, cols) == text(m, cols))
            if pool and m[2]:
                d = pool[m[-1] % len(pool)]
                want.add((m[0], name, d[0], d[-2], d[-1]))
                break
    for found in (impute.hot_deck(missing, donors, F.col("k"), "fila", hot_rows), impute.hot_deck(missing, donors.withColumn("orden", F.col("fila")), F.col("k"), hot_rows=hot_rows)):
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want
    assert len({w[1] for w in want}) > 3


def test_a_donor_travels_for_the_pools_in_use_only(spark):
    from tramorisk.operators import impute

    kinds = "fila string, anio int, distrito string, mes int, turno int, tipo int, subtipo string"
    donors = spark.createDataFrame([(f"d{i}", 1, "a", i % 12, i % 4, i % 3, "x") for i in range(60)], kinds)
    missing = spark.createDataFrame([("m", 1, "a", 0, 0, 0, "x")], kinds)
    cells = impute._cell_levels(impute._text_keys(missing, ["fila"]), impute._text_keys(donors, ["fila"]))
    marked = cells.select("_k_mes", F.explode("_dan").alias("c")).filter("size(c._usados) > 0").select("_k_mes", "c._k_turno", "c._k_tipo", "c._usados").collect()
    assert [tuple(r) for r in marked] == [("0", "0", "0", [0])]


def test_only_rows_without_a_place_meet_the_donors(spark):
    from tramorisk.operators import impute

    rows = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 2.0), ("c", None, None), ("d", None, None), (None, 1.0, 1.0)], "fila string, latitud double, longitud double")
    recovered = spark.createDataFrame([("b", 3.0, 4.0), ("a", 9.0, 9.0)], "fila string, lat_rec double, lon_rec double")
    simulated = spark.createDataFrame([("b", 5.0, 6.0), ("c", 7.0, 8.0)], "fila string, lat_sim double, lon_sim double")
    filled = impute.overlay(rows, recovered, simulated)
    assert {tuple(r) for r in filled.collect()} == {("a", 1.0, 2.0, "OBSERVADA"), (None, 1.0, 1.0, "OBSERVADA"), ("b", 3.0, 4.0, "MISMA_DENUNCIA"), ("c", 7.0, 8.0, "SIMULADA"), ("d", None, None, "SIN_UBI")}
    assert "Union" in filled._jdf.queryExecution().optimizedPlan().toString()
