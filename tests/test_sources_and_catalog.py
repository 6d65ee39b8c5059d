from datetime import datetime, timezone
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tramorisk.sources import forecast, readers

SF = "/root/testdata/sf0.001"


def test_delimiter_and_mark(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿id;nombre\n1;a,b\n2;ñ\n".encode())
    rows = readers.read_delimited(spark, str(path)).collect()
    assert [r["id"] for r in rows] == ["1", "2"] and rows[0]["nombre"] == "a,b" and rows[1]["nombre"] == "ñ"


def test_partitioned_sink_and_fingerprint(spark, tmp_path):
    df = spark.range(30).selectExpr("id", "concat('2024-0', id % 3 + 1) AS periodo")
    readers.write_partitioned(df, str(tmp_path / "p"), "periodo")
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 30
    assert readers.fingerprint(back, {"r": 1}) == readers.fingerprint(back, {"r": 1}) != readers.fingerprint(back, {"r": 2})
    readers.store_fingerprint(spark, str(tmp_path / "m"), "x")
    assert readers.reusable(spark, str(tmp_path / "m"), "x") and not readers.reusable(spark, str(tmp_path / "m"), "y")
    with pytest.raises(ValueError, match="changed"):
        readers.reusable(spark, str(tmp_path / "m"), "y", allow_replace=False)


def test_forecast_is_registered_once(spark, tmp_path):
    df = spark.range(4).withColumn("p", F.rand(1))
    readers.register_forecast(spark, df, str(tmp_path / "r"), "2026-01", ["id"])
    with pytest.raises(ValueError, match="already registered"):
        readers.register_forecast(spark, df, str(tmp_path / "r"), "2026-01", ["id"])
    assert spark.read.parquet(str(tmp_path / "r/filas")).filter("periodo = '2026-01'").count() == 4
    with pytest.raises(ValueError, match="late"):
        readers.register_forecast(spark, df, str(tmp_path / "r"), "2026-02", ["id"], now=datetime(2026, 2, 1, 6, tzinfo=timezone.utc))
    readers.register_forecast(spark, df, str(tmp_path / "r"), "2026-02", ["id"], now=datetime(2026, 2, 1, 4, tzinfo=timezone.utc))
    assert {(r["periodo"], r["filas"]) for r in readers.registered_forecasts(spark, str(tmp_path / "r")).collect()} == {("2026-01", 4), ("2026-02", 4)}


def test_forecast_load_repairs_rows(spark):
    rows = [("a", "1.4", "-12", "-77", "", ""), ("b", "x", "-12", "-77", "", ""), ("c", "0.5", "-12", "-77", "bajo", "0.9")]
    df = spark.createDataFrame(rows, "tramo_id string, riesgo_score string, latitud string, longitud string, nivel_riesgo string, riesgo_score_noche string")
    out = {r["tramo_id"]: r for r in forecast.repaired_forecast(df).collect()}
    assert set(out) == {"a", "c"} and out["a"]["riesgo_score"] == 1.0 and out["a"]["nivel_riesgo"] == "alto" and out["c"]["nivel_riesgo"] == "bajo"
    assert out["a"]["riesgo_score_noche"] == 1.0 and out["c"]["nivel_riesgo_noche"] == "alto"


def test_catalog_is_consistent():
    names, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(names) and len(names) > 150 and len(oracles) > 120


def test_catalog_loads_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and e.oracle_sql()"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["A01_monthly_coverage", "A03_buffer_panel", "P06_event_dates", "P12_repaired_places", "T07_two_stratum_sample", "V06_joint_cutoffs", "W03_observed_windows", "J12_hot_deck"])
def test_oracle_agrees_on_the_small_tables(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "customer", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = sorted(tuple(map(str, r)) for r in entry.queries()[name](spark, SF).collect())
    assert got and got == sorted(tuple(map(str, r)) for r in con.execute(entry.oracle_sql()[name]).fetchall())


def test_model_queries_use_the_published_settings():
    from tramorisk.operators import models
    from tramorisk.plans import catalog_models as cm

    assert {cm._RF, cm._RF_WINDOWS, cm._RF_MONTHLY} <= set(models.FOREST_SPECS) and {cm._GBT, cm._GBT_MONTHLY, cm._HURDLE, cm._ORDINAL} <= set(models.BOOSTED_SPECS)
    assert cm._SPLIT.train[0] == 3 and list(cm._SPANS.values()) == [3, 6, 12, 24, None]


def test_a_leak_is_seen_in_every_month(spark):
    from pyspark.sql import Window as W, functions as F

    from tramorisk.plans import jobs

    cube = spark.range(5).select(F.concat(F.lit("t#"), "id").alias("tramo_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("mes_idx"), F.lit(0).alias("turno_idx")).withColumn("n", F.col("mes_idx") + 1)
    order = W.partitionBy("tramo_id").orderBy("mes_idx")
    clean = lambda df: df.select("tramo_id", "mes_idx", "turno_idx", F.col("n").alias("riesgo"), F.lag("n").over(order).alias("a"))
    leaky = lambda df: df.select("tramo_id", "mes_idx", "turno_idx", F.lag("n").over(order).alias("a"), F.lead("n", 2).over(order).alias("b"))
    count = lambda build: {r["mes_idx"]: (r["filas"], r["cambiadas"]) for r in jobs.changed_by_future(cube, build, ["n"], 6).collect()}
    assert count(clean) == {m: (5, 0) for m in range(6)}
    assert count(leaky) == {m: (5, 5 if m < 4 else 0) for m in range(6)}


def test_dense_panel_moves_nothing_above_the_explode(spark):
    from tramorisk.operators import windows
    from tramorisk.plans.registry import Tables

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = windows.shift_history(Tables(spark, SF).dense_cube())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    assert not [x for x in lines[:next(i for i, x in enumerate(lines) if "Generate explode" in x)] if "Exchange" in x]


def test_yearly_files_lose_no_line(spark, tmp_path):
    from tramorisk.sources import readers

    head = "id;FECHA_HORA_HECHO;TURNO"
    (tmp_path / "a.csv").write_text("\ufeff" + head + "\n1;2019/01/05 10:00:00;noche\n2;2018/01/05 10:00:00;noche\n3;2019/02/05 10:00:00;noche;de;mas\n4;ayer;tarde\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text(head.replace(";", ",") + "\n5,2020/12/31 23:59:59,tarde\n6,2020/01/01 00:00:00\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text(head + "\n", encoding="utf-8")
    rows, rejected = readers.read_years(spark, {2019: str(tmp_path / "a.csv"), 2020: str(tmp_path / "b.csv"), 2021: str(tmp_path / "c.csv")})
    assert sorted((r["anio"], r["id"]) for r in rows.collect()) == [(2019, "1"), (2020, "5")]
    assert sorted((r["anio"], r["motivo"]) for r in rejected.collect()) == [(2019, "malformada"), (2019, "otro anio"), (2019, "sin fecha"), (2020, "malformada")]
    assert rejected.filter("motivo = 'malformada' and anio = 2019").first()["linea"].startswith("3;2019/02/05")


def test_rounding_keeps_the_bits_and_skips_the_text(spark):
    import random
    import struct

    from tramorisk.plans import registry

    draw = random.Random(5)
    values = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, -1e-9, 5e-7, 1.5e-6, 2.5, 0.1250005, 1e5 + 0.1234565, 1e17, -123456.7890125, 4.9e-324, 1.7e308]
    values += [draw.uniform(-1, 1) * 10 ** draw.randint(-8, 14) for _ in range(3000)] + [draw.randint(-9**9, 9**9) / 7 for _ in range(1000)]
    values += [k / 2 / 10**p for p in (3, 5, 6) for k in range(-400, 400)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    bits = lambda x: x if x is None else struct.pack("<d", x)
    for places in (3, 5, 6):
        plain = F.round("v", places)
        pairs = rows.select(F.when(plain == 0, F.lit(0.0)).otherwise(plain).alias("a"), "v").withColumn("w", F.col("v"))
        found = registry.shaped(pairs, f"a:d17 w:d{places}").collect()
        assert [bits(r["a"]) for r in found] == [bits(r["w"]) for r in found]
    wide = spark.range(0, 100_000, 1, 4).select(*[(F.col("id") * k / 7).alias(f"c{k}") for k in range(1, 61)])

    def seconds(build):
        import time

        for _ in range(2):
            start = time.time()
            build.write.format("noop").mode("overwrite").save()
        return time.time() - start

    old = lambda c: F.when(F.round(c, 6) == 0, F.lit(0.0)).otherwise(F.round(c, 6)).alias(c)
    assert seconds(registry.shaped(wide, " ".join(f"{c}:d" for c in wide.columns))) < 0.8 * seconds(wide.select(*map(old, wide.columns)))
