import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramorisk.operators import evaluate as ev, models, ordered, sampling


def test_exact_quantiles_match_numpy(spark):
    rng = random.Random(3)
    rows = [(g, float(rng.choice([1, 1, 1, rng.random() * 9]))) for g in "ab" for _ in range(157)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["prob"]): r["valor"] for r in ordered.exact_quantiles(df, ["g"], "v", [0.0, 0.33, 0.75, 1.0], slices=5).collect()}
    for (g, p), v in got.items():
        assert v == pytest.approx(np.quantile([x for k, x in rows if k == g], p))
    assert len(got) == 8


def test_global_rank_with_one_hot_value(spark):
    rows = [(i, 5 if i % 3 else i) for i in range(300)]
    ranked = ordered.global_rank(spark.createDataFrame(rows, "id int, v int"), [], [F.desc("v"), F.asc("id")], "r", slices=7).collect()
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda t: (-t[1], t[0])), 1)}
    assert {r["id"]: r["r"] for r in ranked} == want


def test_salted_join_keeps_every_pair(spark):
    many = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(400)], "k int, a int")
    few = spark.createDataFrame([(k % 50, k) for k in range(80)], "k int, b int")
    plain = sorted(map(tuple, many.join(few, ["k"]).collect()))
    assert sorted(map(tuple, ordered.salted_join(many, few, ["k"], hot_rows=20).collect())) == plain
    left = ordered.salted_join(many, few, ["k"], "left", hot_rows=20)
    assert left.count() == many.join(few, ["k"], "left").count()


def test_keep_first_over_cuts(spark):
    rows = [("a", i) for i in range(500)] + [("b", i) for i in range(3)]
    kept = ordered.keep_first(spark.createDataFrame(rows, "g string, v int"), ["g"], [F.desc("v")], 40, rows_per_cut=60).collect()
    assert sorted(r["v"] for r in kept if r["g"] == "a") == list(range(460, 500))
    assert {r["_tamano"] for r in kept} == {500, 3}


def test_keep_first_keeps_null_groups_and_whole_groups_beside_cut_ones(spark):
    rows = [(g, i) for g, n in ((None, 4), ("a", 150), ("b", 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, v int")
    kept = ordered.keep_first(df, ["g"], [F.desc("v")], F.when(F.col("g") == "a", 12).otherwise(F.col("_tamano")), rows_per_cut=40).collect()
    want = [(None, i) for i in range(4)] + [("a", i) for i in range(138, 150)] + [("b", i) for i in range(90)]
    assert sorted(((r["g"] or "", r["v"]) for r in kept)) == [(g or "", v) for g, v in want]
    assert {r["g"]: r["_tamano"] for r in kept} == {None: 4, "a": 150, "b": 90}


def test_keep_first_with_many_cuts_and_a_quota_near_their_size(spark):
    df = spark.createDataFrame([("a" if i % 10 else None, i) for i in range(1000)], "g string, v int")
    kept = ordered.keep_first(df, ["g"], [F.desc("v")], 29, rows_per_cut=30).collect()
    for g in ("a", None):
        top = sorted((i for i in range(1000) if bool(i % 10) == bool(g)), reverse=True)[:29]
        assert sorted((r["v"] for r in kept if r["g"] == g), reverse=True) == top


def test_keep_first_with_a_quota_beyond_one_task(spark):
    df = spark.createDataFrame([("a", i) for i in range(500)] + [("b", i) for i in range(30)], "g string, v int")
    kept = ordered.keep_first(df, ["g"], [F.desc("v")], F.when(F.col("g") == "a", 200).otherwise(99), rows_per_cut=60).collect()
    assert sorted(r["v"] for r in kept if r["g"] == "a") == list(range(300, 500)) and len(kept) == 230


def test_two_stratum_invariants(spark):
    rows = [(f"s{i}", 1, 0, 0 if i < 1000 else (1 if i < 1020 else 2), i % 3 == 0) for i in range(1030)]
    df = spark.createDataFrame(rows, "tramo_id string, mes_idx int, turno_idx int, y int, activo boolean")
    kept = sampling.two_stratum(df, ["mes_idx", "turno_idx"], sampling.hash_order(), minimum=90).collect()
    assert sum(r["y"] > 0 for r in kept) == 30 and len({r["tramo_id"] for r in kept}) == len(kept) == 120
    assert sum(r["activo"] for r in kept if r["y"] == 0) == 54
    assert sum(r["peso_inclusion"] for r in kept) == pytest.approx(1030)


def test_sample_is_repeatable(spark):
    df = spark.range(900).selectExpr("concat('s', id) AS tramo_id", "CAST(id % 4 AS INT) AS mes_idx", "CAST(id % 2 AS INT) AS y")
    draw = lambda n: sampling.cap_per_class(df.repartition(n), ["mes_idx"], 30, sampling.hash_order(keys=("tramo_id", "mes_idx")))
    assert sampling.sample_digest(draw(3)).first() == sampling.sample_digest(draw(11)).first()


def _separable(spark):
    rows = [(0, 0.9, 0.05, 0.05), (0, 0.8, 0.15, 0.05), (0, 0.7, 0.2, 0.1), (1, 0.2, 0.7, 0.1), (1, 0.3, 0.6, 0.1), (1, 0.25, 0.65, 0.1),
            (2, 0.1, 0.1, 0.8), (2, 0.1, 0.2, 0.7), (2, 0.2, 0.2, 0.6)]
    return spark.createDataFrame(rows, "y int, p0 double, p1 double, p2 double")


def test_joint_cutoffs_on_a_separable_case(spark):
    df = _separable(spark)
    best = ev.best_joint_cutoffs(df).first()
    assert best["objetivo"] == pytest.approx(1.0)
    pred = df.withColumn("pred", F.when(F.col("p2") >= best["alto"], 2).when(F.col("p1") >= best["medio"], 1).otherwise(0))
    row = ev.metrics(ev.confusion(pred)).first()
    assert row["accuracy"] == 1.0 and row["f1_macro"] == 1.0


def test_average_precision_and_cutoff_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.4), (1, 0.2)], "y int, s double")
    ap = ev.average_precision(df, F.col("y") == 1, "s").first()["average_precision"]
    assert ap == pytest.approx((1 * 1 + 1 * 2 / 3 + 1 * 3 / 5) / 3)
    assert ev.best_cutoff(df, F.col("y") == 1, "s").first()["corte"] == pytest.approx(0.2)


def test_monotone_repair_and_frozen_high(spark):
    df = spark.createDataFrame([(0.3, 0.5)], "m double, h double")
    parts = df.select(*ev.monotone_repair(F.col("m"), F.col("h"))).first()
    assert list(parts) == pytest.approx([0.6, 0.0, 0.4])
    with pytest.raises(ValueError):
        ev.frozen_high([F.lit(0.1)] * 3, [F.lit(0.1)] * 3, 1.5, 1.0)


def test_models_give_probabilities(spark):
    rows = [(f"s{i}", i % 4, i % 3, float(i % 3) + (i % 7) / 10, float(i % 5) if i % 11 else None) for i in range(240)]
    df = spark.createDataFrame(rows, "tramo_id string, mes_idx int, y int, a double, b double")
    for family in ("bosque", "impulso", "valla", "ordinal"):
        spec = models.ModelSpec(family, family, trees=3, depth=3, step=0.3)
        scored = models.fit(spec, df, ["a", "b"]).score(df)
        assert models.probability_faults(scored).first()["fallas"] == 0
        hits = scored.filter(F.col("y") == F.expr("CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END")).count()
        assert hits > 200
    calibrated = models.calibrate(scored, scored)
    assert models.probability_faults(calibrated).first()["fallas"] == 0
