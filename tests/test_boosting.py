"""Many boosted fits in one job."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tramorisk.operators import boosting, models
from tramorisk.operators.models import ModelSpec


def plain_tree(codes, g, h, depth, min_rows, ridge=1.0):
    """Leaf value of every row, by trying every split of every node."""
    out = np.zeros(len(g))

    def split(rows, level):
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + ridge)
        best = (1e-9, None)
        if level < depth:
            for j in range(codes.shape[1]):
                for b in range(boosting.BINS):
                    left, right = rows[codes[rows, j] <= b], rows[codes[rows, j] > b]
                    if len(left) >= min_rows and len(right) >= min_rows and score(left) + score(right) - score(rows) > best[0] + 1e-12:
                        best = (score(left) + score(right) - score(rows), (left, right))
        if best[1]:
            split(best[1][0], level + 1)
            split(best[1][1], level + 1)
        else:
            out[rows] = g[rows].sum() / (h[rows].sum() + ridge)

    split(np.arange(len(g)), 0)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_a_tree_takes_the_best_splits(seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 6, (90, 3)).astype(np.int32)
    g, h = rng.normal(size=90) + (codes[:, 1] > 2), rng.random(90) + 0.1
    feature, last, value, leaf = boosting.grow(codes, g, h, 3, 4)
    assert np.allclose(value[leaf], plain_tree(codes, g, h, 3, 4))


def table(spark, rows=600):
    """Class by two features, one of them missing at times."""
    base = spark.range(rows).select(F.concat(F.lit("t"), "id").alias("tramo_id"), (F.col("id") % 97).cast("double").alias("a"),
                                    F.when(F.col("id") % 11 > 0, (F.col("id") * 7 % 89).cast("double")).alias("b"), (F.col("id") * 31 % 13).cast("double").alias("ruido"))
    return base.withColumn("y", F.when(F.col("a") > 70, 2).when(F.coalesce("b", F.lit(0.0)) > 45, 1).otherwise(0)).withColumn("peso_muestra", F.lit(1.0) + F.col("y"))


SPECS = {"uno": ModelSpec("uno", "impulso", trees=30, depth=3, step=0.2), "dos": ModelSpec("dos", "valla", trees=30, depth=3, step=0.2),
         "tres": ModelSpec("tres", "ordinal", trees=30, depth=2, step=0.2, min_rows=5)}


def test_families_learn_and_give_probabilities(spark, monkeypatch):
    monkeypatch.setattr(boosting, "ROWS_PER_SCORE", 70)  # several shares for each fit
    rows, features = table(spark), ["a", "b", "ruido"]
    samples = [boosting.sample_rows(rows, n, features) for n in SPECS]
    trees = boosting.fit_many(samples[0].unionByName(samples[1]).unionByName(samples[2]), SPECS)
    assert sorted((r["ajuste"], r["parte"]) for r in trees.collect()) == [
        ("dos", "evento"), ("dos", "grave"), ("tres", "alto"), ("tres", "medio"), ("uno", "clase0"), ("uno", "clase1"), ("uno", "clase2")]
    asked = samples[0].withColumn("fila", F.monotonically_increasing_id()).select("fila", "y", "x", F.explode(F.array(*[F.lit(n) for n in SPECS])).alias("ajuste"))
    scored = boosting.score_many(asked, trees, SPECS)
    found = scored.groupBy("ajuste").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1)).alias("off"), F.min(F.least("p0", "p1", "p2")).alias("least"),
                                         F.avg((F.when((F.col("p2") >= F.col("p1")) & (F.col("p2") >= F.col("p0")), 2).when(F.col("p1") >= F.col("p0"), 1).otherwise(0) == F.col("y")).cast("int")).alias("right"))
    for r in found.collect():
        assert r["n"] == 600 and r["off"] < 1e-9 and r["least"] >= 0 and r["right"] > 0.95, r


def test_a_fit_is_the_same_alone_and_among_others(spark):
    rows = table(spark, 200)
    alone = boosting.fit_many(boosting.sample_rows(rows, "uno", ["a", "b"]), {"uno": SPECS["uno"]})
    both = boosting.fit_many(boosting.sample_rows(rows, "uno", ["a", "b"]).unionByName(boosting.sample_rows(rows, "dos", ["b"])), SPECS)
    pick = lambda t: sorted((r["parte"], r["corte"], [round(v, 9) for v in r["hoja"]]) for r in t.filter("ajuste = 'uno'").collect())
    assert pick(alone) == pick(both)


def test_awkward_samples(spark, monkeypatch):
    """One class only, a feature that is always missing, a constant one; too many rows are refused."""
    rows = table(spark, 50).filter("y < 1").withColumn("nada", F.lit(None).cast("double")).withColumn("igual", F.lit(3.0))
    trees = boosting.fit_many(boosting.sample_rows(rows, "uno", ["nada", "igual"]), {"uno": SPECS["uno"]})
    asked = boosting.sample_rows(rows, "uno", ["nada", "igual"]).select("ajuste", "y", "x")
    assert boosting.score_many(asked, trees, {"uno": SPECS["uno"]}).filter("p0 < 0.99").count() == 0
    monkeypatch.setattr(boosting, "MAX_ROWS", 10)
    with pytest.raises(ValueError, match="models.fit"):
        boosting.fit_many(boosting.sample_rows(rows, "uno", ["igual"]), {"uno": SPECS["uno"]})


def test_forests_keep_the_node_of_every_row(spark):
    # Every level of every tree walked each row down from the root again.
    rows = spark.range(400).selectExpr("CAST(id % 17 AS DOUBLE) AS a", "CAST((id * 31) % 101 AS DOUBLE) AS b", "CAST(id % 3 AS INT) AS y", "1.0 + (id % 5) AS w")
    spec = models.ModelSpec("bosque", trees=8, depth=12, min_rows=2)
    vectors = Pipeline(stages=models._assembled(["a", "b"])).fit(rows).transform(rows)
    forest = models._forest(spec, "y", "w", "m")
    assert forest.getCacheNodeIds()
    one, other = (f.fit(vectors).toDebugString.split("\n", 1)[1] for f in (forest, models._forest(spec, "y", "w", "m").setCacheNodeIds(False)))
    assert one == other


def test_binary_parts_of_a_boosted_fit_train_side_by_side(spark, monkeypatch):
    # one part after the other, each thousands of short jobs.
    from threading import Barrier

    meet = Barrier(3, timeout=60)

    class Part:
        def __init__(self, *args):
            self.name = args[3]

        def fit(self, rows):
            meet.wait()
            return self.name, rows.agg({"_y": "sum"}).first()[0]

    monkeypatch.setattr(models, "_boosted", Part)
    rows = spark.range(30).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id % 3 AS INT) AS y")
    fitted = models.fit(models.BOOSTED_SPECS[0], rows, ["a"])
    assert fitted.parts == {f"clase{i}": (f"clase{i}", 10.0) for i in range(3)}
