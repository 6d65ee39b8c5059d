"""Spark ML pipelines, scoring and calibration."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tramorisk.functions.risk import length_factor
from tramorisk.operators.evaluate import hurdle, monotone_repair
from tramorisk.operators.ordered import keep_first
from tramorisk.session import settle, together


def channel_scaling(panel: DataFrame, channels: Sequence[str], floor: float = 0.05) -> DataFrame:
    """Mean and floored deviation of each log-scaled channel."""
    factor = length_factor(F.col("longitud_m"))
    value = lambda c: F.log1p(F.greatest(F.col(c) / factor, F.lit(0.0)))
    wide = panel.agg(*[F.avg(value(c)).alias(f"m_{c}") for c in channels], *[F.stddev_pop(value(c)).alias(f"s_{c}") for c in channels])
    rows = F.array(*[F.struct(F.lit(c).alias("canal"), F.col(f"m_{c}").alias("media"), F.greatest(F.col(f"s_{c}"), F.lit(floor)).alias("desviacion")) for c in channels])
    return wide.select(F.explode(rows).alias("_r")).select("_r.*")


# ---------------------------------------------------------------- specifications

@dataclass(frozen=True)
class ModelSpec:
    """Classifier family and its settings."""

    name: str
    family: str = "bosque"
    trees: int = 120
    depth: int = 14
    min_rows: int = 2
    subset: str = "sqrt"
    sample: float = 1.0
    step: float = 0.06
    seed: int = 42
    power: float = 0.0


# Published settings per family.
FOREST_SPECS = (ModelSpec("bosque_turno", trees=120, depth=14, min_rows=2), ModelSpec("bosque_ventanas", trees=160, depth=16, min_rows=8, subset="0.75"),
                ModelSpec("bosque_mensual", trees=200, depth=16, min_rows=20, sample=0.8), ModelSpec("bosque_ajuste", trees=160, depth=18, min_rows=5))
BOOSTED_SPECS = (ModelSpec("impulso_turno", "impulso", trees=200, depth=6, step=0.06), ModelSpec("impulso_mensual", "impulso", trees=320, depth=5, min_rows=20, step=0.055),
                 ModelSpec("valla", "valla", trees=300, depth=4, min_rows=8, step=0.05), ModelSpec("ordinal", "ordinal", trees=320, depth=5, min_rows=20, step=0.055))


#: Binary fits of each boosted family: target and member rows by the class column.
PARTS: dict[str, dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]]] = {
    "impulso": {f"clase{i}": (lambda y, i=i: y == i, lambda y: F.lit(True)) for i in range(3)},
    "valla": {"evento": (lambda y: y > 0, lambda y: F.lit(True)), "grave": (lambda y: y == 2, lambda y: y > 0)},
    "ordinal": {"medio": (lambda y: y >= 1, lambda y: F.lit(True)), "alto": (lambda y: y >= 2, lambda y: F.lit(True))},
    "alto": {"alto": (lambda y: y == 2, lambda y: F.lit(True))},
}


def blend(family: str, at: Callable[[str], Column]) -> tuple[Column, Column, Column]:
    """Three class probabilities from those of a boosted family's parts."""
    if family == "valla":
        return hurdle(at("evento"), at("grave"))
    if family == "ordinal":
        return monotone_repair(at("medio"), at("alto"))
    if family == "alto":
        return 1 - at("alto"), F.lit(0.0), at("alto")
    raw = [at(f"clase{i}") for i in range(3)]
    total = F.greatest(raw[0] + raw[1] + raw[2], F.lit(1e-12))
    return raw[0] / total, raw[1] / total, raw[2] / total


def _assembled(features: Sequence[str]) -> list:
    filled = [f"{c}__lleno" for c in features]
    return [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="vector", handleInvalid="keep")]


def _forest(spec: ModelSpec, label: str, weight: str | None, prefix: str) -> RandomForestClassifier:
    model = RandomForestClassifier(labelCol=label, featuresCol="vector", numTrees=spec.trees, maxDepth=spec.depth, minInstancesPerNode=spec.min_rows,
                                   featureSubsetStrategy=spec.subset, subsamplingRate=spec.sample, seed=spec.seed, cacheNodeIds=True, probabilityCol=f"{prefix}prob",
                                   rawPredictionCol=f"{prefix}raw", predictionCol=f"{prefix}pred", maxMemoryInMB=512)
    return model.setWeightCol(weight) if weight else model


def _boosted(spec: ModelSpec, label: str, weight: str | None, prefix: str) -> GBTClassifier:
    model = GBTClassifier(labelCol=label, featuresCol="vector", maxIter=spec.trees, maxDepth=spec.depth, minInstancesPerNode=spec.min_rows, stepSize=spec.step,
                          subsamplingRate=0.85, seed=spec.seed, predictionCol=f"{prefix}pred", maxMemoryInMB=512)
    model = model.setProbabilityCol(f"{prefix}prob").setRawPredictionCol(f"{prefix}raw")
    return model.setWeightCol(weight) if weight else model


def _numeric(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in features], *[F.col(c).cast("double").alias(c) for c in features])


@dataclass
class RiskClassifier:
    """Fitted three-class model; ``score`` adds p0, p1 and p2."""

    spec: ModelSpec
    features: list[str]
    prepare: PipelineModel
    parts: dict

    def score(self, df: DataFrame) -> DataFrame:
        kept = list(df.columns)
        out = self.prepare.transform(_numeric(df, self.features))
        for name, model in self.parts.items():
            out = model.transform(out).withColumn(f"_{name}", vector_to_array(f"{name}prob")).drop(f"{name}prob", f"{name}raw", f"{name}pred")
        p0, p1, p2 = self._blend()
        return out.select(*kept, p0.alias("p0"), p1.alias("p1"), p2.alias("p2"))

    def _blend(self) -> tuple[Column, Column, Column]:
        # a class never seen in training has no slot: its probability is 0
        at = lambda n, i: F.coalesce(F.try_element_at(F.col(f"_{n}"), F.lit(i + 1)), F.lit(0.0))
        if self.spec.family == "bosque":
            return at("m", 0), at("m", 1), at("m", 2)
        return blend(self.spec.family, lambda part: at(part, 1))

    def importances(self) -> list[tuple[str, float]]:
        """Mean importance of each feature over the fitted parts, best first."""
        sums = [0.0] * len(self.features)
        for model in self.parts.values():
            for i, v in enumerate(model.featureImportances.toArray()):
                sums[i] += float(v) / len(self.parts)
        return sorted(zip(self.features, sums), key=lambda kv: (-kv[1], kv[0]))

    def save(self, path: str) -> None:
        self.prepare.write().overwrite().save(f"{path}/prepara")
        for name, model in self.parts.items():
            model.write().overwrite().save(f"{path}/{name}")

    @staticmethod
    def load(path: str, spec: ModelSpec, features: Sequence[str]) -> "RiskClassifier":
        names = ["m"] if spec.family == "bosque" else list(PARTS[spec.family])
        kind = RandomForestClassificationModel if spec.family == "bosque" else GBTClassificationModel
        return RiskClassifier(spec, list(features), PipelineModel.load(f"{path}/prepara"), {n: kind.load(f"{path}/{n}") for n in names})


def fit(spec: ModelSpec, train: DataFrame, features: Sequence[str], label: str = "y", weight: str | None = None) -> RiskClassifier:
    """Median imputation and the classifier of ``spec`` on a stored sample."""
    features = list(features)
    rows = _numeric(train.select(*features, label, *([weight] if weight else [])), features)
    prepare = Pipeline(stages=_assembled(features)).fit(rows)
    ready = settle(prepare.transform(rows).select("vector", label, *([weight] if weight else [])))
    flag = lambda cond: ready.withColumn("_y", cond.cast("double"))
    y = F.col(label)
    if spec.family == "bosque":
        parts = {"m": _forest(spec, label, weight, "m").fit(ready)}
    elif spec.family in PARTS:
        # A boosted fit is thousands of short jobs, so its binary parts train side by side.
        binary = PARTS[spec.family].items()
        fits = together([lambda n=n, t=t, m=m: _boosted(spec, "_y", weight, n).fit(flag(t(y)).filter(m(y))) for n, (t, m) in binary])
        parts = dict(zip(PARTS[spec.family], fits, strict=True))
    else:
        raise ValueError(f"unknown family {spec.family}")
    return RiskClassifier(spec, features, prepare, parts)


def high_specialist(base: DataFrame, train: DataFrame, features: Sequence[str], spec: ModelSpec, weight: str | None = None) -> DataFrame:
    """Replace P(high) of ``base`` by a binary specialist's and rescale the rest."""
    features = list(features)
    rows = _numeric(train.select(*features, "y", *([weight] if weight else [])), features)
    prepare = Pipeline(stages=_assembled(features)).fit(rows)
    ready = settle(prepare.transform(rows).withColumn("_y", (F.col("y") == 2).cast("double")).select("vector", "_y", *([weight] if weight else [])))
    model = _boosted(spec, "_y", weight, "esp").fit(ready)
    kept = list(base.columns)
    out = model.transform(prepare.transform(_numeric(base, features))).withColumn("_h", vector_to_array("espprob")[1])
    rest = F.greatest(F.col("p0") + F.col("p1"), F.lit(1e-12))
    keep = {"p0": F.col("p0") / rest * (1 - F.col("_h")), "p1": F.col("p1") / rest * (1 - F.col("_h")), "p2": F.col("_h")}
    return out.select(*[keep.get(c, F.col(c)).alias(c) for c in kept])


def sequence_network(train: DataFrame, rows: DataFrame, sequence: str, context: Sequence[str], hidden: int = 16, iterations: int = 20, seed: int = 42) -> DataFrame:
    """Perceptron on flattened sequences plus context; adds p0, p1 and p2."""
    flat = lambda df: df.withColumn("_x", F.concat(F.flatten(sequence), F.array(*[F.col(c).cast("double") for c in context]))).withColumn(
        "vector", array_to_vector("_x"))
    ready = settle(flat(train).select("vector", F.col("y").cast("double").alias("y")))
    width = ready.first()["vector"].size
    model = MultilayerPerceptronClassifier(labelCol="y", featuresCol="vector", layers=[width, hidden, 3], maxIter=iterations, seed=seed).fit(ready)
    out = model.transform(flat(rows)).withColumn("_p", vector_to_array("probability"))
    return out.select(*rows.columns, *[F.col("_p")[i].alias(f"p{i}") for i in range(3)])


def calibrate(fitted_on: DataFrame, rows: DataFrame, odds: bool = True, strength: float | None = None, low_rows: int = 160_000, seed: int = 42) -> DataFrame:
    """Multinomial calibration of p0, p1, p2 learnt on ``fitted_on``.

    With ``odds`` the inputs are log-odds against the low class and lows are
    capped with inverse weights; otherwise they are the three log-probabilities.
    """
    strength = (10.0 if odds else 0.3) if strength is None else strength
    safe = [F.least(F.greatest(F.col(f"p{i}"), F.lit(1e-7)), F.lit(1.0)) for i in range(3)]
    terms = [F.log(safe[1] / safe[0]), F.log(safe[2] / safe[0])] if odds else [F.log(s) for s in safe]
    ready = fitted_on.withColumn("vector", array_to_vector(F.array(*terms)))
    if odds:
        order = [F.xxhash64(F.lit(seed), *[c for c in fitted_on.columns if c in ("tramo_id", "mes_idx", "turno_idx", "id")]),
                 *[F.col(c) for c in fitted_on.columns if c in ("tramo_id", "mes_idx", "turno_idx", "id")]]
        quota = F.when(F.col("y") == 0, F.lit(low_rows)).otherwise(F.col("_tamano"))
        ready = keep_first(ready, ["y"], order, quota).withColumn("_w", F.when(F.col("y") == 0, F.col("_tamano") / F.least(F.col("_tamano"), F.lit(low_rows))).otherwise(1.0))
    else:
        ready = ready.withColumn("_w", F.lit(1.0))
    ready = settle(ready.select("vector", F.col("y").cast("double").alias("y"), "_w"))
    total = ready.agg(F.sum("_w")).first()[0]
    model = LogisticRegression(labelCol="y", featuresCol="vector", weightCol="_w", family="multinomial", maxIter=100, regParam=1.0 / (strength * total), standardization=False).fit(ready)
    out = model.transform(rows.withColumn("vector", array_to_vector(F.array(*terms)))).withColumn("_p", vector_to_array("probability"))
    return out.select(*[F.coalesce(F.try_element_at("_p", F.lit(int(c[1]) + 1)), F.lit(0.0)).alias(c) if c in ("p0", "p1", "p2") else F.col(c) for c in rows.columns])


def probability_faults(scored: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Rows whose probabilities are missing, out of range or do not add to 1."""
    total = F.col("p0") + F.col("p1") + F.col("p2")
    bad = total.isNull() | F.isnan(total) | (F.abs(total - 1) > tolerance) | (F.least("p0", "p1", "p2") < -tolerance)
    return scored.agg(F.count(F.lit(1)).alias("filas"), F.count(F.when(bad, 1)).alias("fallas"))
