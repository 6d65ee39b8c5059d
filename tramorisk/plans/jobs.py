"""Training and comparison jobs composed of the operators.

Every job follows one pattern: features for all months in one windowed pass,
a stored stratified sample of the months before the target, one fit, scores
of the evaluated months, and small metric tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from tramorisk.functions.risk import argmax3, decide, length_factor, risk_class
from tramorisk.operators import evaluate as ev, models, sampling
from tramorisk.session import settle


def rolling_sets(rows: DataFrame, origins: Iterable[int], spans: dict[str, int | None], first: int = 3) -> DataFrame:
    """Training rows of every origin and window: months before the origin only.

    Each row is repeated once per window that contains it.
    """
    plans = [F.struct(F.lit(o).alias("origen"), F.lit(name).alias("ventana"), F.lit(max(first, o - size) if size else first).alias("desde"))
             for o in origins for name, size in spans.items()]
    fits = F.filter(F.array(*plans), lambda p: (F.col("mes_idx") >= p["desde"]) & (F.col("mes_idx") < p["origen"]))
    return rows.withColumn("_p", F.explode(fits)).select("*", "_p.origen", "_p.ventana").drop("_p")


def swap_targets(completed: DataFrame, observed: DataFrame, segments: DataFrame, first_evaluation: int, high_from: float) -> DataFrame:
    """Labels from completed places for training and observed ones after."""
    both = completed.select("tramo_id", "mes_idx", F.col("peso").alias("_c")).join(
        observed.select("tramo_id", "mes_idx", F.col("peso").alias("_o")), ["tramo_id", "mes_idx"], "full")
    late = F.col("mes_idx") >= first_evaluation
    weight = F.coalesce(F.when(late, F.col("_o")).otherwise(F.col("_c")), F.lit(0.0))
    joined = both.join(segments.select("tramo_id", "longitud_m"), "tramo_id")
    return joined.select("tramo_id", "mes_idx", F.when(late, "evaluacion").otherwise("entrenamiento").alias("etapa"),
                         risk_class(weight / length_factor(F.col("longitud_m")), high_from).alias("y"))


@dataclass(frozen=True)
class Split:
    """Month ranges (inclusive) of one experiment."""

    train: tuple[int, int]
    validation: tuple[int, int]
    test: tuple[int, int]

    def __post_init__(self) -> None:
        if not self.train[1] < self.validation[0] <= self.validation[1] < self.test[0]:
            raise ValueError("stages must be chronological and disjoint")


def months(df: DataFrame, span: tuple[int, int]) -> DataFrame:
    return df.filter(F.col("mes_idx").between(*span))


Sampler = Callable[[DataFrame], DataFrame]


def capped(cap: int = 450, low_factor: int = 2, shifts: bool = True) -> Sampler:
    strata = ["mes_idx", "turno_idx"] if shifts else ["mes_idx"]
    keys = ("tramo_id", *strata)
    return lambda df: sampling.balanced_weights(sampling.cap_per_class(df, strata, cap, sampling.hash_order(keys=keys), low_factor=low_factor)).withColumnRenamed("peso_clase", "peso_muestra")


def minority_bound(floor: int = 50_000, ceiling: int = 250_000) -> Sampler:
    return lambda df: sampling.balanced_weights(sampling.cap_low_class(df, sampling.hash_order(keys=("tramo_id", "mes_idx")), floor=floor, ceiling=ceiling)).withColumnRenamed("peso_clase", "peso_muestra")


def two_strata(power: float = 1.0, minimum: int = 900) -> Sampler:
    return lambda df: sampling.two_stratum(df, ["mes_idx", "turno_idx"], sampling.hash_order(), minimum=minimum).withColumn("peso_muestra", F.pow("peso_inclusion", F.lit(power)))


def per_class_month(balance: float = 1.25, cap: int = 18_000, rows: int = 90_000, shifts: bool = False) -> Sampler:
    strata = ("mes_idx", "turno_idx") if shifts else ("mes_idx",)
    return lambda df: sampling.class_month_sample(df, sampling.hash_order(keys=("tramo_id", *strata)), cap, rows, balance, strata=strata).withColumnRenamed("peso", "peso_muestra")


@dataclass
class Arm:
    """One fitted candidate with scored validation and test months."""

    name: str
    model: models.RiskClassifier
    validation: DataFrame
    test: DataFrame


def run_arm(name: str, rows: DataFrame, features: Sequence[str], spec: models.ModelSpec, split: Split, sampler: Sampler) -> Arm:
    """Sample, fit and score one candidate. ``rows`` carries y and features."""
    train = settle(sampler(months(rows, split.train)))
    model = models.fit(spec, train, features, weight="peso_muestra")
    keys = [c for c in ("tramo_id", "mes_idx", "turno_idx", "y") if c in rows.columns]
    scored = lambda span: settle(model.score(months(rows, span)).select(*keys, "p0", "p1", "p2"))
    return Arm(name, model, scored(split.validation), scored(split.test))


def named(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("nombre", F.lit(name))


def arm_metrics(name: str, scored: DataFrame, predicted: Column) -> DataFrame:
    """Metric row of one candidate with the average precision of high."""
    counts = ev.confusion(scored.withColumn("pred", predicted))
    ap = ev.average_precision(scored, F.col("y") == 2, "p2").first()
    row = named(ev.metrics(counts), name).withColumn("average_precision", F.lit(float(ap["average_precision"]) if ap else 0.0))
    return row.withColumn("puntaje", F.col("accuracy") * 0.4 + F.col("f1_medio_alto") * 0.6)


def by_argmax() -> Column:
    return argmax3(F.col("p0"), F.col("p1"), F.col("p2"))


def by_cutoffs(cuts: dict[str, float]) -> Column:
    return decide(F.col("p1"), F.col("p2"), cuts["medio"], cuts["alto"])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def compare_arms(arms: Sequence[Arm], decision: Callable[[Arm], Column] | None = None) -> DataFrame:
    """Test metrics of every arm; decisions come from validation months only."""
    decision = decision or (lambda arm: by_argmax())
    return settle(union_all([arm_metrics(a.name, a.test, decision(a)) for a in arms]))


def joint_decision(arm: Arm) -> Column:
    best = ev.best_joint_cutoffs(arm.validation).first()
    return by_cutoffs({"medio": best["medio"], "alto": best["alto"]})


def two_stage_decision(arm: Arm) -> Column:
    return by_cutoffs(ev.two_stage_cutoffs(arm.validation))


def rule_decision(arm: Arm) -> Column:
    """Best of argmax and the fixed cutoff pairs on validation months."""
    best = ev.fixed_rule_search(arm.validation).orderBy(F.desc(F.round("puntaje", 12)), "celda").first()
    return by_argmax() if best["celda"] == 0 else by_cutoffs({"medio": best["corte_medio"], "alto": best["corte_alto"]})


def multiplier_decision(arm: Arm) -> Column:
    best = ev.best_multiplier(ev.multiplier_search(arm.validation, *ev.MULTIPLIERS["base"])).first()
    return argmax3(F.col("p0"), F.col("p1") * best["mult_medio"], F.col("p2") * best["mult_alto"])


def with_calibration(arm: Arm) -> Arm:
    """Calibrated twin of an arm, learnt on its validation months."""
    return replace(arm, name=f"{arm.name}_calibrado", validation=settle(models.calibrate(arm.validation, arm.validation)),
                   test=settle(models.calibrate(arm.validation, arm.test)))


def with_prior(arm: Arm, rows: DataFrame, beta: float) -> Arm:
    """Arm whose test probabilities follow last month's class shares."""
    shares = rows.groupBy("y").count().collect()  # three classes
    total = sum(r["count"] for r in shares)
    reference = [next((r["count"] for r in shares if r["y"] == c), 0) / total for c in range(3)]
    return replace(arm, name=f"{arm.name}_prior", test=settle(ev.adapt_prior(arm.test, reference, beta)))


def refit_and_forecast(rows: DataFrame, features: Sequence[str], spec: models.ModelSpec, history: tuple[int, int], target: int,
                       sampler: Sampler, cuts: dict[str, float]) -> DataFrame:
    """Fit on all known months and score the next one by segment and shift."""
    model = models.fit(spec, settle(sampler(months(rows, history))), features, weight="peso_muestra")
    scored = model.score(rows.filter(F.col("mes_idx") == target)).withColumn("clase", by_cutoffs(cuts))
    return scored


def changed_by_future(cube: DataFrame, build: Callable[[DataFrame], DataFrame], measures: Sequence[str], months: int, target: str = "riesgo") -> DataFrame:
    """For every month the rows whose features change if that month and all later ones are altered; one pass over all cuts.

    Each segment is repeated once for every cut, with every measure altered from
    the cut on, and the features of the cut's own month are compared with
    the unaltered ones. ``target`` is the one column that may change.
    """
    keys = ["tramo_id", "mes_idx", "turno_idx"]
    digest = lambda df: df.select(*keys, F.xxhash64(*[c for c in df.columns if c not in (*keys, target)]).alias("_h"))
    late = F.col("mes_idx") >= F.col("_corte")
    names = [m for m in measures if m in cube.columns]
    altered = cube.withColumn("_corte", F.explode(F.sequence(F.lit(0), F.lit(months - 1)))).select(
        F.concat_ws("#", "tramo_id", "_corte").alias("tramo_id"), *[F.when(late, F.col(c) * 3 + 7).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in cube.columns if c != "tramo_id"])
    parts = F.split("tramo_id", "#")
    at_cut = build(altered).filter(F.col("mes_idx") == F.element_at(parts, -1).cast("int")).withColumn("tramo_id", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "#"))
    both = digest(build(cube)).join(digest(at_cut).withColumnRenamed("_h", "_g"), keys, "left")
    return both.groupBy("mes_idx").agg(F.count(F.lit(1)).alias("filas"), F.count(F.when(~F.col("_h").eqNullSafe(F.col("_g")), 1)).alias("cambiadas"))
