"""Experiments of many fits: features stored once, fits side by side, finished ones found again.

The scores of every fit are stored under the fingerprint of the input files and
of the experiment's settings, and marked when they are whole. A rerun fits what
is not marked. Boosted fits train as groups of one job; forests, which Spark ML
spreads over the cluster level by level, run at once from a bounded number of
driver threads, each in a scheduler pool of its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from tramorisk.functions.risk import argmax3, decide
from tramorisk.operators import boosting, evaluate as ev, models
from tramorisk.plans.jobs import Sampler, months
from tramorisk.session import ensure_checkpoint_dir, settle, together
from tramorisk.sources.readers import exists, fingerprint, register_forecast, registered_forecasts, reusable, store_fingerprint, table_digest

KEYS = ("tramo_id", "mes_idx", "turno_idx")
FORECAST = ["tramo_id", "mes_idx", "p0", "p1", "p2"]


@dataclass(frozen=True)
class Candidate:
    """One fit: its rows, columns, settings, sample, training months and the months it scores, by stage."""

    name: str
    rows: DataFrame = field(repr=False)
    features: Sequence[str]
    spec: models.ModelSpec
    sampler: Sampler = field(repr=False)
    sampling: str
    train: tuple[int, int]
    stages: dict[str, tuple[int, int]]


class Store:
    """Scores of an experiment's fits, kept under the fingerprint of inputs and settings."""

    def __init__(self, tables, name: str, settings: object, inputs: Sequence[str] = ("lineitem", "supplier", "part")) -> None:
        self.spark = tables.spark
        text = json.dumps([fingerprint(tables.table(i), {}) for i in inputs] + [name, repr(settings)])
        self.mark = hashlib.sha256(text.encode()).hexdigest()
        self.root = f"{ensure_checkpoint_dir(self.spark)}/experimentos/{name}/{self.mark[:24]}"

    def done(self, name: str) -> bool:
        return reusable(self.spark, f"{self.root}/marcas/{name}", self.mark)

    def finish(self, name: str) -> None:
        store_fingerprint(self.spark, f"{self.root}/marcas/{name}", self.mark)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table of the experiment, computed by the first run that gets here."""
        if not self.done(name):
            build().write.mode("overwrite").parquet(f"{self.root}/{name}")
            self.finish(name)
        return self.spark.read.parquet(f"{self.root}/{name}")

    def scores(self, names: Iterable[str]) -> DataFrame:
        """``ajuste``, ``etapa``, keys, ``y`` and probabilities of finished fits."""
        paths = [f"{self.root}/puntajes/ajuste={n}" for n in names]
        return self.spark.read.option("basePath", f"{self.root}/puntajes").parquet(*paths)

    def run(self, candidates: Sequence[Candidate]) -> None:
        """Fit and score what is not finished yet."""
        open_ = [c for c in candidates if not self.done(c.name)]
        forests, boosted = [c for c in open_ if c.spec.family == "bosque"], [c for c in open_ if c.spec.family != "bosque"]
        together([*([lambda: self._boost(boosted)] if boosted else []), *[lambda c=c: self._forest(c) for c in forests]])

    def _asked(self, candidate: Candidate) -> DataFrame:
        """Rows of the scored months with their stage."""
        stage = F.lit(None).cast("string")
        for name, span in candidate.stages.items():
            stage = F.when(F.col("mes_idx").between(*span), F.lit(name)).otherwise(stage)
        return candidate.rows.withColumn("etapa", stage).filter("etapa is not null")

    def _kept(self, rows: DataFrame) -> list[str]:
        return ["etapa", *[k for k in (*KEYS, "y") if k in rows.columns]]

    def _forest(self, candidate: Candidate) -> None:
        model = models.fit(candidate.spec, settle(candidate.sampler(months(candidate.rows, candidate.train))), candidate.features, weight="peso_muestra")
        scored = model.score(self._asked(candidate).withColumn("y", F.col("y").cast("int"))).select(*self._kept(candidate.rows), "p0", "p1", "p2")
        scored.write.mode("overwrite").parquet(f"{self.root}/puntajes/ajuste={candidate.name}")
        self.finish(candidate.name)

    def _boost(self, candidates: Sequence[Candidate]) -> None:
        specs = {c.name: c.spec for c in candidates}
        samples = together([lambda c=c: settle(boosting.sample_rows(c.sampler(months(c.rows, c.train)), c.name, c.features)) for c in candidates])
        asked = [boosting.sample_rows(self._asked(c).withColumn("_w", F.lit(1.0)), c.name, c.features, weight="_w", keep=self._kept(c.rows)).drop("w") for c in candidates]
        united = lambda frames: frames[0] if len(frames) == 1 else united([*[a.unionByName(b, True) for a, b in zip(frames[::2], frames[1::2])], *frames[len(frames) // 2 * 2:]])  # noqa: E731, B905
        scored = boosting.score_many(united(asked), boosting.fit_many(united(samples), specs), specs)
        scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ajuste").parquet(f"{self.root}/puntajes")
        together([lambda c=c: self.finish(c.name) for c in candidates])


def metric_table(scored: DataFrame, predicted: Column, groups: Sequence[str] = ("ajuste", "etapa")) -> DataFrame:
    """Metric row of every group in one job, with the average precision of high and the mixed score."""
    table = ev.metrics(ev.confusion(scored.withColumn("pred", predicted), groups))
    precision = ev.average_precision(scored, F.col("y") == 2, "p2", groups)
    joined = table.join(precision.select(*groups, "average_precision"), list(groups), "left").fillna(0.0, ["average_precision"])
    return joined.withColumn("puntaje", F.col("accuracy") * 0.4 + F.col("f1_medio_alto") * 0.6)


def by_argmax() -> Column:
    return argmax3(F.col("p0"), F.col("p1"), F.col("p2"))


def with_cuts(scored: DataFrame, cuts: dict[str, tuple[float, float]]) -> tuple[DataFrame, Column]:
    """Scores with each fit's own cutoffs (medium, high) and the decision by them."""
    table = scored.sparkSession.createDataFrame([(k, float(m), float(h)) for k, (m, h) in cuts.items()], "ajuste string, _medio double, _alto double")
    joined = scored.join(F.broadcast(table), "ajuste")  # one row for each fit of the experiment
    return joined, decide(F.col("p1"), F.col("p2"), F.col("_medio"), F.col("_alto"))


def joint_cuts(scored: DataFrame) -> tuple[float, float]:
    best = ev.best_joint_cutoffs(scored).first()
    return best["medio"], best["alto"]


def two_stage_cuts(scored: DataFrame) -> tuple[float, float]:
    cuts = ev.two_stage_cutoffs(scored)
    return cuts["medio"], cuts["alto"]


def cuts_of(scored: DataFrame, names: Sequence[str], search: Callable[[DataFrame], tuple[float, float]]) -> dict[str, tuple[float, float]]:
    """Cutoffs of every fit, searched at once."""
    return dict(zip(names, together([lambda n=n: search(scored.filter(F.col("ajuste") == n)) for n in names]), strict=True))


def staged_comparison(store: Store, candidates: Sequence[Candidate], always: Sequence[str] = ()) -> DataFrame:
    """Calibrate and cut on one stage, choose on the next, look back on the last.

    Every candidate is judged raw and calibrated on the stage ``seleccion``; the
    calibration and the cutoffs come from ``calibracion`` alone. The better variant
    stands for the candidate. The best candidate of each family, the best of all
    and those in ``always`` are then evaluated on ``retrospectiva`` with what
    was frozen. Columns: ``ajuste``, ``variante``, ``etapa``, ``elegido`` and
    the metrics.
    """
    store.run(candidates)
    names = [c.name for c in candidates]
    raw = store.scores(names)

    def calibrated() -> DataFrame:
        first = raw.filter("etapa = 'calibracion'")
        frames = together([lambda n=n: settle(models.calibrate(first.filter(F.col("ajuste") == n), raw.filter(F.col("ajuste") == n))) for n in names])
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    both = raw.withColumn("variante", F.lit("directo")).unionByName(store.once("calibrados", calibrated).withColumn("variante", F.lit("calibrado")))
    both = both.withColumn("candidato", F.col("ajuste")).withColumn("ajuste", F.concat_ws("|", "candidato", "variante"))
    variants = [f"{n}|{v}" for n in names for v in ("directo", "calibrado")]
    cut_rows = store.once("cortes", lambda: both.sparkSession.createDataFrame(
        [(k, float(m), float(h)) for k, (m, h) in cuts_of(both.filter("etapa = 'calibracion'"), variants, joint_cuts).items()], "ajuste string, medio double, alto double"))
    cuts = {r["ajuste"]: (r["medio"], r["alto"]) for r in cut_rows.collect()}  # one row for each variant
    judged, decision = with_cuts(both.filter("etapa <> 'calibracion'"), cuts)
    table = store.once("metricas", lambda: metric_table(judged, decision, ("ajuste", "candidato", "variante", "etapa")))
    chosen = [r for r in table.filter("etapa = 'seleccion'").collect()]
    order = lambda r: (-round(r["f1_medio_alto"], 12), r["variante"] != "directo", names.index(r["candidato"]))
    own = {n: min((r for r in chosen if r["candidato"] == n), key=order) for n in names}
    family = {c.name: c.spec.family for c in candidates}
    best = {f: min((own[n] for n in names if family[n] == f), key=order)["candidato"] for f in set(family.values())}
    winner = min(own.values(), key=order)["candidato"]
    late = {*best.values(), winner, *always}
    keep = F.lit(False)
    for n in names:
        stages = ["seleccion", "retrospectiva"] if n in late else ["seleccion"]
        keep = keep | ((F.col("candidato") == n) & F.col("etapa").isin(stages) & ((F.col("etapa") == "seleccion") | (F.col("variante") == own[n]["variante"])))
    return table.filter(keep).withColumn("nombre", F.col("candidato")).withColumn("elegido", (F.col("candidato") == winner).cast("int"))


def refit(candidate: Candidate, name: str, train: tuple[int, int], stages: dict[str, tuple[int, int]]) -> Candidate:
    """The same candidate fitted on other months."""
    return replace(candidate, name=name, train=train, stages=stages)


# ---------------------------------------------------------------- monthly protocol

@dataclass(frozen=True)
class Protocol:
    """Origins, windows and families of the monthly protocol: choose on B, confirm on C, forecast D before its labels are read."""

    families: dict[str, models.ModelSpec]
    windows: dict[str, int | None]
    origins_b: tuple[int, ...]
    origins_c: tuple[int, ...]
    month_d: int
    first: int = 3
    control: str = "3m"
    keep: float = 0.9

    def __post_init__(self) -> None:
        if not max(self.origins_b) < min(self.origins_c) <= max(self.origins_c) < self.month_d:
            raise ValueError("phases must be chronological and disjoint")
        if self.control not in self.windows:
            raise ValueError("the control window must be one of the windows")


class MonthlyProtocol:
    """State of one protocol in its store: each phase reads only what the phase before it has frozen."""

    def __init__(self, store: Store, protocol: Protocol, rows: DataFrame, features: Sequence[str], sampler: Sampler, sampling: str) -> None:
        self.store, self.protocol = store, protocol
        self._rows, self._features, self._sampler, self._sampling = rows, features, sampler, sampling

    def _candidate(self, phase: str, family: str, window: str, origin: int) -> Candidate:
        size, first = self.protocol.windows[window], self.protocol.first
        train = (max(first, origin - size) if size else first, origin - 1)
        # No row at or behind the origin reaches the fit, whatever the sampler does.
        return Candidate(f"{phase}_{family}_{window}_{origin}", self._rows, self._features, self.protocol.families[family], self._sampler, self._sampling, train, {phase: (origin, origin)})

    def phase_b(self) -> DataFrame:
        """Metrics of every family and window over the origins of B, all confusions added first."""
        p = self.protocol
        plans = {(f, w, o): self._candidate("B", f, w, o) for f in p.families for w in p.windows for o in p.origins_b}
        self.store.run(list(plans.values()))
        named = self.store.scores([c.name for c in plans.values()]).withColumn("familia", F.split("ajuste", "_")[1]).withColumn("ventana", F.split("ajuste", "_")[2])
        return self.store.once("fase_B", lambda: metric_table(named, by_argmax(), ("familia", "ventana")))

    def choose(self, table: DataFrame) -> list[dict]:
        """Best window of each family that keeps the control window's precision and recall of high; the first is the winner."""
        rows = [r.asDict() for r in table.collect()]  # one row for each family and window
        picked = []
        for family in self.protocol.families:
            own = [r for r in rows if r["familia"] == family]
            control = next(r for r in own if r["ventana"] == self.protocol.control)
            fit = [r for r in own if all(r[c] >= self.protocol.keep * control[c] for c in ("precision_alto", "recall_alto"))]
            picked.append(max(fit, key=lambda r: (round(r["puntaje"], 12), -list(self.protocol.windows).index(r["ventana"]))))
        return sorted(picked, key=lambda r: -round(r["puntaje"], 12))

    def frozen(self) -> dict[str, str]:
        """Window of each family, winner first. What was frozen stays; a choice that would now differ is an error."""
        picked = [(i, r["familia"], r["ventana"]) for i, r in enumerate(self.choose(self.phase_b()))]
        kept = sorted(map(tuple, self.store.once("seleccion", lambda: self.store.spark.createDataFrame(picked, "orden long, familia string, ventana string")).collect()))
        if kept != picked:
            raise ValueError("the frozen selection cannot change")
        return {family: window for _, family, window in kept}

    def phase_c(self) -> DataFrame:
        """Scores of the months of C, each by a refit on the frozen window before it."""
        plans = [self._candidate("C", f, w, o) for f, w in self.frozen().items() for o in self.protocol.origins_c]
        self.store.run(plans)
        return self.store.scores([c.name for c in plans]).withColumn("familia", F.split("ajuste", "_")[1])

    def register_d(self, period: str) -> dict[str, str]:
        """Forecast of month D by every family, registered once; its digests. Labels of that month are not among the columns."""
        path, digests = f"{self.store.root}/registro_D", {}
        for family, window in self.frozen().items():
            place = f"{path}/{family}"
            if not exists(self.store.spark, f"{place}/registro/periodo={period}"):
                plan = self._candidate("D", family, window, self.protocol.month_d)
                self.store.run([plan])
                register_forecast(self.store.spark, self.store.scores([plan.name]).select(*FORECAST), place, period, FORECAST)
            digests[family] = registered_forecasts(self.store.spark, place).filter(F.col("periodo") == period).first()["huella"]
        return digests

    def evaluate_d(self, period: str) -> DataFrame:
        """Metrics of the registered forecasts against the labels, once; a second evaluation and changed forecasts are errors."""
        if self.store.done("evaluacion_D"):
            raise ValueError("month D is already evaluated")
        digests, frames = self.register_d(period), []
        truth = self._rows.filter(F.col("mes_idx") == self.protocol.month_d).select("tramo_id", "mes_idx", F.col("y").cast("int").alias("y"))
        for family, digest in digests.items():
            stored = self.store.spark.read.parquet(f"{self.store.root}/registro_D/{family}/filas/periodo={period}")
            if table_digest(stored, FORECAST).first()["huella"] != digest:
                raise ValueError(f"the registered forecast of {family} has changed")
            frames.append(stored.join(truth, ["tramo_id", "mes_idx"]).withColumn("familia", F.lit(family)).withColumn("huella", F.lit(digest)))
        united = frames[0]
        for frame in frames[1:]:
            united = united.unionByName(frame)
        return self.store.once("evaluacion_D", lambda: metric_table(united, by_argmax(), ("familia", "huella")))

    def evaluation_d(self, period: str) -> DataFrame:
        """The one evaluation of D, made now or before."""
        return self.store.once("evaluacion_D", lambda: None) if self.store.done("evaluacion_D") else self.evaluate_d(period)
