"""Confusion metrics, average precision, threshold searches and selection.

Every search first reduces the rows to a small table of distinct decision
patterns or score steps; the grid is walked on that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tramorisk.functions.risk import CLASSES, argmax3, decide, ratio
from tramorisk.operators.ordered import exact_quantiles, running_sums


def confusion(df: DataFrame, groups: Sequence[str] = (), truth: str = "y", predicted: str = "pred") -> DataFrame:
    """Nine counts ``c00..c22`` (truth, prediction), one row per group."""
    cell = lambda t, p: F.count(F.when((F.col(truth) == t) & (F.col(predicted) == p), 1)).alias(f"c{t}{p}")
    return df.groupBy(*groups).agg(*[cell(t, p) for t in range(3) for p in range(3)])


CELLS = tuple(f"c{t}{p}" for t in range(3) for p in range(3))


def add_confusions(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sum confusion rows into wider groups."""
    return counts.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in CELLS])


def confusion_sets(counts: DataFrame) -> DataFrame:
    """Confusion by month and shift, by shift, by month and overall.

    A column that was rolled away is marked ``-1``.
    """
    sums = [F.sum(c).alias(c) for c in CELLS]
    cube = counts.cube("mes_idx", "turno_idx").agg(*sums)
    return cube.fillna(-1, ["mes_idx", "turno_idx"])


def night_confusion(counts: DataFrame) -> DataFrame:
    """Night and early-morning shifts together."""
    return counts.filter(F.col("turno_idx").isin(0, 3)).agg(*[F.sum(c).alias(c) for c in CELLS])


def metrics(counts: DataFrame) -> DataFrame:
    """Metrics of confusion rows; 0 where a denominator is 0."""
    c = {k: F.col(k) for k in CELLS}
    actual = [c[f"c{i}0"] + c[f"c{i}1"] + c[f"c{i}2"] for i in range(3)]
    guessed = [c[f"c0{i}"] + c[f"c1{i}"] + c[f"c2{i}"] for i in range(3)]
    hit = [c[f"c{i}{i}"] for i in range(3)]
    total = actual[0] + actual[1] + actual[2]
    precision = [ratio(hit[i], guessed[i]) for i in range(3)]
    recall = [ratio(hit[i], actual[i]) for i in range(3)]
    f1 = [ratio(hit[i] * 2, actual[i] + guessed[i]) for i in range(3)]
    mean = lambda xs: (xs[0] + xs[1] + xs[2]) / 3.0
    out = {"n": total, "accuracy": ratio(hit[0] + hit[1] + hit[2], total), "balanced_accuracy": mean(recall),
           "precision_macro": mean(precision), "recall_macro": mean(recall), "f1_macro": mean(f1),
           "f1_medio_alto": (f1[1] + f1[2]) / 2.0}
    for i, name in enumerate(CLASSES):
        out |= {f"precision_{name}": precision[i], f"recall_{name}": recall[i], f"f1_{name}": f1[i],
                f"reales_{name}": actual[i], f"predichos_{name}": guessed[i]}
    kept = [k for k in counts.columns if k not in CELLS]
    return counts.select(*kept, *[v.alias(k) for k, v in out.items()])


def class_report(counts: DataFrame) -> DataFrame:
    """One row per class of the metric table."""
    wide = metrics(counts)
    kept = [k for k in counts.columns if k not in CELLS]
    rows = [F.struct(F.lit(n).alias("clase"), F.col(f"precision_{n}").alias("precision"), F.col(f"recall_{n}").alias("recall"),
                     F.col(f"f1_{n}").alias("f1"), F.col(f"reales_{n}").alias("soporte")) for n in CLASSES]
    return wide.select(*kept, F.explode(F.array(*rows)).alias("_r")).select(*kept, "_r.*")


def row_shares(counts: DataFrame) -> DataFrame:
    """Confusion cells with their percent inside the true class."""
    kept = [k for k in counts.columns if k not in CELLS]
    rows = [F.struct(F.lit(t).alias("y"), F.lit(p).alias("pred"), F.col(f"c{t}{p}").alias("n"),
                     (ratio(F.col(f"c{t}{p}"), F.col(f"c{t}0") + F.col(f"c{t}1") + F.col(f"c{t}2")) * 100).alias("porcentaje"))
            for t in range(3) for p in range(3)]
    return counts.select(*kept, F.explode(F.array(*rows)).alias("_r")).select(*kept, "_r.*")


def _score_steps(df: DataFrame, groups: Sequence[str], positive: Column, score: str) -> DataFrame:
    """Cumulative hits and rows from the best score down, per distinct score."""
    steps = df.groupBy(*groups, score).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(positive, 1)).alias("_p"))
    return running_sums(steps, groups, [F.desc(score)], {"_filas": F.col("_n"), "_aciertos": F.col("_p")})


def average_precision(df: DataFrame, positive: Column, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times recall gain over distinct scores."""
    steps = _score_steps(df, groups, positive, score)
    gain = F.sum(F.col("_p") * F.col("_aciertos") / F.col("_filas"))
    total = F.sum("_p")
    out = steps.groupBy(*groups).agg(gain.alias("_g"), total.alias("positivos"), F.sum("_n").alias("filas"))
    return out.select(*groups, "filas", "positivos", ratio(F.col("_g"), F.col("positivos")).alias("average_precision"))


def precision_recall(df: DataFrame, positive: Column, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 at every distinct score used as cutoff."""
    steps = _score_steps(df, groups, positive, score)
    totals = df.groupBy(*groups).agg(F.count(F.when(positive, 1)).alias("_todos"))
    # one row per group of a closed domain
    joined = steps.join(F.broadcast(totals), list(groups)) if groups else steps.withColumn(
        "_todos", F.lit(df.filter(positive).count()))
    precision, recall = F.col("_aciertos") / F.col("_filas"), ratio(F.col("_aciertos"), F.col("_todos"))
    return joined.select(*groups, F.col(score).alias("corte"), precision.alias("precision"), recall.alias("recall"),
                         ratio(F.col("_aciertos") * 2, F.col("_todos") + F.col("_filas")).alias("f1"))


def best_cutoff(df: DataFrame, positive: Column, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Cutoff with the largest F1, the smallest one on ties."""
    curve = precision_recall(df, positive, score, groups).withColumn("_f", F.round("f1", 12))
    best = curve.groupBy(*groups).agg(F.max(F.struct("_f", (-F.col("corte")).alias("_c"), "precision", "recall", "f1")).alias("_m"))
    return best.select(*groups, (-F.col("_m._c")).alias("corte"), "_m.precision", "_m.recall", "_m.f1")


def two_stage_cutoffs(df: DataFrame, medium: str = "p1", high: str = "p2", truth: str = "y") -> dict[str, float]:
    """High cutoff first, then the medium one among the rows below it."""
    top = best_cutoff(df, F.col(truth) == 2, high).first()
    alto = top["corte"] if top else 1.0
    rest = df.filter(F.col(high) < alto)
    mid = best_cutoff(rest, F.col(truth) == 1, medium).first()
    return {"alto": float(alto), "medio": float(mid["corte"]) if mid else 1.0}


def cutoff_grids(df: DataFrame, truth: str = "y", scores: Sequence[str] = ("p1", "p2"), inner: int = 55, outer: int = 35) -> list[list[float]]:
    """Candidate cutoffs per score: quantiles of positives and of all rows."""
    own = [i / (inner - 1) for i in range(inner)]
    every = [0.9 + i * (0.9999 - 0.9) / (outer - 1) for i in range(outer)]
    tagged = [F.struct(F.lit(s).alias("serie"), F.col(s).alias("v")) for s in scores]
    tagged += [F.when(F.col(truth) == k, F.struct(F.lit(f"{s}+").alias("serie"), F.col(s).alias("v"))) for k, s in enumerate(scores, 1)]
    long = df.select(F.explode(F.array(*tagged)).alias("_r")).filter("_r IS NOT NULL").select("_r.*")
    found = exact_quantiles(long, ["serie"], "v", [*own, *every]).collect()  # series x probabilities
    pick = lambda serie, probs: {r["valor"] for r in found if r["serie"] == serie and r["prob"] in probs}
    return [sorted({0.0, 1.000001} | pick(f"{s}+", set(own)) | pick(s, set(every))) for s in scores]


def _bin(score: Column, edges: Sequence[float], below: int = 0) -> Column:
    """How many edges lie at or below the score, as a balanced decision tree."""
    if not edges:
        return F.lit(below)
    middle = len(edges) // 2
    return F.when(score < edges[middle], _bin(score, edges[:middle], below)).otherwise(_bin(score, edges[middle + 1:], below + middle + 1))


def joint_cutoffs(df: DataFrame, medium: Sequence[float], high: Sequence[float], truth: str = "y",
                  p_medium: str = "p1", p_high: str = "p2") -> DataFrame:
    """Mean F1 of medium and high for every pair of cutoffs.

    Rows fall into a two-way histogram once; each pair of cutoffs is then a
    sum over at most grid x grid x 3 cells.
    """
    cells = df.groupBy(_bin(F.col(p_medium), medium).alias("_i"), _bin(F.col(p_high), high).alias("_j"), F.col(truth).alias("_y")).agg(
        F.count(F.lit(1)).alias("_n"))
    supports = {r["_y"]: r["s"] for r in cells.groupBy("_y").agg(F.sum("_n").alias("s")).collect()}
    s1, s2 = supports.get(1, 0), supports.get(2, 0)
    highs = cells.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(high) - 1)))).filter(F.col("_j") >= F.col("j") + 1).groupBy("j").agg(
        F.sum("_n").alias("_g"), F.sum(F.when(F.col("_y") == 2, F.col("_n")).otherwise(0)).alias("_h"))
    mids = (cells.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(high) - 1)))).filter(F.col("_j") <= F.col("j"))
            .groupBy("j", "_i").agg(F.sum("_n").alias("_n"), F.sum(F.when(F.col("_y") == 1, F.col("_n")).otherwise(0)).alias("_m")))
    mids = mids.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(medium) - 1)))).filter(F.col("_i") >= F.col("i") + 1).groupBy("i", "j").agg(
        F.sum("_n").alias("_mg"), F.sum("_m").alias("_mh"))
    spark = df.sparkSession
    grid = spark.range(len(medium)).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(len(high) - 1))).alias("j"))
    full = grid.join(mids, ["i", "j"], "left").join(highs, ["j"], "left").fillna(0)
    f_mid = F.col("_mh") * 2 / F.greatest(F.lit(s1) + F.col("_mg"), F.lit(1))
    f_high = F.col("_h") * 2 / F.greatest(F.lit(s2) + F.col("_g"), F.lit(1))
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(k) + 1)
    return full.select(pick(medium, "i").alias("medio"), pick(high, "j").alias("alto"), f_mid.alias("f1_medio"), f_high.alias("f1_alto"),
                       ((f_mid + f_high) / 2.0).alias("objetivo"))


def best_joint_cutoffs(df: DataFrame, truth: str = "y") -> DataFrame:
    """Best pair of cutoffs; the smallest pair on ties."""
    medium, high = cutoff_grids(df, truth)
    return joint_cutoffs(df, medium, high, truth).orderBy(F.desc(F.round("objetivo", 12)), "medio", "alto").limit(1)


def _grid_confusion(df: DataFrame, predictions: Sequence[Column], groups: Sequence[str] = (), truth: str = "y") -> DataFrame:
    """Confusion per grid position, through the distinct decision patterns."""
    pattern = F.concat(*[p.cast("string") for p in predictions])
    small = df.groupBy(*groups, F.col(truth).alias("y"), pattern.alias("_patron")).agg(F.count(F.lit(1)).alias("_n"))
    rows = small.withColumn("celda", F.explode(F.sequence(F.lit(0), F.lit(len(predictions) - 1)))).withColumn(
        "pred", F.substring(F.col("_patron"), F.col("celda") + 1, F.lit(1)).cast("int"))
    cell = lambda t, p: F.sum(F.when((F.col("y") == t) & (F.col("pred") == p), F.col("_n")).otherwise(0)).alias(f"c{t}{p}")
    return rows.groupBy(*groups, "celda").agg(*[cell(t, p) for t in range(3) for p in range(3)])


# Multiplier grids of the three searches.
MULTIPLIERS = {"base": ((0.7, 0.85, 1.0, 1.15, 1.35, 1.6, 1.9, 2.3), (0.7, 0.85, 1.0, 1.15, 1.35, 1.6))}


def multiplier_search(df: DataFrame, medium: Sequence[float], high: Sequence[float], truth: str = "y",
                      accuracy_weight: float = 0.4, f1_weight: float = 0.6) -> DataFrame:
    """Score of argmax(p x [1, m, h]) for every pair of multipliers."""
    pairs = [(m, h) for m in medium for h in high]
    preds = [argmax3(F.col("p0"), F.col("p1") * m, F.col("p2") * h) for m, h in pairs]
    scored = metrics(_grid_confusion(df, preds, truth=truth))
    mult = lambda k: F.element_at(F.array(*[F.lit(float(p[k])) for p in pairs]), F.col("celda") + 1)
    return scored.withColumn("mult_medio", mult(0)).withColumn("mult_alto", mult(1)).withColumn(
        "puntaje", F.col("accuracy") * accuracy_weight + F.col("f1_medio_alto") * f1_weight)


def best_multiplier(scored: DataFrame) -> DataFrame:
    """Best pair, the first of the grid on ties."""
    return scored.orderBy(F.desc(F.round("puntaje", 12)), "celda").limit(1)


# Cutoff steps and objective weights of the fixed-rule search.
RULE_HIGH = (0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)
RULE_MEDIUM = (0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60)
RULE_WEIGHTS = {"f1_macro": 0.45, "balanced_accuracy": 0.25, "recall_alto": 0.20, "average_precision": 0.10}


def fixed_rule_search(df: DataFrame, truth: str = "y") -> DataFrame:
    """Score of argmax and of every fixed cutoff pair; cell 0 is argmax."""
    pairs = [(h, m) for h in RULE_HIGH for m in RULE_MEDIUM]
    preds = [argmax3(F.col("p0"), F.col("p1"), F.col("p2"))] + [decide(F.col("p1"), F.col("p2"), m, h) for h, m in pairs]
    scored = metrics(_grid_confusion(df, preds, truth=truth))
    ap = average_precision(df, F.col(truth) == 2, "p2").first()["average_precision"]
    cut = lambda k: F.element_at(F.array(F.lit(None).cast("double"), *[F.lit(float(p[k])) for p in pairs]), F.col("celda") + 1)
    value = F.lit(RULE_WEIGHTS["average_precision"] * ap)
    for name in ("f1_macro", "balanced_accuracy", "recall_alto"):
        value = value + F.col(name) * RULE_WEIGHTS[name]
    return scored.withColumn("corte_alto", cut(0)).withColumn("corte_medio", cut(1)).withColumn("puntaje", value)


def guarded_choice(rows: DataFrame, control: DataFrame, keep: float = 0.9, name: str = "nombre") -> DataFrame:
    """Best candidate that keeps the control's precision and recall of high.

    Dominating candidates come first, then eligible ones, then all.
    """
    c = control.first()
    eligible = (F.col("precision_alto") >= c["precision_alto"] * keep) & (F.col("recall_alto") >= c["recall_alto"] * keep)
    dominating = eligible & (F.col("accuracy") >= c["accuracy"]) & (F.col("f1_medio_alto") >= c["f1_medio_alto"])
    tier = F.when(dominating, 2).when(eligible, 1).otherwise(0)
    return rows.withColumn("nivel_guarda", tier).orderBy(F.desc("nivel_guarda"), F.desc("puntaje"), name).limit(1)


def frozen_high(base: Sequence[Column], light: Sequence[Column], blend: float, multiplier: float) -> Column:
    """Keep the base model's high class; blend low and medium elsewhere."""
    if not 0 <= blend <= 1 or multiplier <= 0:
        raise ValueError("blend must lie in [0, 1] and the multiplier above 0")
    original = argmax3(*base)
    mix = [base[i] * (1 - blend) + light[i] * blend for i in (0, 1)]
    return F.when(original == 2, 2).when(mix[1] * multiplier > mix[0], 1).otherwise(0).cast("int")


def frozen_high_search(df: DataFrame, base: Sequence[str], light: Sequence[str], blends: Sequence[float],
                       multipliers: Sequence[float], truth: str = "y") -> DataFrame:
    pairs = [(b, m) for b in blends for m in multipliers]
    preds = [frozen_high([F.col(c) for c in base], [F.col(c) for c in light], b, m) for b, m in pairs]
    scored = metrics(_grid_confusion(df, preds, truth=truth))
    value = lambda k: F.element_at(F.array(*[F.lit(float(p[k])) for p in pairs]), F.col("celda") + 1)
    return scored.withColumn("mezcla", value(0)).withColumn("multiplicador", value(1)).withColumn(
        "puntaje", F.col("accuracy") * 0.4 + F.col("f1_medio_alto") * 0.6)


def adapt_prior(df: DataFrame, reference: Sequence[float], beta: float, truth: str = "y") -> DataFrame:
    """Probabilities re-weighted by last month's class shares."""
    shares = df.groupBy("mes_idx").agg(*[F.avg(F.when(F.col(truth) == c, 1.0).otherwise(0.0)).alias(f"_s{c}") for c in range(3)])
    before = shares.withColumn("mes_idx", F.col("mes_idx") + 1)
    joined = df.join(F.broadcast(before), "mes_idx", "left")  # calendar rows only
    for c in range(3):
        joined = joined.withColumn(f"_q{c}", F.col(f"p{c}") * F.coalesce(
            F.pow((F.col(f"_s{c}") + 1e-6) / (float(reference[c]) + 1e-6), F.lit(float(beta))), F.lit(1.0)))
    total = F.col("_q0") + F.col("_q1") + F.col("_q2")
    for c in range(3):
        joined = joined.withColumn(f"p{c}", F.col(f"_q{c}") / total)
    return joined.drop(*[f"_s{c}" for c in range(3)], *[f"_q{c}" for c in range(3)])


def log_loss(df: DataFrame, groups: Sequence[str] = (), truth: str = "y", floor: float = 1e-15) -> DataFrame:
    """Log loss, prevalence of high and accuracy of the largest class."""
    own = F.when(F.col(truth) == 0, F.col("p0")).when(F.col(truth) == 1, F.col("p1")).otherwise(F.col("p2"))
    share = lambda c: F.avg(F.when(F.col(truth) == c, 1.0).otherwise(0.0))
    return df.groupBy(*groups).agg(F.avg(-F.log(F.greatest(own, F.lit(floor)))).alias("log_loss"), share(2).alias("prevalencia_alto"),
                                   F.greatest(share(0), share(1), share(2)).alias("linea_base_mayoria"))


def best_per_group(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "puesto") -> DataFrame:
    """First candidate of each group; candidate tables are experiment sized."""
    w = W.partitionBy(*groups).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) == 1).drop(name)


def metric_deltas(rows: DataFrame, arm: str, base: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Each arm's metrics minus those of the base arm."""
    control = rows.filter(F.col(arm) == base).select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    others = rows.filter(F.col(arm) != base)
    joined = others.join(control, list(keys)) if keys else others.join(F.broadcast(control))  # one metric row
    return joined.select(*keys, arm, *[(F.col(c) - F.col(f"_b_{c}")).alias(f"delta_{c}") for c in columns])


def changed_labels(left: DataFrame, right: DataFrame, keys: Sequence[str], label: str = "y") -> DataFrame:
    """Labels that differ between two truths of the same cells."""
    both = left.select(*keys, F.col(label).alias("_a")).join(right.select(*keys, F.col(label).alias("_b")), list(keys))
    return both.agg(F.count(F.lit(1)).alias("celdas"), F.count(F.when(F.col("_a") != F.col("_b"), 1)).alias("cambiadas"))


def monotone_repair(p_mid: Column, p_high: Column) -> tuple[Column, Column, Column]:
    """Three probabilities from two cumulative ones, averaged when swapped."""
    mean = (p_mid + p_high) / 2.0
    mid, high = F.when(p_high > p_mid, mean).otherwise(p_mid), F.when(p_high > p_mid, mean).otherwise(p_high)
    return F.lit(1.0) - mid, mid - high, high


def hurdle(p_event: Column, p_high_given_event: Column) -> tuple[Column, Column, Column]:
    return F.lit(1.0) - p_event, p_event * (F.lit(1.0) - p_high_given_event), p_event * p_high_given_event
