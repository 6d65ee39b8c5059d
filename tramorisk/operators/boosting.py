"""Boosted trees for many small fits at once.

An experiment fits hundreds of classifiers on samples of bounded size, and one
fit through Spark ML is thousands of jobs of a few milliseconds each. Here the
samples of all fits are one table of binned rows, each binary fit is one group
of it, and a single job trains them all side by side. A fit whose sample is
beyond ``MAX_ROWS`` belongs to ``models.fit``, which spreads one fit over the
cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tramorisk.operators.models import PARTS, ModelSpec, blend
from tramorisk.session import settle

MAX_ROWS = 1_000_000
BINS = 64
ROWS_PER_SCORE = 100_000
_TREES = "ajuste string, parte string, base double, nivel int, rasgo array<int>, corte array<double>, hoja array<double>"


def sample_rows(sample: DataFrame, fit: str, features: Sequence[str], label: str = "y", weight: str = "peso_muestra", keep: Sequence[str] = ()) -> DataFrame:
    """A sample as (``ajuste``, ``y``, ``w``, ``x``) and the columns ``keep``; missing features are NaN and go with the smallest values."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    return sample.select(F.lit(fit).alias("ajuste"), F.col(label).cast("int").alias("y"), F.col(weight).cast("double").alias("w"), x.alias("x"),
                         *[F.col(c) for c in keep if c != label])


def _by_part(samples: DataFrame, specs: dict[str, ModelSpec]) -> DataFrame:
    """Each row once for every binary fit it takes part in, with its target ``_t``."""
    frames = []
    for family in sorted({s.family for s in specs.values()}):
        names = [n for n, s in specs.items() if s.family == family]
        parts = F.array(*[F.struct(F.lit(p).alias("parte"), target(F.col("y")).cast("double").alias("t"), member(F.col("y")).alias("en"))
                          for p, (target, member) in PARTS[family].items()])
        rows = samples.filter(F.col("ajuste").isin(names)).select("ajuste", "w", "x", F.explode(parts).alias("p")).filter("p.en")
        frames.append(rows.select("ajuste", "p.parte", F.col("p.t").alias("_t"), "w", "x", F.xxhash64("x", "p.t", "w").alias("_o")))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _binned(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bin of every value and the upper edges of the bins, by quantiles of each column; NaN is in the first bin."""
    codes, edges = np.zeros(x.shape, np.int32), []
    for j in range(x.shape[1]):
        known = x[~np.isnan(x[:, j]), j]
        cuts = np.unique(np.quantile(known, np.arange(1, BINS) / BINS, method="lower")) if len(known) else np.zeros(0)
        cuts = cuts[cuts < known.max()] if len(cuts) else cuts
        codes[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(cuts, x[:, j], side="left"))
        edges.append(np.append(cuts, np.inf))
    return codes, edges


def grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, min_rows: int, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree by second-order gains: feature and last left bin of each inner node (-1: no split, all go left), leaf values, leaf of each row."""
    n, d = codes.shape
    feature, last = np.full((1 << depth) - 1, -1), np.full((1 << depth) - 1, BINS)
    node = np.zeros(n, np.int64)
    columns = np.ascontiguousarray(codes.T)
    for level in range(depth):
        width, first = 1 << level, (1 << level) - 1
        sums = np.empty((3, width, d, BINS))
        for j in range(d):
            at = node * BINS + columns[j]
            for k, v in enumerate((g, h, None)):
                sums[k, :, j] = np.bincount(at, v, width * BINS).reshape(width, BINS)
        left_g, left_h, left_n = sums.cumsum(3)
        all_g, all_h, all_n = (t[:, :1, -1:] for t in (left_g, left_h, left_n))
        gain = left_g ** 2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g ** 2 / (all_h + ridge)
        gain[(left_n < min_rows) | (all_n - left_n < min_rows)] = 0
        best = gain.reshape(width, -1).argmax(1)
        split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
        feature[first:first + width] = np.where(split, best // BINS, -1)
        last[first:first + width] = np.where(split, best % BINS, BINS)
        node = 2 * node + (codes[np.arange(n), np.maximum(feature[first + node], 0)] > last[first + node])
    leaves = 1 << depth
    value = np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + ridge)
    return feature, last, value, node


def boost(x: np.ndarray, target: np.ndarray, weight: np.ndarray, spec: ModelSpec) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Start value, features, cuts and leaves of ``spec.trees`` trees on the logistic loss; each tree sees 85 % of the rows."""
    codes, edges = _binned(x)
    rng = np.random.default_rng(spec.seed)
    weight = weight / weight.mean()
    share = np.clip((weight * target).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(x), base)
    features, cuts, leaves = [], [], []
    for _ in range(spec.trees):
        p = 1 / (1 + np.exp(-score))
        seen = np.flatnonzero(rng.random(len(x)) < 0.85)
        feature, last, value, _ = grow(codes[seen], (weight * (target - p))[seen], (weight * p * (1 - p))[seen], spec.depth, spec.min_rows)
        cut = np.array([edges[f][b] if f >= 0 else np.inf for f, b in zip(feature, last, strict=True)])
        score += spec.step * value[_leaf(x, feature, cut, spec.depth)]
        features.append(np.maximum(feature, 0))
        cuts.append(cut)
        leaves.append(spec.step * value)
    return base, np.concatenate(features), np.concatenate(cuts), np.concatenate(leaves)


def _leaf(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Leaf of every row; a missing value is not above any cut."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for level in range(depth):
        at = (1 << level) - 1 + node
        node = 2 * node + (x[rows, np.maximum(feature[at], 0)] > cut[at])
    return node


def fit_many(samples: DataFrame, specs: dict[str, ModelSpec]) -> DataFrame:
    """Trees of all fits, one row for each binary part; ``samples`` as from ``sample_rows``, in bounded groups."""
    crowded = samples.groupBy("ajuste").count().filter(F.col("count") > MAX_ROWS).first()
    if crowded:
        raise ValueError(f"the sample of {crowded['ajuste']} has {crowded['count']} rows; fit it by models.fit")

    def run(key: tuple[str, str], group: pd.DataFrame) -> pd.DataFrame:
        spec, group = specs[key[0]], group.sort_values("_o")  # the same order at every attempt
        base, feature, cut, leaf = boost(np.stack(group["x"].to_numpy()), group["_t"].to_numpy(), group["w"].to_numpy(), spec)
        return pd.DataFrame({"ajuste": [key[0]], "parte": [key[1]], "base": [base], "nivel": [spec.depth], "rasgo": [feature], "corte": [cut], "hoja": [leaf]})

    rows = _by_part(samples, specs)
    return settle(rows.repartition(max(1, min(3 * len(specs), 10_000)), "ajuste", "parte").groupBy("ajuste", "parte").applyInPandas(run, _TREES))


def _probability(x: np.ndarray, base: float, depth: int, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    score, inner, leaves = np.full(len(x), base), (1 << depth) - 1, 1 << depth
    for t in range(len(leaf) // leaves):
        tree = slice(t * inner, (t + 1) * inner)
        score += leaf[t * leaves:(t + 1) * leaves][_leaf(x, feature[tree], cut[tree], depth)]
    return 1 / (1 + np.exp(-score))


def score_many(rows: DataFrame, trees: DataFrame, specs: dict[str, ModelSpec]) -> DataFrame:
    """Rows (``ajuste``, ``x``, others) with p0, p1 and p2 instead of ``x``.

    The rows of a fit are dealt to shares of about ``ROWS_PER_SCORE``, and its
    trees go to each share.
    """
    kept = [c for c in rows.columns if c != "x"]
    sizes = rows.groupBy("ajuste").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_SCORE).cast("int").alias("_s"))  # one row for each fit of the experiment
    dealt = rows.join(F.broadcast(sizes), "ajuste").withColumn("_k", F.pmod(F.xxhash64(*kept), F.col("_s")).cast("int")).drop("_s")
    spread = trees.join(F.broadcast(sizes), "ajuste").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_s")
    order = {family: list(parts) for family, parts in PARTS.items()}

    def run(key: tuple[str, int], group: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        found = {m.parte: m for m in models.itertuples()}
        x = np.stack(group["x"].to_numpy()) if len(group) else np.zeros((0, 1))
        each = [_probability(x, m.base, m.nivel, np.asarray(m.rasgo), np.asarray(m.corte), np.asarray(m.hoja)) if (m := found.get(p)) else np.zeros(len(x))
                for p in order[specs[key[0]].family]] if len(group) else []
        return group[kept].assign(_p=list(np.stack(each, 1)) if each else [])

    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + ["_p array<double>"])
    scored = dealt.groupBy("ajuste", "_k").cogroup(spread.groupBy("ajuste", "_k")).applyInPandas(run, schema)
    return _blended(scored, specs, order, kept)


def _blended(scored: DataFrame, specs: dict[str, ModelSpec], order: dict[str, list[str]], kept: Sequence[str]) -> DataFrame:
    def value(i: int) -> Column:
        out = F.lit(None).cast("double")
        for family in sorted({s.family for s in specs.values()}):
            at: Callable[[str], Column] = lambda part, parts=order[family]: F.get("_p", F.lit(parts.index(part)))
            names = [n for n, s in specs.items() if s.family == family]
            out = F.when(F.col("ajuste").isin(names), blend(family, at)[i]).otherwise(out)
        return out

    return scored.select(*kept, *[value(i).alias(f"p{i}") for i in range(3)])
