"""Risk ratios, classes, scores and edge costs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CLASSES = ("bajo", "medio", "alto")
# Label cuts of the three label families.
HIGH_FROM_SHIFT = 3.0
HIGH_FROM_BUFFER = 2.3442396250791653
# Level cuts of a score.
MEDIUM_SCORE, HIGH_SCORE = 0.34, 0.66
# Penalties per metre inside the coloured zones, blend shares, speed.
RED_PENALTY, ORANGE_PENALTY = 200.0, 20.0
HISTORY_SHARE, FORECAST_SHARE = 0.70, 0.30
SPEED_KMH = 25.0


def length_factor(length_m: Column) -> Column:
    return F.greatest(length_m / 100.0, F.lit(1.0))


def risk_class(risk: Column, high_from: float | Column) -> Column:
    high = high_from if isinstance(high_from, Column) else F.lit(float(high_from))
    return F.when(risk >= high, 2).when(risk > 0, 1).otherwise(0).cast("int")


def risk_score(p_medium: Column, p_high: Column) -> Column:
    return F.least(F.greatest(p_medium * 0.5 + p_high, F.lit(0.0)), F.lit(1.0))


def level(score: Column) -> Column:
    return F.when(score >= HIGH_SCORE, "alto").when(score >= MEDIUM_SCORE, "medio").otherwise("bajo")


def decide(p_medium: Column, p_high: Column, medium_from: float | Column, high_from: float | Column) -> Column:
    """Class by two cutoffs; the high one has the last word."""
    return F.when(p_high >= high_from, 2).when(p_medium >= medium_from, 1).otherwise(0).cast("int")


def argmax3(a: Column, b: Column, c: Column) -> Column:
    """Index of the largest of three values, the first one on ties."""
    return F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2).cast("int")


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def safe_cost(distance: Column, risk: Column, beta: Column | float) -> Column:
    return distance * (F.lit(1.0) + (beta if isinstance(beta, Column) else F.lit(float(beta))) * risk)


def field_cost(distance: Column, mean: Column, red_m: Column, orange_m: Column, beta: Column | float) -> Column:
    return safe_cost(distance, mean, beta) + red_m * RED_PENALTY + orange_m * ORANGE_PENALTY


def hotspot_cost(distance: Column, risk: Column, levels: Column) -> Column:
    excess = F.greatest((risk - HIGH_SCORE) / 0.34, F.lit(0.0))
    return distance * (risk + excess * excess * 2.0 + F.when(levels == "alto", 0.25).otherwise(0.0))


def travel_minutes(distance_m: Column) -> Column:
    return distance_m / F.lit(SPEED_KMH * 1000 / 60)


def risk_reduction(fast: Column, safe: Column) -> Column:
    """Percent of exposure saved, never negative."""
    saved = F.round(F.greatest((fast - safe) / fast * 100, F.lit(0.0)), 2)
    return F.when(fast <= 1e-12, F.lit(0.0)).otherwise(saved)
