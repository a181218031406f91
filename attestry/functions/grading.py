"""Scores to grades, and the score shapes that checks share. The cut-offs are fixed values of the output contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITY_CUTS = ((0.90, "critical"), (0.70, "high"), (0.45, "medium"))
DISPOSITION_CUTS = ((0.80, "quarantine"), (0.50, "review"))
VERDICT_CUTS = ((0.80, "strong"), (0.60, "good"), (0.35, "partial"))


def _steps(score: Column, cuts, last: str) -> Column:
    out = F.lit(last)
    for cut, name in reversed(cuts):
        out = F.when(score >= cut, name).otherwise(out)
    return out


def severity_for(score: Column) -> Column:
    return _steps(score, SEVERITY_CUTS, "low")


def disposition_for(score: Column) -> Column:
    return _steps(score, DISPOSITION_CUTS, "accept")


def verdict_band(rate: Column) -> Column:
    """NaN, infinite and null rates are not measured. Spark orders NaN above all numbers, so it is asked first."""
    measured = rate.isNotNull() & ~F.isnan(rate) & (F.abs(rate) < float("inf"))
    return F.when(~measured | rate.isNull(), "not measured").otherwise(_steps(rate, VERDICT_CUTS, "unsupported"))


def bounded(value: Column, midpoint: float, sharpness: float = 2.0) -> Column:
    """0 to 1, a half at midpoint; negative values count as 0."""
    v = F.pow(F.greatest(value, F.lit(0.0)), F.lit(sharpness))
    return v / (F.lit(midpoint**sharpness) + v)


def squash(value: Column, midpoint: float = 0.0, scale: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-(value - midpoint) / scale))


def duplicate_score(size: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(0.97), 0.55 + 0.05 * (size - 3)))


def risk_disposition(p_above: Column, n: Column) -> Column:
    return F.when((p_above > 0.9) & (n >= 30), "quarantine").when(p_above > 0.6, "review").otherwise("accept")


def p_rate_above(k: Column, n: Column, threshold: float = 0.05) -> Column:
    """P(rate > threshold) under Beta(1 + k, 1 + n - k): the binomial tail P(Bin(n + 1, threshold) <= k), in logs."""
    import math

    q, step = math.log(1 - threshold), math.log(threshold / (1 - threshold))
    start = F.struct(((n + 1) * F.lit(q)).cast("double").alias("l"), F.exp((n + 1) * F.lit(q)).cast("double").alias("s"))

    def add(acc, j):
        term = acc["l"] + F.log((n + 2 - j) / j) + F.lit(step)
        return F.struct(term.alias("l"), (acc["s"] + F.exp(term)).alias("s"))

    js = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.aggregate(js, start, add, lambda a: a["s"]))
