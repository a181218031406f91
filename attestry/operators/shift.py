"""Distribution shift: two-sample statistics, correction, attribution and classification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.operators.ordered import ranged, running, smallest_from_here
from attestry.session import stored


def ks_statistic(rows: DataFrame) -> DataFrame:
    """(measure, d, effect, n_reference, n_observed) of rows (measure, observed boolean, value).

    Values are counted before they are ordered, and sums run range by range over (measure, value): a few measures are no few tasks.
    """
    c = rows.groupBy("measure", "value").agg(F.count_if(~F.col("observed")).alias("r"), F.count_if(F.col("observed")).alias("o"))
    # one row a measure: its number, its totals, and those of the measures before it
    whole = c.groupBy("measure").agg(F.sum("r").alias("nr"), F.sum("o").alias("no"))
    w = W.orderBy("measure").rowsBetween(W.unboundedPreceding, -1)
    whole = stored(whole.select("*", F.row_number().over(W.orderBy("measure")).alias("m"), *(F.coalesce(F.sum(x).over(w), F.lit(0)).alias(f"b{x}") for x in ("nr", "no"))), "measures")
    t = running(ranged(c.join(F.broadcast(whole), "measure"), "m", "value"), {"ur": "r", "uo": "o"}, ["m", "value"])
    gap = F.abs((F.col("ur") - F.col("bnr")) / F.col("nr") - (F.col("uo") - F.col("bno")) / F.col("no"))
    d = t.withColumn("gap", gap).groupBy("measure").agg(F.max("gap").alias("d"))
    when = lambda o: F.when(F.col("observed") == o, F.col("value"))
    m = rows.groupBy("measure").agg(F.avg(when(False)).alias("mr"), F.avg(when(True)).alias("mo"), F.var_pop(when(False)).alias("vr"), F.var_pop(when(True)).alias("vo"), F.count(when(False)).alias("n_reference"), F.count(when(True)).alias("n_observed"))
    spread = F.sqrt((F.col("vr") + F.col("vo")) / 2)
    effect = (F.col("mo") - F.col("mr")) / F.when(spread > 0, spread).otherwise(1.0)
    return d.join(m, "measure").where("n_reference >= 3 and n_observed >= 3").select("measure", "d", effect.alias("effect"), "n_reference", "n_observed")


#: Sample sizes up to whose product the distribution is counted exactly.
EXACT = 4_000_000


def _ks_tail(d: float, m: int, n: int) -> float:
    """P(D >= d) for two samples of m and n values without ties: the share of lattice paths that leave the band, or its limit."""
    import math

    import numpy as np

    if m * n > EXACT:
        x = d * math.sqrt(m * n / (m + n))
        return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.2 else 1.0
    m, n = sorted((m, n))
    limit, j = d - 1e-9 / (m * n), np.arange(n + 1)
    # share[j]: of the paths to (i, j), those inside the band so far; the last step came along j with chance j / (i + j)
    share = np.cumprod(j / n < limit).astype(float)
    for i in range(1, m + 1):
        inside = np.flatnonzero(np.abs(i / m - j / n) < limit)
        below, share = share * i / (i + j), np.zeros(n + 1)
        before = 0.0
        for k in inside:
            # the band has no gaps: the place before is in it, but for the first
            before = share[k] = below[k] + before * k / (i + k)
    return float(min(1.0, max(0.0, 1 - share[n])))


def with_p_value(tests: DataFrame) -> DataFrame:
    """Rows of ks_statistic with p: exact where the samples' sizes allow, else the limit distribution's."""
    @F.pandas_udf("double")
    def p(d: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_ks_tail(float(a), int(b), int(c)) for a, b, c in zip(d, m, n, strict=True)])

    return tests.withColumn("p", p("d", "n_reference", "n_observed"))


def benjamini_hochberg(tests: DataFrame, key: str, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """tests with p_adjusted and significant."""
    t = running(ranged(tests.withColumn("_one", F.lit(1)), p, key), {"_r": "_one"}, [p, key])
    n = tests.agg(F.count("*").alias("_n"))
    t = t.crossJoin(F.broadcast(n))
    t = smallest_from_here(t, F.least(F.lit(1.0), F.col(p) * F.col("_n") / F.col("_r")), [p, key], "p_adjusted")
    return t.withColumn("significant", F.col("p_adjusted") < alpha).drop("_one", "_r", "_n", "_b")


def attribution(effects: DataFrame) -> DataFrame:
    """(measure, share) of the physical causes that carry at least a hundredth of the shift."""
    w = effects.select("measure", F.abs("effect").alias("w"), F.sum(F.abs("effect")).over(W.partitionBy()).alias("total"))
    explained = F.least(F.lit(0.95), F.col("total") / (F.col("total") + 1.2))
    s = w.where("total > 0").select("measure", (explained * F.col("w") / F.col("total")).alias("share"))
    return s.where(F.col("share") >= 0.01).select("measure", F.round("share", 4).alias("share"))


def classify(total: Column, unexplained: Column, localised: Column, concentrated: Column) -> Column:
    odd = (localised & (unexplained > 0.25)) | (concentrated & (unexplained > 0.25)) | (unexplained > 0.45)
    return F.when(total < 0.05, "NO MEANINGFUL SHIFT").when(odd, "SUSPICIOUS").otherwise("DRIFT")
