"""Intervals, calibration and permutation tests: what SQL can't say, over aggregates of all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from attestry.operators.metrics import finite
from attestry.session import stored


def _beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(Beta(a, b) <= x) by Lentz's continued fraction."""
    from math import lgamma

    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    x = np.clip(x, 1e-300, 1)
    log = np.vectorize(lgamma)
    front = np.exp(log(a + b) - log(a) - log(b) + a * np.log(x) + b * np.log1p(-np.minimum(x, 1 - 1e-16))) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
    return np.where(flip, 1 - front * h, front * h)


def beta_quantile(q: float):
    """A vectorised function of (k, n): the q-quantile of Beta(1 + k, 1 + n - k), by bisection."""

    @pandas_udf("double")
    def run(k: pd.Series, n: pd.Series) -> pd.Series:
        a, b = 1.0 + k.to_numpy(float), 1.0 + np.maximum(n.to_numpy(float) - k.to_numpy(float), 0)
        lo, hi = np.zeros(len(a)), np.ones(len(a))
        for _ in range(60):
            mid = (lo + hi) / 2
            under = _beta_tail(a, b, mid) < q
            lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
        return pd.Series((lo + hi) / 2)

    return run


def p_rate_above(k: Column, n: Column, threshold: float = 0.05) -> Column:
    """P(rate > threshold) under Beta(1 + k, 1 + n - k), whatever the size of k."""

    @pandas_udf("double")
    def run(k: pd.Series, n: pd.Series) -> pd.Series:
        a, b = 1.0 + k.to_numpy(float), 1.0 + np.maximum(n.to_numpy(float) - k.to_numpy(float), 0)
        return pd.Series(np.clip(1 - _beta_tail(a, b, np.full(len(a), threshold)), 0, 1))

    return run(k, n)


def credible_interval(k: Column, n: Column) -> tuple[Column, Column]:
    return beta_quantile(0.025)(k, n), beta_quantile(0.975)(k, n)


def auroc_interval(df: DataFrame, draws: int = 200, seed: int = 0) -> DataFrame:
    """(low, high, n_draws): the middle 95 % of the AUROC over Poisson resamples of (y, score), stratified by class.

    Resampled counts are drawn per distinct score, after a map-side combine, in one pass for all draws; each draw
    is then ranked on its own, so no task sees more than one draw's distinct scores.
    """
    g = finite(df).groupBy("score").agg(F.sum(F.col("y").cast("long")).alias("p"), F.sum(1 - F.col("y").cast("long")).alias("q"))

    @pandas_udf("array<struct<p:long,q:long>>")
    def draw(score: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        out = []
        for s, a, b in zip(score, p, q, strict=True):
            rng = np.random.default_rng((seed, int(np.float64(s + 0.0).view(np.uint64))))
            out.append([{"p": int(x), "q": int(y)} for x, y in zip(rng.poisson(a, draws), rng.poisson(b, draws), strict=True)])
        return pd.Series(out)

    # drawn counts depend on the score alone, so a lost task draws them again alike
    d = g.select("score", F.posexplode(draw("score", "p", "q")).alias("draw", "c")).select("draw", "score", "c.p", "c.q").where("p + q > 0")
    below = F.sum("q").over(W.partitionBy("draw").orderBy("score").rowsBetween(W.unboundedPreceding, 0)) - F.col("q") / 2
    one = d.withColumn("u", F.col("p") * below).groupBy("draw").agg((F.sum("u") / (F.sum("p") * F.sum("q"))).alias("a")).where("a is not null")
    n = F.count("*")
    pick = lambda x: F.when(n >= 10, F.percentile("a", x)).otherwise(float("nan"))
    return one.agg(pick(0.025).alias("low"), pick(0.975).alias("high"), n.alias("n_draws"))


def isotonic(train: DataFrame, df: DataFrame) -> DataFrame:
    """df (score) with calibrated: an increasing fit of train (y, score), clipped to 0 and 1; the clipped score if train has
    under 8 rows or one class."""
    from pyspark.ml.regression import IsotonicRegression

    d = finite(train).select(F.col("y").cast("double").alias("label"), F.col("score").cast("double").alias("features"))
    n, low, high = d.agg(F.count("*"), F.min("label"), F.max("label")).first()
    if n < 8 or low == high:
        return df.withColumn("calibrated", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))))
    model = IsotonicRegression(weightCol="w").fit(d.groupBy("features").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("w")))
    out = model.transform(df.withColumn("features", F.col("score").cast("double"))).drop("features")
    return out.withColumn("calibrated", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction")))).drop("prediction")


def projections(samples: DataFrame, id_col: str, label: str, vector: str, least: int = 16) -> DataFrame:
    """(id, label, projection): distance along the main direction of each class of at least ``least`` rows.

    Each task sums its rows' outer products by class; what is shuffled is one matrix per task and class, whatever the
    class's size, and a class's direction joins its rows.
    """
    rows = samples.select(F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v"))

    def partial(batches):
        sums: dict = {}
        for b in batches:
            for name, g in b.groupby("label"):
                x = np.array(g["v"].tolist())
                n, s, c = sums.get(name, (0, 0, 0))
                sums[name] = (n + len(x), s + x.sum(axis=0), c + x.T @ x)
        yield pd.DataFrame([(k, n, s.tolist(), c.ravel().tolist()) for k, (n, s, c) in sums.items()], columns=["label", "n", "s", "c"])

    def direction(g: pd.DataFrame) -> pd.DataFrame:
        n, s = int(g["n"].sum()), np.sum(g["s"].tolist(), axis=0)
        c = np.sum(g["c"].tolist(), axis=0).reshape(len(s), len(s)) - np.outer(s, s) / n
        return pd.DataFrame([(g["label"].iloc[0], n, (s / n).tolist(), np.linalg.eigh(c)[1][:, -1].tolist())], columns=["label", "n", "mean", "axis"])

    parts = rows.where("label is not null and v is not null").select("label", "v").mapInPandas(partial, "label string, n long, s array<double>, c array<double>")
    axes = stored(parts.groupBy("label").applyInPandas(direction, "label string, n long, mean array<double>, axis array<double>").where(F.col("n") >= least), "axes")
    along = F.aggregate(F.zip_with(F.zip_with("v", "mean", lambda a, b: a - b), "axis", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.join(axes, "label").select("id", "label", F.abs(along).alias("projection"))


def mmd(reference: np.ndarray, observed: np.ndarray, permutations: int = 200, seed: int = 0) -> tuple[float, float]:
    """(distance, p) of two samples of vectors, of a few hundred rows each by the operator's definition."""
    x = np.concatenate((reference, observed)).astype(float)
    sq = np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), 0)
    k = np.exp(-sq / max(float(np.median(np.sqrt(sq))), 1e-9))
    n = len(reference)

    def value(order):
        a, b = order[:n], order[n:]
        return k[np.ix_(a, a)].mean() + k[np.ix_(b, b)].mean() - 2 * k[np.ix_(a, b)].mean()

    own, rng = value(np.arange(len(x))), np.random.default_rng(seed)
    more = sum(value(rng.permutation(len(x))) >= own for _ in range(permutations))
    return float(max(own, 0.0)), (more + 1) / (permutations + 1)
