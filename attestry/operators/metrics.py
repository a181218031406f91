"""Detection metrics over (y int, score double). Rows with a score that isn't finite are left out of all of them.

Ranks come from counts by distinct score, after a map-side combine; running sums go range by range, in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators.ordered import ranged, running

NAN = float("nan")
#: Bin edges as floating-point multiples of a tenth that a linear spacing gives.
EDGES = tuple(i * 0.1 for i in range(11))


def finite(df: DataFrame) -> DataFrame:
    return df.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))).select(*df.columns)


def _by_score(df: DataFrame) -> DataFrame:
    return finite(df).groupBy("score").agg(F.sum(F.col("y").cast("long")).alias("p"), F.sum(1 - F.col("y").cast("long")).alias("q"))


def auroc(df: DataFrame) -> DataFrame:
    """(auroc): Mann-Whitney with ties at half; NaN if a class is missing."""
    t = running(ranged(_by_score(df), "score"), {"upto": "q"}, ["score"])
    t = t.withColumn("u", F.col("p") * (F.col("upto") - F.col("q") / 2)).agg(F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return t.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p") * F.col("q"))).otherwise(NAN).alias("auroc"))


def roc_points(df: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score, from the highest, after (infinity, 0, 0); the diagonal if a class is missing."""
    g = _by_score(df).withColumn("_down", -F.col("score"))
    whole = g.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    t = running(ranged(g, "_down"), {"tp": "p", "fp": "q"}, ["_down"]).crossJoin(F.broadcast(whole))
    t = t.where("np > 0 and nq > 0").select(F.col("score").alias("threshold"), (F.col("fp") / F.col("nq")).alias("fpr"), (F.col("tp") / F.col("np")).alias("tpr"))
    start = df.sparkSession.sql("select double('infinity') threshold, 0D fpr, 0D tpr")
    end = whole.where("coalesce(np, 0) = 0 or coalesce(nq, 0) = 0").selectExpr("-double('infinity') as threshold", "1D as fpr", "1D as tpr")
    return start.unionByName(t).unionByName(end)


def tpr_at_fpr(df: DataFrame, at: float = 0.01) -> DataFrame:
    """(tpr): linear between the ROC points around at; of points with the same fpr the last counts."""
    point = F.struct("fpr", "tpr")
    both = roc_points(df).agg(F.max(F.when(F.col("fpr") <= at, point)).alias("lo"), F.min(F.when(F.col("fpr") > at, point)).alias("hi"))
    part = (F.lit(at) - F.col("lo.fpr")) / (F.col("hi.fpr") - F.col("lo.fpr"))
    return both.select(F.coalesce(F.col("lo.tpr") + part * (F.col("hi.tpr") - F.col("lo.tpr")), "lo.tpr").alias("tpr"))


def average_precision(df: DataFrame, key: str) -> DataFrame:
    """(average_precision): mean precision at each positive, by score descending and then key, a number."""
    d = finite(df).select("y", key, (-F.col("score")).alias("_down"), F.lit(1).alias("_one"))
    t = running(ranged(d, "_down", key), {"r": "_one", "tp": "y"}, ["_down", key])
    return t.where("y = 1").agg(F.coalesce(F.avg(F.col("tp") / F.col("r")), F.lit(NAN)).alias("average_precision"))


def precision_recall_at(df: DataFrame, key: str, k: int) -> DataFrame:
    d = finite(df)
    top = d.orderBy(F.desc("score"), key).limit(k).agg(F.sum("y").alias("hit"), F.count("*").alias("n"))
    return top.crossJoin(d.agg(F.sum("y").alias("p"))).select((F.col("hit") / F.col("n")).alias("precision"), (F.col("hit") / F.col("p")).alias("recall"))


def reliability_bins(df: DataFrame) -> DataFrame:
    """(bin, n, mean_score, rate) of ten bins, closed on the left, 1 in the last."""
    b = F.lit(0)
    for i in range(1, 10):
        b = F.when(F.col("score") >= EDGES[i], i).otherwise(b)
    return finite(df).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("rate"))


def ece(df: DataFrame) -> DataFrame:
    b = reliability_bins(df)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))


def brier(df: DataFrame) -> DataFrame:
    return finite(df).agg(F.avg(F.pow(F.col("score") - F.col("y"), F.lit(2.0))).alias("brier"))


def disposition_confusion(truth: DataFrame, worst: DataFrame, key: str) -> DataFrame:
    """(y, accept, review, quarantine): samples that no check mentions count as accepted."""
    t = truth.join(worst, key, "left").withColumn("disposition", F.coalesce("disposition", F.lit("accept")))
    return t.groupBy("y").agg(*(F.count_if(F.col("disposition") == d).alias(d) for d in ("accept", "review", "quarantine")))
