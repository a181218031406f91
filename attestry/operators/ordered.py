"""Running sums over a total order, without one partition that sees all rows.

The order is cut at quantiles of its value, so a range holds a bounded share of the rows; a value so frequent that it
is itself a cut has ranges of its own, cut at quantiles of the key. Totals by range, a fixed number of rows, are summed first; rows then
need only those before them in their own range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 128


def ranged(df: DataFrame, value: str, key: str | None = None, ranges: int = RANGES) -> DataFrame:
    """df with _b, a struct that numbers the ranges in the order of (value, key), both ascending and numeric."""
    q = [i / ranges for i in range(1, ranges)]
    columns = [value] + ([key] if key else [])
    cuts = df.agg(*(F.percentile_approx(F.col(c).cast("double"), q, 10_000).alias(c) for c in columns)).first()
    below = lambda c: F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts[c])))), lambda x: x < F.col(c).cast("double")))
    if not cuts[value]:
        return df.withColumn("_b", F.struct(F.lit(0).alias("v"), F.lit(False).alias("one"), F.lit(0).alias("k")))
    one = F.col(value).cast("double").isin(sorted(set(cuts[value])))
    k = F.when(one, below(key)).otherwise(0) if key else F.lit(0)
    # a cut's own rows come after the smaller ones that count the same cuts below them
    return df.withColumn("_b", F.struct(below(value).alias("v"), one.alias("one"), k.alias("k")))


def running(df: DataFrame, sums: dict[str, str], order: list[str]) -> DataFrame:
    """df (with _b) and, under each name, the sum of that column over the rows up to and including this one."""
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy("_b").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    base = totals.select("_b", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    w = W.partitionBy("_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # one row a range: the broadcast side has a fixed bound
    return df.join(F.broadcast(base), "_b").select("*", *((F.col(f"_{n}") + F.sum(c).over(w)).alias(n) for n, c in sums.items())).drop(*(f"_{n}" for n in sums))


def smallest_from_here(df: DataFrame, value: Column, order: list[str], name: str) -> DataFrame:
    """df (with _b) and the least of value over this row and all that follow."""
    after = W.orderBy("_b").rowsBetween(1, W.unboundedFollowing)
    df = df.withColumn("_x", value)
    rest = df.groupBy("_b").agg(F.min("_x").alias("_m")).select("_b", F.min("_m").over(after).alias("_m"))
    w = W.partitionBy("_b").orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    return df.join(F.broadcast(rest), "_b").withColumn(name, F.least(F.min("_x").over(w), "_m")).drop("_x", "_m")
