"""Evidence rolled up to contributors and batches. Every sample counts once, however many checks flagged it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.grading import risk_disposition
from attestry.operators.ordered import ranged, running
from attestry.operators.resampling import p_rate_above
from attestry.session import stored


def group_risk(samples: DataFrame, flagged: DataFrame, group: str, sample: str = "sample_id") -> DataFrame:
    """(group, n, n_flagged, rate, p_above, disposition). samples: (sample, group); flagged: (sample)."""
    s = samples.where(F.col(group).isNotNull()).select(sample, group).distinct()
    f = flagged.select(sample).distinct().withColumn("_f", F.lit(1))
    g = s.join(f, sample, "left").groupBy(group).agg(F.count("*").alias("n"), F.count("_f").alias("n_flagged"))
    g = g.withColumn("rate", F.col("n_flagged") / F.col("n")).withColumn("p_above", p_rate_above(F.col("n_flagged"), F.col("n")))
    return g.withColumn("disposition", risk_disposition(F.col("p_above"), F.col("n")))


def leave_one_out(risk: DataFrame, group: str) -> DataFrame:
    """Each group's rate beside the largest and the median of all other groups' rates, 0 where there are none.

    Leaving one of the ranked rates out moves the median by one rank at most: of all rates only the largest two and the three about
    the middle are needed, and each group needs no more than its own rank. Groups never meet in pairs, nor in one row.
    """
    one = risk.select(group, "rate").withColumn("_one", F.lit(1).cast("long")).withColumn("_key", F.xxhash64(F.col(group)))
    ranked = stored(running(ranged(one, "rate", "_key"), {"_r": "_one"}, ["rate", "_key"]).select(group, "rate", "_r"), "ranks")
    n = ranked.count()
    # ranks of the others' median, without the group at rank r: those above it move down by one
    low, high = (n - 2) // 2 + 1, (n - 1) // 2 + 1
    wanted = sorted({r for r in (low, low + 1, high, high + 1, n - 1, n) if 1 <= r <= n})
    at = {r["_r"]: r["rate"] for r in ranked.where(F.col("_r").isin(wanted)).collect()}  # six rows at most
    rate = lambda rank: F.lit(float(at.get(rank, 0.0)))
    without = lambda rank: F.when(F.col("_r") <= rank, rate(rank + 1)).otherwise(rate(rank))
    if n < 2:
        return ranked.select(group, "rate", F.lit(0.0).alias("others_max"), F.lit(0.0).alias("others_median"))
    return ranked.select(group, "rate", F.when(F.col("_r") == n, rate(n - 1)).otherwise(rate(n)).alias("others_max"), ((without(low) + without(high)) / 2).alias("others_median"))


def worst_disposition(findings: DataFrame, key: str, disposition: str = "disposition") -> DataFrame:
    order = F.array(F.lit("accept"), F.lit("review"), F.lit("quarantine"))
    return findings.groupBy(key).agg(F.max(F.array_position(order, F.col(disposition))).alias("w")).select(key, F.element_at(order, F.col("w").cast("int")).alias(disposition))


def modal(rows: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """Each group's most frequent value; on a tie the one that came first. Two aggregations, no window."""
    c = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return c.groupBy(group).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first"))).alias("m")).select(group, F.col(f"m.{value}").alias(value), F.col("m.n").alias("n"))
