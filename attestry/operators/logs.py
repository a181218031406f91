"""Verification of append-only, hash-linked logs with windows.

Every check needs only stored neighbours, so a log is verified in parallel: chains are cut into ranges of lines, and each range takes up the
last hash, highest number and latest time of those before it, a row for each range. A chain that holds all lines is no single task. Rows:
(chain, idx, seq, prev_hash, record_hash, nonce, ts) where idx is the line. Malformed rows (null in any of these) are reported and otherwise
passed over: the next good row links to the last good one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.operators.ordered import ranged

GENESIS = "0" * 64
MALFORMED, CHAIN, REPLAY, GAP, NONCE, TIME = "MALFORMED", "CHAIN_BROKEN", "SEQUENCE_REPLAY", "SEQUENCE_GAP", "NONCE_REUSE", "TIMESTAMP_REGRESSION"
FIELDS = ("seq", "prev_hash", "record_hash", "nonce", "ts")


def well_formed() -> Column:
    ok = F.lit(True)
    for c in FIELDS:
        ok = ok & F.col(c).isNotNull()
    return ok


DETAIL = ("earlier", "missing_from", "missing_to")


def verify_log_detail(log: DataFrame, content_hash: Column | None = None) -> DataFrame:
    """(chain, idx, seq, code, earlier, missing_from, missing_to): one row per failure; a line may have several.

    earlier is the latest line before that used the number, or the first that used the nonce; missing_from and missing_to are the first and
    last number that a gap leaves out. content_hash is a record's digest computed from its content: links must then name that digest, so a
    record edited under an unchanged record_hash breaks the next link. Without it the stored hashes are compared.
    """
    ok = well_formed()
    none = [F.lit(None).cast("long").alias(c) for c in DETAIL]
    log = log.withColumn("_own", F.coalesce(content_hash, "record_hash") if content_hash is not None else F.col("record_hash"))
    bad = log.where(~ok).select("chain", "idx", "seq", F.lit(MALFORMED).alias("code"), *none)
    good = ranged(log.where(ok), "idx")
    ends = good.groupBy("chain", "_b").agg(F.max_by("_own", "idx").alias("l"), F.max("seq").alias("s"), F.max("ts").alias("t"))
    past = W.partitionBy("chain").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("chain", "_b", F.last("l").over(past).alias("_l"), F.max("s").over(past).alias("_s"), F.max("t").over(past).alias("_t"))
    w = W.partitionBy("chain", "_b").orderBy("idx")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    g = good.join(ends, ["chain", "_b"]).select(
        "*", F.coalesce(F.lag("_own").over(w), "_l", F.lit(GENESIS)).alias("expected"), F.greatest(F.max("seq").over(before), "_s").alias("top"), F.greatest(F.max("ts").over(before), "_t").alias("latest"),
        F.lag("idx").over(W.partitionBy("chain", "seq").orderBy("idx")).alias("used"), F.min("idx").over(W.partitionBy("chain", "nonce")).alias("nonce_at"),
    )
    order = F.when(F.col("used").isNotNull() | (F.col("seq") < F.col("top")), REPLAY).when(F.col("seq") > F.col("top") + 1, GAP)
    codes = F.array_compact(F.array(F.when(F.col("prev_hash") != F.col("expected"), CHAIN), order, F.when(F.col("nonce_at") < F.col("idx"), NONCE), F.when(F.col("ts") < F.col("latest"), TIME)))
    f = g.select("chain", "idx", "seq", "used", "nonce_at", "top", F.explode(codes).alias("code"))
    earlier = F.when(F.col("code") == REPLAY, F.col("used")).when(F.col("code") == NONCE, F.col("nonce_at"))
    gap = lambda c: F.when(F.col("code") == GAP, c).cast("long")
    return bad.unionByName(f.select("chain", "idx", "seq", "code", earlier.cast("long").alias("earlier"), gap(F.col("top") + 1).alias("missing_from"), gap(F.col("seq") - 1).alias("missing_to")))


def verify_log(log: DataFrame, content_hash: Column | None = None) -> DataFrame:
    """(chain, idx, seq, code): one row per failure; a line may have several."""
    return verify_log_detail(log, content_hash).drop(*DETAIL)


def summary(log: DataFrame) -> DataFrame:
    """(chain, total, n_failures, first_bad, n_verified): verified are the lines before the first failure."""
    f = verify_log(log).groupBy("chain").agg(F.count("*").alias("n_failures"), F.min("idx").alias("first_bad"))
    # lines are counted, not numbers subtracted: line numbers needn't be dense
    t = log.select("chain", "idx").join(f, "chain", "left").groupBy("chain").agg(
        F.count("*").alias("total"), F.coalesce(F.first("n_failures"), F.lit(0)).alias("n_failures"), F.first("first_bad").alias("first_bad"),
        F.count_if(F.col("first_bad").isNull() | (F.col("idx") < F.col("first_bad"))).alias("n_verified"),
    )
    return t


def verify_handoffs(chain: DataFrame) -> DataFrame:
    """(chain, hop): hops whose input isn't the output of the hop before; the first must start from GENESIS."""
    w = W.partitionBy("chain").orderBy("hop")
    return chain.withColumn("expected", F.lag("output_digest", 1, GENESIS).over(w)).where(F.col("input_digest") != F.col("expected")).select("chain", "hop")
