"""Findings: one claim about one asset. Attribution, validation, joins to the answer key, risk roll-ups and the verdict.

Columns of a finding that are used here: asset_ref, asset_type, attack_class, detector_id, score, disposition, reason,
unavailable_reason (null for a finding that was made).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.grading import severity_for, verdict_band

# Fixed values of the output contract.
ASSET_TYPES = ("sample", "contributor", "model", "receipt", "dataset", "custody")
CATEGORIES = (
    ("Trigger / pattern risk", ("badnets_patch", "blended_trigger")),
    ("Label anomaly risk", ("label_flip", "systematic_mislabel")),
    ("Duplicate / near-duplicate risk", ("near_duplicate_flood",)),
    ("OOD / distribution risk", ("ood_insertion",)),
)
CHECKS = (
    ("badnets_patch", ("trigger_freq", "spectral_signature")),
    ("blended_trigger", ("trigger_freq", "spectral_signature")),
    ("label_flip", ("label_noise",)),
    ("systematic_mislabel", ("label_noise", "contributor")),
    ("near_duplicate_flood", ("near_duplicate",)),
    ("ood_insertion", ("ood",)),
    ("model_substitute", ("fingerprint", "weight_digest")),
    ("model_perturb", ("weight_digest", "weight_stats")),
    ("model_backdoor", ("trigger_recon", "weight_stats")),
    ("receipt_alter", ("provenance.verify",)),
    ("receipt_replay", ("provenance.verify",)),
    ("receipt_delete", ("provenance.verify",)),
    ("receipt_reorder", ("provenance.verify",)),
    ("distribution_shift", ("shift",)),
)
JARGON = (
    "anomalous embedding", "mahalanobis", "latent space", "penultimate activation", "eigenvector", "l2 norm", "kurtosis", "z-score",
    "logit", "softmax", "p-value", "cosine similarity", "hamming distance", "outlier score", "feature vector",
)
IDENTITY = ("fingerprint", "weight_digest")


def attach_contributors(samples: DataFrame, explicit: DataFrame, pattern: str, path: str, key: str = "sample_id", own: str = "contributor_id") -> DataFrame:
    """samples with the contributor that a map (key, contributor) names, else the pattern's match in the path, else their own.

    The match is the pattern's first group if it has one. A map with several rows of one key counts the smallest.
    """
    import re

    group = 1 if re.compile(pattern).groups else 0
    m = explicit.groupBy(key).agg(F.min("contributor").alias("_m"))
    found = F.nullif(F.regexp_extract(F.col(path), pattern, group), F.lit(""))
    return samples.join(m, key, "left").withColumn(own, F.coalesce("_m", found, own)).drop("_m")


def violations(score: Column, reason: Column, unavailable: Column, asset_type: Column) -> Column:
    """The rules that a finding breaks, as an array of names."""
    low = F.lower(reason)
    jargon = F.lit(False)
    for word in JARGON:
        jargon = jargon | F.contains(low, F.lit(word))
    rules = {
        "score_range": score.isNull() | F.isnan(score) | (score < 0) | (score > 1),
        "empty_reason": reason.isNull() | (F.trim(reason) == ""),
        "long_reason": F.length(F.trim(reason)) > 400,
        "jargon": jargon,
        "no_number": ~F.rlike(F.coalesce(reason, F.lit("")), F.lit(r"\d")) & unavailable.isNull(),
        "asset_type": asset_type.isNull() | ~asset_type.isin(*ASSET_TYPES),
    }
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))


def unmatched(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """(asset_ref): samples that findings name and the answer key doesn't hold."""
    refs = findings.where("asset_type = 'sample'").select("asset_ref").distinct()
    return refs.join(truth.select(F.col("sample_id").alias("asset_ref")), "asset_ref", "left_anti")


def score_truth(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """truth with score: the highest of a sample's findings; silence is 0."""
    made = findings.where("asset_type = 'sample' and unavailable_reason is null")
    best = made.groupBy(F.col("asset_ref").alias("sample_id")).agg(F.max("score").alias("score"))
    return truth.join(best, "sample_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def category_risk(findings: DataFrame) -> DataFrame:
    """(category, n_checked, n_flagged, level, status); categories with no findings stay, at zero."""
    rows = [(name, attack) for name, attacks in CATEGORIES for attack in attacks]
    kinds = findings.sparkSession.createDataFrame(rows, "category string, attack_class string")
    # grouped by attack class first: a few rows meet the table of categories
    f = findings.where("asset_type = 'sample' and unavailable_reason is null").groupBy("attack_class").agg(
        F.count("*").alias("n"), F.count_if(F.col("disposition") != "accept").alias("f"), F.count_if(F.col("disposition") == "quarantine").alias("q"), F.max("score").alias("top"),
    )
    g = kinds.join(f, "attack_class", "left").groupBy("category").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "nfq"), F.coalesce(F.max("top"), F.lit(0.0)).alias("top"))
    status = F.when(F.col("q") > 0, "quarantine").when(F.col("f") > 0, "review").otherwise("accept")
    return g.select("category", F.col("n").alias("n_checked"), F.col("f").alias("n_flagged"), severity_for(F.col("top")).alias("level"), status.alias("status"))


def coverage(findings: DataFrame, measured: DataFrame) -> DataFrame:
    """(attack_class, detector_id, n_made, tpr, status) of each attack class and its checks. measured: (attack_class, tpr).

    A check that made no finding is unsupported; one that did is graded by its measured rate, if there is one.
    """
    rows = [(attack, check) for attack, checks in CHECKS for check in checks]
    kinds = findings.sparkSession.createDataFrame(rows, "attack_class string, detector_id string")
    made = findings.where("unavailable_reason is null").groupBy("detector_id").agg(F.count("*").alias("n"))
    t = kinds.join(made, "detector_id", "left").join(measured, "attack_class", "left")
    n = F.coalesce("n", F.lit(0))
    return t.select("attack_class", "detector_id", n.alias("n_made"), "tpr", F.when(n == 0, "unsupported").otherwise(verdict_band(F.col("tpr"))).alias("status"))


def overall_verdict(findings: DataFrame) -> DataFrame:
    """(verdict, n_quarantine, n_review, model): red if anything is quarantined; amber if anything is to be reviewed or a
    model was looked at but no identity check ran; else green."""
    model, made = F.col("asset_type") == "model", F.col("unavailable_reason").isNull()
    worst = lambda d: made & (F.col("disposition") == d)
    t = findings.agg(
        F.count_if(worst("quarantine")).alias("n_quarantine"), F.count_if(worst("review")).alias("n_review"), F.count_if(model).alias("m"), F.count_if(model & worst("quarantine")).alias("mq"),
        F.count_if(model & worst("review")).alias("mr"), F.count_if(model & made & F.col("detector_id").isin(*IDENTITY)).alias("mi"),
    )
    state = F.when(F.col("m") == 0, "none").when(F.col("mq") > 0, "edited").when(F.col("mr") > 0, "review").when(F.col("mi") > 0, "verified").otherwise("not verified")
    verdict = F.when(F.col("n_quarantine") > 0, "red").when((F.col("n_review") > 0) | (state == "not verified"), "amber").otherwise("green")
    return t.select(verdict.alias("verdict"), "n_quarantine", "n_review", state.alias("model"))


def split(df: DataFrame, key: str, fit: float = 0.4, calibrate: float = 0.3, seed: str = "split") -> DataFrame:
    """df with split: fit, calibrate or test by a seeded hash of the key. No shuffle, and new rows move no old ones."""
    u = F.conv(F.substr(F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string"))), F.lit(1), F.lit(8)), 16, 10).cast("double") / 2.0**32
    return df.withColumn("split", F.when(u < fit, "fit").when(u < fit + calibrate, "calibrate").otherwise("test"))


def split_leakage(splits: DataFrame, key: str) -> DataFrame:
    """(key, n_splits) of keys that are in more than one split."""
    return splits.groupBy(key).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def spread(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, sd, low, median, high) of measurements by group; the deviation of one is null."""
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.percentile(value, 0.5).alias("median"), F.max(value).alias("high"))
