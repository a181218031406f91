"""Findings against an answer key: splits, calibration, and the tables of a measurement.

truth: sample_id, is_poisoned (0/1), attack_class, contributor_id. Everything is one plan over all rows; a table has a row for each attack,
contributor or check, and only tables are brought to the driver, for CSV and Markdown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.grading import risk_disposition, verdict_band
from attestry.operators import findings as fd
from attestry.operators import metrics, resampling
from attestry.operators.ordered import ranged, running
from attestry.session import stored

FRACTIONS = (0.4, 0.3, 0.3)
#: The checks that are meant to find each attack on samples.
PRIMARY = {a: checks for a, checks in fd.CHECKS}


def stratified_split(df: DataFrame, key: str, by: str | None = None, fractions: tuple[float, float, float] = FRACTIONS, seed: str = "split") -> DataFrame:
    """df with split: fit, calibrate or test, in these shares of each stratum, by the order of a seeded hash of the key.

    Ranks are taken range by range, so a stratum that holds most rows is no single task.
    """
    if abs(sum(fractions) - 1) > 1e-9:
        raise ValueError(f"fractions must sum to 1, got {fractions}")
    u = F.conv(F.substr(F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string"))), F.lit(1), F.lit(13)), 16, 10).cast("long")
    s = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    d = df.withColumns({"_u": u, "_s": s, "_one": F.lit(1).cast("long")})
    strata = {r["_s"]: r["n"] for r in d.groupBy("_s").agg(F.count("*").alias("n")).collect()}  # one row a stratum
    parts = []
    for name, n in sorted(strata.items()):
        one = d.where(F.col("_s") == name)
        r = running(ranged(one, "_u"), {"_r": "_one"}, ["_u", key])
        fit, cal = int(fractions[0] * n + 0.5), int(fractions[1] * n + 0.5)
        parts.append(r.withColumn("split", F.when(F.col("_r") <= fit, "fit").when(F.col("_r") <= fit + cal, "calibrate").otherwise("test")).select(*df.columns, "split"))
    if not parts:
        return df.withColumn("split", F.lit("test"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scores(findings: DataFrame, truth: DataFrame, attack: str | None = None, detector: str | None = None, tier: int | None = None) -> DataFrame:
    """(sample_id, y, score): the highest score of each sample, 0 for silence. With an attack, its samples and all clean ones."""
    f = findings
    if detector is not None:
        f = f.where(F.col("detector_id") == detector)
    if tier is not None:
        f = f.where(F.col("access_tier") <= tier)
    t = truth.select("sample_id", F.col("is_poisoned").cast("int").alias("y"), "attack_class")
    if attack is not None:
        t = t.where((F.col("y") == 0) | (F.col("attack_class") == attack))
    best = F.coalesce("calibrated_score", "score")
    return fd.score_truth(f.withColumn("score", best), t).select("sample_id", "y", "score")


def calibrate_findings(findings: DataFrame, truth: DataFrame, splits: DataFrame) -> DataFrame:
    """findings with calibrated_score: one increasing curve for each detector, fitted on the calibration split; rows that say why a
    check didn't run stay as they are."""
    made = findings.where("unavailable_reason is null").drop("calibrated_score")
    t = truth.select(F.col("sample_id").alias("asset_ref"), F.col("is_poisoned").cast("int").alias("y"))
    train = made.where("asset_type = 'sample'").join(t, "asset_ref").join(splits.where("split = 'calibrate'").select(F.col("sample_id").alias("asset_ref")), "asset_ref")
    out = findings.where("unavailable_reason is not null")
    for r in made.select("detector_id").distinct().orderBy("detector_id").collect():  # a handful of detectors
        mine = F.col("detector_id") == r["detector_id"]
        out = out.unionByName(resampling.isotonic(train.where(mine).select("y", "score"), made.where(mine)).withColumnRenamed("calibrated", "calibrated_score"))
    return out


def table_detection(findings: DataFrame, truth: DataFrame, draws: int = 200) -> DataFrame:
    """(attack_class, access_tier, detector, n, n_poisoned, auroc, auroc_low, auroc_high, tpr, ece, average_precision, verdict): each attack's
    samples against all clean ones, for any check and for those that are meant to find it."""
    attacks = [r[0] for r in truth.where("is_poisoned = 1").select("attack_class").distinct().orderBy("attack_class").collect()]
    ran = {(r["detector_id"], r["access_tier"]) for r in findings.where("unavailable_reason is null").select("detector_id", "access_tier").distinct().collect()}
    tiers = sorted({t for _, t in ran}) or [0]
    rows = []
    for attack in attacks:
        for tier in tiers:
            for detector in (None, *(d for d in PRIMARY.get(attack, ()) if (d, tier) in ran)):
                s = stored(scores(findings, truth, attack, detector, tier), "scores")
                n, bad = s.agg(F.count("*"), F.sum("y")).first()
                if not bad:
                    continue
                one = metrics.auroc(s).crossJoin(metrics.tpr_at_fpr(s, 0.01)).crossJoin(metrics.ece(s)).crossJoin(metrics.average_precision(s.withColumn("_k", F.xxhash64("sample_id")), "_k")).crossJoin(resampling.auroc_interval(s, draws)).first()
                rows.append((attack, tier, detector or "any detector", n, bad, one["auroc"], one["low"], one["high"], one["tpr"], one["ece"], one["average_precision"]))
    shape = "attack_class string, access_tier int, detector string, n long, n_poisoned long, auroc double, auroc_low double, auroc_high double, tpr double, ece double, average_precision double"
    return truth.sparkSession.createDataFrame(rows, shape).withColumn("verdict", verdict_band(F.col("tpr")))


def table_contributors(findings: DataFrame, truth: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(contributor, n_samples, n_flagged, flagged_rate, low, high, p_above, disposition, true_poison_rate, matches_truth)."""
    flagged = findings.where("asset_type = 'sample' and unavailable_reason is null and disposition <> 'accept'").select(F.col("asset_ref").alias("sample_id")).distinct().withColumn("_f", F.lit(1))
    g = truth.where(F.col("contributor_id").isNotNull()).join(flagged, "sample_id", "left").groupBy("contributor_id").agg(F.count("*").alias("n"), F.count("_f").alias("k"), F.avg(F.col("is_poisoned").cast("double")).alias("rate"))
    low, high = resampling.credible_interval(F.col("k"), F.col("n"))
    p = resampling.p_rate_above(F.col("k"), F.col("n"), threshold)
    g = g.select(F.col("contributor_id").alias("contributor"), F.col("n").alias("n_samples"), F.col("k").alias("n_flagged"), (F.col("k") / F.col("n")).alias("flagged_rate"), low.alias("low"), high.alias("high"), p.alias("p_above"), F.col("rate").alias("true_poison_rate"))
    g = g.withColumn("disposition", risk_disposition(F.col("p_above"), F.col("n_samples")))
    return g.withColumn("matches_truth", (F.col("true_poison_rate") > threshold) == (F.col("disposition") != "accept"))


def table_tamper(attempts: DataFrame) -> DataFrame:
    """(attack_class, attempts, detected, rate, named, codes) of rows (attack_class, detected, correct_code, codes array)."""
    g = attempts.groupBy("attack_class").agg(F.count("*").alias("attempts"), F.count_if("detected").alias("detected"), F.count_if("correct_code").alias("named"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("codes")))).alias("codes"))
    return g.select("attack_class", "attempts", "detected", (F.col("detected") / F.col("attempts")).alias("rate"), "named", F.array_join("codes", ", ").alias("codes"))


def table_runtime(timings: DataFrame) -> DataFrame:
    """(check, seconds, n, seconds_per_1000) of rows (check, seconds, n samples)."""
    g = timings.groupBy("check").agg(F.sum("seconds").alias("seconds"), F.sum("n").alias("n"))
    return g.withColumn("seconds_per_1000", F.when(F.col("n") > 0, 1000 * F.col("seconds") / F.col("n")))


def overall_confidence(findings: DataFrame) -> DataFrame:
    """(confidence): the mean of those that findings state, null if none does."""
    return findings.where("unavailable_reason is null").agg(F.avg("confidence").alias("confidence"))


def measured(sweep: DataFrame, attack: str = "attack", rate: str = "tpr_at_1pct") -> DataFrame:
    """(attack_class, tpr): the median over a sweep's cells, for coverage; a fixed number of cells, rows with an error left out."""
    ok = sweep.where(F.col("error").isNull()) if "error" in sweep.columns else sweep
    return ok.groupBy(F.col(attack).alias("attack_class")).agg(F.percentile(rate, 0.5).alias("tpr"))


def score_all(findings: DataFrame, truth: DataFrame, draws: int = 200) -> dict[str, DataFrame]:
    """The tables, and the calibration error before and after, on the test split alone."""
    splits = stored(stratified_split(truth.select("sample_id", "is_poisoned"), "sample_id", "is_poisoned"), "splits")
    done = stored(calibrate_findings(findings, truth, splits), "calibrated")
    test = truth.join(splits.where("split = 'test'").select("sample_id"), "sample_id")
    raw = findings.withColumn("calibrated_score", F.lit(None).cast("double"))
    system = scores(raw, truth).join(splits.select("sample_id", "split"), "sample_id")
    fitted = resampling.isotonic(system.where("split = 'calibrate'"), system.where("split = 'test'"))
    before = metrics.ece(system.where("split = 'test'")).withColumnRenamed("ece", "before")
    after = metrics.ece(fitted.select("y", F.col("calibrated").alias("score"))).withColumnRenamed("ece", "after")
    return {
        "table1_detection": table_detection(done, test, draws), "table2_contributors": table_contributors(findings, truth),
        "confusion": metrics.disposition_confusion(truth.select(F.col("sample_id").alias("asset_ref"), F.col("is_poisoned").cast("int").alias("y")), _worst(findings), "asset_ref"),
        "calibration": before.crossJoin(after), "unmatched": fd.unmatched(findings, truth),
    }


def _worst(findings: DataFrame) -> DataFrame:
    from attestry.operators.rollup import worst_disposition

    return worst_disposition(findings.where("asset_type = 'sample' and unavailable_reason is null"), "asset_ref")


def top_reason(findings: DataFrame, by: Column) -> DataFrame:
    """(group, detector_id, n): each group's most frequent check, of equals the first by name."""
    c = findings.where("unavailable_reason is null").groupBy(by.alias("group"), "detector_id").agg(F.count("*").alias("n"))
    return c.groupBy("group").agg(F.min_by(F.struct("detector_id", "n"), F.struct(-F.col("n"), "detector_id")).alias("m")).select("group", "m.detector_id", "m.n")
