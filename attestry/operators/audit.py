"""An audit: files to findings to a verdict. One table of features feeds every detector; one that fails leaves a finding that says so."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import canonical, pixels
from attestry.operators import custody, detectors, features, findings, logs
from attestry.session import stored
from attestry.sources.datasets import Dataset

#: Each check on samples and the attack that it is named under.
DATA = (("near_duplicate", "near_duplicate_flood", detectors.near_duplicate), ("ood", "ood_insertion", detectors.ood), ("label_noise", "label_flip", detectors.label_noise), ("trigger_freq", "badnets_patch", detectors.trigger_freq))
#: Failures of a signed log and the attack that each is named under.
LOG_ATTACKS = {logs.REPLAY: "receipt_replay", logs.NONCE: "receipt_replay", logs.GAP: "receipt_delete", logs.TIME: "receipt_reorder"}


@dataclass
class Audit:
    samples: DataFrame
    findings: DataFrame
    timings: list[tuple[str, float]] = field(default_factory=list)
    limitations: list[str] = field(default_factory=list)

    def verdict(self) -> DataFrame:
        return findings.overall_verdict(self.findings)

    def coverage(self, measured: DataFrame | None = None) -> DataFrame:
        none = self.findings.sparkSession.createDataFrame([], "attack_class string, tpr double")
        return findings.coverage(self.findings, measured if measured is not None else none)


def measures(samples: DataFrame, observed: bool) -> DataFrame:
    """(measure, observed, value) of samples with statistics, for the shift check."""
    named = F.transform("statistics", lambda v, i: F.struct(F.get(F.array(*map(F.lit, pixels.STATISTICS)), i).alias("measure"), v.alias("value")))
    return samples.where(F.col("statistics").isNotNull()).select(F.explode(named).alias("m")).select("m.measure", F.lit(observed).alias("observed"), "m.value")


def audit(spark: SparkSession, data: Dataset, reference: DataFrame | None = None, activations: DataFrame | None = None, model_findings: list[DataFrame] | None = None, receipts: tuple[DataFrame, DataFrame] | None = None) -> Audit:
    """All checks over a data set. reference: featured samples of an accepted batch; activations: (sample_id, activation) of a model's
    inside; model_findings: those of weights.compare_*; receipts: a signed log and its keyring."""
    s = features.featured(spark, data.samples, data.root)
    done, timings = [], []

    def check(name: str, attack: str, run, tier: int = 0) -> None:
        start = time.perf_counter()
        done.append(detectors.isolated(spark, name, attack, run, tier))
        timings.append((name, time.perf_counter() - start))

    for name, attack, run in DATA:
        check(name, attack, lambda run=run: run(s))
    if activations is not None:
        check("spectral_signature", "badnets_patch", lambda: detectors.spectral_signature(s.join(activations, "sample_id")), 2)
    if reference is not None:
        check("shift", "distribution_shift", lambda: detectors.shift_finding(measures(reference, False).unionByName(measures(s, True)), s))
    for f in model_findings or []:
        done.append(f.select(*detectors.COLUMNS))
    made = _union(spark, done)
    check("contributor", "systematic_mislabel", lambda: detectors.roll_up(s, made))
    check("contributor", "systematic_mislabel", lambda: detectors.roll_up(s, made, "batch_id"))
    if receipts is not None:
        check("provenance.verify", "receipt_alter", lambda: log_findings(custody.verify_receipts(*receipts)))
    return Audit(s, stored(_union(spark, done), "findings"), timings, list(data.limitations))


def _union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], detectors.FINDING)
    for p in parts:
        out = out.unionByName(p)
    return out


def log_findings(failures: DataFrame, priority: tuple[str, ...] = custody.PRIORITY, detector: str = "provenance.verify", asset_type: str = "receipt") -> DataFrame:
    """Failures of a log as findings, one a record, under the gravest failure and the attack that it points to."""
    h = custody.headlines(failures, priority)
    attack = F.lit("receipt_alter")
    for code, name in LOG_ATTACKS.items():
        attack = F.when(F.col("code") == code, name).otherwise(attack)
    ref = F.concat_ws(":", F.col("chain").cast("string"), F.coalesce(F.col("seq"), F.col("idx")).cast("string"))
    reason = F.concat(F.lit("Line "), (F.col("idx") + 1).cast("string"), F.lit(" fails: "), F.lower(F.replace(F.array_join("codes", ", "), F.lit("_"), F.lit(" "))), F.lit("."))
    out = detectors.findings(h.withColumn("_attack", attack), detector, "receipt_alter", ref, F.lit(1.0), reason, {"codes": F.col("codes"), "line": F.col("idx"), "attack": F.col("_attack")}, asset_type)
    return out.withColumn("attack_class", F.get_json_object("evidence", "$.attack"))


def custody_findings(failures: DataFrame) -> DataFrame:
    f = log_findings(failures, custody.HOP_PRIORITY, "custody.verify", "custody")
    return f.withColumn("attack_class", F.lit("custody_break"))


# ---- the audit's own log

AUDIT_LOG = "chain string, idx long, seq long, detector_id string, config_hash string, output_digest string, started string, ended string, prev_hash string, record_hash string"
_FIELDS = [c.split()[0] for c in AUDIT_LOG.split(", ")]


def audit_entries(spark: SparkSession, chain: str, runs: list[tuple[str, dict, str, str, str]], after: tuple[int, str] | None = None) -> DataFrame:
    """Log rows of (detector, config, output digest, started, ended), each linked to the one before; after: the last (seq, record_hash) so far."""
    seq, prev = after if after else (-1, logs.GENESIS)
    rows = []
    for detector, config, digest, start, end in runs:
        seq += 1
        body = {"chain": chain, "seq": seq, "detector_id": detector, "config_hash": canonical.digest(config), "output_digest": digest, "started": start, "ended": end, "prev_hash": prev}
        own = canonical.digest(body)
        rows.append(tuple((body | {"idx": seq, "record_hash": own})[c] for c in _FIELDS))
        prev = own
    return spark.createDataFrame(rows, AUDIT_LOG)


def verify_audit(log: DataFrame) -> DataFrame:
    """(chain, idx, seq, code): rows whose content, link or number isn't what it must be. Content is hashed again."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def again(rows):
        import pandas as pd

        names = [c for c in _FIELDS if c not in ("idx", "record_hash")]
        return pd.Series([canonical.digest({c: (int(r[c]) if c == "seq" else r[c]) for c in names}) for r in rows.to_dict("records")])

    w = W.partitionBy("chain").orderBy("idx")
    # stored first: the digest is a function that windows shouldn't ask twice
    d = stored(log.withColumn("_own", again(F.struct(*(c for c in _FIELDS if c not in ("idx", "record_hash"))))), "digests")
    d = d.withColumn("_expected", F.lag("_own", 1, logs.GENESIS).over(w)).withColumn("_place", F.row_number().over(w) - 1)
    codes = F.array_compact(F.array(F.when(F.col("_own") != F.col("record_hash"), "CONTENT_CHANGED"), F.when(F.col("prev_hash") != F.col("_expected"), logs.CHAIN), F.when(F.col("seq") != F.col("_place"), "NUMBERING")))
    return d.select("chain", "idx", "seq", F.explode(codes).alias("code"))


def assessment_id(day: str, digest: str) -> str:
    """The day as YYYYMMDD and six digits of what was assessed."""
    import hashlib

    return f"{day.replace('-', '')}-{hashlib.sha256(digest.encode()).hexdigest()[:6]}"
