"""Faults to measure detectors with: poisoned samples with an answer key, edited weights, and images changed on the way to features.

A victim is picked by the order of a seeded hash of its id, so a pick is the same on any cluster and the larger of two shares
contains the smaller. samples: sample_id, label, contributor_id, ...; truth: sample_id, is_poisoned, attack_class, true_label, stored_label, contributor_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an attack does to an image: a function of pixels named here is applied where victims are decoded.
PIXELS = {"badnets_patch": "patched", "blended_trigger": "blended", "near_duplicate_flood": "variant"}


def clean_truth(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", F.lit(0).alias("is_poisoned"), F.lit(None).cast("string").alias("attack_class"), F.col("label").alias("true_label"), F.col("label").alias("stored_label"), "contributor_id")


def victims(truth: DataFrame, n: int, seed: str, where: Column | None = None) -> DataFrame:
    """(sample_id): n samples that no attack has touched yet."""
    t = truth.where(F.col("is_poisoned") == 0)
    if where is not None:
        t = t.where(where)
    return t.orderBy(F.md5(F.concat(F.lit(seed + "|"), "sample_id")), "sample_id").limit(n).select("sample_id")


def _mark(truth: DataFrame, some: DataFrame, attack: str, stored: Column | None = None) -> DataFrame:
    t = truth.join(some.withColumn("_v", F.lit(True)), "sample_id", "left")
    hit = F.col("_v").isNotNull()
    return t.select(
        "sample_id", F.when(hit, 1).otherwise(F.col("is_poisoned")).alias("is_poisoned"), F.when(hit, attack).otherwise(F.col("attack_class")).alias("attack_class"), "true_label",
        F.when(hit, stored if stored is not None else F.col("stored_label")).otherwise(F.col("stored_label")).alias("stored_label"), "contributor_id",
    )


def relabelled(samples: DataFrame, truth: DataFrame) -> DataFrame:
    """samples with the labels that the answer key says are stored."""
    t = truth.select("sample_id", "stored_label")
    return samples.join(t, "sample_id", "left").withColumn("label", F.coalesce("stored_label", "label")).drop("stored_label")


def label_flip(truth: DataFrame, n: int, labels: list[str], seed: str = "flip") -> DataFrame:
    """truth with n samples under another label, picked by hash among the rest."""
    others = F.array_except(F.array(*map(F.lit, sorted(labels))), F.array("true_label"))
    pick = F.get(others, F.pmod(F.xxhash64(F.lit(seed), "sample_id"), F.size(others)).cast("int"))
    return _mark(truth, victims(truth, n, seed, F.col("true_label").isNotNull()), "label_flip", pick)


def systematic_mislabel(truth: DataFrame, n: int, source: str, target: str, contributor: str | None = None, seed: str = "system") -> DataFrame:
    """truth with n samples of one class, of one contributor if named, under one other label."""
    where = F.col("true_label") == source
    if contributor is not None:
        where = where & (F.col("contributor_id") == contributor)
    return _mark(truth, victims(truth, n, seed, where), "systematic_mislabel", F.lit(target))


def image_attack(truth: DataFrame, n: int, attack: str, target: str | None = None, seed: str = "image") -> DataFrame:
    """truth with n samples marked for an attack on their pixels; with a target they are stored under that label."""
    return _mark(truth, victims(truth, n, seed), attack, F.lit(target) if target else None)


def flood(samples: DataFrame, truth: DataFrame, n: int, copies: int, contributor: str, seed: str = "flood") -> tuple[DataFrame, DataFrame]:
    """(samples, truth) with so many near copies of each of n samples, sent by one contributor."""
    some = samples.join(victims(truth, n, seed), "sample_id").withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    more = some.withColumn("sample_id", F.concat("sample_id", F.lit("#copy"), "_i")).withColumn("contributor_id", F.lit(contributor)).select(samples.columns)
    marked = clean_truth(more).withColumns({"is_poisoned": F.lit(1), "attack_class": F.lit("near_duplicate_flood")})
    return samples.unionByName(more), truth.unionByName(marked)


def insertion(samples: DataFrame, truth: DataFrame, foreign: DataFrame, label: str, contributor: str) -> tuple[DataFrame, DataFrame]:
    """(samples, truth) with foreign samples (sample_id, and any other columns of samples) under one label."""
    more = foreign.withColumns({"label": F.lit(label), "contributor_id": F.lit(contributor)})
    marked = clean_truth(more).withColumns({"is_poisoned": F.lit(1), "attack_class": F.lit("ood_insertion"), "true_label": F.lit(None).cast("string")})
    return samples.unionByName(more, allowMissingColumns=True), truth.unionByName(marked)


def assign_contributors(truth: DataFrame, contributors: list[str], concentration: float = 0.0, seed: str = "who") -> DataFrame:
    """truth with contributors dealt by hash; this share of the poisoned samples all goes to the last of them."""
    u = lambda tag: F.pmod(F.xxhash64(F.lit(f"{seed}|{tag}"), "sample_id"), F.lit(1 << 30))
    dealt = F.get(F.array(*map(F.lit, contributors)), (u("deal") % len(contributors)).cast("int"))
    return truth.withColumn("contributor_id", F.when((F.col("is_poisoned") == 1) & (u("poison") < concentration * (1 << 30)), contributors[-1]).otherwise(dealt))


def summary(truth: DataFrame) -> DataFrame:
    """(attack_class, contributor_id, n): what was poisoned, and whose."""
    return truth.where("is_poisoned = 1").groupBy("attack_class", "contributor_id").agg(F.count("*").alias("n"))


def perturb_weights(weights: DataFrame, scale: float, seed: int = 0, layer: str | None = None) -> DataFrame:
    """Weights (name, shape, values) with noise of this share of each layer's deviation, seeded by the layer's name."""
    only = F.lit(True) if layer is None else F.col("name") == layer

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for name, values, hit in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                v = np.array(values, np.float64)
                rng = np.random.default_rng((seed, int.from_bytes(hashlib.sha256(name.encode()).digest()[:6], "big")))
                out.append((v + rng.normal(0, scale * v.std(), v.shape)).tolist() if hit and len(v) else v.tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64()))], names=["name", "shape", "values"])

    return weights.select("name", "shape", "values", only.alias("hit")).mapInArrow(run, "name string, shape array<int>, values array<double>")
