"""Detectors as plans: each takes a table of samples with features and gives findings.

samples: sample_id, label, contributor_id, batch_id and the features that a detector reads (see features.featured). A detector
that can't run gives one row with an unavailable_reason, at score 0; :func:`isolated` makes such a row of an error as well, so that
no detector stops another. Scores, limits and weights are fixed values of the output contract.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.grading import bounded, disposition_for, duplicate_score, severity_for
from attestry.functions.vectors import dot, normalized
from attestry.operators import graph, outliers, resampling, rollup, shift, similarity
from attestry.session import stored

FINDING = (
    "asset_ref string, asset_type string, attack_class string, detector_id string, access_tier int, score double, severity string, disposition string, "
    "reason string, evidence string, unavailable_reason string, confidence double, calibrated_score double"
)
COLUMNS = [c.split()[0] for c in FINDING.split(", ")]
NEAR, HASHED, BITS, LEAST_CLUSTER = 0.99, 0.90, 8, 3
NEIGHBOURS, LEAST_LABELLED = 20, 20


def findings(df: DataFrame, detector: str, attack: str, ref: Column, score: Column, reason: Column, evidence: dict[str, Column] | None = None, asset_type: str = "sample", tier: int = 0, confidence: float | None = None, disposition: Column | None = None) -> DataFrame:
    """df's rows as findings. reason is cut at 400 characters; evidence becomes a JSON object."""
    s = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(score, F.lit(0.0)))), F.lit(0.0))
    text = F.when(F.length(reason) > 400, F.concat(F.substring(reason, 1, 397), F.lit("..."))).otherwise(reason)
    shown = F.to_json(F.struct(*(c.alias(k) for k, c in evidence.items()))) if evidence else F.lit("{}")
    df = df.select(ref.cast("string").alias("asset_ref"), s.alias("score"), text.alias("reason"), shown.alias("evidence"), (disposition if disposition is not None else F.lit(None).cast("string")).alias("disposition"))
    return df.select(
        "asset_ref", F.lit(asset_type).alias("asset_type"), F.lit(attack).alias("attack_class"), F.lit(detector).alias("detector_id"), F.lit(tier).alias("access_tier"), "score",
        severity_for(F.col("score")).alias("severity"), F.coalesce("disposition", disposition_for(F.col("score"))).alias("disposition"), "reason", "evidence",
        F.lit(None).cast("string").alias("unavailable_reason"), F.lit(confidence).cast("double").alias("confidence"), F.lit(None).cast("double").alias("calibrated_score"),
    )


def unavailable(spark: SparkSession, detector: str, attack: str, why: str, asset_ref: str = "dataset", asset_type: str = "dataset", tier: int = 0) -> DataFrame:
    """One row that says why a detector didn't run."""
    return spark.createDataFrame([(asset_ref, asset_type, attack, detector, tier, 0.0, "low", "accept", why[:400], "{}", why[:400], None, None)], FINDING)


def unavailable_rows(df: DataFrame, detector: str, attack: str, ref: Column, why: Column, asset_type: str = "dataset", tier: int = 0) -> DataFrame:
    out = findings(df, detector, attack, ref, F.lit(0.0), why, asset_type=asset_type, tier=tier)
    return out.withColumn("unavailable_reason", F.col("reason"))


def isolated(spark: SparkSession, detector: str, attack: str, run: Callable[[], DataFrame], tier: int = 0) -> DataFrame:
    """run()'s findings, computed and stored; on any error one row that names it."""
    try:
        return stored(run().select(*COLUMNS), detector)
    except Exception as e:  # noqa: BLE001  whatever stops a detector must not stop the audit
        return unavailable(spark, detector, attack, f"The check stopped with {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", tier=tier)


def _number(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


# ---- copies


def close_pairs(units: DataFrame, least: float = NEAR, tables: int = 64, planes: int = 8, seed: int = 5) -> DataFrame:
    """(a, b, similarity) of rows (id, u: unit vector) with a cosine of at least ``least``.

    Vectors that close lie within sqrt(2 - 2 least) of each other, so each of ``tables`` keys, ``planes`` projections cut at 4.24
    times that, is shared by a chance of 0.19: with 64 keys all but 2e-6 of such pairs meet. Candidates are confirmed on the vectors.
    Equal vectors are one node under their smallest id, and its copies link to that: a hot copy group has no pairs.
    """
    dim = units.select(F.size("u").alias("n")).limit(1).first()
    if dim is None:
        return units.sparkSession.createDataFrame([], "a string, b string, similarity double")
    rng = np.random.default_rng(seed)
    wide = 4.24 * (2 - 2 * least) ** 0.5
    axes, shifts = rng.normal(size=(dim["n"], tables * planes)), rng.uniform(0, wide, tables * planes)

    def keyed(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            u = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            cells = np.floor((u @ axes + shifts) / wide).astype("<i4").reshape(len(u), tables, planes)
            keys = [[xxhash.xxh3_64_intdigest(c.tobytes(), t) - (1 << 63) for t, c in enumerate(row)] for row in cells]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["id", "keys"])

    rep = units.groupBy(F.xxhash64("u").alias("same"), "u").agg(F.min("id").alias("first"))
    copies = units.join(rep, "u").where(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    nodes = stored(rep.select(F.col("first").alias("id"), "u"), "nodes")
    keys = nodes.mapInArrow(keyed, f"id {nodes.schema['id'].dataType.simpleString()}, keys array<long>").select("id", F.explode("keys").alias("key"))
    pairs = keys.alias("x").join(keys.alias("y"), "key").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    return similar(pairs, nodes).where(F.col("similarity") >= least).unionByName(copies)


def similar(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the cosine of their unit vectors."""
    one = lambda c: units.select(F.col("id").alias(c), F.col("u").alias(f"_{c}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").withColumn("similarity", dot(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def near_duplicate(samples: DataFrame) -> DataFrame:
    """Members of groups of at least three near copies: cosine of 0.99, or 0.90 where the hashes of some angles differ in 8 bits at most."""
    s = samples.where(F.col("embedding").isNotNull()).select(F.col("sample_id").alias("id"), "contributor_id", normalized(F.col("embedding")).alias("u"), "hashes")
    s = stored(s, "units")
    units = s.select("id", "u")
    by_hash = similarity.hamming_candidates(s.select("id", F.explode("hashes").alias("hash")).distinct(), BITS)
    hashed = similar(by_hash, units).where(F.col("similarity") >= HASHED)
    edges = close_pairs(units).select("a", "b").unionByName(hashed.select("a", "b")).distinct()
    # components work on numbers
    numbered = stored(s.select("id", F.monotonically_increasing_id().alias("k")), "numbers")
    e = edges.join(numbered.toDF("a", "ka"), "a").join(numbered.toDF("b", "kb"), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    groups = graph.clusters(e, LEAST_CLUSTER).withColumnRenamed("id", "k")
    groups = stored(groups.join(numbered, "k").select("id", "component", "size"), "groups")
    member = s.join(groups, "id")
    # the mean cosine of all pairs from the sum of the vectors: no pairs are made
    total = member.select("component", F.posexplode("u").alias("at", "x")).groupBy("component", "at").agg(F.sum("x").alias("t")).groupBy("component").agg(F.sum(F.col("t") * F.col("t")).alias("square"))
    source = member.where(F.col("contributor_id").isNotNull()).groupBy("component", "contributor_id").agg(F.count("*").alias("n")).groupBy("component").agg(F.max(F.struct("n", "contributor_id")).alias("top"))
    g = member.join(total, "component").join(source, "component", "left")
    mean = (F.col("square") - F.col("size")) / (F.col("size") * (F.col("size") - 1))
    named = F.when(F.col("top.n") >= F.greatest(F.lit(2), F.floor(0.6 * F.col("size"))), F.concat(F.lit(" "), F.col("top.n").cast("string"), F.lit(" of them came from "), F.col("top.contributor_id"), F.lit("."))).otherwise("")
    reason = F.concat(F.lit("One of "), F.col("size").cast("string"), F.lit(" images that are almost the same picture, alike to "), _number(100 * mean, 1), F.lit(" %."), named)
    return findings(g, "near_duplicate", "near_duplicate_flood", F.col("id"), duplicate_score(F.col("size")), reason, {"cluster": F.col("component"), "size": F.col("size"), "mean_similarity": mean})


# ---- places among the others of a class


def ood(samples: DataFrame) -> DataFrame:
    """Distance from the trimmed centre of the sample's class; classes under eight samples are reported as not checked."""
    s = samples.where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    d = outliers.class_distances(s, "sample_id", "label", "embedding")
    reason = F.concat(F.lit("This image is "), _number(F.col("ratio")), F.lit(" times as far from the centre of class '"), F.col("label"), F.lit("' as its typical images."))
    made = findings(d, "ood", "ood_insertion", F.col("id"), F.col("score"), reason, {"ratio": F.col("ratio"), "distance": F.col("distance")})
    few = s.groupBy("label").agg(F.count("*").alias("n")).where("n < 8")
    return made.unionByName(unavailable_rows(few, "ood", "ood_insertion", F.concat(F.lit("class:"), F.col("label")), F.concat(F.lit("Class '"), F.col("label"), F.lit("' has "), F.col("n").cast("string"), F.lit(" images; 8 are needed."))))


def label_noise(samples: DataFrame) -> DataFrame:
    """Disagreement of a sample's label with those of its nearest neighbours."""
    s = samples.where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    n, kinds = s.agg(F.count("*"), F.count_distinct("label")).first()
    if n < LEAST_LABELLED or kinds < 2:
        why = f"{n} labelled images of {kinds} classes; {LEAST_LABELLED} images of 2 classes are needed."
        return unavailable(samples.sparkSession, "label_noise", "label_flip", why)
    k = min(NEIGHBOURS, n - 1)
    near = outliers.nearest_blocks(s, "sample_id", "embedding", k)
    d = outliers.label_disagreement(near, s.select(F.col("sample_id").alias("id"), "label"), k)
    reason = F.concat(F.lit("Labelled '"), F.col("label"), F.lit("', but "), _number(100 * (1 - F.col("agreement")), 0), F.lit(f" % of its {k} most similar images are labelled otherwise, most of them '"), F.col("majority"), F.lit("'."))
    return findings(d, "label_noise", "label_flip", F.col("id"), F.col("score"), reason, {"agreement": F.col("agreement"), "majority": F.col("majority")})


def trigger_freq(samples: DataFrame) -> DataFrame:
    """Unusual high-frequency energy, and tiles that are unusual against the same tile of all other images."""
    s = samples.where(F.col("tiles").isNotNull()).withColumn("_all", F.lit(1))
    z = outliers.robust_z(s.select("sample_id", "energy", "_all"), "energy", "_all").select(F.col("sample_id").alias("id"), F.abs("z").alias("z"))
    t = outliers.tile_anomaly(s, "sample_id", "tiles").join(z, "id")
    score = bounded(0.3 * F.col("z") + F.col("worst_z") + 5 * F.col("consistency"), 6.0)
    place = F.concat(F.lit("row "), (F.floor(F.col("worst_tile") / 8) + 1).cast("string"), F.lit(", column "), (F.col("worst_tile") % 8 + 1).cast("string"))
    reason = F.concat(F.lit("The tile in "), place, F.lit(" of 8 x 8 differs "), _number(F.col("worst_z"), 1), F.lit(" times the usual spread from that tile of the other images"), F.when(F.col("consistency") > 0, F.concat(F.lit("; "), _number(100 * F.col("consistency"), 1), F.lit(" % of images differ there"))).otherwise(""), F.lit("."))
    return findings(t, "trigger_freq", "badnets_patch", F.col("id"), score, reason, {"tile": F.col("worst_tile"), "tile_z": F.col("worst_z"), "energy_z": F.col("z"), "consistency": F.col("consistency")})


def spectral_signature(samples: DataFrame, vector: str = "activation", least: int = 16) -> DataFrame:
    """Projection on the main direction of the class's inner activations."""
    s = samples.where(F.col("label").isNotNull() & F.col(vector).isNotNull())
    if not s.groupBy("label").count().where(F.col("count") >= least).limit(1).count():
        return unavailable(samples.sparkSession, "spectral_signature", "badnets_patch", f"No class has {least} images with activations.", tier=2)
    z = outliers.robust_z(resampling.projections(s, "sample_id", "label", vector, least), "projection", "label")
    reason = F.concat(F.lit("Inside the model this image stands "), _number(F.col("z"), 1), F.lit(" times the usual spread out along the direction in which class '"), F.col("label"), F.lit("' varies most."))
    return findings(z, "spectral_signature", "badnets_patch", F.col("id"), bounded(F.col("z"), 3.0), reason, {"projection": F.col("projection"), "z": F.col("z")}, tier=2, confidence=0.6)


# ---- roll-up and shift


def roll_up(samples: DataFrame, made: DataFrame, group: str = "contributor_id") -> DataFrame:
    """Contributors or batches by the share of their samples that any check flagged; batches are referred to as batch:<id>."""
    spark = samples.sparkSession
    if not samples.where(F.col(group).isNotNull()).limit(1).count():
        if group == "batch_id":
            return spark.createDataFrame([], FINDING)
        return unavailable(spark, "contributor", "systematic_mislabel", "0 images name who sent them.", asset_type="contributor")
    flagged = made.where("asset_type = 'sample' and unavailable_reason is null and disposition <> 'accept'")
    risk = stored(rollup.group_risk(samples, flagged.select(F.col("asset_ref").alias("sample_id")), group), "risk")
    others = rollup.leave_one_out(risk, group).drop("rate")
    by = flagged.select(F.col("asset_ref").alias("sample_id"), "detector_id").join(samples.select("sample_id", group), "sample_id").groupBy(group, "detector_id").agg(F.count("*").alias("n"))
    counts = by.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("detector_id", "n")))).alias("checks"), F.max(F.struct("n", "detector_id")).alias("top"))
    low, high = resampling.credible_interval(F.col("n_flagged"), F.col("n"))
    r = risk.join(others, group).join(counts, group, "left").withColumn("low", low).withColumn("high", high)
    top = F.when(F.col("top").isNotNull(), F.concat(F.lit(" Most often by "), F.col("top.detector_id"), F.lit(" ("), F.col("top.n").cast("string"), F.lit(")."))).otherwise("")
    reason = F.concat(F.col("n_flagged").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" images were flagged ("), _number(100 * F.col("rate"), 1), F.lit(" %); the middle of the others is "), _number(100 * F.col("others_median"), 1), F.lit(" %."), top)
    evidence = {"rate": F.col("rate"), "low": F.col("low"), "high": F.col("high"), "p_above": F.col("p_above"), "others_max": F.col("others_max"), "checks": F.col("checks")}
    ref = F.concat(F.lit("batch:"), F.col(group)) if group == "batch_id" else F.col(group)
    return findings(r, "contributor", "systematic_mislabel", ref, F.col("p_above"), reason, evidence, "contributor", disposition=F.col("disposition"))


def shift_finding(rows: DataFrame, samples: DataFrame | None = None, total: float | None = None) -> DataFrame:
    """One finding about a batch against its reference. rows: (measure, observed, value); total: the distance of the whole, else the mean
    effect over 3, at most 1. samples: the observed ones, whose contributors tell whether one of them brought most."""
    spark = rows.sparkSession
    e = {r["measure"]: abs(r["effect"]) for r in shift.ks_statistic(rows).select("measure", "effect").collect()}  # one row a measure
    if not e:
        return unavailable(spark, "shift", "distribution_shift", "Fewer than 3 values on one side of every measure.")
    weight = sum(e.values())
    explained = min(0.95, weight / (weight + 1.2)) if weight else 0.0
    whole = min(1.0, weight / len(e) / 3) if total is None else total
    fine, coarse = (max((e.get(k, 0.0) for k in names), default=0.0) for names in (("sharpness", "camera noise"), ("brightness", "contrast", "colour balance", "saturation")))
    localised = fine > max(0.5, 1.2 * coarse)
    concentrated = False
    if samples is not None:
        top = samples.where(F.col("contributor_id").isNotNull()).groupBy("contributor_id").count().agg(F.max("count"), F.sum("count")).first()
        concentrated = bool(top[1]) and top[0] > 0.8 * top[1]
    one = spark.createDataFrame([(whole, 1 - explained, localised, concentrated)], "total double, unexplained double, localised boolean, concentrated boolean")
    kind = shift.classify(F.col("total"), F.col("unexplained"), F.col("localised"), F.col("concentrated"))
    factors = "; ".join(f"{k} {100 * explained * v / weight:.0f} %" for k, v in sorted(e.items(), key=lambda x: (-x[1], x[0])) if weight and explained * v / weight >= 0.01)
    score = F.when(kind == "NO MEANINGFUL SHIFT", 0.0).otherwise(F.least(F.lit(1.0), 2 * F.col("unexplained") + F.when(kind == "SUSPICIOUS", 0.3).otherwise(0.0)))
    reason = F.concat(kind, F.lit(f": {100 * (1 - explained):.0f} % of the change has no physical cause; the rest is {factors or 'none'}."))
    return findings(one, "shift", "distribution_shift", F.lit("dataset"), score, reason, {"kind": kind, "total": F.col("total"), "unexplained": F.col("unexplained")}, "dataset", disposition=F.when(kind == "SUSPICIOUS", "review").otherwise("accept"))
