"""Answer keys, calibration, attacks, data sets on disk, weights, the audit and its log."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.functions import canonical, pixels
from attestry.operators import attacks, audit, custody, detectors, logs, metrics, scoring, weights
from attestry.sources import datasets, records


@pytest.fixture(scope="module")
def run(spark):
    """400 samples, 40 of them poisoned, with scores that tell them apart but for some."""
    rng = np.random.default_rng(0)
    y = np.arange(400) < 40
    s = np.clip(rng.normal(0.25 + 0.55 * y, 0.12), 0, 1)
    truth = spark.createDataFrame([(f"s{i:03d}", int(y[i]), "label_flip" if y[i] else None, "a", "b" if y[i] else "a", "C3" if i < 45 else f"C{i % 3}") for i in range(400)], "sample_id string, is_poisoned int, attack_class string, true_label string, stored_label string, contributor_id string")
    df = spark.createDataFrame([(f"s{i:03d}", float(s[i])) for i in range(400)], "id string, s double")
    made = detectors.findings(df, "label_noise", "label_flip", F.col("id"), F.col("s"), F.concat(F.lit("score "), F.col("s").cast("string")))
    return made.unionByName(detectors.unavailable(spark, "ood", "ood_insertion", "2 images only")), truth, y, s


def test_split_is_stratified(spark, run):
    truth = run[1]
    s = scoring.stratified_split(truth, "sample_id", "is_poisoned")
    got = {(r["is_poisoned"], r["split"]): r["count"] for r in s.groupBy("is_poisoned", "split").count().collect()}
    assert got == {(0, "fit"): 144, (0, "calibrate"): 108, (0, "test"): 108, (1, "fit"): 16, (1, "calibrate"): 12, (1, "test"): 12}
    assert s.select("sample_id").distinct().count() == 400
    with pytest.raises(ValueError):
        scoring.stratified_split(truth, "sample_id", None, (0.5, 0.5, 0.5))


def test_score_all(spark, run, tmp_path):
    made, truth, y, s = run
    out = scoring.score_all(made, truth, draws=50)
    rows = out["table1_detection"].collect()
    assert {r["detector"] for r in rows} == {"any detector", "label_noise"} and all(r["n"] == 120 and r["n_poisoned"] == 12 and r["auroc"] > 0.9 and 0 <= r["auroc_low"] <= r["auroc_high"] <= 1 for r in rows)
    c = {r["contributor"]: r for r in out["table2_contributors"].collect()}
    assert c["C3"]["disposition"] == "quarantine" and c["C3"]["matches_truth"] and abs(c["C3"]["true_poison_rate"] - 40 / 45) < 1e-9
    cal = out["calibration"].first()
    assert cal["after"] < cal["before"]
    conf = {r["y"]: r.asDict() for r in out["confusion"].collect()}
    assert sum(v for k, v in conf[1].items() if k != "y") == 40 and conf[1]["quarantine"] == int(((s >= 0.8) & y).sum())
    assert out["unmatched"].count() == 0
    records.write_table(out["table2_contributors"], str(tmp_path / "t2"), ["contributor", "flagged_rate"])
    with pytest.raises(KeyError):
        records.write_table(out["table2_contributors"], str(tmp_path / "t3"), ["nothing"])
    assert spark.read.option("header", True).csv(str(tmp_path / "t2")).count() == 4


def test_tables_of_attempts_and_times(spark):
    t = scoring.table_tamper(spark.createDataFrame([("receipt_alter", True, True, ["CHAIN_BROKEN"]), ("receipt_alter", True, False, ["A"]), ("clean", False, True, [])], "attack_class string, detected boolean, correct_code boolean, codes array<string>"))
    assert {(r["attack_class"], r["attempts"], r["rate"], r["named"], r["codes"]) for r in t.collect()} == {("receipt_alter", 2, 1.0, 1, "A, CHAIN_BROKEN"), ("clean", 1, 0.0, 1, "")}
    r = scoring.table_runtime(spark.createDataFrame([("ood", 2.0, 500), ("ood", 1.0, 500)], "check string, seconds double, n long")).first()
    assert r["seconds_per_1000"] == 3.0


def test_metrics_without_a_class(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, score double")
    assert {(r["fpr"], r["tpr"]) for r in metrics.roc_points(one).collect()} == {(0.0, 0.0), (1.0, 1.0)}
    assert abs(metrics.tpr_at_fpr(one, 0.01).first()[0] - 0.01) < 1e-12


def test_attacks_keep_the_key(spark):
    s = spark.range(60).select(F.format_string("s%02d", "id").alias("sample_id"), F.format_string("k%d", F.col("id") % 3).alias("label"), F.lit("C0").alias("contributor_id"))
    t = attacks.clean_truth(s)
    t = attacks.label_flip(t, 6, ["k0", "k1", "k2"])
    t = attacks.systematic_mislabel(t, 5, "k1", "k2", "C0")
    t = attacks.image_attack(t, 4, "badnets_patch", "k0")
    by = {r["attack_class"]: r["n"] for r in t.groupBy("attack_class").agg(F.count("*").alias("n")).collect()}
    assert by == {None: 45, "label_flip": 6, "systematic_mislabel": 5, "badnets_patch": 4}
    assert t.where("attack_class in ('label_flip', 'systematic_mislabel') and stored_label = true_label").count() == 0
    assert attacks.relabelled(s, t).join(t, "sample_id").where("label <> stored_label").count() == 0
    s2, t2 = attacks.flood(s, t, 2, 3, "C9")
    s3, t3 = attacks.insertion(s2, t2, spark.createDataFrame([("x1",)], "sample_id string"), "k0", "C9")
    assert s3.count() == t3.count() == 67 and {r["contributor_id"]: r["n"] for r in attacks.summary(t3).where("attack_class = 'near_duplicate_flood'").collect()} == {"C9": 6}
    who = attacks.assign_contributors(t, ["A", "B"], 1.0)
    assert who.where("is_poisoned = 1 and contributor_id <> 'B'").count() == 0 and who.where("is_poisoned = 0").select("contributor_id").distinct().count() == 2


def test_weights_and_fingerprints(spark):
    rng = np.random.default_rng(3)
    net = {"conv.w": (4, 3, 3, 3), "fc.w": (5, 16), "fc.b": (5,)}
    rows = [(k, list(v), rng.normal(size=int(np.prod(v))).tolist()) for k, v in net.items()]
    w = spark.createDataFrame(rows, "name string, shape array<int>, values array<double>")
    rec = weights.layer_record(w)
    got = {r["name"]: r for r in rec.collect()}
    assert abs(got["fc.w"]["spectral_norm"] - np.linalg.norm(np.reshape(rows[1][2], (5, 16)), 2)) < 1e-9 and got["conv.w"]["n"] == 108
    same = weights.compare_weights(rec, rec).first()
    assert same["score"] == 0 and same["disposition"] == "accept"
    other = weights.compare_weights(weights.layer_record(attacks.perturb_weights(w, 0.1, layer="fc.w")), rec).first()
    assert other["score"] == 1 and other["severity"] == "critical" and "1 layers" in other["reason"] and "fc.w" in other["reason"]
    assert weights.compare_weights(rec, None).first()["unavailable_reason"]
    big = [(k, s, (np.array(v) + (np.arange(len(v)) // 16 == 2) * 9).tolist() if k == "fc.w" else v) for k, s, v in rows]
    st = weights.weight_stats(spark.createDataFrame(big, w.schema)).first()
    assert json.loads(st["evidence"])["row"] == 2 and st["confidence"] == 0.45 and st["score"] > weights.weight_stats(w).first()["score"]
    m = np.array(rows[1][2]).reshape(5, 16)
    p = weights.probes(spark, (16,), 50)
    ask = lambda k: weights.answered(p, lambda x, k=k: x @ (m + k).T, (16,))
    assert weights.compare_fingerprints(ask(0), ask(0)).first()["score"] == 0
    assert weights.compare_fingerprints(ask(0), ask(0.5)).first()["score"] == 1
    assert weights.compare_fingerprints(ask(0), weights.answered(p, lambda x: x[:, :3], (16,))).first()["score"] == 1


def test_receipts_custody_and_digests(spark):
    from attestry.functions import ed25519

    seeds = {a: bytes([i + 1] * 32) for i, a in enumerate(("lab", "hub"))}
    keys = spark.createDataFrame([(a, bytearray(ed25519.public_key(s))) for a, s in seeds.items()], "actor_id string, key binary")
    hops = spark.createDataFrame([], custody.HOPS)
    for i in range(5):
        actor = ("lab", "hub")[i % 2]
        hops = custody.add_hop(hops, "c", actor, seeds[actor], f"{i:064d}", f"2024-01-0{i + 1}")
    assert custody.verify_custody(hops, keys).count() == 0
    codes = lambda h: {(r["idx"], r["code"]) for r in custody.verify_custody(h, keys).collect()}
    assert codes(custody.alter(hops, 2, output_digest="x")) == {(3, "HANDOFF_MISMATCH")}
    assert codes(custody.delete(hops, 2)) == {(3, "HANDOFF_MISMATCH"), (3, "CHAIN_BROKEN"), (3, "HOP_GAP")}
    assert codes(hops.withColumn("actor_id", F.when(F.col("idx") == 1, "who").otherwise(F.col("actor_id")))) == {(1, "UNKNOWN_ACTOR")}
    assert codes(hops.withColumn("ts", F.when(F.col("idx") == 1, F.lit(None)).otherwise(F.col("ts")))) >= {(1, "MALFORMED")}
    log = hops.withColumn("nonce", F.col("idx").cast("string"))
    # content edited under an unchanged digest: found when the digest is made again
    body = F.sha2(F.concat_ws("|", "idx", "output_digest"), 256)
    made = log.withColumn("record_hash", body).withColumn("prev_hash", F.lag(body, 1, logs.GENESIS).over(__import__("pyspark").sql.Window.partitionBy("chain").orderBy("idx")))
    edited = custody.alter(made, 2, output_digest="edited")
    assert logs.verify_log(edited).count() == 0
    assert [(r["idx"], r["code"]) for r in logs.verify_log(edited, F.sha2(F.concat_ws("|", "idx", "output_digest"), 256)).collect()] == [(3, logs.CHAIN)]
    f = audit.log_findings(custody.verify_receipts(custody.replay(log, 1, 3), keys)).collect()
    assert f and all(r["asset_type"] == "receipt" and r["score"] == 1 and any(c.isdigit() for c in r["reason"]) for r in f) and "receipt_replay" in {r["attack_class"] for r in f}
    d = spark.createDataFrame([(f"i{k}", f"d{k}") for k in range(300)], "sample_id string, sha256 string")
    one, two = custody.content_digest(d).first(), custody.content_digest(d.repartition(7)).first()
    assert one == two and one["n"] == 300 and custody.content_digest(d.where("sample_id <> 'i7'")).first()["digest"] != one["digest"]


def test_audit_log(spark):
    runs = [(f"d{i}", {"k": i}, "00", "t0", "t1") for i in range(6)]
    log = audit.audit_entries(spark, "a", runs)
    assert audit.verify_audit(log).count() == 0
    bad = {(r["idx"], r["code"]) for r in audit.verify_audit(custody.alter(log, 2, output_digest="11")).collect()}
    assert bad == {(2, "CONTENT_CHANGED"), (3, logs.CHAIN)}
    assert {(r["idx"], r["code"]) for r in audit.verify_audit(custody.delete(log, 2)).collect()} >= {(3, logs.CHAIN), (3, "NUMBERING")}
    assert audit.assessment_id("2024-05-06", "x").startswith("20240506-")


def test_audit_of_a_folder(spark, tmp_path):
    root = tmp_path / "set"
    for label in range(2):
        (root / f"k{label}").mkdir(parents=True)
        for i in range(14):
            (root / f"k{label}" / f"C{i % 2}_{i:02d}.png").write_bytes(pixels.png(pixels.class_image(label, i)))
    for i in range(4):
        (root / "k0" / f"C1_copy{i}.png").write_bytes(pixels.png(pixels.variant(pixels.class_image(0, 77), i)))
    assert datasets.detect_format(spark, str(root)) == "folder"
    d = datasets.load_dataset(spark, str(root), pattern=r"(C\d)_")
    assert d.samples.count() == 32 and d.limitations == []
    found = audit.audit(spark, d)
    rows = found.findings.collect()
    assert {r["detector_id"] for r in rows} == {"near_duplicate", "ood", "label_noise", "trigger_freq", "contributor"} and len(found.timings) == 6
    assert sum(r["detector_id"] == "near_duplicate" for r in rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    from attestry.operators.findings import violations

    v = found.findings.select(F.explode(violations(F.col("score"), F.col("reason"), F.col("unavailable_reason"), F.col("asset_type")))).collect()
    assert v == []
    assert found.verdict().first()["verdict"] in ("red", "amber", "green") and found.coverage().where("detector_id = 'near_duplicate'").first()["n_made"] == 4
    records.write_lines(found.findings, str(tmp_path / "out"), ["asset_ref", "detector_id"])
    back = records.read_findings(spark, str(tmp_path / "out"))
    assert back.count() == len(rows) and back.where(F.size("violations") > 0).count() == 0
    with pytest.raises(FileNotFoundError):
        datasets.detect_format(spark, str(tmp_path / "nothing"))


def test_coco_and_yolo_sets(spark, tmp_path):
    c = tmp_path / "c"
    (c / "annotations").mkdir(parents=True)
    (c / "images").mkdir()
    (c / "images" / "a.png").write_bytes(b"x")
    (c / "annotations" / "instances_x.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a.png"}, {"id": 2, "file_name": "b.png"}], "annotations": [], "categories": []}))
    (c / "contributors.json").write_text('{"C5": ["a.png"]}')
    d = datasets.load_dataset(spark, str(c))
    r = d.samples.collect()
    assert d.layout == "coco" and len(r) == 1 and r[0]["contributor_id"] == "C5" and r[0]["image_path"].endswith("images/a.png") and len(d.limitations) == 3
    y = tmp_path / "y"
    for p in ("images/train", "labels/train"):
        (y / p).mkdir(parents=True)
    (y / "images/train/a.png").write_bytes(b"x")
    (y / "labels/train/a.txt").write_text("1 .5 .5 .1 .1\n")
    (y / "data.yaml").write_text("names: [car, van]\n")
    d = datasets.load_dataset(spark, str(y))
    assert d.layout == "yolo" and d.samples.first()["label"] == "van"


def test_lines_keep_whole_numbers(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (None, 2)], "b long, a long")
    records.write_lines(df, str(tmp_path / "l"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect()) == ['{"a":2}', '{"b":1}']
    with pytest.raises(TypeError):
        canonical.text(object())


def test_two_sample_p_values():
    import itertools

    from attestry.operators.shift import _ks_tail

    def d(a, b):
        return max(abs(sum(v <= t for v in a) / len(a) - sum(v <= t for v in b) / len(b)) for t in [*a, *b])

    # every way of dealing seven values into three and four
    all_ = [d(a, [v for v in range(7) if v not in a]) for a in itertools.combinations(range(7), 3)]
    for value in set(all_):
        assert abs(_ks_tail(value, 3, 4) - sum(v >= value - 1e-9 for v in all_) / len(all_)) < 1e-9
        assert abs(_ks_tail(value, 4, 3) - _ks_tail(value, 3, 4)) < 1e-12
    limit = 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * 0.06**2 * 450) for k in range(1, 50))
    assert abs(_ks_tail(0.06, 900, 900) - limit) < 0.01 and _ks_tail(0.5, 10**6, 10**6) < 1e-9
