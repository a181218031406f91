"""Images to findings: features against plain definitions, and detectors on images with planted faults."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.functions import pixels
from attestry.operators import detectors, features, outliers, similarity
from attestry.sources import images


def test_pixels():
    a = pixels.class_image(1, 2)
    assert a.shape == (64, 64, 3) and pixels.resized(a, 64) is a and pixels.resized(a, 8).shape == (8, 8, 3)
    flat = np.full((40, 30, 3), 120, np.uint8)
    assert (pixels.resized(flat, 16) == 120).all() and (pixels.grey(flat) == 120).all() and pixels.high_frequency_share(np.ones((64, 64))) < 1e-9
    # the transform keeps length, and equals its definition at one place
    g = pixels.grey(a) / 255.0
    d = pixels.dct2(g)
    assert abs((d**2).sum() - (g**2).sum()) < 1e-9
    c = lambda k: np.cos(np.pi / 64 * (np.arange(64) + 0.5) * k)
    assert abs(d[3, 5] - 2 / 64 * (c(3)[:, None] * c(5)[None, :] * g).sum()) < 1e-9
    e = pixels.embedding(a)
    assert len(e) == 150 and abs(np.linalg.norm(e) - 1) < 1e-6
    one, near, other = (pixels.perceptual_hash(x) for x in (a, pixels.variant(a, 1), pixels.class_image(4, 9)))
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert bits(one, near) <= 8 < bits(one, other)
    turned = pixels.hashes(pixels.rotated(a, 8.0))
    assert min(bits(x, y) for x in turned for y in pixels.hashes(a)) <= bits(turned[0], one)
    s = dict(zip(pixels.STATISTICS, pixels.statistics(a), strict=True))
    assert abs(s["brightness"] - (a / 255).mean()) < 1e-9 and abs(s["colour balance"] - (s["red"] - s["blue"])) < 1e-12
    t = pixels.tile_contrast(pixels.grey(pixels.patched(a)) / 255.0)
    assert t.argmax() in (54, 55, 62, 63) and len(t) == 64
    assert pixels.from_spark(-1, -1, 0, b"") is None


@pytest.fixture(scope="module")
def intake(spark, tmp_path_factory):
    """Images of three classes by four contributors; one of them sends copies, foreign pictures, patches and wrong labels."""
    root = tmp_path_factory.mktemp("intake")
    truth = {}

    def put(label, name, a, who, fault=None):
        (root / label).mkdir(exist_ok=True)
        (root / label / f"{name}.png").write_bytes(pixels.png(a))
        truth[f"{label}/{name}.png"] = (who, fault)

    for label in range(3):
        for i in range(20):
            put(f"k{label}", f"ok{i:02d}", pixels.class_image(label, i), f"C{i % 3}")
    for i in range(6):
        put("k0", f"copy{i}", pixels.variant(pixels.class_image(0, 777), i), "C3", "near_duplicate_flood")
    for i in range(3):
        put("k1", f"odd{i}", pixels.foreign_image(i), "C3", "ood_insertion")
        put("k2", f"flip{i}", pixels.class_image(0, 500 + i), "C3", "label_flip")
    for i in range(5):
        put("k1", f"patch{i}", pixels.patched(pixels.class_image(1, 600 + i)), "C3", "badnets_patch")
    (root / "k1" / "torn.png").write_bytes(b"not a picture")
    truth["k1/torn.png"] = ("C0", None)
    s = images.image_folder(spark, str(root))
    who = spark.createDataFrame([(k, v[0]) for k, v in truth.items()], "sample_id string, who string")
    s = s.join(who, "sample_id").withColumn("contributor_id", F.col("who")).drop("who")
    return features.featured(spark, s, str(root)), truth


def test_features_of_files(spark, intake):
    s, truth = intake
    rows = {r["sample_id"]: r for r in s.collect()}
    assert set(rows) == set(truth) and not rows["k1/torn.png"]["ok"] and rows["k1/torn.png"]["embedding"] is None
    a = pixels.class_image(2, 4)
    r = rows["k2/ok04.png"]
    assert np.allclose(r["embedding"], pixels.embedding(a)) and r["hashes"] == pixels.hashes(a) and np.allclose(r["statistics"], pixels.statistics(a))


def test_detectors_find_what_was_planted(spark, intake):
    s, truth = intake
    planted = lambda fault: {k for k, v in truth.items() if v[1] == fault}
    dup = {r["asset_ref"]: r for r in detectors.near_duplicate(s).collect()}
    assert planted("near_duplicate_flood") <= set(dup)
    r = dup["k0/copy0.png"]
    assert json.loads(r["evidence"])["size"] >= 6 and "C3" in r["reason"] and any(c.isdigit() for c in r["reason"])
    ood = {r["asset_ref"]: r["score"] for r in detectors.ood(s).collect()}
    assert min(ood[k] for k in planted("ood_insertion")) > np.median([v for k, v in ood.items() if not truth[k][1]])
    noise = {r["asset_ref"]: r for r in detectors.label_noise(s).collect()}
    flips = planted("label_flip")
    assert len(noise) == len(truth) - 1 and np.mean([noise[k]["score"] for k in flips]) > 2 * np.mean([r["score"] for k, r in noise.items() if not truth[k][1]])
    assert all(json.loads(noise[k]["evidence"])["majority"] != "k2" for k in flips)
    trig = {r["asset_ref"]: r["score"] for r in detectors.trigger_freq(s).collect()}
    assert np.mean([trig[k] for k in planted("badnets_patch")]) > np.mean([trig[k] for k in trig if not truth[k][1]])
    made = detectors.label_noise(s).unionByName(detectors.near_duplicate(s))
    up = {r["asset_ref"]: r for r in detectors.roll_up(s, made).collect()}
    assert up["C3"]["score"] == max(r["score"] for r in up.values()) and "near_duplicate" in up["C3"]["evidence"]
    assert detectors.roll_up(s, made, "batch_id").count() == 0
    assert detectors.spectral_signature(s.withColumn("activation", F.col("embedding"))).where("unavailable_reason is null").count() > 40


def test_detectors_that_cannot_run_say_so(spark, intake):
    s, _ = intake
    few = s.where("sample_id like '%odd%'")
    for made in (detectors.label_noise(few), detectors.ood(few), detectors.spectral_signature(few.withColumn("activation", F.col("embedding"))), detectors.roll_up(few.withColumn("contributor_id", F.lit(None).cast("string")), few.select(F.lit("x").alias("asset_ref")).limit(0).selectExpr("asset_ref", "'' as asset_type", "'' as disposition", "'' as detector_id", "'' as unavailable_reason"))):
        rows = made.collect()
        assert rows and all(r["unavailable_reason"] and r["score"] == 0 and r["disposition"] == "accept" for r in rows)
    broken = detectors.isolated(spark, "ood", "ood_insertion", lambda: s.select("no_such_column")).collect()
    assert len(broken) == 1 and "AnalysisException" in broken[0]["unavailable_reason"] or "stopped with" in broken[0]["unavailable_reason"]
    assert detectors.near_duplicate(s.limit(0)).count() == 0


def test_close_pairs_and_neighbours_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24))
    v = np.concatenate([base, base[:20] + rng.normal(scale=0.02, size=(20, 24)), base[:10]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, u array<double>")
    sims = v @ v.T
    got = {(r["a"], r["b"]) for r in detectors.close_pairs(df).collect()}
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if sims[i, j] >= detectors.NEAR}
    # copies link to the first of their kind alone
    assert {p for p in want if max(p) < 60} <= got <= want and {(i, 60 + i) for i in range(10)} <= got
    near = outliers.nearest_blocks(df, "id", "u", 5, rows=16).collect()
    for i in range(70):
        order = sorted((j for j in range(70) if j != i), key=lambda j: (-round(sims[i, j], 9), j))[:5]
        assert [r["other"] for r in sorted((r for r in near if r["id"] == i), key=lambda r: r["rank"])] == order


def test_neighbours_of_odd_vectors_equal_a_plain_join(spark, monkeypatch):
    from pyspark.sql import Window as W

    from attestry.functions.vectors import dot, normalized

    rng = np.random.default_rng(3)
    rows = [(f"s{i:03d}", x) for i, x in enumerate(np.round(rng.normal(size=(120, 8)), 1).astype(np.float32).tolist())]
    rows += [("copy", rows[0][1]), ("cope", rows[0][1]), ("zero", [0.0] * 8), ("none", None), ("part", [1.0, None] + [0.0] * 6), ("nan", [float("nan")] + [1.0] * 7), (None, [1.0] * 8), ("s005", rows[9][1])]
    df = spark.createDataFrame(rows, "id string, u array<float>").cache()
    v = df.select("id", normalized(outliers.as_doubles(F.col("u"))).alias("v"))
    p = v.join(v.toDF("other", "w"), F.col("id") != F.col("other")).select("id", "other", F.round(dot(F.col("v"), F.col("w")), 9).alias("similarity"))
    p = p.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "other"))).where("rank <= 9")
    key = lambda x: sorted(repr((r["id"], r["rank"], r["other"], r["similarity"] if r["similarity"] is None else round(r["similarity"], 6) + 0.0)) for r in x.collect())
    want = key(p)
    few = F.col("id").like("%0%") | F.col("id").isin("nan", "none", "zero", "copy")
    near = outliers.nearest(df.where(few), df, "id", "u", 9)
    assert key(outliers.nearest_blocks(df, "id", "u", 9)) == want and key(outliers.nearest_blocks(df, "id", "u", 9, rows=1000)) == want
    assert key(near) == key(p.where(few)) and len(want) > 1000
    # neither a broadcast of the queries nor a product of tables by rows, which compares them component by component
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_block_products_shuffle_as_many_copies_whatever_the_table(spark):
    copies = lambda n: outliers._vectors(spark.range(n).select("id", F.array(*[F.lit(1.0)] * 64).alias("u")), "id", "u", outliers.PARTS)[1]
    assert copies(1000) == copies(900_000) == outliers.PARTS < copies(2_000_000)


def test_hamming_candidates_equal_all_pairs(spark):
    import random

    rng = random.Random(4)
    rows = []
    for i in range(60):
        h = rng.getrandbits(64)
        rows += [(i, h), (i, rng.getrandbits(64)), (100 + i, h ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(5, 12))))]
    signed = [(i, h - (1 << 64) if h >> 63 else h) for i, h in rows]
    got = {(r["a"], r["b"]) for r in similarity.hamming_candidates(spark.createDataFrame(signed, "id long, hash long")).collect()}
    want = {(min(a, b), max(a, b)) for a, x in rows for b, y in rows if a != b and bin(x ^ y).count("1") <= 8}
    assert got == want and 20 < len(want) < 60 and math.isfinite(len(got))


def test_hamming_buckets_in_blocks_equal_all_pairs(spark, monkeypatch):
    import random

    rng = random.Random(1)
    hashes = {rng.getrandbits(64) for _ in range(100)}
    hashes |= {h ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 12))) for h in hashes}
    hashes |= {h ^ (1 << i) for h in [rng.getrandbits(64)] for i in range(50)}  # 49 and 50 of a bucket
    signed = sorted(h - (1 << 64) if h >> 63 else h for h in hashes)
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    u = spark.createDataFrame([(h,) for h in signed], "hash long")
    # a broadcast of the keys is what ended the driver: nothing that grows with the hashes may be one, and each pair is made once
    for most, block in ((8, 8192), (8, 7), (0, 7)):
        monkeypatch.setattr(similarity, "BLOCK", block)
        near = similarity._near(u, most)
        assert sorted(map(tuple, near.collect())) == [(x, y) for i, x in enumerate(signed) for y in signed[i + 1 :] if bits(x, y) <= most]
        assert near._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_large_groups_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(g), int(i), float(x)) for i, (g, x) in enumerate(zip(rng.integers(0, 3, 3000), np.round(rng.normal(size=3000), 2)))]
    df = spark.createDataFrame(rows, "g int, id long, x double")
    get = lambda: ({r["g"]: r["median"] for r in outliers.medians(df, ["g"], F.col("x")).collect()}, {r["id"] for r in outliers.nearest_in_class(df, "g", "x", "id", F.lit(317)).collect()})
    small = get()
    monkeypatch.setattr(outliers, "SMALL", 10)
    assert get() == small and len(small[1]) == 951
    assert small[0][1] == np.median([x for g, _, x in rows if g == 1])
