import math

from pyspark.sql import functions as F

from attestry.functions.grading import bounded, p_rate_above, squash, verdict_band
from attestry.operators import graph, logs, metrics, shift


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_posterior_tail(spark):
    r = one(spark, p_rate_above(F.lit(214), F.lit(1200)), p_rate_above(F.lit(3), F.lit(400)), p_rate_above(F.lit(0), F.lit(0)))
    assert r[0] > 0.99 and r[1] < 0.05 and abs(r[2] - 0.95) < 1e-12


def test_bounds_and_bands(spark):
    r = one(spark, bounded(F.lit(-3.0), 2.0), bounded(F.lit(2.0), 2.0, 3.0), squash(F.lit(0.0)), verdict_band(F.lit(float("nan"))), verdict_band(F.lit(0.35)))
    assert tuple(r) == (0.0, 0.5, 0.5, "not measured", "partial")


def test_metrics_extremes(spark):
    df = lambda rows: spark.createDataFrame(rows, "y int, score double")
    assert metrics.auroc(df([(0, 0.1), (1, 0.9)])).first()[0] == 1
    assert metrics.auroc(df([(0, 0.5), (1, 0.5)])).first()[0] == 0.5
    assert math.isnan(metrics.auroc(df([(1, 0.5)])).first()[0])
    assert metrics.auroc(df([(0, 0.1), (1, 0.9), (0, float("nan"))])).first()[0] == 1
    bins = {r["bin"] for r in metrics.reliability_bins(df([(1, 0.3), (1, 0.6), (1, 0.7), (0, 1.0)])).collect()}
    assert bins == {2, 5, 6, 9}


def test_edited_record_breaks_its_own_link_and_the_next(spark):
    rows, prev = [], logs.GENESIS
    for i in range(10):
        rows.append(["c", i, i, prev, f"h{i}", f"n{i}", f"2024-01-{i + 1:02d}"])
        prev = f"h{i}"
    rows[3][4] = "edited"
    got = logs.verify_log(spark.createDataFrame(rows, "chain string, idx long, seq long, prev_hash string, record_hash string, nonce string, ts string")).collect()
    assert [(r["idx"], r["code"]) for r in got] == [(4, logs.CHAIN)]
    rows[5][2] = None
    got = logs.verify_log(spark.createDataFrame(rows, "chain string, idx long, seq long, prev_hash string, record_hash string, nonce string, ts string")).collect()
    assert {(r["idx"], r["code"]) for r in got} == {(4, logs.CHAIN), (5, logs.MALFORMED), (6, logs.CHAIN), (6, logs.GAP)}


def test_classification(spark):
    c = lambda *x: shift.classify(*map(F.lit, x))
    r = one(spark, c(0.01, 0.9, True, True), c(0.5, 0.3, True, False), c(0.5, 0.3, False, False), c(0.5, 0.5, False, False))
    assert tuple(r) == ("NO MEANINGFUL SHIFT", "SUSPICIOUS", "DRIFT", "SUSPICIOUS")


def test_rfc_8032_signatures():
    from attestry.functions import ed25519

    # the RFC's first two test vectors
    for seed, public, message, signature in (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ):
        seed, public, message, signature = map(bytes.fromhex, (seed, public, message, signature))
        assert ed25519.public_key(seed) == public and ed25519.sign(seed, message) == signature
        assert ed25519.verify(public, message, signature)
        assert not ed25519.verify(public, message + b"x", signature)
        assert not ed25519.verify(public, message, signature[:32] + bytes(32))


def test_signatures_of_many_keys_and_of_few():
    import random

    from attestry.functions import ed25519 as ed

    rng = random.Random(5)
    seeds = [rng.randbytes(32) for _ in range(2)] * 70 + [rng.randbytes(32) for _ in range(5)]
    messages = [rng.randbytes(i % 40) for i in range(len(seeds))]
    keys, made = [ed.public_key(s) for s in seeds], ed.sign_all(seeds, messages)
    assert made[:5] == [ed.sign(s, m) for s, m in zip(seeds[:5], messages[:5], strict=True)] and all(ed.verify_all(keys, messages, made))
    # of keys that sign often and of such as don't: an edited message, part, number, one past the order, another form of the point, no key
    one = (1).to_bytes(32, "little")
    for at in (0, len(seeds) - 1):
        key, m, s = keys[at], messages[at], made[at]
        past = s[:32] + (int.from_bytes(s[32:], "little") + ed.ORDER).to_bytes(32, "little")
        odd = [(key, m + b"x", s), (key, m, bytes([s[0] ^ 1]) + s[1:]), (key, m, s[:40] + bytes([s[40] ^ 4]) + s[41:]), (key, m, past), (key, m, s[:63]), (b"k", m, s), (b"\xff" * 32, m, s), (one, m, (ed.P + 1).to_bytes(32, "little") + bytes(32))]
        got = ed.verify_all(*map(list, zip(*odd, *zip(keys, messages, made, strict=True), (one, m, one + bytes(32)), strict=False)))
        assert got == [False] * len(odd) + [True] * (len(seeds) + 1)


def test_custody_reads_its_hops_once(spark):
    from attestry.operators import custody

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(x):
        seen.add(1)
        return x

    rows = spark.range(40).select(F.lit("c").alias("chain"), F.col("id").alias("idx"), F.col("id").cast("string").alias("text"))
    h = custody.chained(rows, "text").select("*", F.lit("a").alias("actor_id"), F.lit("0").alias("input_digest"), F.lit("1").alias("output_digest"), F.lpad("text", 4, "0").alias("ts"), F.lit(None).alias("signature"))
    keys = spark.createDataFrame([("a", bytearray(32))], "actor_id string, key binary")
    got = custody.verify_custody(h.withColumn("signature", F.when(F.col("idx") != 7, slow("text")).cast("binary")), keys).collect()
    assert seen.value in (39, 40) and {r["code"] for r in got if r["idx"] == 7} == {logs.MALFORMED} and len(got) > 80
    assert {r["code"] for r in custody.verify_custody(h, keys).collect()} == {logs.MALFORMED}


def test_canonical_json():
    from attestry.functions import canonical

    assert canonical.text({"b": [1, -0.0, float("nan")], "a": {"é": b"\x01", "s": {2, 1}}}) == '{"a":{"s":[1,2],"é":"01"},"b":[1,0.0,"NaN"]}'
    assert canonical.digest({"a": 1, "b": 2}) == canonical.digest({"b": 2, "a": 1})


def test_intrusions_are_named(spark):
    from attestry.operators import custody

    rows = spark.range(20).select(F.lit("c").alias("chain"), F.col("id").alias("idx"), F.col("id").cast("string").alias("text"))
    log = custody.chained(rows, "text").withColumn("nonce", F.concat(F.lit("n"), "idx")).withColumn("ts", F.lpad("text", 4, "0"))
    codes = lambda x: {r["code"] for r in logs.verify_log(x).collect()}
    assert codes(log) == set()
    assert codes(custody.delete(log, 7)) == {logs.CHAIN, logs.GAP}
    assert codes(custody.replay(log, 3, 9)) == {logs.CHAIN, logs.REPLAY, logs.NONCE, logs.TIME}
    assert codes(custody.reorder(log, 4, 5)) == {logs.CHAIN, logs.GAP, logs.REPLAY, logs.TIME}
    assert codes(custody.alter(log, 6, record_hash="0")) == {logs.CHAIN}


def test_stream_takes_up_what_is_new(spark, tmp_path):
    from attestry.operators import custody
    from attestry.streaming import logs as stream

    rows = spark.range(40).select((F.col("id") % 2).cast("string").alias("chain"), F.col("id").alias("idx"), F.col("id").cast("string").alias("text"))
    log = custody.chained(rows, "text").withColumn("nonce", F.when(F.col("idx") == 30, "n4").otherwise(F.concat(F.lit("n"), "idx"))).withColumn("ts", F.lpad("text", 4, "0")).drop("text")
    log = custody.delete(log, 25)
    for k, part in enumerate(("idx < 20", "idx >= 20")):
        log.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream.verify(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log"), f"{tmp_path}/out", f"{tmp_path}/state")
        assert k in (0, 1)
    got = spark.read.schema(stream.OUT).parquet(*(f"{tmp_path}/out/part={k}" for k in range(3)))
    key = lambda df: sorted((r["chain"], r["idx"], r["code"]) for r in df.collect())
    assert key(got) == key(logs.verify_log(log)) and len(key(got)) == 3


def test_stream_in_triggers_equals_the_batch_and_a_trigger_may_run_again(spark, tmp_path):
    from oracle import DATA

    from attestry.plans.queries import _log
    from attestry.streaming import logs as stream

    log = _log(spark, DATA).withColumn("chain", F.col("chain").cast("string")).withColumn("prev_hash", F.when(F.col("idx") % 41 != 7, F.col("prev_hash"))).cache()
    run = stream._trigger(f"{tmp_path}/out", f"{tmp_path}/state")
    for k, part in enumerate(("idx < 300", "idx >= 300 and idx < 301", "idx >= 301 and idx < 650", "idx >= 650")):
        run(log.where(part), k)
        if k == 2:  # broken off after its files were written
            run(log.where(part), k)
    key = lambda df: sorted((r["chain"], r["idx"], r["seq"], r["code"]) for r in df.collect())
    got = spark.read.schema(stream.OUT).parquet(*(f"{tmp_path}/out/part={k}" for k in range(3)))
    want = key(logs.verify_log(log))
    assert key(got) == want and len({r[3] for r in want}) == 6
    # no line is handed to Python, one by one, and no task has a whole chain
    assert "FlatMapGroups" not in stream.order_failures(log.where(logs.well_formed()), spark.createDataFrame([], stream.ENDS))[0]._jdf.queryExecution().toString()


def test_running_sums_over_hot_values(spark):
    from attestry.operators.ordered import ranged, running

    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") % 11).cast("double").alias("v"), F.lit(1).alias("one"))
    got = running(ranged(df, "v", "id", 8), {"r": "one"}, ["v", "id"]).collect()
    assert [r["r"] for r in sorted(got, key=lambda r: (r["v"], r["id"]))] == list(range(1, 3001))
    assert len({r["_b"] for r in got}) > 8


def test_canonical_udf(spark):
    from attestry.functions import canonical

    df = spark.createDataFrame([('{"b": 1.50, "a": [true, null]}',), ("no",), (None,)], "j string")
    assert [r[0] for r in df.select(canonical.canonical_udf()("j")).collect()] == ['{"a":[true,null],"b":1.5}', None, None]


def test_rows_only_queries(spark):
    import numpy as np
    from oracle import DATA

    from attestry.operators.resampling import _beta_tail, mmd
    from attestry.plans.registry import QUERIES

    for r in QUERIES["beta_credible_interval"](spark, DATA).collect():
        assert 0 <= r["low"] < r["high"] <= 1
    # Beta(1, n) and Beta(n, 1) have closed forms
    x = np.array([0.01, 0.2, 0.9])
    assert np.allclose(_beta_tail(np.ones(3), np.full(3, 7.0), x), 1 - (1 - x) ** 7) and np.allclose(_beta_tail(np.full(3, 7.0), np.ones(3), x), x**7)
    a, b = QUERIES["auroc"](spark, DATA).first()[0], QUERIES["bootstrap_auroc"](spark, DATA).first()
    assert b["low"] < a < b["high"] and b["n_draws"] == 200
    c = sorted((r["score"], r["calibrated"]) for r in QUERIES["isotonic_calibration"](spark, DATA).collect())
    assert all(x[1] <= y[1] + 1e-12 for x, y in zip(c, c[1:], strict=False))
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").where("label = 1").toPandas()
    v = np.array(e["embedding"].tolist(), float)
    want = dict(zip(e["vec_id"], np.abs((v - v.mean(axis=0)) @ np.linalg.svd(v - v.mean(axis=0))[2][0]), strict=True))
    got = {r["id"]: r["projection"] for r in QUERIES["spectral_projection"](spark, DATA).where("label = 1").collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 for k in got)
    rng = np.random.default_rng(1)
    assert mmd(rng.normal(size=(60, 4)), rng.normal(size=(60, 4)) + 2)[1] < 0.01 < mmd(rng.normal(size=(60, 4)), rng.normal(size=(60, 4)))[1]


def test_image_sources(spark, tmp_path):
    import json

    from attestry.sources import images, records

    for p in ("set/cat/a b.png", "set/cat/c+d.JPG", "set/dog/x.png", "set/top.png", "set/dog/notes.txt", "y/images/train/a.png", "y/images/train/b.png", "y/images/c.png"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    key = lambda df: sorted((r["sample_id"], r["label"], r["batch_id"]) for r in df.collect())
    assert key(images.image_folder(spark, f"{tmp_path}/set")) == [("cat/a b.png", "cat", None), ("cat/c+d.JPG", "cat", None), ("dog/x.png", "dog", None), ("top.png", None, None)]
    (tmp_path / "y/labels/train").mkdir(parents=True)
    (tmp_path / "y/labels/train/a.txt").write_text("1 .5 .5 .1 .1\nbad line\n0 .5 .5 .1 .1\n1.0 .5 .5 .1 .1\n")
    (tmp_path / "y/labels/c.txt").write_text("7 .5 .5 .1 .1\n0 .1 .1 .1 .1\n")
    assert key(images.yolo(spark, f"{tmp_path}/y", {0: "car", 1: "van"})) == [("images/c.png", "7", None), ("images/train/a.png", "van", "train"), ("images/train/b.png", None, "train")]
    doc = {"images": [{"id": 1, "file_name": "a.png", "contributor_id": "C0"}, {"id": 2, "file_name": "b.png"}], "annotations": [{"image_id": 1, "category_id": 9}, {"image_id": 1, "category_id": 3}], "categories": [{"id": 3, "name": "car"}]}
    (tmp_path / "coco.json").write_text(json.dumps(doc))
    assert key(images.coco(spark, f"{tmp_path}/coco.json")) == [("a.png", "9", None), ("b.png", None, None)]
    (tmp_path / "map.json").write_text(json.dumps({"a": "C1", "C2": ["b", "c"]}))
    assert sorted(map(tuple, images.contributor_map(spark, f"{tmp_path}/map.json").collect())) == [("a", "C1"), ("b", "C2"), ("c", "C2")]
    (tmp_path / "log.jsonl").write_text('{"seq": 0, "nonce": "n"}\n\nnot json\n{"seq": 2}\n')
    got = records.read_log(spark, f"{tmp_path}/log.jsonl", "seq long, nonce string").orderBy("idx").collect()
    assert [(r["idx"], r["malformed"], r["seq"]) for r in got] == [(0, False, 0), (1, True, None), (2, False, 2)]
    records.write_lines(spark.createDataFrame([(1, None, 0.5)], "b long, a string, c double"), f"{tmp_path}/lines")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/lines").collect()] == ['{"b":1,"c":0.5}']
    assert records.markdown(spark.createDataFrame([(1, 0.123456)], "n int, x double"), 5).endswith("| 1 | 0.1235 |")


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (7, 7)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}
