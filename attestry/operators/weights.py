"""Models by their weights and answers: statistics and digests of layers, comparison with what was enrolled, and fingerprints.

Weights are a table (name, shape array<int>, at, value): one row for each number, or (name, shape, values array<double>) with a row
for each layer. Answers are a table (probe, output array<double>).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.grading import bounded
from attestry.functions.vectors import dot, norm
from attestry.operators import detectors, layers

# Fixed values of the output contract.
PROBES, SAME, FAR = 200, 1e-7, 1e-3


def _described(batches):
    import hashlib

    import pyarrow as pa

    for b in batches:
        rows = []
        for name, shape, values in zip(*(c.to_pylist() for c in b.columns), strict=True):
            v = np.array(values, np.float64)
            m = v.reshape(shape[0], -1) if len(shape) > 1 and v.size else v.reshape(-1, 1)
            digest = hashlib.sha256(f"{name}|{'x'.join(map(str, shape))}|".encode() + v.astype("<f8").tobytes()).hexdigest()
            rows.append((name, float(np.linalg.norm(m, 2)) if v.size else 0.0, digest))
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.string()), strict=True)], names=["name", "spectral_norm", "digest"])


def layer_record(weights: DataFrame) -> DataFrame:
    """(name, shape, n, mean, std, absmax, kurtosis, spectral_norm, digest) of (name, shape, values). A layer is one task's row."""
    stats = layers.layer_stats(weights.select("name", F.explode("values").alias("value")))
    more = weights.select("name", "shape", "values").mapInArrow(_described, "name string, spectral_norm double, digest string")
    return weights.select("name", "shape").join(stats, "name", "left").join(more, "name")


def weight_digest(record: DataFrame) -> DataFrame:
    """(digest): one digest of all layers, in the order of their names."""
    return record.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda x: F.concat(x["name"], F.lit(":"), x["digest"])), "\n"), 256).alias("digest"))


def compare_weights(observed: DataFrame, enrolled: DataFrame | None, model: str = "model") -> DataFrame:
    """One finding: equal digests score 0, any other 1, with the layers that differ most."""
    spark = observed.sparkSession
    if enrolled is None:
        return detectors.unavailable(spark, "weight_digest", "model_perturb", "0 records of this model are enrolled.", model, "model", 1)
    same = weight_digest(observed).first()[0] == weight_digest(enrolled).first()[0]
    diff = layers.diff_layers(observed, enrolled)
    n = observed.join(enrolled.select("name", F.col("digest").alias("_d")), "name", "full").where(~F.col("digest").eqNullSafe(F.col("_d"))).count()
    worst = diff.orderBy(F.desc(F.abs(F.coalesce("mean_shift", F.lit(float("inf")))) + F.abs(F.coalesce("std_change", F.lit(float("inf"))))), "name").limit(5).collect()
    names = ", ".join(r["name"] for r in worst)
    reason = "All weights equal the enrolled ones: 0 layers differ." if same else f"{n} layers differ from the enrolled ones" + (f", most of all {names}." if names else ".")
    one = spark.createDataFrame([(0.0 if same else 1.0, reason, n)], "s double, r string, n long")
    return detectors.findings(one, "weight_digest", "model_perturb", F.lit(model), F.col("s"), F.col("r"), {"n_changed": F.col("n")}, "model", 1)


def weight_stats(weights: DataFrame, model: str = "model") -> DataFrame:
    """One finding about the head, the last matrix by name: an output whose weights stand out, and tails heavier than other layers'."""
    from attestry.operators.outliers import robust_z

    spark = weights.sparkSession
    heads = weights.where((F.size("shape") == 2) & (F.size("values") > 16)).agg(F.max("name")).first()[0]
    if heads is None:
        return detectors.unavailable(spark, "weight_stats", "model_backdoor", "0 layers are a matrix of more than 16 weights.", model, "model", 1)
    stats = layers.layer_stats(weights.where((F.size("shape") == 2) & (F.size("values") > 16)).select("name", F.explode("values").alias("value")))
    own, others = stats.agg(F.max(F.when(F.col("name") == heads, F.col("kurtosis"))), F.median(F.when(F.col("name") != heads, F.col("kurtosis")))).first()
    tail = max(0.0, (own or 0.0) - (others or 0.0))
    h = weights.where(F.col("name") == heads).select("shape", F.posexplode("values").alias("at", "v"))
    rows = F.when(F.get("shape", F.lit(0)) <= F.get("shape", F.lit(1)), F.floor(F.col("at") / F.get("shape", F.lit(1)))).otherwise(F.col("at") % F.get("shape", F.lit(1)))
    sums = h.groupBy(rows.cast("int").alias("row")).agg(F.sum(F.abs("v")).alias("mass")).withColumn("_all", F.lit(1))
    top = robust_z(sums, "mass", "_all").agg(F.max(F.struct("z", -F.col("row"))).alias("m")).select(F.col("m.z").alias("z"), (-F.col("m.col2")).alias("row"))
    s = bounded(0.15 * F.lit(tail) + 0.8 * F.greatest(F.col("z"), F.lit(0.0)), 3.5)
    reason = F.concat(F.lit("Output "), F.col("row").cast("string"), F.lit(" of the last layer has weights that stand "), F.format_string("%.1f", "z"), F.lit(" times the usual spread above the others'."))
    return detectors.findings(top, "weight_stats", "model_backdoor", F.lit(model), s, reason, {"row": F.col("row"), "z": F.col("z"), "tail": F.lit(tail)}, "model", 1, 0.45, F.when(s >= 0.5, "review").otherwise("accept"))


def probes(spark: SparkSession, shape: tuple[int, ...], n: int = PROBES, seed: int = 0) -> DataFrame:
    """(probe, values): seeded uniform inputs, the same on any cluster."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([np.random.default_rng((seed, i)).random(int(np.prod(shape))).tolist() for i in ids], pa.list_(pa.float64()))], names=["probe", "values"])

    return spark.range(n).mapInArrow(run, "probe long, values array<double>")


def answered(inputs: DataFrame, model: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> DataFrame:
    """(probe, output): a model's answers, a batch at a time. model is any function of an array (n, *shape); it is sent to executors."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, *shape)
            y = np.asarray(model(x), np.float64).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y.tolist(), pa.list_(pa.float64()))], names=["probe", "output"])

    return inputs.mapInArrow(run, "probe long, output array<double>")


def onnx_model(raw: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """An ONNX file's model as a function; the session is opened on the executor that first calls it."""
    opened = {}

    def run(x: np.ndarray) -> np.ndarray:
        if "s" not in opened:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            opened["s"] = onnxruntime.InferenceSession(raw, options, providers=["CPUExecutionProvider"])
        s = opened["s"]
        return s.run(None, {s.get_inputs()[0].name: x.astype(np.float32)})[0]

    return run


def compare_fingerprints(observed: DataFrame, enrolled: DataFrame | None, model: str = "model") -> DataFrame:
    """One finding from answers (probe, output) to the same probes: the cosine distance of all answers, each at length 1, on a logarithmic
    scale from 1e-7 (score 0) to 1e-3 (score 1); answers of another shape score 1."""
    spark = observed.sparkSession
    if enrolled is None:
        return detectors.unavailable(spark, "fingerprint", "model_substitute", "0 fingerprints of this model are enrolled.", model, "model")
    largest = lambda v: F.array_position(v, F.array_max(v))
    j = observed.join(enrolled.select("probe", F.col("output").alias("known")), "probe", "full")
    each = j.select(
        (F.size("output").eqNullSafe(F.size("known"))).alias("fits"), F.when(F.size("output") == F.size("known"), dot(F.col("output"), F.col("known")) / ((norm(F.col("output")) + 1e-12) * (norm(F.col("known")) + 1e-12))).alias("cosine"),
        (largest(F.col("output")) == largest(F.col("known"))).alias("agrees"),
    )
    t = each.agg(F.bool_and("fits").alias("fits"), (1 - F.avg("cosine")).alias("distance"), F.avg(F.col("agrees").cast("double")).alias("agreement"), F.count("*").alias("n"))
    d = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.coalesce("distance", F.lit(2.0))))
    ramp = (F.log10(F.greatest(d, F.lit(SAME))) - F.log10(F.lit(SAME))) / (F.log10(F.lit(FAR)) - F.log10(F.lit(SAME)))
    s = F.when(~F.coalesce("fits", F.lit(False)), 1.0).when(d < SAME, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ramp)))
    reason = F.when(~F.coalesce("fits", F.lit(False)), "The answers have another shape than the 1 enrolled.").otherwise(F.concat(F.lit("Over "), F.col("n").cast("string"), F.lit(" probes the answers lie "), F.format_string("%.2g", d), F.lit(" from the enrolled ones; "), F.format_string("%.1f", 100 * F.col("agreement")), F.lit(" % name the same class.")))
    return detectors.findings(t, "fingerprint", "model_substitute", F.lit(model), s, reason, {"distance": d, "agreement": F.col("agreement")}, "model")
