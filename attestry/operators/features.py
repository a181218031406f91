"""Images to features, one pass over the decoded pixels.

Spark's image source decodes in the JVM; a vectorised function computes all features of an image at once, so pixels cross
to Python once and never leave the task. Features are keyed by the content's digest: copies of an image are computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.session import stored

FEATURES = "image_path string, ok boolean, embedding array<double>, hashes array<long>, energy double, tiles array<double>, statistics array<double>"


def _measured(batches):
    import pyarrow as pa

    from attestry.functions import pixels

    kinds = (pa.string(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    names = [c.split()[0] for c in FEATURES.split(", ")]
    for b in batches:
        rows = []
        for path, h, w, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            a = pixels.from_spark(h, w, n, data)
            if a is None:
                rows.append((path, False, None, None, None, None, None))
                continue
            small = pixels.resized(a, pixels.SIDE)
            g = pixels.resized(pixels.grey(a), pixels.SIDE) / 255.0
            rows.append((path, True, pixels.embedding(small).tolist(), pixels.hashes(a), pixels.high_frequency_share(g), pixels.tile_contrast(g).tolist(), pixels.statistics(small)))
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def image_features(spark: SparkSession, root: str) -> DataFrame:
    """(image_path, ok, embedding, hashes, energy, tiles, statistics) of the images under root; ok is false, and the rest null, where one can't be decoded."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(root)
    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(_measured, FEATURES)


def featured(spark: SparkSession, samples: DataFrame, root: str) -> DataFrame:
    """samples (sample_id, image_path, ...) with their features, stored once: all detectors read that table."""
    name = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    f = image_features(spark, root).withColumn("_path", name(F.col("image_path"))).drop("image_path")
    return stored(samples.withColumn("_path", name(F.col("image_path"))).join(f, "_path", "left").drop("_path"), "features")
