"""Labelled image sets as samples (sample_id, image_path, label, contributor_id, batch_id), one row per image.

Listings and annotation files are read by Spark; image bytes aren't, until something asks for them. Of a label that several
objects share the most frequent counts, on a tie the first seen. Ids are paths under the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators.rollup import modal

# What counts as an image.
SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")
SAMPLE = ["sample_id", "image_path", "label", "contributor_id", "batch_id"]


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, rel) of the files under root; content is a column that no plan here reads."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    top = root.split(":", 1)[-1].rstrip("/") + "/"
    rel = F.element_at(F.split(F.col("path"), "\\Q" + top + "\\E", 2), 2)
    return df.withColumn("rel", F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B")))).where(F.rlike(F.lower("rel"), F.lit(pattern)))


def _images(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root, r"\.(?:" + "|".join(s[1:] for s in SUFFIXES) + r")$")


def _none() -> Column:
    return F.lit(None).cast("string")


def image_folder(spark: SparkSession, root: str) -> DataFrame:
    """The label is the first folder, where there is one."""
    parts = F.split("rel", "/")
    return _images(spark, root).select(F.col("rel").alias("sample_id"), F.col("path").alias("image_path"), F.when(F.size(parts) > 1, parts[0]).alias("label"), _none().alias("contributor_id"), _none().alias("batch_id"))


_COCO = "images array<struct<id:long,file_name:string,contributor_id:string,batch_id:string>>, annotations array<struct<image_id:long,category_id:long>>, categories array<struct<id:long,name:string>>"


def coco(spark: SparkSession, annotations: str) -> DataFrame:
    """One annotation file, or a folder of such. A category without a name is called by its id; an image without objects has no label."""
    doc = spark.read.schema(_COCO).json(annotations, multiLine=True)
    part = lambda c, *more: doc.select(F.posexplode(c).alias("at", "x")).select("at", "x.*")
    names = part("categories").groupBy(F.col("id").alias("category_id")).agg(F.min("name").alias("name"))
    objects = part("annotations").join(names, "category_id", "left").withColumn("label", F.coalesce("name", F.col("category_id").cast("string")))
    labels = modal(objects, "image_id", "label", "at").select(F.col("image_id").alias("id"), "label")
    images = part("images").join(labels, "id", "left")
    name = F.coalesce("file_name", F.col("id").cast("string"))
    return images.select(name.alias("sample_id"), F.col("file_name").alias("image_path"), "label", "contributor_id", "batch_id")


def yolo(spark: SparkSession, root: str, names: dict[int, str] | None = None) -> DataFrame:
    """Label lines are in labels/, beside images/. Lines that don't start with a number are passed over; the split is the batch."""
    images = _images(spark, root).withColumn("key", F.regexp_replace(F.regexp_replace("rel", r"(^|.*/)images/", "$1labels/"), r"\.[^.]*$", ".txt"))
    top = root.split(":", 1)[-1].rstrip("/") + "/"
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    lines = lines.select(F.url_decode(F.replace(F.element_at(F.split(F.col("_metadata.file_path"), "\\Q" + top + "\\E", 2), 2), F.lit("+"), F.lit("%2B"))).alias("key"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    cid = F.try_to_number(F.regexp_extract("line", r"^\s*(-?\d+)(?:\.\d*)?(?:\s|$)", 1), F.lit("S999999999")).cast("long")
    known = F.create_map(*(F.lit(x) for k, v in (names or {}).items() for x in (k, v))) if names else F.create_map().cast("map<bigint,string>")
    objects = lines.withColumn("cid", cid).where("cid is not null").withColumn("label", F.coalesce(F.try_element_at(known.cast("map<bigint,string>"), F.col("cid")), F.col("cid").cast("string")))
    labels = modal(objects, "key", "label", "at").select("key", "label")
    parts = F.split("rel", "/")
    return images.join(labels, "key", "left").select(F.col("rel").alias("sample_id"), F.col("path").alias("image_path"), "label", _none().alias("contributor_id"), F.when((F.size(parts) > 2) & (parts[0] == "images"), parts[1]).alias("batch_id"))


def contributor_map(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, contributor) of a JSON object {id: contributor}, {contributor: [ids]}, or both mixed."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    ids = F.from_json("v", "array<string>")
    listed = F.startswith(F.ltrim("v"), F.lit("["))
    pair = F.when(listed, F.transform(ids, lambda i: F.struct(i.alias("sample_id"), F.col("k").alias("contributor")))).otherwise(F.array(F.struct(F.col("k").alias("sample_id"), F.col("v").alias("contributor"))))
    return whole.select(F.explode(pair).alias("p")).select("p.*")
