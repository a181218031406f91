"""Image sets as they lie on disk: which layout it is, its samples, who sent them, and what is missing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import findings
from attestry.sources import images

# Where annotation files are looked for, in this order, and which JSON files are none.
ANNOTATIONS = ("instances*.json", "annotations/instances*.json", "annotations/*.json", "*.json")
OTHERS = ("contributors.json", "ground_truth.json", "run_manifest.json")
#: Folders under the root, and beside the annotations, that may hold an annotated image.
BASES = ("", "images/", "train/", "val/", "annotations/")


@dataclass(frozen=True)
class Dataset:
    root: str
    layout: str
    samples: DataFrame
    limitations: list[str] = field(default_factory=list)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _glob(spark: SparkSession, root: str, pattern: str) -> list[str]:
    fs, p = _fs(spark, f"{root.rstrip('/')}/{pattern}")
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [] if s.isFile())


def annotation_files(spark: SparkSession, root: str) -> list[str]:
    """The annotation files of the first pattern that matches any."""
    for pattern in ANNOTATIONS:
        found = [f for f in _glob(spark, root, pattern) if f.rpartition("/")[2] not in OTHERS]
        if found:
            return found
    return []


def detect_format(spark: SparkSession, root: str) -> str:
    """coco, yolo or folder: the first that fits. Only folders near the root are listed."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        raise FileNotFoundError(root)
    if annotation_files(spark, root):
        return "coco"
    if yaml_file(spark, root) or exists(spark, f"{root}/labels"):
        return "yolo"
    if any(s.isDirectory() or s.getPath().getName().lower().endswith(images.SUFFIXES) for s in fs.listStatus(p)):
        return "folder"
    raise ValueError(f"no known layout under {root}")


def yaml_file(spark: SparkSession, root: str) -> str | None:
    found = _glob(spark, root, "data.yaml") or _glob(spark, root, "*.yaml") or _glob(spark, root, "*.yml")
    return found[0] if found else None


def yolo_names(spark: SparkSession, root: str) -> dict[int, str]:
    """Class names of data.yaml: a mapping or a list; none where there is no such file."""
    import yaml

    path = yaml_file(spark, root)
    if not path:
        return {}
    names = (yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {}).get("names") or {}
    return {int(k): str(v) for k, v in (names.items() if isinstance(names, dict) else enumerate(names))}


def resolve_paths(spark: SparkSession, samples: DataFrame, root: str) -> DataFrame:
    """samples with image_path made a file under the root: the first of ``BASES`` under which there is one; null where there is none."""
    files = images._images(spark, root).select("path", "rel")
    names = F.array(*(F.struct(F.lit(i).alias("rank"), F.concat(F.lit(b), F.col("image_path")).alias("rel")) for i, b in enumerate(BASES)))
    tried = samples.where(F.col("image_path").isNotNull()).select("sample_id", F.explode(names).alias("t")).select("sample_id", "t.rank", "t.rel").join(files, "rel")
    found = tried.groupBy("sample_id").agg(F.min_by("path", "rank").alias("_found"))
    return samples.join(found, "sample_id", "left").withColumn("image_path", F.col("_found")).drop("_found")


def load_dataset(spark: SparkSession, root: str, layout: str | None = None, contributors: str | None = None, pattern: str | None = None) -> Dataset:
    """Samples of a set with who sent them: by a map (root/contributors.json where none is named), a pattern in the path, or the set itself.

    Samples whose file is missing are left out, and counted among the limitations.
    """
    layout = layout or detect_format(spark, root)
    if layout == "coco":
        s = images.coco(spark, annotation_files(spark, root)[0])
        s = resolve_paths(spark, s, root)
    elif layout == "yolo":
        s = images.yolo(spark, root, yolo_names(spark, root))
    elif layout == "folder":
        s = images.image_folder(spark, root)
    else:
        raise ValueError(f"unknown layout {layout}")
    if contributors is None and exists(spark, f"{root}/contributors.json"):
        contributors = f"{root}/contributors.json"
    if contributors or pattern:
        named = images.contributor_map(spark, contributors) if contributors else spark.createDataFrame([], "sample_id string, contributor string")
        s = findings.attach_contributors(s, named, pattern or r"(?!)()", "sample_id")
    total, lost, labelled, sent = s.agg(F.count("*"), F.count_if(F.col("image_path").isNull()), F.count("label"), F.count("contributor_id")).first()
    notes = []
    if sent < total:
        notes.append(f"{total - sent} of {total} images don't name who sent them.")
    if not labelled:
        notes.append(f"None of {total} images has a label.")
    if lost:
        notes.append(f"{lost} of {total} images are named but missing.")
    return Dataset(root, layout, s.where(F.col("image_path").isNotNull()).select(*images.SAMPLE), notes)
