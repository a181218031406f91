"""Line files: findings, signed logs and answer keys, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import canonical


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log with idx, the place in the file, and malformed, true for a line that isn't an object.

    Readers promise no order, so a log is one whole-text row per file: a file is read by one task, and files in parallel.
    Blank lines are skipped and not counted.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("chain"), F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("l"))
    rows = lines.select("chain", F.posexplode("l").alias("idx", "line"))
    parsed = rows.select("chain", F.col("idx").cast("long").alias("idx"), F.try_parse_json("line").isNull().alias("malformed"), F.from_json("line", schema).alias("r"))
    return parsed.select("chain", "idx", "malformed", "r.*")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, is_poisoned, attack_class, true_label, stored_label, contributor_id) of an answer key's samples: a file, or the folder
    that holds ground_truth.json."""
    from attestry.sources.datasets import exists

    if exists(spark, f"{path}/ground_truth.json"):
        path = f"{path}/ground_truth.json"
    elif not exists(spark, path):
        raise FileNotFoundError(path)
    row = "struct<sample_id:string,is_poisoned:int,attack_class:string,true_label:string,stored_label:string,contributor_id:string>"
    return spark.read.schema(f"samples array<{row}>").json(path, multiLine=True).select(F.explode("samples").alias("s")).select("s.*")


def _lines(batches):
    import pyarrow as pa

    for b in batches:
        # Arrow's own values: a nullable number stays a whole number, not a float
        yield pa.RecordBatch.from_arrays([pa.array([canonical.text({k: v for k, v in row.items() if v is not None}) for row in b.to_pylist()], pa.string())], names=["value"])


def write_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """df as canonical JSON lines; null fields are left out. With an order the files, by name, and their lines follow it."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.mapInArrow(_lines, "value string").write.mode("overwrite").text(path)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of JSON lines with violations, the names of the rules that each breaks; a line that isn't an object breaks 'malformed'."""
    from attestry.operators.detectors import FINDING
    from attestry.operators.findings import violations

    f = spark.read.schema(FINDING + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    v = violations(F.col("score"), F.col("reason"), F.col("unavailable_reason"), F.col("asset_type"))
    return f.withColumn("violations", F.when(F.col("_bad").isNotNull(), F.array(F.lit("malformed"))).otherwise(v)).drop("_bad")


def _show(v) -> str:
    return "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)


def markdown(df: DataFrame, limit: int) -> str:
    """A report table of at most ``limit`` rows; floats have four significant digits, nulls are blank."""
    cell = lambda v: _show(v).replace("|", "\\|").replace("\n", " ")
    rows = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in df.limit(limit).collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def write_table(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """df as CSV with a header, floats with four significant digits, nulls blank. An unknown column is an error."""
    columns = columns or df.columns
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no such columns: {', '.join(missing)}")
    flat = []
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        flat.append(F.when(F.col(c).isNotNull(), F.regexp_replace(F.format_string("%.4g", F.col(c).cast("double")), r"\.?0+$", "")).alias(c) if kind in ("double", "float") else F.col(c).cast("string").alias(c))
    df.select(*flat).write.mode("overwrite").option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)


def read_sweep(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a sweep's JSON lines, without those of cells that failed."""
    return spark.read.schema(schema + ", error string").json(path).where("error is null").drop("error")
