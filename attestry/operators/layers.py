"""Statistics of weight layers (name, value) and their difference from an enrolled record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layer_stats(values: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """(name, n, mean, std, absmax, kurtosis): population deviation and excess kurtosis, 0 for three values or fewer."""
    v = F.col(value).cast("double")
    return values.groupBy(name).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.max(F.abs(v)).alias("absmax"),
        F.when(F.count("*") > 3, F.coalesce(F.kurtosis(v), F.lit(0.0))).otherwise(0.0).alias("kurtosis"),
    )


def diff_layers(observed: DataFrame, enrolled: DataFrame, name: str = "name") -> DataFrame:
    """(name, status, mean_shift, std_change): changed, new and removed layers, in enrolled deviations."""
    o, e = observed.select(name, F.col("mean").alias("m1"), F.col("std").alias("s1")), enrolled.select(name, F.col("mean").alias("m0"), F.col("std").alias("s0"))
    j = o.join(e, name, "full")
    unit = F.when(F.col("s0") > 0, F.col("s0")).otherwise(1.0)
    status = F.when(F.col("m0").isNull(), "new").when(F.col("m1").isNull(), "removed").when((F.col("m0") == F.col("m1")) & (F.col("s0") == F.col("s1")), "unchanged").otherwise("changed")
    return j.select(name, status.alias("status"), ((F.col("m1") - F.col("m0")) / unit).alias("mean_shift"), ((F.col("s1") - F.col("s0")) / unit).alias("std_change")).where("status <> 'unchanged'")
