"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.session import shared_path, stored  # noqa: F401

#: A word: a run of characters other than space, tab, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Tables of at most this many bytes are broadcast; their rows are counted, and what varies in length is measured, first.
BROADCAST_BYTES = 48_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maybe_broadcast(df: DataFrame, rows: int, more_bytes: int = 0, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows, at 96 bytes each and what is given on top, are few enough; otherwise Spark shuffles."""
    return F.broadcast(df) if 96 * rows + more_bytes <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores put before it until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc(col: str) -> Column:
    """CRC-32 of a column's text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def replace_columns(batch, names, arrays):
    """An Arrow batch with these columns put in, in place of any that have the same names."""
    import pyarrow as pa

    keep = [i for i, n in enumerate(batch.schema.names) if n not in names]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + list(arrays), names=[batch.schema.names[i] for i in keep] + list(names))


def tidied(f):
    """f, a function of Arrow batches, that gives memory back when a task ends, and before it starts what a former one left, such as its
    broadcast values: a Python worker lives on and serves others."""

    def give_back():
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    def run(batches):
        give_back()
        try:
            yield from f(batches)
        finally:
            give_back()

    return run
