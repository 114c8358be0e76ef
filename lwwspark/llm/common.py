"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, forget, remove, scratch, shared_dir

BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_small_batches(df: DataFrame) -> DataFrame:
    """Texts go to Python ``BATCH_ROWS`` at a time, and ``BATCH_BYTES``: memory follows the batch, and texts may be long.

    Spark has these bounds in the session only, and reads them when a plan runs, so they stay: a bound that the caller has
    set lower, or for bytes at all, is kept.
    """
    conf, rows, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    if conf.get(size) == "67108864b":  # its default
        conf.set(size, BATCH_BYTES)
    return df


def fold_of(doc_id: str, folds: int):
    """crc32 of the decimal id, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


__all__ = ["by_small_batches", "cut", "fold_of", "forget", "fresh", "remove", "scratch", "shared_dir", "table"]
