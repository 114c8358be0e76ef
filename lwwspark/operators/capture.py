"""Change capture: what writing to a replica adds to its feed and tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered
from .tombstones import replaced


def operations(table: str, ops: DataFrame, now: str, base: int, order: list[str]) -> DataFrame:
    """Feed entries for operations (recordId, operation) that were made, in ``order``."""
    rows = ops.select(F.lit(table).alias("tableName"), "recordId", "operation", F.lit(now).alias("changedAt"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    return numbered(rows, [f"_o{i}" for i in range(len(order))], "id", base).select("id", "tableName", "recordId", "operation", "changedAt")


def difference(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """recordId, operation from two states of a table. Updates that change nothing leave no trace, unlike in ``operations``."""
    o = old.select(F.col(key).alias("_ok"), F.struct(*(c for c in old.columns)).alias("_o"))
    n = new.select(F.col(key).alias("_nk"), F.struct(*(c for c in old.columns)).alias("_n"))
    both = o.join(n, F.col("_ok") == F.col("_nk"), "full")
    what = F.when(F.col("_ok").isNull(), "INSERT").when(F.col("_nk").isNull(), "DELETE").when(~F.col("_o").eqNullSafe(F.col("_n")), "UPDATE")
    return both.select(F.coalesce("_nk", "_ok").alias("recordId"), what.alias("operation")).where("operation is not null")


def buried(tombstones: DataFrame, table: str, ops: DataFrame, now: str) -> DataFrame:
    """Tombstones after the deletions among operations."""
    gone = ops.where(F.col("operation") == "DELETE").select(F.lit(table).alias("tableName"), "recordId", F.lit(now).alias("deletedAt")).distinct()
    return replaced(tombstones, gone, ["tableName", "recordId"])


def heartbeat(held: DataFrame, value: str, record_id: str) -> DataFrame:
    """The heartbeat row after a beat: it only moves forward."""
    beat = held.sparkSession.createDataFrame([(record_id, value)], held.schema)
    return held.unionByName(beat).groupBy("id").agg(F.max("updatedAt").alias("updatedAt"))
