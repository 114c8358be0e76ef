"""Consecutive ids in a global order without sending all rows to one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def numbered(df: DataFrame, order: list, name: str, base: int = 0) -> DataFrame:
    """Adds ``name``: base + 1, base + 2, ... in ``order``. Range partitions are sorted apart; each starts where the one before ends.

    One count for each partition reaches the driver, and goes back as an array that is indexed by the partition's number.
    """
    place = F.monotonically_increasing_id()
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place))
    part = F.shiftright("_place", 33).cast("int")
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("part")).count().collect()}
    if not sizes:
        out = placed.withColumn(name, F.lit(None).cast("bigint")).drop("_place")
    else:
        starts = list(accumulate((sizes.get(p, 0) for p in range(max(sizes))), initial=base))
        begin = F.element_at(F.lit(starts).cast("array<bigint>"), part + 1)
        out = placed.withColumn(name, begin + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_place")
    out._cut_path = placed._cut_path
    return out


