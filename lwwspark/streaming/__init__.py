"""Change feeds as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import CHANGELOG, SYSTEM_TABLES
from ..operators.feed import last_operations
from ..sources.store import Folder


def feed_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A feed's files as they arrive."""
    return spark.readStream.schema(SYSTEM_TABLES[CHANGELOG]).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_last_operations(stream: DataFrame) -> DataFrame:
    """The last operation of every row so far; an entry that comes late loses to those with higher ids."""
    return last_operations(stream)


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every_ms: int | None = None) -> StreamingQuery:
    """Hands each batch, reduced to last operations, to ``apply``; without ``every_ms`` all that is there now, then ends."""

    def batch(df: DataFrame, number: int) -> None:
        apply(last_operations(df), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{every_ms} milliseconds") if every_ms else writer.trigger(availableNow=True)).start()


def _segments(batches: int) -> list[int]:
    """The batches under whose numbers the first ``batches`` of them are kept: one for each one-bit, its lowest folds in the
    batches since the next. So an entry is written again as often as batches double, not once for each."""
    out = []
    while batches:
        out.append(batches - 1)
        batches &= batches - 1
    return out


def _folded(parts: DataFrame) -> DataFrame:
    return parts.groupBy("tableName", "recordId").agg(F.max("last").alias("last"), F.min("pos").alias("pos"))


def maintained_last_operations(spark: SparkSession, feed: str, state: str, checkpoint: str, files_per_batch: int = 1000) -> DataFrame:
    """Brings the last operations that are kept under ``state`` up to the feed's present end, and returns them.

    A batch is written under its number, with the batches that it closes (``_segments``) folded in; one that is run again
    replaces its own result. What it closes goes when the next batch begins, as this one has been committed by then. It can
    be run again at any time, with news or without.
    """
    folder = Folder(spark, state)
    schema = "tableName string, recordId string, last struct<id:bigint,operation:string>, pos bigint"
    read = lambda numbers: spark.read.schema(schema).parquet(*(folder.at(str(n)) for n in numbers))

    def fold(df: DataFrame, number: int) -> None:
        before = _segments(number)
        for name in folder.names():
            if name.isdigit() and int(name) < number and int(name) not in before:
                folder.drop(name)
        new = df.groupBy("tableName", "recordId").agg(F.max(F.struct("id", "operation")).alias("last"), F.min("id").alias("pos"))
        closed = [n for n in before if n not in _segments(number + 1)]
        if closed:
            new = _folded(read(closed).unionByName(new))
        new.write.mode("overwrite").parquet(folder.at(str(number)))

    writer = feed_stream(spark, feed, files_per_batch).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    whole = [int(n) for n in folder.names() if n.isdigit() and folder.exists(f"{n}/_SUCCESS")]
    if not whole:
        return spark.createDataFrame([], "tableName string, recordId string, operation string, pos bigint")
    return _folded(read(_segments(max(whole) + 1))).select("tableName", "recordId", F.col("last.operation").alias("operation"), "pos")


def recent_activity(stream: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Entries by table and hour of their change; later ones than the watermark are dropped."""
    timed = stream.withColumn("at", F.to_timestamp("changedAt"))
    return timed.withWatermark("at", late).groupBy(F.window("at", window), "tableName").agg(F.count("*").alias("n")).select("window.start", "tableName", "n")
