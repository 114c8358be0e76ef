"""The change feed: incremental reads, gaps, last operation for each key, retention, appending another replica's feed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import TableConfig
from .numbering import numbered

COLUMNS = ["id", "tableName", "recordId", "operation", "changedAt"]


def read_since(feed: DataFrame, since: int) -> DataFrame:
    """Entries after an offset; the filter and the five columns reach the scan."""
    return feed.where(F.col("id") > since).select(*COLUMNS)


def max_id(feed: DataFrame) -> DataFrame:
    """max_id: 0 for an empty feed."""
    return feed.agg(F.coalesce(F.max("id"), F.lit(0)).alias("max_id"))


def min_id(feed: DataFrame) -> DataFrame:
    return feed.agg(F.min("id").alias("min_id"))


def gap(last_seen: Column, least: Column) -> Column:
    """Whether entries may be missing: never at the first contact; always in an emptied feed; else if the feed begins later."""
    return F.when(F.coalesce(last_seen, F.lit(0)) == 0, False).when(least.isNull(), True).otherwise(least > last_seen)


def beginnings(feeds: DataFrame) -> DataFrame:
    """remote, min_id of feeds (remote, id). A replica's manifest says the same without reading its feed."""
    return feeds.groupBy("remote").agg(F.min("id").alias("min_id"))


def offsets(state: DataFrame, remotes: DataFrame) -> DataFrame:
    """remote, last_seen: how far each remote's feed has been read, 0 at the first contact. ``state``: remoteClientId, lastSeenId."""
    seen = state.select(F.col("remoteClientId").alias("_of"), "lastSeenId")
    return remotes.select("remote").join(seen, F.col("remote") == F.col("_of"), "left").select("remote", F.coalesce("lastSeenId", F.lit(0).cast("bigint")).alias("last_seen"))


def gaps(least: DataFrame, offsets: DataFrame) -> DataFrame:
    """remote, last_seen, min_id, has_gap for all remotes at once. ``least``: remote, min_id. ``offsets``: remote, last_seen."""
    return offsets.join(least, "remote", "left").select("remote", "last_seen", "min_id", gap(F.col("last_seen"), F.col("min_id")).alias("has_gap"))


def last_operations(feed: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """tableName, recordId, operation (the last), pos (id of the first entry, which keeps the key's turn). ``by``: columns
    that tell several feeds apart."""
    return feed.groupBy(*by, "tableName", "recordId").agg(F.max_by("operation", "id").alias("operation"), F.min("id").alias("pos"))


def retained(feed: DataFrame, since: str) -> DataFrame:
    """Entries not older than ``since``; times compare as text."""
    return feed.where(F.col("changedAt") >= since)


def expired(feed: DataFrame, since: str) -> DataFrame:
    return feed.agg(F.count(F.when(F.col("changedAt") < since, 1)).alias("expired"))


def appended(local: DataFrame, remote: DataFrame, since: str, base: int) -> DataFrame:
    """The local feed and the remote's recent entries under new ids from ``base`` + 1 on, in their order; nothing is dropped twice."""
    new = numbered(retained(remote, since).withColumnRenamed("id", "_id"), ["_id"], "id", base)
    return local.select(*COLUMNS).unionByName(new.select(*COLUMNS))


def in_scope(feed: DataFrame, tables: Iterable[TableConfig]) -> DataFrame:
    """Entries of configured tables; deletions in protected tables go."""
    tables = list(tables)
    known = F.col("tableName").isin([t.name for t in tables])
    guarded = F.col("tableName").isin([t.name for t in tables if t.delete_protected])
    return feed.where(known & ~(guarded & (F.col("operation") == "DELETE")))


def resolved(entries: DataFrame, rows: DataFrame, key: str, by: Iterable[str] = ()) -> DataFrame:
    """Entries with the row that the remote holds now; entries whose row is gone fall out, deletions need none. ``by``:
    columns of both that tell several remotes apart."""
    by = list(by)
    held = rows.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in by), F.struct(*(c for c in rows.columns if c not in by)).alias("row"))
    same = F.col("recordId") == F.col("_key")
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    alive = entries.where(F.col("operation") != "DELETE").join(held, same).drop("_key", *(f"_{c}" for c in by))
    gone = entries.where(F.col("operation") == "DELETE")
    return alive.unionByName(gone.withColumn("row", F.lit(None).cast(alive.schema["row"].dataType)))
