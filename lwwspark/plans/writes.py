"""Writing to a replica's own tables, with capture."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import heartbeat_time, system_time
from ..model import CHANGELOG, HEARTBEAT, HEARTBEAT_ID, PRIMARY_KEY, SYNC_META, SYSTEM_KEYS, TOMBSTONE
from ..operators import capture
from ..operators.lineage import cut, forget
from ..operators.tombstones import once
from ..sources.store import Change, Replica


def _cascaded(replica: Replica, table: str, gone: DataFrame, key: str) -> list[tuple[str, DataFrame]]:
    """(table, recordId) of all deletions that follow from some, the farthest first, the deletions themselves last."""
    out, left = [(table, gone)], [(table, gone)]
    while left:
        parent, keys = left.pop()
        for name, meta in replica.metas.items():
            for column in (c for c, of in meta.cascades if of == parent):
                rows = replica.table(name)
                found = rows.join(keys.select(F.col("recordId").alias("_gone")), F.col(column) == F.col("_gone"), "left_semi").select(F.col(key).alias("recordId"))
                for other, known in out:
                    found = found.join(known, "recordId", "left_anti") if other == name else found
                found = cut(found)
                if found.limit(1).count():
                    out.insert(0, (name, found))
                    left.append((name, found))
    return out


def write(replica: Replica, table: str, upserts: DataFrame | None = None, deletes: list[str] | DataFrame | None = None, now: datetime | None = None, key: str = PRIMARY_KEY) -> None:
    """Inserts or updates rows (whole, by key), and deletes keys; every operation is logged, even one that changes nothing.

    Of several rows with one key the last by its columns stands; all are logged. Deletions take along the rows that refer to
    what is deleted, where the tables say so.
    """
    at, spark = system_time(now or datetime.now(UTC)), replica.spark
    old, end = replica.table(table), replica.version.feed_end
    made: list[tuple[str, DataFrame, list[str]]] = []
    changes: dict[str, Change] = {}
    rows = None
    if upserts is not None:
        rows = upserts.select(*old.columns)
        missing = [c for c in (replica.metas[table].required if table in replica.metas else []) if rows.where(F.col(c).isNull()).limit(1).count()]
        if missing:
            raise ValueError(f"NOT NULL constraint failed: {table}.{missing[0]}")
        held = old.select(F.col(key).alias("_held"))
        nth = F.row_number().over(Window.partitionBy(key).orderBy(*old.columns)).alias("_nth")
        counted = rows.select("*", nth).join(held, F.col(key) == F.col("_held"), "left")
        what = F.when(F.col("_held").isNull() & (F.col("_nth") == 1), "INSERT").otherwise("UPDATE")
        made.append((table, counted.select(F.col(key).alias("recordId"), what.alias("operation"), "_nth"), ["recordId", "_nth"]))
        rows = once(rows, [key])
    deleted: list[tuple[str, DataFrame]] = []
    if deletes is not None:
        keys = deletes if isinstance(deletes, DataFrame) else spark.createDataFrame([(k,) for k in deletes], "recordId string")
        there = old.select(F.col(key).alias("recordId"))
        there = there if rows is None else there.unionByName(rows.select(F.col(key).alias("recordId")))
        deleted = _cascaded(replica, table, cut(keys.select("recordId").distinct().join(there, "recordId", "left_semi")), key)
        for name, gone in deleted:
            made.append((name, gone.withColumn("operation", F.lit("DELETE")), ["recordId"]))
            held = changes.get(name, Change([key])).gone
            mine = gone.select(F.col("recordId").alias(key))
            changes[name] = Change([key], None, mine if held is None else held.unionByName(mine))
        stones = None
        for name, gone in deleted:
            one = gone.select(F.lit(name).alias("tableName"), "recordId", F.lit(at).alias("deletedAt"))
            stones = one if stones is None else stones.unionByName(one)
        changes[TOMBSTONE] = Change(SYSTEM_KEYS[TOMBSTONE], stones)
    if rows is not None:
        gone = changes.get(table, Change([key])).gone
        left = rows if gone is None else rows.join(gone, key, "left_anti").select(*old.columns)
        changes[table] = Change([key], left, gone)
    entries = None
    for name, ops, order in made:
        one = cut(capture.operations(name, ops, at, end, order))
        end = one.agg(F.max("id")).first()[0] or end
        entries = one if entries is None else entries.unionByName(one)
    replica.commit(changes=changes, feed_end=end, appended={CHANGELOG: entries} if end > replica.version.feed_end else {})
    forget(*(gone for _, gone in deleted))


def beat(replica: Replica, now: datetime) -> bool:
    """Moves the heartbeat to today's noon if it is older; logged once a day."""
    value = heartbeat_time(now)
    rows = replica.table(HEARTBEAT).where(F.col("id") == HEARTBEAT_ID).take(1)
    if rows and rows[0]["updatedAt"] >= value:
        return False
    end = replica.version.feed_end + 1
    entry = replica.spark.createDataFrame([(end, HEARTBEAT, HEARTBEAT_ID, "UPDATE" if rows else "INSERT", system_time(now))], replica.table(CHANGELOG).schema)
    replica.commit({HEARTBEAT: capture.heartbeat(replica.table(HEARTBEAT), value, HEARTBEAT_ID)}, feed_end=end, appended={CHANGELOG: entry})
    return True


def set_version(replica: Replica, version: str) -> None:
    if replica.schema_version() != version:
        row = replica.spark.createDataFrame([("schemaVersion", version)], replica.table(SYNC_META).schema)
        replica.commit(changes={SYNC_META: Change(SYSTEM_KEYS[SYNC_META], row)})
