"""Last write wins: merging rows of one replica into another, set by set.

Timestamps are text and compare as text; a null one is empty. What an operation does to a row is said in one place,
``decided``: the merges of two tables and the rounds over any number of remotes both read it from there. Keys don't
influence each other here; tables with further unique columns go through ``unique.py`` where those collide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import newer, stamp


def decided(op: Column, held: Column, lt: Column, rt: Column) -> dict[str, Column]:
    """What an operation does where a row is held or isn't: action, wins (its row is put), told (a conflict), resolution.

    ``lt`` and ``rt``: timestamps of the row that is held, and of the operation's. A key that both hold is a conflict for an
    insertion even if timestamps tie, for an update only if they differ, for a deletion never.
    """
    later = newer(rt, lt)
    gone, insert = op == "DELETE", op == "INSERT"
    action = (
        F.when(gone, F.when(held, "deleted").otherwise("missed"))
        .when(~held, "inserted").when(insert, "upserted").when(later, "updated").otherwise("skipped")
    )
    told = held & ~gone & (insert | (stamp(rt) != stamp(lt)))
    return {"action": action, "wins": ~gone & (~held | later), "told": told, "resolution": F.when(told, F.when(later, "remote_wins").otherwise("local_wins"))}


def _merged(local: DataFrame, remote: DataFrame, op: str, key: str, ts: str, how: str) -> DataFrame:
    l = local.select(F.col(key).alias("_lk"), F.struct(*local.columns).alias("_l"))
    r = remote.select(F.col(key).alias("_rk"), F.struct(*local.columns).alias("_r"))
    both = l.join(r, F.col("_lk") == F.col("_rk"), how)
    lt, rt = F.col("_l")[ts], F.col("_r")[ts]
    d, came = decided(F.lit(op), F.col("_l").isNotNull(), lt, rt), F.col("_r").isNotNull()
    told = came & d["told"]
    return both.select(
        F.when(came & d["wins"], F.col("_r")).otherwise(F.col("_l")).alias("_row"), F.when(came, d["action"]).alias("action"),
        F.when(told, stamp(lt)).alias("local_updated_at"), F.when(told, stamp(rt)).alias("remote_updated_at"), F.when(came, d["resolution"]).alias("resolution"),
    ).select(*(F.col("_row")[c].alias(c) for c in local.columns), "action", "local_updated_at", "remote_updated_at", "resolution")


def apply_insert(local: DataFrame, remote: DataFrame, key: str = "id", ts: str = "updatedAt", how: str = "full") -> DataFrame:
    """The merged rows with action (inserted, upserted, null where only local) and conflict.

    A key that both hold is a conflict even if the timestamps tie. ``how='right'`` gives the remote rows' outcomes alone.
    """
    return _merged(local, remote, "INSERT", key, ts, how)


def apply_update(local: DataFrame, remote: DataFrame, key: str = "id", ts: str = "updatedAt", how: str = "full") -> DataFrame:
    """The merged rows with action (updated, skipped, inserted, null where only local) and conflict (not on ties)."""
    return _merged(local, remote, "UPDATE", key, ts, how)


def apply_delete(local: DataFrame, keys: DataFrame, key: str = "id", of: str = "recordId") -> DataFrame:
    """Local rows without the deleted keys; no timestamp is asked."""
    gone = keys.select(F.col(of).alias("_gone"))
    return local.join(gone, F.col(key) == F.col("_gone"), "left_anti")


def deleted(local: DataFrame, keys: DataFrame, key: str = "id", of: str = "recordId") -> DataFrame:
    """action (deleted, skipped) of every key asked to go."""
    held = local.select(F.col(key).alias("_held"))
    asked = keys.select(F.col(of).alias(of))
    none = F.lit(None).cast("string")
    action = decided(F.lit("DELETE"), F.col("_held").isNotNull(), none, none)["action"]
    return asked.join(held, F.col(of) == F.col("_held"), "left").select(of, F.when(action == "deleted", action).otherwise("skipped").alias("action"))


def pull_in_turn(rows: DataFrame) -> DataFrame:
    """What each remote's operations do when remotes are applied by rank, in one shuffle on the key.

    ``rows``: key, rank (0: the local row), op (LOCAL, INSERT, UPDATE, DELETE), ts, and what else there is. Adds segment,
    action, local_updated_at, remote_updated_at, resolution. Deletions split a key's history into segments; within a segment
    an operation meets the newest row before it.
    """
    by_rank = Window.partitionBy("key").orderBy("rank")
    is_delete = F.col("op") == "DELETE"
    cut_up = rows.withColumns({"segment": F.sum(is_delete.cast("int")).over(by_rank), "_previous": F.lag("op").over(by_rank)})
    inside = Window.partitionBy("key", "segment").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    met = cut_up.withColumn("_best", F.max(F.when(~is_delete, stamp(F.col("ts")))).over(inside))
    # A deletion opens its segment: what it meets is the entry before it.
    held = F.when(is_delete, F.col("_previous").isNotNull() & (F.col("_previous") != "DELETE")).otherwise(F.col("_best").isNotNull())
    d, remote = decided(F.col("op"), held, F.col("_best"), F.col("ts")), F.col("op") != "LOCAL"
    told = remote & d["told"]
    out = met.withColumns({"action": F.when(remote, d["action"]), "local_updated_at": F.when(told, F.col("_best")), "remote_updated_at": F.when(told, stamp(F.col("ts"))), "resolution": F.when(remote, d["resolution"])})
    return out.drop("_previous", "_best")


def standing(pulled: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Of the result of ``pull_in_turn``, by key: rank of the row that stands (null: none), was_held (a local row was
    there), and the standing row's ``carry`` columns. It is the newest of the last segment, ties to the lowest rank."""
    live = F.when(F.col("op") != "DELETE", stamp(F.col("ts")))
    top = F.max_by(F.struct(F.when(live.isNotNull(), F.col("rank")).alias("rank"), *carry), F.struct(F.col("segment"), live.alias("live"), (-F.col("rank")).alias("turn")))
    held = F.max(F.col("op") == "LOCAL").alias("was_held")
    return pulled.groupBy("key").agg(top.alias("_top"), held).select("key", "_top.rank", "was_held", *(F.col(f"_top.{c}") for c in carry))


def state_after_pull(rows: DataFrame) -> DataFrame:
    """key, rank of the row that stands after all remotes."""
    return standing(pull_in_turn(rows)).where("rank is not null").select("key", "rank")


def counters(outcomes: DataFrame) -> DataFrame:
    """One row of the result's counters. An upsert counts as a resolved conflict, a missed deletion nowhere."""
    n = lambda a: F.count(F.when(F.col("action") == a, 1))
    return outcomes.agg(n("inserted").alias("inserted"), n("updated").alias("updated"), n("deleted").alias("deleted"), n("skipped").alias("skipped"), n("upserted").alias("conflicts_resolved"))
