"""Deletions that are remembered: the latest for each row, and how they are applied in a full merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stamp
from .lww import decided


def latest(tombstones: DataFrame) -> DataFrame:
    """The last deletion of each (tableName, recordId)."""
    return tombstones.groupBy("tableName", "recordId").agg(F.max("deletedAt").alias("deletedAt"))


def once(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key: the last by ``order``, then by all columns."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*(order or []), *rows.columns)).alias("_row")
    return rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(last).select("_row.*")


def replaced(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``held`` with the rows of ``new`` in place of those with equal keys; the last of ``new`` by its columns counts."""
    return held.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(once(new.select(*held.columns), keys))


def remade(tombstones: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Tombstones without those whose row was made again at the replica they come from."""
    return tombstones.join(rows.select(F.col(key).alias("_again")), F.col("recordId") == F.col("_again"), "left_anti")


def effective(tombstones: DataFrame, local: DataFrame, remote: DataFrame, key: str = "id", ts: str = "updatedAt") -> DataFrame:
    """Tombstones that delete: their row wasn't made again at the remote, and the local row is older than the deletion."""
    held = local.select(F.col(key).alias("_held"), stamp(F.col(ts)).alias("_at"))
    return remade(tombstones, remote, key).join(held, (F.col("recordId") == F.col("_held")) & (F.col("deletedAt") > F.col("_at")), "left_semi")


def full_merge_in_turn(rows: DataFrame) -> DataFrame:
    """key, rank (of the row that stands, null: none), was_held (a local row was there), outcomes (rank, action, ts), after
    full merges with several remotes by rank.

    ``rows``: key, rank (0: local), kind (ROW or TOMBSTONE), ts. A remote has a row or an effective tombstone of a key,
    never both; rows count as updates, and a tombstone only deletes what is older than it. The fold needs a key's history in
    order; a key has one entry for each replica, so its array is as long as the list of replicas.
    """
    entry = F.struct("rank", "kind", stamp(F.col("ts")).alias("ts"))
    history = rows.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("history"))
    done = "array<struct<rank:int,action:string,ts:string>>"
    none = F.struct(F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("ts"), F.array().cast(done).alias("done"))

    def step(state, e):
        held = state["ts"].isNotNull()
        buries = (e["kind"] == "TOMBSTONE") & held & (e["ts"] > state["ts"])
        d = decided(F.lit("UPDATE"), held, state["ts"], e["ts"])
        puts = (e["kind"] == "ROW") & d["wins"]
        action = F.when(buries, "deleted").when((e["kind"] == "ROW") & (e["rank"] > 0), d["action"])
        told = F.when(action.isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(F.struct(e["rank"].cast("int").alias("rank"), action.alias("action"), e["ts"].alias("ts")))))
        rank = F.when(buries, F.lit(None)).when(puts, e["rank"].cast("int")).otherwise(state["rank"])
        return F.struct(rank.alias("rank"), F.when(buries, F.lit(None)).when(puts, e["ts"]).otherwise(state["ts"]).alias("ts"), told.alias("done"))

    folded = history.select("key", F.exists("history", lambda e: e["rank"] == 0).alias("was_held"), F.aggregate("history", none, step).alias("x"))
    return folded.select("key", "x.rank", "was_held", F.col("x.done").alias("outcomes"))


def as_of_now(feed: DataFrame) -> DataFrame:
    """The tombstones that a feed's deletions leave: the last deletion of each row, by id."""
    last = Window.partitionBy("tableName", "recordId").orderBy(F.desc("id"))
    gone = feed.where(F.col("operation") == "DELETE").withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return gone.select("tableName", "recordId", F.col("changedAt").alias("deletedAt"))
