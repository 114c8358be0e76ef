"""Synchronising a replica with its remotes: incremental pulls, or full merges where a feed has a gap.

All remotes are taken in one pass: their operations are ranked by client id, and each key's history is followed through the
ranks in one shuffle, which gives what taking one remote after the other gives. A remote whose operations can't be applied is
left out and the pass is made again, so that it has no effect on the others. If the pass can't be made at all, remotes that
can't be read are warnings and it is made with the others; if that fails too, the remotes are taken one by one. A pass is one
commit, of changes by key. Only counters, offsets and a bounded number of conflict lines reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cutoff, system_time
from ..model import CHANGELOG, HEARTBEAT, SYNC_STATE, SYSTEM_KEYS, TOMBSTONE, SkippedRemote, SyncConfig, SyncResult, TableConfig
from ..operators import feed, lww, tombstones, unique
from ..operators.lineage import cut, forget
from ..operators.numbering import numbered
from ..sources import store
from ..sources.store import Change, Replica
from . import catalog
from .writes import beat, set_version

CONFLICT_LINES, KEPT_VERSIONS = 1000, 32
OUTCOME = ["rank", "pos", "recordId", "action", "local_updated_at", "remote_updated_at", "resolution", "loser", "at"]


def _never() -> Column:
    return F.lit(None).cast("string")


@dataclass
class Remote:
    """A remote that takes part. ``rank``: its turn, from 1. ``seen``: how far its feed has been read."""

    rank: int
    client: str
    replica: Replica
    seen: int


@dataclass
class Merged:
    """What was done to a table: outcomes of operations, the change by key, and (rank, pos, error) where operations failed."""

    outcomes: DataFrame
    change: Change
    failures: list[tuple[int, int, str]] = field(default_factory=list)


class Held(list):
    """Tables that are cut for one pass."""

    def cut(self, df: DataFrame) -> DataFrame:
        return self.keep(cut(df))

    def keep(self, df: DataFrame) -> DataFrame:
        self.append(df)
        return df

    def drop(self) -> None:
        forget(*self)
        self.clear()


def union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _violates(row: Callable[[str], Column], required: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (row(c).isNull() for c in required), F.lit(False))


def _failures(rows: DataFrame) -> list[tuple[int, int, str]]:
    """The first failure of each rank; ``rows``: rank, pos, failure."""
    first = rows.groupBy("rank").agg(F.min(F.struct("pos", "failure")).alias("x")).select("rank", "x.pos", "x.failure")
    return [(r[0], r[1] or 0, r[2]) for r in first.collect()]


def _contended(mine: DataFrame, rows: DataFrame, sets, key: str, held: Held) -> DataFrame | None:
    """Labels of keys that share unique values; None if there are none."""
    if not sets:
        return None
    labels = held.keep(unique.components(mine, rows, sets, key))
    return labels if labels.limit(1).count() else None


def _without(rows: DataFrame, column: str, labels: DataFrame | None) -> DataFrame:
    return rows if labels is None else rows.join(labels.select("_key"), F.col(column) == F.col("_key"), "left_anti")


def _with_folded(merged: Merged, mine: DataFrame, ops: DataFrame, labels: DataFrame | None, sets, key: str, ts: str, required: list[str], held: Held) -> Merged:
    """Adds what folding the contended keys gives."""
    if labels is None:
        return merged
    folded = held.keep(unique.fold(mine, ops, labels, sets, key, ts, required))
    told = folded.where("kind = 'told'")
    put, gone = folded.where("kind = 'put'").select("row.*"), folded.where("kind = 'gone'").select(F.col("recordId").alias("_gone"))
    # Of touched keys, those are gone that were there.
    gone = gone.join(mine.select(F.col(key)), F.col("_gone") == F.col(key), "left_semi").select(F.col("_gone").alias(key))
    change = Change([key], merged.change.rows.unionByName(put), merged.change.gone.unionByName(gone))
    return Merged(merged.outcomes.unionByName(told.where("failure is null").select(*OUTCOME)), change, merged.failures + _failures(told.where("failure is not null").select("rank", "pos", "failure")))


def merge_operations(mine: DataFrame, ops: DataFrame, config: TableConfig, sets, required: list[str], key: str, held: Held) -> Merged:
    """Operations (rank, pos, recordId, operation, row) of all remotes' feeds on a table."""
    labels = _contended(mine, ops.where("row is not null").select("row.*"), sets, key, held)
    plain = _without(ops, "recordId", labels)
    entry = lambda rows, k, rank, op, ts, pos, row: rows.select(k.alias("key"), rank.alias("rank"), op.alias("op"), ts.cast("string").alias("ts"), pos.alias("pos"), row.alias("row"))
    theirs = entry(plain, F.col("recordId"), F.col("rank"), F.col("operation"), F.col("row")[config.ts], F.col("pos"), F.col("row"))
    touched = plain.select(F.col("recordId").alias("_touched")).distinct()
    met = mine.join(touched, F.col(key) == F.col("_touched"), "left_semi")
    ours = entry(met, F.col(key), F.lit(0), F.lit("LOCAL"), F.col(config.ts), F.lit(None).cast("bigint"), F.lit(None).cast(ops.schema["row"].dataType))
    pulled = held.cut(lww.pull_in_turn(ours.unionByName(theirs)))
    did = pulled.where("rank > 0")
    failures = []
    if required:
        wrote = F.col("action").isin("inserted", "updated") | ((F.col("action") == "upserted") & (F.col("resolution") == "remote_wins"))
        bad = did.where(wrote & _violates(lambda c: F.col("row")[c], required))
        failures = _failures(bad.select("rank", "pos", F.lit("NOT NULL constraint failed").alias("failure")))
    outcomes = did.select("rank", "pos", F.col("key").alias("recordId"), "action", "local_updated_at", "remote_updated_at", "resolution", _never().alias("loser"), _never().alias("at"))
    stands = lww.standing(pulled, ["row"])
    change = Change([key], stands.where("rank > 0").select("row.*"), stands.where("rank is null and was_held").select(F.col("key").alias(key)))
    return _with_folded(Merged(outcomes, change, failures), mine, ops.withColumn("at", _never()), labels, sets, key, config.ts, required, held)


def merge_rows(mine: DataFrame, theirs: DataFrame, stones: DataFrame, config: TableConfig, sets, required: list[str], key: str, held: Held) -> Merged:
    """Every row of the remotes (rank, and the table's columns) as an update, after a remote's rows its tombstones (rank, recordId, deletedAt)."""
    labels = _contended(mine, theirs, sets, key, held)
    entry = lambda rows, k, rank, kind, ts: rows.select(F.col(k).alias("key"), rank.alias("rank"), F.lit(kind).alias("kind"), F.col(ts).cast("string").alias("ts"))
    history = entry(mine, key, F.lit(0), "ROW", config.ts).unionByName(entry(theirs, key, F.col("rank"), "ROW", config.ts)).unionByName(entry(stones, "recordId", F.col("rank"), "TOMBSTONE", "deletedAt"))
    done = held.cut(tombstones.full_merge_in_turn(_without(history, "key", labels)).where(F.size("outcomes") > 0))
    each = done.select(F.col("key").alias("recordId"), F.explode("outcomes").alias("x")).select("x.rank", F.lit(0).cast("bigint").alias("pos"), "recordId", "x.action", F.col("x.ts").alias("_ts"))
    outcomes = each.select("rank", "pos", "recordId", "action", *(_never().alias(c) for c in OUTCOME[4:8]), F.when(F.col("action") == "deleted", F.col("_ts")).alias("at"))
    won = done.where("rank > 0").select(F.col("key").alias("_won"), F.col("rank").alias("_rank"))
    rows = theirs.join(won, (F.col(key) == F.col("_won")) & (F.col("rank") == F.col("_rank"))).select(*mine.columns)
    failures = []
    if required:
        bad = theirs.where(_violates(F.col, required)).select(F.col(key).alias("_bad"), F.col("rank").alias("_rank"))
        wrote = each.where("action in ('inserted', 'updated')").join(bad, (F.col("recordId") == F.col("_bad")) & (F.col("rank") == F.col("_rank")), "left_semi")
        failures = _failures(wrote.select("rank", "pos", F.lit("NOT NULL constraint failed").alias("failure")))
    merged = Merged(outcomes, Change([key], rows, done.where("rank is null and was_held").select(F.col("key").alias(key))), failures)
    if labels is None:
        return merged
    row = F.struct(*mine.columns)
    ops = theirs.select("rank", F.lit(0).cast("bigint").alias("pos"), F.col(key).alias("recordId"), F.lit("UPDATE").alias("operation"), row.alias("row"), _never().alias("at"))
    bury = stones.select("rank", F.lit(1).cast("bigint").alias("pos"), "recordId", F.lit("BURY").alias("operation"), F.lit(None).cast(ops.schema["row"].dataType).alias("row"), F.col("deletedAt").alias("at"))
    return _with_folded(merged, mine, ops.unionByName(bury), labels, sets, key, config.ts, required, held)


def _rows_of(remotes: list[Remote], name: str, like: DataFrame) -> DataFrame:
    """A table's rows at all of the remotes, in the replica's own columns and types, with rank."""
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields]
    return union(r.replica.table(name).select(F.lit(r.rank).alias("rank"), *typed) for r in remotes)


def _settled(merge: Callable[[set[int]], dict[str, Merged]], partly: bool) -> tuple[dict[str, Merged], dict[int, str], list[DataFrame]]:
    """(merges without the remotes that fail; their errors; what these had done before they failed).

    Remotes are left out in their turn, as only those before a remote have a say in whether it fails.
    """
    out: dict[int, str] = {}
    before = []
    while True:
        merged = merge(set(out))
        failed = [f for m in merged.values() for f in m.failures]
        if not failed:
            return merged, out, before
        rank, pos, error = min(failed)
        if partly:
            before += [m.outcomes.where((F.col("rank") == rank) & (F.col("pos") < pos)).withColumn("tableName", F.lit(n)) for n, m in merged.items()]
        out[rank] = error


def _count(told: DataFrame, result: SyncResult, warn: bool, held: Held) -> None:
    """Adds the counters of outcomes; of a remote that failed, what came before the failure counts too."""
    told = told.where(F.col("tableName") != HEARTBEAT)
    n = lww.counters(told).first()
    for name in ("inserted", "updated", "skipped", "deleted", "conflicts_resolved"):
        setattr(result, name, getattr(result, name) + n[name])
    if not warn:
        return
    lines = told.where("resolution is not null")
    top = lines.orderBy("rank", "pos", "tableName").limit(CONFLICT_LINES + 1).collect()
    result.warnings += [f"Conflict on {r['tableName']}:{r['recordId']} resolved as {r['resolution']}" for r in top[:CONFLICT_LINES]]
    if top:
        result.conflicts = cut(lines.select(F.col("tableName").alias("table"), F.col("recordId").alias("record_id"), "local_updated_at", "remote_updated_at", "resolution"))
    if len(top) > CONFLICT_LINES:
        result.warnings.append(f"{result.conflicts.count() - CONFLICT_LINES} more conflicts")


def echo(told: DataFrame) -> DataFrame:
    """tableName, recordId, operation, rank, pos, turn that applying feeds makes in the replica's own feed."""
    entry = lambda k, what: F.struct(k.alias("recordId"), F.lit(what).alias("operation"))
    won = F.col("action").isin("updated", "upserted") & (F.col("resolution") == "remote_wins")
    made = (
        F.when(F.col("action") == "deleted", F.array(entry(F.col("recordId"), "DELETE")))
        .when(F.col("action") == "inserted", F.array(entry(F.col("recordId"), "INSERT")))
        .when(won & F.col("loser").isNotNull(), F.array(entry(F.col("loser"), "DELETE"), entry(F.col("recordId"), "INSERT")))
        .when(won, F.array(entry(F.col("recordId"), "UPDATE")))
    )
    return told.select("tableName", "rank", "pos", F.posexplode(made).alias("turn", "x")).select("tableName", "x.recordId", "x.operation", "rank", "pos", "turn")


def _offsets_after(local: Replica, seen: dict[str, int], now: str) -> Change:
    rows = local.spark.createDataFrame([(c, n, now) for c, n in seen.items()], local.table(SYNC_STATE).schema)
    return Change(SYSTEM_KEYS[SYNC_STATE], rows)


def _told(merged: dict[str, Merged]) -> DataFrame | None:
    return union(m.outcomes.withColumn("tableName", F.lit(n)) for n, m in merged.items()) if merged else None


def _failed(remotes: list[Remote], errors: dict[int, str], what: str) -> list[str]:
    return [f"{what} for client {r.client}: {errors[r.rank]}" for r in remotes if r.rank in errors]


def pull_normal(local: Replica, remotes: list[Remote], tables: list[TableConfig], config: SyncConfig, now: datetime, held: Held) -> SyncResult:
    """The remotes' news: their operations, the echo of these in the own feed, and the new offsets, together or not at all."""
    result, ends = SyncResult(), {r.rank: (r.replica.feed_span() or (0, 0))[1] for r in remotes}
    told_of = [r for r in remotes if ends[r.rank] > r.seen]
    result.clients_synced = len(remotes) - len(told_of)
    if not told_of:
        return result
    news = union(feed.read_since(r.replica.table(CHANGELOG), r.seen).withColumn("rank", F.lit(r.rank)) for r in told_of)
    entries = held.cut(feed.last_operations(news, ["rank"]))
    configs = {c.name: c for c in [*tables, TableConfig(HEARTBEAT, delete_protected=True)]}
    present = {r[0] for r in entries.where(F.col("tableName").isin(list(configs))).select("tableName").distinct().collect()}
    ops: dict[str, DataFrame] = {}
    for name in (n for n in configs if n in present):
        system = name == HEARTBEAT
        scoped = feed.in_scope(entries, [configs[name]])
        rows = _rows_of(told_of, name, local.table(name))
        one = feed.resolved(scoped, rows, "id" if system else config.primary_key, ["rank"]).select("rank", "pos", "recordId", "operation", "row")
        ops[name] = held.cut(one.withColumn("operation", F.lit("UPDATE")) if system else one)

    def merge(without: set[int]) -> dict[str, Merged]:
        out = {}
        for name, df in ops.items():
            meta = local.metas.get(name)
            some = df.where(~F.col("rank").isin(list(without))) if without else df
            out[name] = merge_operations(local.table(name), some, configs[name], meta.unique if meta else (), meta.required if meta else [], "id" if name == HEARTBEAT else config.primary_key, held)
        return out

    merged, errors, before = _settled(merge, partly=True)
    told, at, end = _told(merged), system_time(now), local.version.feed_end
    changes = {n: m.change for n, m in merged.items()}
    appended = {}
    if told is not None:
        told = held.cut(told)
        _count(union([told, *before]), result, True, held)
        made = held.keep(numbered(echo(told).withColumn("changedAt", F.lit(at)), ["rank", "pos", "tableName", "turn"], "id", end))
        top = made.agg(F.max("id")).first()[0]
        if top:
            end, appended = top, {CHANGELOG: made.select(*feed.COLUMNS)}
            gone = made.where((F.col("operation") == "DELETE") & (F.col("tableName") != HEARTBEAT)).select("tableName", "recordId", F.lit(at).alias("deletedAt")).distinct()
            changes[TOMBSTONE] = Change(SYSTEM_KEYS[TOMBSTONE], gone)
    done = [r for r in told_of if r.rank not in errors]
    if done:
        changes[SYNC_STATE] = _offsets_after(local, {r.client: ends[r.rank] for r in done}, at)
        local.commit(changes=changes, feed_end=end, appended=appended)
    result.clients_synced += len(done)
    result.warnings += _failed(told_of, errors, "Sync failed")
    return result


def pull_full(local: Replica, remotes: list[Remote], tables: list[TableConfig], config: SyncConfig, now: datetime, held: Held) -> SyncResult:
    """The remotes' whole tables, tombstones and recent feeds; nothing is captured meanwhile."""
    result, key = SyncResult(), config.primary_key

    def merge(without: set[int]) -> dict[str, Merged]:
        out = {}
        for t in tables:
            some = [r for r in remotes if r.rank not in without and r.replica.has(t.name)]
            if not some:
                continue
            mine, meta = local.table(t.name), local.metas[t.name]
            theirs = _rows_of(some, t.name, mine)
            stones = [
                tombstones.remade(r.replica.table(TOMBSTONE).where(F.col("tableName") == t.name), r.replica.table(t.name), key).select(F.lit(r.rank).alias("rank"), "recordId", "deletedAt")
                for r in some if r.replica.has(TOMBSTONE) and not t.delete_protected
            ]
            none = local.spark.createDataFrame([], "rank int, recordId string, deletedAt string")
            out[t.name] = merge_rows(mine, theirs, union([none, *stones]), t, meta.unique, meta.required, key, held)
        return out

    merged, errors, _ = _settled(merge, partly=False)
    done, told = [r for r in remotes if r.rank not in errors], _told(merged)
    changes = {n: m.change for n, m in merged.items()}
    if told is not None:
        told = held.cut(told)
        _count(told, result, False, held)
        gone = told.where("action = 'deleted'").select("tableName", "recordId", F.col("at").alias("deletedAt"), "rank")
        changes[TOMBSTONE] = Change(SYSTEM_KEYS[TOMBSTONE], tombstones.once(gone, SYSTEM_KEYS[TOMBSTONE], ["rank"]).drop("rank"))
    if done:
        since, end = cutoff(now, config.changelog_retention_days), local.version.feed_end
        recent = union(feed.retained(r.replica.table(CHANGELOG), since).withColumnRenamed("id", "_id").withColumn("rank", F.lit(r.rank)) for r in done)
        new = held.keep(numbered(recent, ["rank", "_id"], "id", end))
        top = new.agg(F.max("id")).first()[0]
        seen = {r.client: (r.replica.feed_span() or (0, 0))[1] for r in done}
        changes[SYNC_STATE] = _offsets_after(local, seen, system_time(now))
        local.commit(changes=changes, feed_end=top or end, appended={CHANGELOG: new.select(*feed.COLUMNS)} if top else {})
    result.clients_synced = len(done)
    result.warnings += _failed(remotes, errors, "Full merge failed")
    return result


def _add(result: SyncResult, more: SyncResult) -> None:
    for name in ("clients_synced", "inserted", "updated", "deleted", "skipped", "conflicts_resolved"):
        setattr(result, name, getattr(result, name) + getattr(more, name))
    result.warnings += more.warnings
    if more.conflicts is not None:
        result.conflicts = more.conflicts if result.conflicts is None else result.conflicts.unionByName(more.conflicts)


def _probe(remote: Remote, tables: list[TableConfig], full: bool) -> None:
    """Reads what a pass reads of a remote; raises what is wrong with it."""
    feed.read_since(remote.replica.table(CHANGELOG), remote.seen).agg(*(F.max(c) for c in feed.COLUMNS)).collect()
    for name in [t.name for t in tables if remote.replica.has(t.name)] + [TOMBSTONE] if full else []:
        rows = remote.replica.table(name)
        rows.agg(F.max(F.xxhash64(*rows.columns))).collect()


def pull(local: Replica, remotes: list[Remote], tables: list[TableConfig], config: SyncConfig, now: datetime, result: SyncResult) -> None:
    """All remotes in one pass; if that can't be made, all that can be read; if that can't either, one by one."""
    full = result.had_changelog_gap
    how, what = (pull_full, "Full merge failed") if full else (pull_normal, "Sync failed")

    def made(some: list[Remote]) -> Exception | None:
        held = Held()
        try:
            _add(result, how(local, some, tables, config, now, held))
        except Exception as e:  # noqa: BLE001  one remote's failure is its own
            return e
        finally:
            held.drop()
        return None

    def readable(remote: Remote) -> bool:
        try:
            _probe(remote, tables, full)
        except Exception as e:  # noqa: BLE001
            result.warnings.append(f"{what} for client {remote.client}: {e}")
            return False
        return True

    if not remotes or made(remotes) is None:
        return
    left = [r for r in remotes if readable(r)]
    if 1 < len(left) < len(remotes) and made(left) is None:
        return
    for r in left:
        if error := made([r]):
            result.warnings.append(f"{what} for client {r.client}: {error}")


def cleanup(local: Replica, config: SyncConfig, now: datetime) -> int:
    """Drops expired entries of the own feed."""
    return local.drop_expired(cutoff(now, config.changelog_retention_days))


def publish(local: Replica, config: SyncConfig) -> None:
    if config.publish_as == "sqlite":
        from ..sources import sqlite

        sqlite.export(local, config.nas_path, config.client_id)
    else:
        local.publish(config.nas_path, config.client_id)


def taking_part(local: Replica, opened: list[tuple[str, Replica | None]], config: SyncConfig, result: SyncResult) -> tuple[list[Remote], bool]:
    """(remotes that can be read and fit, whether one of their feeds has a gap). Others are warnings, in their turn."""
    spark, facts = local.spark, []
    for client, replica in opened:
        try:
            facts.append((client, replica.schema_version(), (replica.feed_span() or (None,))[0]) if replica else None)
        except Exception:  # noqa: BLE001
            facts.append(None)
    known = spark.createDataFrame([f for f in facts if f], "client_id string, remote_version string, min_id long")
    fit = catalog.version_gate(known, config.schema_version) if config.schema_version else known.select("client_id", "remote_version", F.lit(True).alias("usable"))
    # A row for each remote.
    seen = feed.offsets(local.table(SYNC_STATE), fit.where("usable").select(F.col("client_id").alias("remote")))
    least = known.select(F.col("client_id").alias("remote"), "min_id")
    found = {r["remote"]: r for r in feed.gaps(least, seen).collect()}
    out = []
    for (client, replica), fact in zip(opened, facts, strict=True):
        if fact is None:
            result.warnings.append(f"Failed to open remote database: {client}")
        elif client not in found:
            result.skipped_remotes.append(SkippedRemote(client, fact[1], config.schema_version))
            result.warnings.append(f"Skipping client {client}: schema version mismatch (local={config.schema_version}, remote={fact[1] or 'unknown'})")
        else:
            out.append(Remote(len(out) + 1, client, replica, found[client]["last_seen"]))
    return out, any(r["has_gap"] for r in found.values())


def perform_sync(local: Replica, config: SyncConfig, tables: list[TableConfig]) -> SyncResult:
    """One round. Without a gap: publish, pull, beat; with one: pull whole tables from all remotes, beat, then publish."""
    result, spark = SyncResult(), local.spark
    now = config.now() if config.now else datetime.now(UTC)
    if config.schema_version:
        set_version(local, config.schema_version)
    store.Folder(spark, config.nas_path).ensure()
    opened = [(c, store.open_remote(spark, p)) for c, p in store.remotes(spark, config.nas_path, config.client_id)]
    try:
        told = SyncResult()
        remotes, result.had_changelog_gap = taking_part(local, opened, config, told)
        if result.had_changelog_gap:
            result.warnings.append("Changelog gap detected, performing full merge with tombstone support")
        else:
            publish(local, config)
        result.warnings += told.warnings
        result.skipped_remotes += told.skipped_remotes
        pull(local, remotes, tables, config, now, result)
    finally:
        for _, replica in opened:
            if hasattr(replica, "cleanup"):
                replica.cleanup()
    if config.heartbeat_enabled:
        beat(local, now)
    if result.had_changelog_gap:
        publish(local, config)
    cleanup(local, config, now)
    local.vacuum(KEPT_VERSIONS)
    if config.on_after_sync:
        config.on_after_sync(local, result)
    return result


__all__ = ["Held", "Merged", "Remote", "cleanup", "echo", "merge_operations", "merge_rows", "perform_sync", "pull"]
