"""Queries that exercise every operator over the driver's tables: replicas come from orders, feeds from events, unique
collisions from part. Each has a DuckDB form in ``oracle.py``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import CHANGELOG, HEARTBEAT, HEARTBEAT_ID, SYNC_STATE, TOMBSTONE, ColumnInfo, DiscoverOptions, SyncConfig, SyncResult, TableConfig, TableMeta, TableOptions
from .operators import capture, feed, lww, tombstones, unique
from .operators.lineage import scratch
from .operators.numbering import numbered
from .plans import catalog
from .plans.sync import Held, merge_operations, perform_sync
from .plans.writes import beat, set_version, write
from .session import EVENTS, setup_sync
from .sources import sqlite, store
from .streaming import maintained_last_operations

NOW, SINCE = "2024-01-31 00:00:00", "2024-01-24 00:00:00"
TABLES = [TableConfig("users", delete_protected=True), TableConfig("posts")]
REMOTES = (1, 2, 3)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def replica(spark: SparkSession, sf_dir: str, n: int = 0) -> DataFrame:
    """id, status, price, updatedAt: replica 0 lacks every third order; remote n lacks others and has other dates, some equal."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    mine = (k % 3 != 0) if n == 0 else (k % 7 != n)
    shift = F.lit(0) if n == 0 else (k * (n + 1) % 5 - 2).cast("int")
    day = F.date_format(F.date_add(F.to_date("o_orderdate"), shift), "yyyy-MM-dd")
    return o.where(mine).select(k.cast("string").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") + n).alias("price"), day.alias("updatedAt"))


def operations(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """recordId, operation of remote n's feed: deletions have no row left."""
    k = F.col("o_orderkey")
    what = F.when(k % 13 == n, "DELETE").when(k % 2 == 0, "INSERT").otherwise("UPDATE")
    return read(spark, sf_dir, "orders").where((k % 7 != n) | (k % 13 == n)).select(k.cast("string").alias("recordId"), what.alias("operation"))


def events_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    table = F.element_at(F.array(F.lit("users"), F.lit("posts"), F.lit("items")), (F.col("user_id") % 3 + 1).cast("int"))
    what = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return e.select((F.col("event_id") + 1).alias("id"), table.alias("tableName"), F.col("user_id").cast("string").alias("recordId"), what.alias("operation"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("changedAt"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row images for feed entries."""
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


def parts(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """One part for each (brand, type, size): the smallest key at the local replica, the largest at the remote."""
    pick = F.min("p_partkey") if which == "local" else F.max("p_partkey")
    one = read(spark, sf_dir, "part").groupBy("p_brand", "p_type", "p_size").agg(pick.alias("k"))
    day = F.lit("2024-01-02") if which == "local" else F.when(F.col("k") % 2 == 0, "2024-01-03").otherwise("2024-01-01")
    return one.select(F.col("k").cast("string").alias("id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), day.alias("updatedAt"))


UNIQUE = ("brand", "type", "size")
SHAPES = [
    ("users", 0, "id", "TEXT", 0, 1), ("users", 1, "name", "TEXT", 1, 0), ("users", 2, "updatedAt", "TEXT", 1, 0),
    ("posts", 0, "id", "TEXT", 0, 1), ("posts", 1, "modifiedAt", "TEXT", 1, 0),
    ("cache", 0, "id", "TEXT", 0, 1), ("cache", 1, "value", "TEXT", 0, 0),
    ("joins", 0, "userId", "TEXT", 1, 1), ("joins", 1, "updatedAt", "TEXT", 1, 0),
    ("_log", 0, "id", "TEXT", 0, 1), ("_log", 1, "updatedAt", "TEXT", 1, 0),
    ("sqlite_sequence", 0, "id", "TEXT", 0, 0), ("bad", 0, "id", "INTEGER", 0, 1), ("bad", 1, "updatedAt", "TEXT", 1, 0),
]
FILES = ["client-a.sqlite", "client-b.sqlite", "client-c.sqlite.tmp", "client-me.sqlite", "notes.txt", "client-.sqlite", "client-x-y.sqlite"]


def _keyed(rows: DataFrame, rank: int, op, *more: str) -> DataFrame:
    return rows.select(F.col("id").alias("key"), F.lit(rank).alias("rank"), op.alias("op"), F.col("updatedAt").alias("ts"), *more)


def in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, rank, op, ts of the local rows and of three remotes' operations whose rows are there."""
    rows = _keyed(replica(spark, sf_dir), 0, F.lit("LOCAL"))
    for n in REMOTES:
        ops, held = operations(spark, sf_dir, n), replica(spark, sf_dir, n)
        alive = ops.where("operation <> 'DELETE'").join(held, F.col("recordId") == F.col("id"))
        rows = rows.unionByName(_keyed(alive, n, F.col("operation")))
        rows = rows.unionByName(ops.where("operation = 'DELETE'").select(F.col("recordId").alias("key"), F.lit(n).alias("rank"), F.col("operation").alias("op"), F.lit(None).cast("string").alias("ts")))
    return rows


def merge_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, rank, kind, ts of a full merge with three remotes; a remote has a row or a tombstone of a key."""
    rows = replica(spark, sf_dir).select(F.col("id").alias("key"), F.lit(0).alias("rank"), F.lit("ROW").alias("kind"), F.col("updatedAt").alias("ts"))
    for n in REMOTES:
        held = replica(spark, sf_dir, n).select(F.col("id").alias("key"), F.lit(n).alias("rank"), F.lit("ROW").alias("kind"), F.col("updatedAt").alias("ts"))
        dead = read(spark, sf_dir, "orders").where(F.col("o_orderkey") % 7 == n).select(F.col("o_orderkey").cast("string").alias("key"), F.lit(n).alias("rank"), F.lit("TOMBSTONE").alias("kind"), F.lit(f"199{n + 3}-06-01").alias("ts"))
        rows = rows.unionByName(held).unionByName(dead)
    return rows


def buried(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").where(k % 5 == 0).select(F.lit("orders").alias("tableName"), k.cast("string").alias("recordId"), F.concat(F.lit("199"), (k % 9).cast("string"), F.lit("-06-01")).alias("deletedAt"))


def q_converge(s: SparkSession, d: str) -> DataFrame:
    local, remote = parts(s, d, "local"), parts(s, d, "remote")
    ops = remote.select(F.lit(1).alias("rank"), F.col("id").cast("bigint").alias("pos"), F.col("id").alias("recordId"), F.lit("INSERT").alias("operation"), F.struct(*remote.columns).alias("row"))
    merged = merge_operations(local, ops, TableConfig("part"), [UNIQUE], [], "id", Held())
    touched = merged.change.rows.select("id").unionByName(merged.change.gone)
    return local.join(touched, "id", "left_anti").unionByName(merged.change.rows)


def q_resolved(s: SparkSession, d: str) -> DataFrame:
    got = feed.resolved(feed.last_operations(events_feed(s, d)), accounts(s, d), "id")
    return got.select("tableName", "recordId", "operation", F.col("row.name").alias("name"), F.col("row.balance").alias("balance"))


def q_numeric(s: SparkSession, d: str) -> DataFrame:
    """Numbers as timestamps compare as text: 9 beats 10."""
    o = read(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderkey") % 20).alias("updatedAt"))
    return lww.apply_update(o, o.withColumn("updatedAt", F.col("updatedAt") + 1)).select("id", "updatedAt", "action")


def q_null(s: SparkSession, d: str) -> DataFrame:
    k = F.col("id").cast("bigint")
    gaps = lambda r, m: r.withColumn("updatedAt", F.when(k % m == 0, None).when(k % m == 1, "").otherwise(F.col("updatedAt")))
    return lww.apply_update(gaps(replica(s, d), 4), gaps(replica(s, d, 1), 6)).select("id", "updatedAt", "action")


def q_diff(s: SparkSession, d: str) -> DataFrame:
    return capture.difference(replica(s, d), replica(s, d, 1))


def q_offsets(s: SparkSession, d: str) -> DataFrame:
    held = s.createDataFrame([("c0", 5, "x"), ("c9", 7, "y")], "remoteClientId string, lastSeenId long, lastSyncedAt string")
    new = _remotes(s, d).groupBy("remote").agg(F.max("id").alias("lastSeenId")).select(F.col("remote").alias("remoteClientId"), "lastSeenId", F.lit(NOW).alias("lastSyncedAt"))
    return tombstones.replaced(held, new, ["remoteClientId"])


def _remotes(s: SparkSession, d: str) -> DataFrame:
    return events_feed(s, d).withColumn("remote", F.concat(F.lit("c"), (F.col("id") % 5).cast("string")))


def q_gap(s: SparkSession, d: str) -> DataFrame:
    offsets = s.createDataFrame([(f"c{i}", v) for i, v in enumerate([0, 1, 3, 2, 9])] + [("gone", 4), ("new", 0)], "remote string, last_seen long")
    return feed.gaps(feed.beginnings(_remotes(s, d)), offsets)


def q_offset_default(s: SparkSession, d: str) -> DataFrame:
    state = s.createDataFrame([("c0", 12), ("c3", 7)], "remoteClientId string, lastSeenId long")
    return feed.offsets(state, _remotes(s, d).select("remote").distinct())


def q_listing(s: SparkSession, d: str) -> DataFrame:
    """Of a share with files of these names."""
    share = store.Folder(s, scratch(s, "share"))
    share.ensure()
    for name in FILES:
        share.put(name, "")
    found = [(path.rsplit("/", 1)[1], client) for client, path in store.remotes(s, share.path, "me")]
    return s.createDataFrame(found, "file string, client_id string")


def q_heartbeat(s: SparkSession, d: str) -> DataFrame:
    held = s.createDataFrame([(HEARTBEAT_ID, "2024-01-30T12:00:00.000Z")], "id string, updatedAt string")
    return capture.heartbeat(held, "2024-01-31T12:00:00.000Z", HEARTBEAT_ID)


def metas() -> dict[str, TableMeta]:
    names = dict.fromkeys(x[0] for x in SHAPES)
    return {n: TableMeta(tuple(ColumnInfo(*x[2:]) for x in SHAPES if x[0] == n)) for n in names}


def q_discover(s: SparkSession, d: str) -> DataFrame:
    told: list[str] = []
    options = DiscoverOptions(table_options={"posts": TableOptions("modifiedAt")}, on_warning=told.append)
    found = [(t.name, "synced") for t in catalog.discover_tables(metas(), options)]
    return s.createDataFrame(found + [(t.split('"')[1], "no_timestamp") for t in told], "table string, status string")


def q_validate(s: SparkSession, d: str) -> DataFrame:
    errors = catalog.validate(metas(), [TableConfig(n) for n in [*metas(), "absent"]])
    return s.createDataFrame([(e.table, e.message) for e in errors], "table string, message string")


def q_hash(s: SparkSession, d: str) -> DataFrame:
    """Of each table alone, and of all together."""
    known = metas()
    hashes = [(n, catalog.schema_hash(known, [TableConfig(n)])) for n in known]
    return s.createDataFrame([*hashes, ("*", catalog.schema_hash(known, [TableConfig(n) for n in known]))], "table string, schema_hash string")


def q_conflicts(s: SparkSession, d: str) -> DataFrame:
    met = lww.apply_update(replica(s, d), replica(s, d, 1), how="inner").where("resolution is not null")
    return met.select(F.lit("orders").alias("table"), F.col("id").alias("record_id"), "local_updated_at", "remote_updated_at", "resolution")


def q_retained_count(s: SparkSession, d: str) -> DataFrame:
    return feed.expired(events_feed(s, d), SINCE)


def q_append(s: SparkSession, d: str) -> DataFrame:
    f = events_feed(s, d)
    return feed.appended(f.where("id % 2 = 0"), f.where("id % 2 = 1"), SINCE, 1_000_000)


def q_state(s: SparkSession, d: str) -> DataFrame:
    return lww.state_after_pull(in_turn(s, d))


def q_tombstones(s: SparkSession, d: str) -> DataFrame:
    local = replica(s, d)
    gone = tombstones.effective(buried(s, d), local, replica(s, d, 1).where("id % 10 = 0"))
    return lww.apply_delete(local, gone)


def q_nway(s: SparkSession, d: str) -> DataFrame:
    """Four replicas' rows, the newest of each key."""
    rows = None
    for n in (0, *REMOTES):
        r = replica(s, d, n)
        one = _keyed(r.withColumn("row", F.struct(*r.columns)), n, F.lit("UPDATE" if n else "LOCAL"), "row")
        rows = one if rows is None else rows.unionByName(one)
    return lww.standing(lww.pull_in_turn(rows), ["row"]).select("row.*")


def q_versions(s: SparkSession, d: str) -> DataFrame:
    remotes = s.createDataFrame([("a", "v1"), ("b", "v2"), ("c", None)], "client_id string, remote_version string")
    return catalog.version_gate(remotes, "v2")


def q_full_merge(s: SparkSession, d: str) -> DataFrame:
    return lww.apply_update(replica(s, d), replica(s, d, 2)).select("id", "status", "price", "updatedAt")


ORDERS = TableMeta((ColumnInfo("id", "TEXT", 0, 1), ColumnInfo("status"), ColumnInfo("price", "REAL"), ColumnInfo("updatedAt")))


def _round(s: SparkSession, d: str, gap: bool, damaged: bool = False) -> DataFrame:
    """The local orders after one round."""
    return _after_round(s, d, gap, damaged)[0].table("orders")


_ROUNDS: dict[tuple, tuple[store.Replica, SyncResult]] = {}


def _known(s: SparkSession, d: str) -> tuple[store.Replica, SyncResult]:
    """One round for all queries that ask what it left behind."""
    key = s.sparkContext.applicationId, d
    if key not in _ROUNDS:
        _ROUNDS[key] = _after_round(s, d, False, False)
    return _ROUNDS[key]


def _after_round(s: SparkSession, d: str, gap: bool, damaged: bool) -> tuple[store.Replica, SyncResult]:
    """A replica and the round's result, with three remotes in the share; or five, of which one has a feed that is cut short
    and another one's feed has all its bytes overwritten."""
    root, now = scratch(s, "round"), datetime(1999, 1, 1)
    local = store.create(s, f"{root}/local", {"orders": (replica(s, d), ORDERS)})
    store.set_up(local)
    if gap:
        seen = [(f"r{n}", 10**9, "") for n in REMOTES]
        local.commit({SYNC_STATE: s.createDataFrame(seen, local.table(SYNC_STATE).schema)})
    for n in REMOTES:
        remote = store.create(s, f"{root}/r{n}", {"orders": (replica(s, d, n), ORDERS)})
        store.set_up(remote)
        if gap:
            k = F.col("o_orderkey")
            dead = read(s, d, "orders").where(k % 7 == n).select(F.lit("orders").alias("tableName"), k.cast("string").alias("recordId"), F.lit(f"199{n + 3}-06-01").alias("deletedAt"))
            remote.commit({TOMBSTONE: dead})
        else:
            made = numbered(operations(s, d, n).select(F.lit("orders").alias("tableName"), "recordId", "operation", F.lit("1999-01-01 00:00:00").alias("changedAt")), ["recordId"], "id")
            remote.commit({CHANGELOG: made.select(*feed.COLUMNS)})
        remote.publish(f"{root}/share", f"r{n}")
        if damaged and n == 1:
            for client in ("bad-length", "bad-bytes"):
                remote.publish(f"{root}/share", client)
                _spoil(s, f"{root}/share/client-{client}", cut_short=client == "bad-length")
    config = SyncConfig(f"{root}/local", f"{root}/share", "local", now=lambda: now)
    result = perform_sync(local, config, [TableConfig("orders")])
    told = [w for w in result.warnings if "bad-" in w]
    if result.clients_synced != len(REMOTES) or result.had_changelog_gap != gap or len(told) != 2 * damaged:
        raise RuntimeError(f"the round failed: {result.warnings[-1:]}")
    return local, result


def _spoil(s: SparkSession, path: str, cut_short: bool) -> None:
    """Damages a copy's feed: half of each file, or as many zeros."""
    copy = store.Replica(s, path)
    for layer in copy.version.tables[CHANGELOG]:
        folder = store.Folder(s, f"{path}/data/{layer.name}")
        for name, length in layer.files.items():
            folder.drop(name)
            stream = folder.fs.create(folder._path(folder.at(name)))
            stream.write(bytearray(length // 2 if cut_short else length))
            stream.close()


def q_counters(s: SparkSession, d: str) -> DataFrame:
    r = _known(s, d)[1]
    names = ("clients_synced", "inserted", "updated", "deleted", "skipped", "conflicts_resolved")
    return s.createDataFrame([tuple(getattr(r, n) for n in names)], ", ".join(f"{n} long" for n in names))


def q_writes(s: SparkSession, d: str) -> DataFrame:
    """The feed that writing remote 1's rows, then deleting what its feed deletes, makes in the local replica."""
    r = store.create(s, scratch(s, "writes"), {"orders": (replica(s, d), ORDERS)})
    store.set_up(r)
    write(r, "orders", replica(s, d, 1), operations(s, d, 1).where("operation = 'DELETE'").select("recordId"), datetime(1999, 1, 1))
    return r.table(CHANGELOG)


def q_beats(s: SparkSession, d: str) -> DataFrame:
    """What five beats on three days leave in the feed, the last of them in the past."""
    r = store.Replica(s, scratch(s, "beats"))
    store.set_up(r)
    for day, hour in ((1, 0), (1, 23), (2, 5), (4, 1), (3, 1)):
        beat(r, datetime(2024, 1, day, hour))
    return r.table(CHANGELOG).withColumn("held", F.lit(r.table(HEARTBEAT).first()["updatedAt"]))


def q_skipped(s: SparkSession, d: str) -> DataFrame:
    """Remotes with another schema version or none, passed over in a round."""
    root = scratch(s, "skipped")
    tables = {"orders": (replica(s, d).limit(0), ORDERS)}
    for name, version in (("a", "v1"), ("b", "v2"), ("c", None)):
        r = store.create(s, f"{root}/{name}", tables)
        store.set_up(r)
        for v in ("v0", version) if version else ():  # the later one holds
            set_version(r, v)
        r.publish(f"{root}/share", name)
    local = store.create(s, f"{root}/local", tables)
    store.set_up(local)
    result = perform_sync(local, SyncConfig(f"{root}/local", f"{root}/share", "me", schema_version="v2"), [TableConfig("orders")])
    return s.createDataFrame([(x.client_id, x.remote_version, x.local_version) for x in result.skipped_remotes], "client_id string, remote_version string, local_version string")


def q_catalog(s: SparkSession, d: str) -> DataFrame:
    """Columns as a SQLite file declares them, of tables with odd names too; some are read in place, some from a copy."""
    path = scratch(s, "catalog") + ".sqlite"
    odd = {n.replace("cache", 'ca"che').replace("sqlite_", "other_"): m for n, m in metas().items()}
    sqlite.write_file(path, {n: (s.range(0).select(*(F.lit(None).cast("string").alias(c) for c in m.names)), m) for n, m in odd.items()})
    rows = []
    for n, copied in ((0, False), (1, True)):
        opened = sqlite.as_replica(s, path, copied)
        found = sorted(opened.metas.items())
        rows += [(t, i, c.name, c.type, c.notnull, c.pk) for t, m in found[n::2] for i, c in enumerate(m.columns)]
        opened.cleanup()
    return s.createDataFrame(rows, "table string, cid int, column string, type string, notnull int, pk int")


def q_versions_held(s: SparkSession, d: str) -> DataFrame:
    """A reader keeps the version that it opened while a writer goes on; both sides' rows."""
    path = scratch(s, "held")
    store.create(s, path, {"orders": (replica(s, d), ORDERS)})
    reader, writer = store.Replica(s, path), store.Replica(s, path)
    writer.commit(changes={"orders": store.Change(["id"], replica(s, d, 1).where("cast(id as bigint) % 10 = 0"), replica(s, d).where("cast(id as bigint) % 10 = 1").select("id"))})
    return reader.table("orders").withColumn("side", F.lit("reader")).unionByName(writer.table("orders").withColumn("side", F.lit("writer")))


def q_events(s: SparkSession, d: str) -> DataFrame:
    """What a session tells: events in order around its hook, its tables, its status after a round and while on a timer."""
    root, seen = scratch(s, "events"), []
    store.create(s, f"{root}/a", {"orders": (replica(s, d).limit(3), ORDERS)})
    sync = setup_sync(s, SyncConfig(f"{root}/a", f"{root}/share", "a", interval_ms=3_600_000, on_after_sync=lambda r, x: seen.append("hook")))
    for event in EVENTS:
        sync.on(event, lambda _, e=event: seen.append(e))
    seen.append(f"last {sync.get_status().last_result}")
    sync.sync_now()
    sync.start()
    seen.append(f"running {sync.get_status().is_running}")
    sync.stop()
    seen += [f"running {sync.get_status().is_running}", f"syncing {sync.get_status().is_syncing}", *sync.get_synced_tables()]
    return s.createDataFrame(list(enumerate(seen)), "n int, told string")


def q_stream(s: SparkSession, d: str) -> DataFrame:
    """The feed as a stream of files, one a batch."""
    root = scratch(s, "stream")
    events_feed(s, d).repartitionByRange(3, "id").write.parquet(f"{root}/feed")
    return maintained_last_operations(s, f"{root}/feed", f"{root}/state", f"{root}/checkpoint", 1)


def q_sqlite(s: SparkSession, d: str) -> DataFrame:
    """Orders through a SQLite file and back."""
    path = scratch(s, "orders") + ".sqlite"
    sqlite.write_file(path, {"orders": (replica(s, d), ORDERS)})
    return sqlite.read_table(s, path, "orders", rows=50_000)


QUERIES = {
    "perform_sync_normal": lambda s, d: _round(s, d, gap=False),
    "perform_sync_gap": lambda s, d: _round(s, d, gap=True),
    "perform_sync_damaged": lambda s, d: _round(s, d, gap=False, damaged=True),
    "round_counters": q_counters,
    "round_conflicts": lambda s, d: _known(s, d)[1].conflicts,
    "round_feed": lambda s, d: _known(s, d)[0].table(CHANGELOG).where("tableName = 'orders'").select("recordId", "operation", "changedAt"),
    "round_tombstones": lambda s, d: _known(s, d)[0].table(TOMBSTONE),
    "round_offsets": lambda s, d: _known(s, d)[0].table(SYNC_STATE),
    "write_capture": q_writes,
    "heartbeat_feed": q_beats,
    "skipped_remotes": q_skipped,
    "sqlite_catalog": q_catalog,
    "snapshot_isolation": q_versions_held,
    "session_events": q_events,
    "stream_feed_dedup": q_stream,
    "sqlite_roundtrip": q_sqlite,
    "feed_read_since": lambda s, d: feed.read_since(events_feed(s, d), 500),
    "feed_max_id": lambda s, d: feed.max_id(events_feed(s, d)),
    "feed_min_id": lambda s, d: feed.min_id(events_feed(s, d)),
    "feed_gap_by_remote": q_gap,
    "feed_dedup_last_op": lambda s, d: feed.last_operations(events_feed(s, d)),
    "feed_retention_keep": lambda s, d: feed.retained(events_feed(s, d), SINCE),
    "feed_retention_count": q_retained_count,
    "feed_merge_append": q_append,
    "feed_entries_resolved": q_resolved,
    "table_scope_filter": lambda s, d: feed.in_scope(events_feed(s, d), [TableConfig("users"), TableConfig("posts")]),
    "delete_protection": lambda s, d: feed.in_scope(events_feed(s, d), TABLES),
    "capture_snapshot_diff": q_diff,
    "capture_operations": lambda s, d: capture.operations("orders", operations(s, d, 1).withColumn("k", F.col("recordId").cast("bigint")), NOW, 100, ["k"]),
    "tombstone_upsert": lambda s, d: tombstones.latest(events_feed(s, d).where("operation = 'DELETE'").select("tableName", "recordId", F.col("changedAt").alias("deletedAt"))),
    "tombstone_replace": lambda s, d: capture.buried(buried(s, d), "orders", operations(s, d, 2), NOW),
    "tombstones_of_feed": lambda s, d: tombstones.as_of_now(events_feed(s, d)),
    "offset_upsert": q_offsets,
    "offset_default": q_offset_default,
    "lww_apply_insert": lambda s, d: lww.apply_insert(replica(s, d), replica(s, d, 1)),
    "lww_apply_update": lambda s, d: lww.apply_update(replica(s, d), replica(s, d, 1)),
    "lww_apply_delete": lambda s, d: lww.apply_delete(replica(s, d), operations(s, d, 1).where("operation = 'DELETE'")),
    "lww_delete_outcomes": lambda s, d: lww.deleted(replica(s, d), operations(s, d, 1).where("operation = 'DELETE'")),
    "lww_conflict_report": q_conflicts,
    "lww_counters": lambda s, d: lww.counters(lww.apply_update(replica(s, d), replica(s, d, 1))),
    "lww_null_timestamp": q_null,
    "lww_string_order": q_numeric,
    "nway_lww_merge": q_nway,
    "nway_feed_apply_actions": lambda s, d: lww.pull_in_turn(in_turn(s, d)).where("rank > 0").select("key", "rank", "action"),
    "nway_feed_apply_state": q_state,
    "nway_feed_apply_counters": lambda s, d: lww.pull_in_turn(in_turn(s, d)).where("rank > 0").groupBy("rank", "action").agg(F.count("*").alias("n")),
    "full_merge_table": q_full_merge,
    "full_merge_fold": lambda s, d: tombstones.full_merge_in_turn(merge_history(s, d)).where("rank is not null").select("key", "rank"),
    "full_merge_outcomes": lambda s, d: tombstones.full_merge_in_turn(merge_history(s, d)).select("key", F.explode("outcomes").alias("x")).select("key", "x.rank", "x.action"),
    "tombstone_apply": q_tombstones,
    "unique_collision_pairs": lambda s, d: unique.collisions(parts(s, d, "local"), parts(s, d, "remote"), UNIQUE),
    "unique_convergence": q_converge,
    "heartbeat_upsert": q_heartbeat,
    "schema_hash": q_hash,
    "discover_tables": q_discover,
    "validate_tables": q_validate,
    "version_gate": q_versions,
    "remote_listing": q_listing,
}
