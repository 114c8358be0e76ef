"""Rounds of two and three replicas over a shared directory."""

import random
import sqlite3
from datetime import timedelta

import pytest
from conftest import NOW

from lwwspark.model import CHANGELOG, HEARTBEAT, SYNC_STATE, TOMBSTONE, ColumnInfo, SyncConfig, SyncResult, TableMeta, TableOptions
from lwwspark.plans import sync
from lwwspark.plans.sync import Remote
from lwwspark.plans.writes import write
from lwwspark.session import setup_sync
from lwwspark.sources.store import create

USERS = TableMeta((ColumnInfo("id", "TEXT", 0, 1), ColumnInfo("name", "TEXT", 1), ColumnInfo("updatedAt", "TEXT", 1)))
DECISIONS = TableMeta((ColumnInfo("id", "TEXT", 0, 1), ColumnInfo("cellKey", "TEXT", 1), ColumnInfo("updatedAt", "TEXT", 1)), (("cellKey",),))


class Client:
    def __init__(self, spark, root, name, meta=USERS, table="users", **more):
        self.spark, self.table, self.meta, self.clock = spark, table, meta, [NOW]
        columns = ", ".join(f"{c} string" for c in meta.names)
        replica = create(spark, f"{root}/{name}", {table: (spark.createDataFrame([], columns), meta)})
        more = {"schema_version": "v1"} | more
        self.sync = setup_sync(spark, SyncConfig(replica.folder.path, f"{root}/share", name, now=lambda: self.clock[0], **more))

    @property
    def replica(self):
        return self.sync.replica

    def put(self, *rows):
        write(self.replica, self.table, self.spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in self.meta.names)), now=self.clock[0])

    def drop(self, *keys):
        write(self.replica, self.table, deletes=list(keys), now=self.clock[0])

    def rows(self, table=None):
        return sorted(tuple(r) for r in self.replica.table(table or self.table).collect())

    def forget_feed(self):
        self.replica.commit({CHANGELOG: self.replica.table(CHANGELOG).where("false")})

    def now(self):
        return self.sync.sync_now()


@pytest.fixture
def pair(spark, tmp_path):
    return Client(spark, tmp_path, "a"), Client(spark, tmp_path, "b")


def test_insert_update_delete_travel(pair):
    a, b = pair
    a.put(("u1", "Ann", "2024-01-01"))
    a.now()
    r = b.now()
    assert (r.inserted, r.clients_synced, b.rows()) == (1, 1, [("u1", "Ann", "2024-01-01")])
    a.put(("u1", "Anna", "2024-02-01"))
    a.now()
    r = b.now()
    assert b.rows() == [("u1", "Anna", "2024-02-01")] and r.updated == 1
    a.drop("u1")
    a.now()
    r = b.now()
    assert (r.deleted, b.rows()) == (1, [])
    assert [t[:2] for t in b.rows(TOMBSTONE)] == [("users", "u1")]
    r = b.now()
    assert (r.inserted, r.updated, r.deleted, r.clients_synced) == (0, 0, 0, 1)


def test_newest_wins_and_conflicts_are_told(pair):
    a, b = pair
    a.put(("u1", "old", "2024-01-01"))
    b.put(("u1", "new", "2024-06-01"))
    b.now()
    r = a.now()
    assert a.rows() == [("u1", "new", "2024-06-01")]
    assert r.conflicts_resolved == 1 and any("users:u1 resolved as remote_wins" in w for w in r.warnings)


def test_unique_rows_converge_in_rounds(spark, tmp_path):
    a, b = (Client(spark, tmp_path, n, DECISIONS, "decisions") for n in "ab")
    a.put(("d-a", "c1", "2024-01-01"))
    b.put(("d-b", "c1", "2024-06-01"))
    for c in (a, b, a, b):
        c.now()
    assert a.rows() == b.rows() == [("d-b", "c1", "2024-06-01")]


def test_other_schema_versions_are_passed_over(spark, tmp_path):
    a, b = Client(spark, tmp_path, "a"), Client(spark, tmp_path, "b", schema_version="v2")
    a.put(("u1", "Ann", "2024-01-01"))
    a.now()
    r = b.now()
    assert b.rows() == [] and r.clients_synced == 0
    assert [(s.client_id, s.remote_version, s.local_version) for s in r.skipped_remotes] == [("a", "v1", "v2")]
    assert any("schema version mismatch" in w for w in r.warnings)


def test_a_damaged_copy_is_a_warning(pair, tmp_path):
    a, b = pair
    a.put(("u1", "Ann", "2024-01-01"))
    a.now()
    (tmp_path / "share/client-bad.sqlite").write_text("garbage")
    r = b.now()
    assert any("Failed to open remote database: bad" in w for w in r.warnings) and r.inserted == 1


def test_a_remote_that_cannot_be_read_is_a_warning_of_its_own(spark, tmp_path, pair):
    """Its feed is there and as long as it was, but its bytes are not its own; the others are merged."""
    a, b = pair
    c = Client(spark, tmp_path, "c")
    for x, name in ((a, "Ann"), (c, "Cy")):
        x.put((f"u-{name}", name, "2024-01-01"))
        x.now()
    for f in (tmp_path / "share/client-a/data").glob(f"{CHANGELOG}-*/*part-*"):
        if f.name.endswith(".crc"):
            f.unlink()
        else:
            f.write_bytes(bytes(f.stat().st_size))
    r = b.now()
    assert [w for w in r.warnings if "Sync failed for client a" in w] and len(r.warnings) == 1
    assert (r.clients_synced, b.rows()) == (1, [("u-Cy", "Cy", "2024-01-01")])
    a.put(("u-Ann", "Ann", "2024-02-01"))


def test_conflicts_are_all_in_the_result(pair, monkeypatch):
    monkeypatch.setattr("lwwspark.plans.sync.CONFLICT_LINES", 2)
    a, b = pair
    a.put(*((f"u{i}", "old", "2024-01-01") for i in range(5)))
    b.put(*((f"u{i}", "new", "2024-06-01") for i in range(5)))
    a.now()
    r = b.now()
    assert r.conflicts_resolved == 5 and r.warnings[-1] == "3 more conflicts" and len(r.warnings) == 3
    assert sorted(tuple(x) for x in r.conflicts.collect()) == [("users", f"u{i}", "2024-06-01", "2024-01-01", "local_wins") for i in range(5)]


def test_missing_values_take_the_remote_back(spark, tmp_path):
    loose = TableMeta((ColumnInfo("id", "TEXT", 0, 1), ColumnInfo("name"), ColumnInfo("updatedAt", "TEXT", 1)))
    a, b, c = Client(spark, tmp_path, "a", loose), Client(spark, tmp_path, "b"), Client(spark, tmp_path, "c")
    a.put(("u1", None, "2024-01-01"), ("u2", "x", "2024-01-01"))
    c.put(("u2", "y", "2023-01-01"))
    for x in (a, c):
        x.now()
    r = b.now()
    assert any("Sync failed for client a: NOT NULL constraint failed" in w for w in r.warnings)
    assert b.rows() == [("u2", "y", "2023-01-01")] and r.clients_synced == 1 and [s[0] for s in b.rows(SYNC_STATE)] == ["c"]


@pytest.mark.parametrize("full, seed", [(False, 3), (True, 1)])
def test_one_pass_is_what_taking_remotes_in_turn_is(spark, tmp_path, full, seed):
    """Random replicas with a unique column: tables, feeds, tombstones, offsets and counters, all remotes at once and one by one."""
    rng = random.Random(seed)

    def rows(n, ids):
        values = rng.sample(range(14), n)
        return [(k, f"c{v}" if rng.random() < 0.8 else f"own-{k}-{rng.randrange(99)}", f"2024-0{rng.randint(1, 9)}-01") for k, v in zip(rng.sample(ids, n), values, strict=True)]

    ids = [f"k{i}" for i in range(16)]
    remotes = []
    for turn, name in enumerate(("x", "y", "z"), 1):
        c = Client(spark, tmp_path, name, DECISIONS, "decisions")
        c.put(*rows(8, ids))
        c.drop(*rng.sample(ids, 4))
        c.put(*[r for r in rows(3, ids) if r[1] not in {q[1] for q in c.rows()}])
        remotes.append(Remote(turn, name, c.replica, 0))
    start = rows(9, ids)
    results = []
    for way in ("once", "each"):
        local = Client(spark, tmp_path, f"l-{way}", DECISIONS, "decisions")
        local.put(*start)
        result = SyncResult(had_changelog_gap=full)
        for some in [remotes] if way == "once" else [[r] for r in remotes]:
            sync.pull(local.replica, some, local.sync._tables, local.sync._config, NOW, result)
        feed = [(e.tableName, e.recordId, e.operation) for e in local.replica.table(CHANGELOG).orderBy("id").collect()]
        counts = [getattr(result, f) for f in ("clients_synced", "inserted", "updated", "deleted", "skipped", "conflicts_resolved")] + [sorted(result.warnings)]
        results.append((local.rows(), local.rows(TOMBSTONE), local.rows(SYNC_STATE), feed, counts))
    assert results[0] == results[1]


def test_sqlite_files_as_replicas_and_copies(spark, tmp_path):
    """Two clients live in SQLite files, of which one publishes such files too; what their applications write travels."""
    made = "create table users (id text primary key, name text not null, updatedAt text not null); create table _own (x); create index byName on users (name)"
    syncs = {}
    for who, form in (("a", "sqlite"), ("b", "parquet")):
        with sqlite3.connect(f"{tmp_path}/{who}.sqlite") as db:
            db.executescript(made)
        db.close()
        syncs[who] = setup_sync(spark, SyncConfig(f"{tmp_path}/{who}.sqlite", f"{tmp_path}/share", who, now=lambda: NOW, publish_as=form))

    def sql(who, statement):
        with sqlite3.connect(f"{tmp_path}/{who}.sqlite") as db:
            got = db.execute(statement).fetchall()
        db.close()
        return got

    sql("a", "insert into users values ('u1', 'Ann', '2024-01-01'), ('u2', 'Bea', '2024-01-01')")
    assert syncs["a"].sync_now().clients_synced == 0 and (tmp_path / "share/client-a.sqlite").exists()
    assert syncs["b"].sync_now().inserted == 2 and sql("b", "select * from users order by id") == [("u1", "Ann", "2024-01-01"), ("u2", "Bea", "2024-01-01")]
    sql("b", "update users set name = 'Anna', updatedAt = '2024-02-01' where id = 'u1'")
    sql("b", "delete from users where id = 'u2'")
    syncs["b"].sync_now()
    r = syncs["a"].sync_now()
    assert (r.updated, r.deleted, sql("a", "select * from users")) == (1, 1, [("u1", "Anna", "2024-02-01")])
    assert sql("a", "select name from sqlite_master where type = 'index' and name = 'byName'") and sql("a", "select count(*) from _own") == [(0,)]


def gap_after_delete(a, b):
    a.put(("u1", "Ann", "2024-01-01"), ("u2", "Bea", "2024-01-01"))
    a.now()
    b.now()
    a.drop("u1")
    a.forget_feed()
    a.now()


def test_gap_merges_whole_tables_without_zombies(spark, pair, tmp_path):
    a, b = pair
    gap_after_delete(a, b)
    before = len(b.rows(CHANGELOG))
    r = b.now()
    assert r.had_changelog_gap and r.deleted == 1 and b.rows() == [("u2", "Bea", "2024-01-01")]
    assert any("gap detected" in w for w in r.warnings)
    assert not [e for e in b.rows(CHANGELOG)[before:] if e[1] == "users" and e[3] == "DELETE"]
    c = Client(spark, tmp_path, "c")
    c.now()
    assert "u1" not in [k for k, *_ in c.rows()]
    a.now()
    assert [b.now().had_changelog_gap for _ in range(2)] == [False, False]


def test_a_row_made_again_is_kept(pair):
    a, b = pair
    gap_after_delete(a, b)
    a.put(("u1", "back", "2024-06-01"))
    a.forget_feed()
    a.now()
    assert b.now().had_changelog_gap
    assert ("u1", "back", "2024-06-01") in b.rows()


def test_heartbeat_is_logged_once_a_day(pair):
    a, b = pair
    a.now()
    a.now()
    assert a.rows(HEARTBEAT) == [("00000000-0000-0000-0000-000000000000", "2024-07-01T12:00:00.000Z")]
    assert len([e for e in a.rows(CHANGELOG) if e[1] == HEARTBEAT]) == 1
    a.now()
    r = b.now()
    assert b.rows(HEARTBEAT) and (r.inserted, r.updated) == (0, 0)


def test_protected_tables_keep_deleted_rows(spark, tmp_path):
    guard = {"users": TableOptions(delete_protected=True)}
    a, b = Client(spark, tmp_path, "a"), Client(spark, tmp_path, "b", table_options=guard)
    a.put(("u1", "Ann", "2024-01-01"))
    a.now()
    b.now()
    a.drop("u1")
    a.now()
    assert b.now().deleted == 0 and len(b.rows()) == 1


def test_retention_drops_old_entries(pair):
    a, _ = pair
    a.clock[0] = NOW - timedelta(days=30)
    a.put(("u1", "Ann", "2024-01-01"))
    a.clock[0] = NOW
    a.put(("u2", "Bea", "2024-01-01"))
    a.now()
    assert [e[2] for e in a.rows(CHANGELOG) if e[1] == "users"] == ["u2"]


def test_uncaught_collision_takes_the_remote_back(spark, tmp_path):
    """An update that moves a row onto another row's unique value fails; nothing of that remote is kept, not even the offset."""
    a, b = (Client(spark, tmp_path, n, DECISIONS, "decisions") for n in "ab")
    b.put(("x", "c1", "2024-01-01"), ("y", "c2", "2024-01-01"))
    a.put(("x", "c2", "2024-05-01"), ("z", "c9", "2024-05-01"))
    a.now()
    r = b.now()
    assert any("Sync failed for client a" in w for w in r.warnings) and r.clients_synced == 0
    assert b.rows() == [("x", "c1", "2024-01-01"), ("y", "c2", "2024-01-01")] and b.rows(SYNC_STATE) == []


def test_events_status_hook_and_reentry(spark, tmp_path):
    seen = []
    a = Client(spark, tmp_path, "a", on_after_sync=lambda r, result: seen.append("hook"))
    a.sync.on("sync:start", lambda _: seen.append("start"))
    a.sync.on("sync:start", lambda _: 1 / 0)
    a.sync.on("sync:complete", lambda r: seen.append("complete"))
    assert a.sync.get_status().last_result is None
    r = a.now()
    status = a.sync.get_status()
    assert seen == ["start", "hook", "complete"] and status.last_result is r and not status.is_syncing and not status.is_running
    tables = a.sync.get_synced_tables()
    tables.append("x")
    assert a.sync.get_synced_tables() == ["users"]
    a.sync._lock.acquire()
    with pytest.raises(RuntimeError, match="already in progress"):
        a.now()
    a.sync._lock.release()


def test_timer(spark, tmp_path):
    a = Client(spark, tmp_path, "a", interval_ms=50)
    done = __import__("threading").Event()
    a.sync.on("sync:complete", lambda _: done.set())
    a.sync.start()
    a.sync.start()
    assert a.sync.get_status().is_running and done.wait(60)
    a.sync.stop()
    assert not a.sync.get_status().is_running
    while a.sync.get_status().is_syncing:
        __import__("time").sleep(0.1)


def test_setup_refuses_what_is_unfit(spark, tmp_path):
    nothing = TableMeta((ColumnInfo("key", "TEXT", 0, 1),))
    with pytest.raises(ValueError, match="No sync tables"):
        Client(spark, tmp_path, "n", nothing, "t")
    number = TableMeta((ColumnInfo("id", "INTEGER", 0, 1), ColumnInfo("updatedAt", "TEXT")))
    with pytest.raises(ValueError, match="must be TEXT"):
        Client(spark, tmp_path, "m", number, "t")


def test_automatic_versions_differ_with_the_columns(spark, tmp_path):
    more = TableMeta((*USERS.columns, ColumnInfo("email")))
    a, b = Client(spark, tmp_path, "a", schema_version=None), Client(spark, tmp_path, "b", more, schema_version=None)
    a.now()
    assert b.now().skipped_remotes[0].client_id == "a"
