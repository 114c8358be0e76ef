"""Stores, SQLite files and streams."""

import random
import sqlite3

import pytest

from lwwspark.model import CHANGELOG, ColumnInfo, TableMeta
from lwwspark.sources import sqlite, store
from lwwspark.streaming import _segments, feed_stream, maintained_last_operations, recent_activity, run_batches, running_last_operations

META = TableMeta((ColumnInfo("id", "TEXT", 0, 1), ColumnInfo("n", "INTEGER"), ColumnInfo("updatedAt", "TEXT", 1)), (("n",),))
SCHEMA = "id string, n long, updatedAt string"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_versions_are_isolated_and_atomic(spark, tmp_path):
    r = store.create(spark, f"{tmp_path}/r", {"t": (table(spark, ("a", 1, "x")), META)})
    reader = store.Replica(spark, r.folder.path)
    rival = store.Replica(spark, r.folder.path)
    r.commit({"t": table(spark, ("b", 2, "x"))})
    assert [x.id for x in reader.table("t").collect()] == ["a"] and [x.id for x in store.Replica(spark, r.folder.path).table("t").collect()] == ["b"]
    with pytest.raises(store.Busy):
        rival.commit({"t": table(spark, ("c", 3, "x"))})
    r.commit({}, appended={"t": table(spark, ("d", 4, "x"))})
    assert sorted(x.id for x in r.table("t").collect()) == ["b", "d"] and r.metas["t"] == META
    r.vacuum(1)
    assert sorted(x.id for x in store.Replica(spark, r.folder.path).table("t").collect()) == ["b", "d"]


def by_key(r, name="t"):
    return {x.id: (x.n, x.updatedAt) for x in r.table(name).collect()}


def test_changes_are_layers_as_large_as_they_are(spark, tmp_path, monkeypatch):
    """Against a plain dictionary, over folds of small layers and of changes into rows; files are counted."""
    monkeypatch.setattr(store, "MANY_LAYERS", 3)
    rng = random.Random(5)
    state = {f"k{i}": (i, "x") for i in range(400)}
    r = store.create(spark, f"{tmp_path}/r", {"t": (table(spark, *((k, *v) for k, v in state.items())), META)})
    base, written = r.version.tables["t"][0], []
    for step in range(14):
        size = 60 if step == 9 else 3
        put = {f"k{rng.randrange(450)}": (rng.randrange(1000) + 1000, str(step)) for _ in range(size)}
        gone = {f"k{rng.randrange(450)}" for _ in range(2)} - set(put) if step % 2 else set()
        before = {x.name for x in r.version.tables["t"]}
        r.commit(changes={"t": store.Change(["id"], table(spark, *((k, *v) for k, v in put.items())), spark.createDataFrame([(k,) for k in gone], "id string"))})
        state = {k: v for k, v in (state | put).items() if k not in gone}
        assert by_key(r) == state and len(r.version.tables["t"]) <= 2 + store.MANY_LAYERS
        written.append(sum(x.rows for x in r.version.tables["t"] if x.name not in before))
        if step < 9:
            assert r.version.tables["t"][0] == base
    assert max(written[:9]) < 40 and sum(written[:9]) < 200  # never the table
    assert by_key(store.Replica(spark, r.folder.path)) == state
    r.publish(f"{tmp_path}/share", "a")
    assert by_key(store.open_remote(spark, f"{tmp_path}/share/client-a")) == state
    r.commit(changes={"t": store.Change(["id"], table(spark))})
    assert by_key(r) == state


def test_feeds_keep_few_layers_and_drop_whole_ones(spark, tmp_path):
    r = store.Replica(spark, f"{tmp_path}/r")
    entry = lambda i, day: (i, "t", str(i), "INSERT", f"2024-01-{day:02} 00:00:00")
    feed = "id long, tableName string, recordId string, operation string, changedAt string"
    for n in range(1, 41):
        r.commit(appended={CHANGELOG: spark.createDataFrame([entry(n, (n + 1) // 2)], feed)})
    assert len(r.version.tables[CHANGELOG]) <= store.MANY_LAYERS + 1 and r.feed_span() == (1, 40)
    before = {x.name for x in r.version.tables[CHANGELOG]}
    assert r.drop_expired("2024-01-11 00:00:00") == 20 and sorted(x.id for x in r.table(CHANGELOG).collect()) == list(range(21, 41)) and r.feed_span() == (21, 40)
    assert len({x.name for x in r.version.tables[CHANGELOG]} - before) <= 1
    assert r.drop_expired("2024-01-11 00:00:00") == 0 and r.drop_expired("2025") == 20 and r.table(CHANGELOG).count() == 0 and r.feed_span() is None


def test_damage_shows_when_a_copy_is_opened_or_read(spark, tmp_path):
    r = store.create(spark, f"{tmp_path}/r", {"t": (table(spark, *((f"k{i}", i, "x") for i in range(3000))).coalesce(1), META)})
    for who in ("short", "bytes", "gone"):
        r.publish(f"{tmp_path}/share", who)
    at = {who: next(p for p in (tmp_path / f"share/client-{who}/data").glob("t-*/part-*")) for who in ("short", "bytes", "gone")}
    at["gone"].unlink()
    at["short"].write_bytes(at["short"].read_bytes()[:-100])
    raw = bytearray(at["bytes"].read_bytes())
    raw[len(raw) // 3] ^= 0xFF
    at["bytes"].write_bytes(raw)
    assert store.open_remote(spark, f"{tmp_path}/share/client-short") is None and store.open_remote(spark, f"{tmp_path}/share/client-gone") is None
    (at["bytes"].parent / f".{at['bytes'].name}.crc").unlink()  # not what the file system remembers of its bytes: the pages' own sums
    copy = store.open_remote(spark, f"{tmp_path}/share/client-bytes")
    with pytest.raises(Exception, match="(?i)checksum|FAILED_READ_FILE"):
        copy.table("t").collect()


def test_listing_and_opening(spark, tmp_path):
    share = f"{tmp_path}/share"
    assert store.remotes(spark, share, "me") == []
    r = store.create(spark, f"{tmp_path}/r", {"t": (table(spark, ("a", 1, "x")), META)})
    for who in ("b", "a", "me"):
        r.publish(share, who)
    (tmp_path / "share/client-z.sqlite.tmp").write_text("")
    (tmp_path / "share/other").write_text("")
    (tmp_path / "share/client-bad.sqlite").write_text("garbage" * 1000)
    assert [c for c, _ in store.remotes(spark, share, "me")] == ["a", "b", "bad"]
    assert store.open_remote(spark, f"{share}/client-a").table("t").count() == 1
    assert store.open_remote(spark, f"{share}/client-bad.sqlite") is None and store.open_remote(spark, f"{share}/client-none") is None
    files = lambda: sorted(p.name for p in (tmp_path / "share/client-a/data").iterdir())
    before = files()
    r.publish(share, "a")
    assert files() == before  # unchanged tables aren't copied again


def test_sqlite_files_go_both_ways(spark, tmp_path):
    path = f"{tmp_path}/client-x.sqlite"
    rows = [(f"k{i}", i if i % 5 else None, "2024") for i in range(250)]
    sqlite.write_file(path, {"t": (table(spark, *rows), META), 'odd "name"': (table(spark), META)})
    assert sqlite3.connect(path).execute("select count(*), sum(n) from t").fetchone() == (250, sum(n or 0 for _, n, _ in rows))
    got = sqlite.read_table(spark, path, "t", rows=100)
    assert got.rdd.getNumPartitions() == 3 and sorted(map(tuple, got.collect())) == sorted(rows)
    assert sqlite.declared(path)["t"] == META
    replica = store.open_remote(spark, path)
    with sqlite3.connect(path) as db:
        db.execute("delete from t")
    assert replica.table("t").count() == 250 and replica.table('odd "name"').count() == 0
    assert store.open_remote(spark, path, copy=False).table("t").count() == 0
    sqlite.export(replica, f"{tmp_path}/out", "y")
    assert store.open_remote(spark, f"{tmp_path}/out/client-y.sqlite").table("t").count() == 250


def test_sqlite_tables_of_any_kind(spark, tmp_path):
    """Sparse rowids, tables without rowids, expression and partial indexes, cascades."""
    path = f"{tmp_path}/odd.sqlite"
    with sqlite3.connect(path) as db:
        db.execute("create table sparse (id integer primary key, v text)")
        db.executemany("insert into sparse values (?, ?)", [(1, "a"), (1_700_000_000_000, "b"), (-5, "c")])
        db.execute("create table plain (a text, b int, v text, primary key (a, b)) without rowid")
        db.executemany("insert into plain values (?, ?, ?)", [(f"k{i % 3}", i, str(i)) for i in range(250)])
        db.execute("create table refs (id text primary key, of int references sparse(id) on delete cascade, w text, x text, y text unique)")
        db.execute("create unique index e on refs (lower(w))")
        db.execute("create unique index p on refs (x) where x > 'm'")
    db.close()
    got = sqlite.read_table(spark, path, "sparse", rows=2)
    assert got.rdd.getNumPartitions() == 2 and sorted(map(tuple, got.collect())) == [(-5, "c"), (1, "a"), (1_700_000_000_000, "b")]
    got = sqlite.read_table(spark, path, "plain", rows=40)
    assert got.rdd.getNumPartitions() == 7 and sorted(map(tuple, got.collect())) == sorted((f"k{i % 3}", i, str(i)) for i in range(250))
    meta = sqlite.declared(path)["refs"]
    assert meta.unique == (("y",),) and meta.cascades == (("of", "sparse"),)
    with pytest.raises(ValueError, match="every executor"):
        sqlite.local_path("hdfs://x/y.sqlite")


def test_a_stream_can_be_run_again(spark, tmp_path):
    """After each run, with news or without, the state is that of the whole feed; old state goes."""
    from lwwspark.operators.feed import last_operations

    feed, state, checkpoint = (f"{tmp_path}/{n}" for n in ("feed", "state", "cp"))
    (tmp_path / "feed").mkdir()
    schema = "id long, tableName string, recordId string, operation string, changedAt string"
    assert maintained_last_operations(spark, feed, state, checkpoint).count() == 0
    for n in range(6):
        entries = [(n * 10 + i, "t", str((i + n) % 7), "UPDATE" if i % 3 else "DELETE", "2024") for i in range(10)]
        if n != 3:
            spark.createDataFrame(entries, schema).repartitionByRange(2, "id").write.mode("append").parquet(feed)
        got = maintained_last_operations(spark, feed, state, checkpoint, files_per_batch=1)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, last_operations(spark.read.schema(schema).parquet(feed)).collect()))
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.isdigit()]) <= 6
    assert [_segments(n) for n in (1, 2, 3, 4, 6)] == [[0], [1], [2, 1], [3], [5, 3]]


def test_streams(spark, tmp_path):
    for n in range(3):
        entries = [(n * 10 + i, "t", str(i % 4), "UPDATE" if i % 3 else "DELETE", f"2024-01-0{n + 1} 00:00:00") for i in range(10)]
        spark.createDataFrame(entries, "id long, tableName string, recordId string, operation string, changedAt string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    stream = feed_stream(spark, f"{tmp_path}/feed", 1)
    q = running_last_operations(stream).writeStream.outputMode("complete").format("memory").queryName("last_ops").trigger(availableNow=True).start()
    q.awaitTermination()
    from lwwspark.operators.feed import last_operations

    batch = last_operations(spark.read.parquet(f"{tmp_path}/feed"))
    assert sorted(map(tuple, spark.table("last_ops").collect())) == sorted(map(tuple, batch.collect()))
    seen = []
    run_batches(stream, lambda df, n: seen.append(df.count()), f"{tmp_path}/cp").awaitTermination()
    assert seen == [4, 4, 4]
    q = recent_activity(stream).writeStream.outputMode("append").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination()
    assert all(r.n == 10 for r in spark.table("activity").collect())


def test_setup_and_capture_of_writes(spark, tmp_path):
    from datetime import datetime

    from lwwspark.model import CHANGELOG, HEARTBEAT, SYSTEM_TABLES, TOMBSTONE
    from lwwspark.plans.writes import beat, set_version, write

    r = store.create(spark, f"{tmp_path}/r", {"t": (table(spark), META)})
    store.set_up(r)
    store.set_up(r)
    assert all(r.has(n) and r.table(n).schema.names == s.names for n, s in SYSTEM_TABLES.items())
    now = datetime(2024, 7, 1, 23, 59)
    write(r, "t", table(spark, ("a", 1, "x"), ("b", 2, "x")), now=now)
    write(r, "t", table(spark, ("a", 1, "x")), now=now)  # changes nothing, is logged
    write(r, "t", deletes=["b", "nobody"], now=now)
    log = sorted(map(tuple, r.table(CHANGELOG).collect()))
    assert [e[:4] for e in log] == [(1, "t", "a", "INSERT"), (2, "t", "b", "INSERT"), (3, "t", "a", "UPDATE"), (4, "t", "b", "DELETE")] and log[0][4] == "2024-07-01 23:59:00"
    assert [tuple(x) for x in r.table(TOMBSTONE).collect()] == [("t", "b", "2024-07-01 23:59:00")]
    assert beat(r, now) and not beat(r, now) and beat(r, datetime(2024, 7, 2)) and not beat(r, datetime(2024, 7, 1))
    assert [x.operation for x in r.table(CHANGELOG).where(f"tableName = '{HEARTBEAT}'").orderBy("id").collect()] == ["INSERT", "UPDATE"]
    r.commit({CHANGELOG: r.table(CHANGELOG).where("false")})
    write(r, "t", table(spark, ("c", 3, "x")), now=now)
    assert [x.id for x in r.table(CHANGELOG).collect()] == [7]  # ids are never given out twice
    assert r.schema_version() is None
    set_version(r, "v1")
    set_version(r, "v2")
    assert store.Replica(spark, r.folder.path).schema_version() == "v2"


def test_writes_keep_keys_unique_and_follow_references(spark, tmp_path):
    from datetime import datetime

    from lwwspark.model import CHANGELOG, TOMBSTONE
    from lwwspark.plans.writes import write

    now, text = datetime(2024, 7, 1), "id string, userId string, updatedAt string"
    users = TableMeta((ColumnInfo("id", "TEXT", 0, 1), ColumnInfo("n", "INTEGER"), ColumnInfo("updatedAt", "TEXT", 1)))
    notes = TableMeta((ColumnInfo("id", "TEXT", 0, 1), ColumnInfo("userId"), ColumnInfo("updatedAt", "TEXT", 1)), (), (("userId", "users"),))
    marks = TableMeta(notes.columns, (), (("userId", "notes"),))
    r = store.create(spark, f"{tmp_path}/r", {"users": (table(spark), users), "notes": (spark.createDataFrame([], text), notes), "marks": (spark.createDataFrame([], text), marks)})
    store.set_up(r)
    write(r, "users", table(spark, ("b", 1, "2021"), ("b", 1, "2022"), ("c", 1, "x")), now=now)
    assert by_key(r, "users") == {"b": (1, "2022"), "c": (1, "x")}
    assert sorted((x.recordId, x.operation) for x in r.table(CHANGELOG).collect()) == [("b", "INSERT"), ("b", "UPDATE"), ("c", "INSERT")]
    with pytest.raises(ValueError, match="NOT NULL constraint failed: users.updatedAt"):
        write(r, "users", table(spark, ("d", 1, None)), now=now)
    write(r, "notes", spark.createDataFrame([("n1", "b", "1"), ("n2", "c", "1"), ("n3", "b", "1")], text), now=now)
    write(r, "marks", spark.createDataFrame([("m1", "n1", "1"), ("m2", "n2", "1")], text), now=now)
    write(r, "users", table(spark, ("e", 1, "x")), deletes=["b", "e"], now=now)
    assert set(by_key(r, "users")) == {"c"} and [x.id for x in r.table("notes").collect()] == ["n2"] and [x.id for x in r.table("marks").collect()] == ["m2"]
    gone = [(x.tableName, x.recordId) for x in r.table(CHANGELOG).where("operation = 'DELETE'").orderBy("id").collect()]
    assert gone == [("marks", "m1"), ("notes", "n1"), ("notes", "n3"), ("users", "b"), ("users", "e")]
    assert {(x.tableName, x.recordId) for x in r.table(TOMBSTONE).collect()} == set(gone)
