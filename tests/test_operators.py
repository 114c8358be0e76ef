"""Small facts about operators, and comparisons with plain Python folds."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lwwspark.model import ColumnInfo, DiscoverOptions, TableConfig, TableMeta, TableOptions
from lwwspark.operators import capture, components, feed, lww, tombstones, unique
from lwwspark.operators.numbering import numbered
from lwwspark.plans import catalog
from lwwspark.plans.sync import Held, merge_operations

ROW = "id string, name string, email string, updatedAt string"
FEED = "id long, tableName string, recordId string, operation string, changedAt string"


def test_gap_rules(spark):
    feeds = spark.createDataFrame([("b", 2), ("c", 1), ("c", 2)], "remote string, id long")
    offsets = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("d", 5), ("e", None)], "remote string, last_seen long")
    assert {r.remote: r.has_gap for r in feed.gaps(feed.beginnings(feeds), offsets).collect()} == {"a": False, "b": True, "c": False, "d": True, "e": False}


def test_feed_reads_after_the_offset_and_empty_feeds(spark):
    f = spark.createDataFrame([(1, "t", "a", "INSERT", "x"), (2, "t", "a", "UPDATE", "x"), (3, "t", "a", "DELETE", "x")], FEED)
    assert sorted(r.id for r in feed.read_since(f, 1).collect()) == [2, 3] and feed.read_since(f, 3).count() == 0
    assert feed.max_id(f).first()[0] == 3 and feed.max_id(f.where("false")).first()[0] == 0
    assert [tuple(r) for r in feed.last_operations(f).collect()] == [("t", "a", "DELETE", 1)]
    assert feed.last_operations(f.where("false")).count() == 0


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(i, "t", str(i), "INSERT", "x") for i in range(10)], FEED).write.parquet(str(tmp_path / "f"))
    plan = feed.read_since(spark.read.parquet(str(tmp_path / "f")), 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan


def rows(spark, *r):
    return spark.createDataFrame(list(r), ROW)


def outcome(df):
    return {r.id: (r.name, r.action, r.resolution) for r in df.collect()}


def test_insert_and_update(spark):
    local = rows(spark, ("k", "l", "e", "2024-01-02"), ("tie", "l", "e", "2024-01-02"), ("only", "l", "e", None))
    remote = rows(spark, ("k", "r", "e", "2024-06-01"), ("tie", "r", "e", "2024-01-02"), ("new", "r", "e", None))
    assert outcome(lww.apply_insert(local, remote)) == {
        "k": ("r", "upserted", "remote_wins"), "tie": ("l", "upserted", "local_wins"), "new": ("r", "inserted", None), "only": ("l", None, None)}
    assert outcome(lww.apply_update(local, remote)) == {
        "k": ("r", "updated", "remote_wins"), "tie": ("l", "skipped", None), "new": ("r", "inserted", None), "only": ("l", None, None)}
    asked = spark.createDataFrame([("k",), ("nobody",)], "recordId string")
    assert {r.recordId: r.action for r in lww.deleted(local, asked).collect()} == {"k": "deleted", "nobody": "skipped"}
    assert sorted(r.id for r in lww.apply_delete(local, asked).collect()) == ["only", "tie"]


def sequential(history):
    """{key: [(rank, op, ts)]} applied remote by remote."""
    state, actions = {}, {}
    for key, entries in history.items():
        for rank, op, ts in sorted(entries):
            held = state.get(key)
            ts = ts or ""
            if op == "LOCAL":
                state[key] = (ts, rank)
                continue
            if op == "DELETE":
                actions[key, rank] = "deleted" if held else "missed"
                state.pop(key, None)
            elif held is None:
                actions[key, rank] = "inserted"
                state[key] = (ts, rank)
            else:
                actions[key, rank] = "upserted" if op == "INSERT" else "updated" if ts > held[0] else "skipped"
                if ts > held[0]:
                    state[key] = (ts, rank)
    return {k: r for k, (_, r) in state.items()}, actions


def test_pull_in_turn_is_the_sequential_fold(spark):
    rng, entries, history = random.Random(3), [], {}
    for k in range(400):
        for rank in range(5):
            op = rng.choice(["LOCAL", None]) if rank == 0 else rng.choice(["INSERT", "UPDATE", "DELETE", None])
            if op:
                ts = None if op == "DELETE" else rng.choice([None, "", "1", "2", "3"])
                entries.append((str(k), rank, op, ts))
                history.setdefault(str(k), []).append((rank, op, ts))
    df = spark.createDataFrame(entries, "key string, rank int, op string, ts string")
    state, actions = sequential(history)
    assert {r.key: r["rank"] for r in lww.state_after_pull(df).collect()} == state
    assert {(r.key, r["rank"]): r.action for r in lww.pull_in_turn(df).where("rank > 0").collect()} == actions


META = ["id", "u", "updatedAt"]


def table_fold(local, ops):
    """A whole table with one unique column, operation after operation."""
    state = unique.Rows("id", "updatedAt", [("u",)])
    for r in local:
        state.hold(r)
    told = []
    for pos, op, row in ops:
        try:
            action = state.delete(row["id"])[0] if op == "DELETE" else (state.insert if op == "INSERT" else state.update)(row)[0]
        except ValueError:
            return None, pos
        told.append((pos, action))
    return {k: (r["u"], r["updatedAt"]) for k, r in state.rows.items()}, told


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000))
def test_components_fold_like_the_whole_table(spark, seed):
    rng = random.Random(seed)
    u = lambda: rng.choice([None, *range(12)])
    taken, local = set(), []
    for i in range(12):
        v = u()
        if v not in taken or v is None:
            taken.add(v)
            local.append({"id": f"k{i}", "u": v, "updatedAt": rng.choice("123")})
    ops = [(n, rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), {"id": f"k{k}", "u": u(), "updatedAt": rng.choice("1234")}) for n, k in enumerate(rng.sample(range(18), 10))]
    schema = "id string, u int, updatedAt string"
    l = spark.createDataFrame([tuple(r[c] for c in META) for r in local], schema)
    o = spark.createDataFrame([(1, n, r["id"], op, None if op == "DELETE" else tuple(r[c] for c in META)) for n, op, r in ops], f"rank int, pos long, recordId string, operation string, row struct<{schema.replace(' ', ':').replace(',:', ',')}>")
    merged = merge_operations(l, o, TableConfig("t"), [("u",)], [], "id", Held())
    expected, told = table_fold(local, ops)
    if expected is None:
        assert min(merged.failures)[:2] == (1, told)
        return
    assert not merged.failures
    rows, gone = merged.change.rows.collect(), [r.id for r in merged.change.gone.collect()]
    touched = [r.id for r in rows] + gone
    assert len(touched) == len(set(touched)) and set(gone) <= {r["id"] for r in local}
    after = {r["id"]: (r["u"], r["updatedAt"]) for r in local if r["id"] not in touched} | {r.id: (r.u, r.updatedAt) for r in rows}
    assert after == expected
    assert sorted((r.pos, r.action) for r in merged.outcomes.collect()) == told


def test_tombstones_yield_to_rows_made_again_and_newer_rows(spark):
    stones = spark.createDataFrame([("t", k, "2024-03-01") for k in ("old", "new", "again", "absent")], "tableName string, recordId string, deletedAt string")
    local = rows(spark, ("old", "", "", "2024-01-01"), ("new", "", "", "2024-05-01"), ("again", "", "", "2024-01-01"), ("none", "", "", None))
    assert [r.recordId for r in tombstones.effective(stones, local, rows(spark, ("again", "", "", "x"))).collect()] == ["old"]
    iso = rows(spark, ("old", "", "", "2024-03-01T00:00:00Z"))
    blank = spark.createDataFrame([("t", "old", "2024-03-01 23:59:59")], stones.schema)
    assert tombstones.effective(blank, iso, iso.where("false")).count() == 0  # a blank sorts before T


def test_capture_and_numbers(spark):
    old = rows(spark, ("a", "1", "", "x"), ("b", "1", "", "x"), ("c", None, "", "x"))
    new = rows(spark, ("a", "1", "", "x"), ("b", "2", "", "x"), ("d", "1", "", "x"))
    assert {r.recordId: r.operation for r in capture.difference(old, new).collect()} == {"b": "UPDATE", "c": "DELETE", "d": "INSERT"}
    many = numbered(spark.range(1000).repartition(7), ["id"], "n", 5)
    assert [r.n - r.id for r in many.collect()] == [6] * 1000
    assert numbered(spark.range(0), ["id"], "n").count() == 0


def meta(*columns, unique=()):
    return TableMeta(tuple(ColumnInfo(*c) if isinstance(c, tuple) else ColumnInfo(c) for c in columns), unique)


def test_discovery_and_validation():
    told = []
    metas = {"zeta": meta("id", "updatedAt"), "alpha": meta("id", "modifiedAt"), "cache": meta("id", "value"), "joins": meta("userId", "updatedAt"), "_x": meta("id", "updatedAt"), "sqlite_sequence": meta("id", "updatedAt")}
    options = DiscoverOptions(table_options={"alpha": TableOptions("modifiedAt", True)}, on_warning=told.append)
    assert catalog.discover_tables(metas, options) == [TableConfig("alpha", "modifiedAt", True), TableConfig("zeta")]
    assert len(told) == 1 and '"cache"' in told[0]
    told.clear()
    options.exclude_tables = ("cache",)
    catalog.discover_tables(metas, options)
    assert not told and catalog.discover_tables({}) == []
    bad = {"n": meta(("id", "INTEGER"), "x"), "k": meta("x")}
    assert [(e.table, e.message.split()[0]) for e in catalog.validate(bad, [TableConfig("gone"), TableConfig("k"), TableConfig("n")])] == [("gone", "Table"), ("k", "Primary"), ("n", "Primary"), ("n", "Column")]
    assert catalog.schema_hash(metas, [TableConfig("zeta")]) != catalog.schema_hash({"zeta": meta("id", "updatedAt", "more")}, [TableConfig("zeta")])


def test_newest_of_many_replicas_prefers_low_ranks_on_ties(spark):
    df = spark.createDataFrame([("a", "LOCAL", None, 0), ("a", "UPDATE", "", 1), ("b", "LOCAL", "1", 0), ("b", "UPDATE", "2", 2), ("b", "UPDATE", "2", 1)], "key string, op string, ts string, rank int")
    assert {r.key: (r["rank"], r.was_held) for r in lww.standing(lww.pull_in_turn(df)).collect()} == {"a": (0, True), "b": (1, True)}


def test_full_merges_tell_what_each_remote_did(spark):
    rows = [("a", 0, "ROW", "2"), ("a", 1, "TOMBSTONE", "3"), ("a", 2, "ROW", "1"), ("a", 3, "ROW", "0"), ("b", 0, "ROW", "5"), ("b", 1, "TOMBSTONE", "5"), ("b", 2, "ROW", "6"), ("c", 2, "TOMBSTONE", "9")]
    got = {r.key: (r["rank"], r.was_held, [tuple(x) for x in r.outcomes]) for r in tombstones.full_merge_in_turn(spark.createDataFrame(rows, "key string, rank int, kind string, ts string")).collect()}
    assert got == {"a": (2, True, [(1, "deleted", "3"), (2, "inserted", "1"), (3, "skipped", "0")]), "b": (2, True, [(2, "updated", "6")]), "c": (None, False, [])}


def test_of_rows_with_one_key_one_stands(spark):
    new = rows(spark, ("b", "x", "", "2021"), ("b", "x", "", "2022"), ("c", "", "", "1"))
    got = tombstones.replaced(rows(spark, ("a", "", "", "1"), ("b", "", "", "0")), new, ["id"])
    assert sorted((r.id, r.updatedAt) for r in got.collect()) == [("a", "1"), ("b", "2022"), ("c", "1")]


def test_a_long_chain_of_unique_values_is_one_component_in_few_rounds(spark, monkeypatch):
    """10,000 pairs: local row i holds value i, the remote's row i holds value i + 1."""
    cuts = []
    of = components.cut
    monkeypatch.setattr(components, "cut", lambda df: cuts.append(1) or of(df))
    key = F.format_string("k%06d", "id").alias("id")
    local = spark.range(10_000).select(key, F.col("id").alias("u"), F.lit("1").alias("updatedAt"))
    remote = spark.range(10_000).select(key, (F.col("id") + 1).alias("u"), F.lit("2").alias("updatedAt"))
    labels = unique.components(local, remote.repartition(7), [("u",)])
    assert labels.count() == 10_000 and {r.component for r in labels.select("component").distinct().collect()} == {"k000000"}
    assert len(cuts) <= 20
    assert unique.components(local, local, [("u",)]).count() == 0


def test_components_of_text_chains_stars_and_nothing(spark):
    links = [(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("200", f"{i}") for i in range(201, 300)] + [("7", "7")]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {**{f"{i:03}": "000" for i in range(1, 61)}, **{f"{i}": "200" for i in range(201, 300)}}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0
