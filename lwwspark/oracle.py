"""The queries once more, in DuckDB's SQL and on purpose in other words."""

from __future__ import annotations

from .model import HEARTBEAT_ID
from .queries import FILES, NOW, REMOTES, SHAPES, SINCE


def _replica(n: int = 0) -> str:
    mine = "o_orderkey % 3 <> 0" if n == 0 else f"o_orderkey % 7 <> {n}"
    day = "o_orderdate" if n == 0 else f"o_orderdate + to_days(cast(o_orderkey * {n + 1} % 5 - 2 as integer))"
    return f"(select cast(o_orderkey as varchar) as id, o_orderstatus as status, o_totalprice + {n} as price, strftime({day}, '%Y-%m-%d') as updatedAt from orders where {mine})"


def _ops(n: int) -> str:
    return f"""(select cast(o_orderkey as varchar) as recordId, case when o_orderkey % 13 = {n} then 'DELETE' when o_orderkey % 2 = 0 then 'INSERT' else 'UPDATE' end as operation
      from orders where o_orderkey % 7 <> {n} or o_orderkey % 13 = {n})"""


_FEED = """(select event_id + 1 as id, case user_id % 3 when 0 then 'users' when 1 then 'posts' else 'items' end as tableName, cast(user_id as varchar) as recordId,
      case event_type when 'signup' then 'INSERT' when 'error' then 'DELETE' else 'UPDATE' end as operation, strftime(ts, '%Y-%m-%d %H:%M:%S') as changedAt from events)"""
_REMOTES = f"(select *, 'c' || cast(id % 5 as varchar) as remote from {_FEED})"
_BURIED = "(select 'orders' as tableName, cast(o_orderkey as varchar) as recordId, '199' || cast(o_orderkey % 9 as varchar) || '-06-01' as deletedAt from orders where o_orderkey % 5 = 0)"


def _parts(which: str) -> str:
    pick = "min" if which == "local" else "max"
    day = "'2024-01-02'" if which == "local" else "case when k % 2 = 0 then '2024-01-03' else '2024-01-01' end"
    return f"""(select cast(k as varchar) as id, p_brand as brand, p_type as type, p_size as size, {day} as updatedAt
      from (select p_brand, p_type, p_size, {pick}(p_partkey) as k from part group by all))"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_SHAPES = f'(select * from (values {_values(SHAPES)}) v("table", cid, "column", type, "notnull", pk))'
_LAST = f"(select tableName, recordId, arg_max(operation, id) as operation, min(id) as pos from {_FEED} group by 1, 2)"
_DELETED = f"(select recordId from {_ops(1)} where operation = 'DELETE')"


def _outer(n: int, hit: str, tie: str, told: str) -> str:
    l, r = _replica(), _replica(n)
    pick = lambda c: f"case when r.updatedAt > l.updatedAt then r.{c} else l.{c} end as {c}"
    cols = ", ".join(pick(c) for c in ("id", "status", "price", "updatedAt"))
    return f"""
select {cols}, case when r.updatedAt > l.updatedAt then '{hit}' else '{tie}' end as action,
  case when {told} then l.updatedAt end as local_updated_at, case when {told} then r.updatedAt end as remote_updated_at,
  case when {told} then case when r.updatedAt > l.updatedAt then 'remote_wins' else 'local_wins' end end as resolution
from {l} l join {r} r on l.id = r.id
union all select l.*, null, null, null, null from {l} l where not exists (from {r} r where r.id = l.id)
union all select r.*, 'inserted', null, null, null from {r} r where not exists (from {l} l where l.id = r.id)"""


def _turns() -> str:
    """All histories as ordered lists, folded one entry after the other: (rank, ts) that stands, and what each entry did."""
    rows = [f"select id as key, 0 as rank, 'LOCAL' as op, updatedAt as ts from {_replica()}"]
    for n in REMOTES:
        rows.append(f"select recordId, {n}, operation, r.updatedAt from {_ops(n)} o join {_replica(n)} r on r.id = o.recordId where operation <> 'DELETE'")
        rows.append(f"select recordId, {n}, 'DELETE', null from {_ops(n)} where operation = 'DELETE'")
    entries = " union all ".join(rows)
    return f"""
with recursive e as (select *, row_number() over (partition by key order by rank) as n from ({entries})),
f as (
  select key, n, rank, cast(null as varchar) as action, case when op = 'DELETE' then null else rank end as held, case when op = 'DELETE' then null else ts end as held_ts, op from e where n = 1
  union all
  select e.key, e.n, e.rank, null,
    case when e.op = 'DELETE' then null when f.held is null or e.ts > f.held_ts then e.rank else f.held end,
    case when e.op = 'DELETE' then null when f.held is null or e.ts > f.held_ts then e.ts else f.held_ts end, e.op
  from f join e on e.key = f.key and e.n = f.n + 1),
a as (
  select f.key, f.rank, f.n, f.held,
    case when f.op = 'DELETE' then case when p.held is not null then 'deleted' else 'missed' end
      when p.held is null then 'inserted' when f.op = 'INSERT' then 'upserted' when f.held = f.rank then 'updated' else 'skipped' end as action
  from f left join f p on p.key = f.key and p.n = f.n - 1)
"""


def _history() -> str:
    rows = [f"select id as key, 0 as rank, 'ROW' as kind, updatedAt as ts from {_replica()}"]
    for n in REMOTES:
        rows.append(f"select id, {n}, 'ROW', updatedAt from {_replica(n)}")
        rows.append(f"select cast(o_orderkey as varchar), {n}, 'TOMBSTONE', '199{n + 3}-06-01' from orders where o_orderkey % 7 = {n}")
    return " union all ".join(rows)


_NULLS = [f"(select id, case when cast(id as bigint) % {m} = 0 then null when cast(id as bigint) % {m} = 1 then '' else updatedAt end as updatedAt from {_replica(n)})" for n, m in ((0, 4), (1, 6))]
_L, _R = _replica(), _replica(1)

_ANY = " union all ".join(f"select *, {n} as rank from {_replica(n)}" for n in (0, *REMOTES))
_STATE = "select key, held as rank from a where held is not null qualify row_number() over (partition by key order by n desc) = 1 and n = (select max(n) from e where e.key = a.key)"
_FOLD = f"""
        with recursive e as (select *, row_number() over (partition by key order by rank) as n, count(*) over (partition by key) as size from ({_history()})),
        f as (
          select key, n, size, case when kind = 'ROW' then rank end as held, case when kind = 'ROW' then ts end as held_ts from e where n = 1
          union all
          select e.key, e.n, e.size,
            case when e.kind = 'ROW' then case when f.held is null or e.ts > f.held_ts then e.rank else f.held end else case when e.ts > f.held_ts then null else f.held end end,
            case when e.kind = 'ROW' then case when f.held is null or e.ts > f.held_ts then e.ts else f.held_ts end else case when e.ts > f.held_ts then null else f.held_ts end end
          from f join e on e.key = f.key and e.n = f.n + 1)
        """
_STANDS = "select key, held as rank from f where n = size and held is not null"
_ROWS = f"select id, status, price, updatedAt from ({_ANY}) r join ({{}}) w on w.key = r.id and w.rank = r.rank"

ORACLE_SQL = {
    "perform_sync_normal": _turns() + _ROWS.format(_STATE),
    "perform_sync_gap": _FOLD + _ROWS.format(_STANDS),
    "perform_sync_damaged": _turns() + _ROWS.format(_STATE),
    "full_merge_outcomes": _FOLD + """
        select f.key, e.rank, case when e.kind = 'TOMBSTONE' then 'deleted' when p.held is null then 'inserted' when f.held = e.rank then 'updated' else 'skipped' end as action
        from f join e on e.key = f.key and e.n = f.n left join f p on p.key = f.key and p.n = f.n - 1
        where e.rank > 0 and (e.kind = 'ROW' or (p.held is not null and f.held is null))""",
    "round_counters": _turns() + """
        select 3 as clients_synced, count(*) filter (where action = 'inserted') as inserted, count(*) filter (where action = 'updated') as updated,
          count(*) filter (where action = 'deleted') as deleted, count(*) filter (where action = 'skipped') as skipped, count(*) filter (where action = 'upserted') as conflicts_resolved
        from a where rank > 0""",
    "round_conflicts": _turns() + """
        select 'orders' as "table", e.key as record_id, p.held_ts as local_updated_at, e.ts as remote_updated_at, case when e.ts > p.held_ts then 'remote_wins' else 'local_wins' end as resolution
        from e join f p on p.key = e.key and p.n = e.n - 1 where p.held is not null and (e.op = 'INSERT' or (e.op = 'UPDATE' and e.ts <> p.held_ts))""",
    "round_feed": _turns() + """
        select key as recordId, case action when 'deleted' then 'DELETE' when 'inserted' then 'INSERT' else 'UPDATE' end as operation, '1999-01-01 00:00:00' as changedAt
        from a where rank > 0 and (action in ('deleted', 'inserted') or (action in ('updated', 'upserted') and held = rank))""",
    "round_tombstones": _turns() + "select distinct 'orders' as tableName, key as recordId, '1999-01-01 00:00:00' as deletedAt from a where action = 'deleted'",
    "round_offsets": " union all ".join(f"select 'r{n}' as remoteClientId, count(*) as lastSeenId, '1999-01-01 00:00:00' as lastSyncedAt from {_ops(n)}" for n in REMOTES),
    "write_capture": f"""
        with w as (
          select 0 as turn, id as recordId, case when id in (select id from {_L}) then 'UPDATE' else 'INSERT' end as operation from {_R}
          union all select 1, recordId, 'DELETE' from {_DELETED} where recordId in (select id from {_L} union select id from {_R}))
        select row_number() over (order by turn, recordId) as id, 'orders' as tableName, recordId, operation, '1999-01-01 00:00:00' as changedAt from w""",
    "heartbeat_feed": f"""
        select id, '_heartbeat' as tableName, '{HEARTBEAT_ID}' as recordId, case when id = 1 then 'INSERT' else 'UPDATE' end as operation, made as changedAt, '2024-01-04T12:00:00.000Z' as held
        from (values (1, '2024-01-01 00:00:00'), (2, '2024-01-02 05:00:00'), (3, '2024-01-04 01:00:00')) v(id, made)""",
    "skipped_remotes": "select client_id, remote_version, 'v2' as local_version from (values ('a', 'v1'), ('c', null)) v(client_id, remote_version)",
    "sqlite_catalog": f"""select case "table" when 'cache' then 'ca"che' when 'sqlite_sequence' then 'other_sequence' else "table" end as "table", cid, "column", type, "notnull", pk from {_SHAPES}""",
    "snapshot_isolation": f"""
        select *, 'reader' as side from {_L} union all select *, 'writer' from {_R} where cast(id as bigint) % 10 = 0
        union all select *, 'writer' from {_L} where cast(id as bigint) % 10 <> 1 and id not in (select id from {_R} where cast(id as bigint) % 10 = 0)""",
    "session_events": """
        select * from (values (0, 'last None'), (1, 'sync:start'), (2, 'hook'), (3, 'sync:complete'), (4, 'running True'), (5, 'running False'), (6, 'syncing False'), (7, 'orders')) v(n, told)""",
    "stream_feed_dedup": f"select tableName, recordId, arg_max(operation, id) as operation, min(id) as pos from {_FEED} group by 1, 2",
    "sqlite_roundtrip": f"select * from {_L}",
    "feed_read_since": f"select * from {_FEED} where id > 500",
    "feed_max_id": f"select coalesce((select id from {_FEED} order by id desc limit 1), 0) as max_id",
    "feed_min_id": f"select id as min_id from {_FEED} order by id limit 1",
    "feed_gap_by_remote": f"""
        select o.remote, o.last_seen, m.min_id, case when o.last_seen = 0 then false when m.min_id is null then true else m.min_id > o.last_seen end as has_gap
        from (values ('c0', 0), ('c1', 1), ('c2', 3), ('c3', 2), ('c4', 9), ('gone', 4), ('new', 0)) o(remote, last_seen)
        left join lateral (select min(id) as min_id from {_REMOTES} f where f.remote = o.remote) m on true""",
    "feed_dedup_last_op": f"""
        select tableName, recordId, operation, first as pos from (
          select *, min(id) over (partition by tableName, recordId) as first from {_FEED})
        qualify row_number() over (partition by tableName, recordId order by id desc) = 1""",
    "feed_retention_keep": f"select * from {_FEED} where not changedAt < '{SINCE}'",
    "feed_retention_count": f"select count(*) filter (where changedAt < '{SINCE}') as expired from {_FEED}",
    "feed_merge_append": f"""
        select * from {_FEED} where id % 2 = 0
        union all select 1000000 + row_number() over (order by id), tableName, recordId, operation, changedAt from {_FEED} where id % 2 = 1 and changedAt >= '{SINCE}'""",
    "feed_entries_resolved": f"""
        select tableName, recordId, operation, c_name as name, c_acctbal as balance from {_LAST} f, customer c where f.operation <> 'DELETE' and cast(c.c_custkey as varchar) = f.recordId
        union all select tableName, recordId, operation, null, null from {_LAST} where operation = 'DELETE'""",
    "table_scope_filter": f"select * from {_FEED} where tableName in ('users', 'posts')",
    "delete_protection": f"select * from {_FEED} where tableName = 'posts' or (tableName = 'users' and operation <> 'DELETE')",
    "capture_snapshot_diff": f"""
        select id as recordId, 'INSERT' as operation from {_R} where id not in (select id from {_L})
        union all select id, 'DELETE' from {_L} where id not in (select id from {_R})
        union all select id, 'UPDATE' from (select * from {_R} except select * from {_L}) where id in (select id from {_L})""",
    "capture_operations": f"select 100 + row_number() over (order by cast(recordId as bigint)) as id, 'orders' as tableName, recordId, operation, '{NOW}' as changedAt from {_ops(1)}",
    "tombstone_upsert": f"select distinct on (tableName, recordId) tableName, recordId, changedAt as deletedAt from {_FEED} where operation = 'DELETE' order by tableName, recordId, changedAt desc",
    "tombstone_replace": f"""
        select * from {_BURIED} b where b.recordId not in (select recordId from {_ops(2)} where operation = 'DELETE')
        union all select 'orders', recordId, '{NOW}' from {_ops(2)} where operation = 'DELETE'""",
    "tombstones_of_feed": f"select tableName, recordId, arg_max(changedAt, id) as deletedAt from {_FEED} where operation = 'DELETE' group by 1, 2",
    "offset_upsert": f"""
        select remote as remoteClientId, max(id) as lastSeenId, '{NOW}' as lastSyncedAt from {_REMOTES} group by 1
        union all select 'c9', 7, 'y'""",
    "offset_default": f"select distinct remote, case remote when 'c0' then 12 when 'c3' then 7 else 0 end as last_seen from {_REMOTES}",
    "lww_apply_insert": _outer(1, "upserted", "upserted", "true"),
    "lww_apply_update": _outer(1, "updated", "skipped", "l.updatedAt <> r.updatedAt"),
    "lww_apply_delete": f"select * from {_L} l where not exists (from {_DELETED} d where d.recordId = l.id)",
    "lww_delete_outcomes": f"select recordId, case when recordId in (select id from {_L}) then 'deleted' else 'skipped' end as action from {_DELETED}",
    "lww_conflict_report": f"""
        select 'orders' as "table", l.id as record_id, l.updatedAt as local_updated_at, r.updatedAt as remote_updated_at, case when r.updatedAt > l.updatedAt then 'remote_wins' else 'local_wins' end as resolution
        from {_L} l, {_R} r where l.id = r.id and l.updatedAt <> r.updatedAt""",
    "lww_counters": f"""
        select count(*) filter (where l.id is null) as inserted, count(*) filter (where r.updatedAt > l.updatedAt) as updated, 0 as deleted,
          count(*) filter (where l.id is not null and not r.updatedAt > l.updatedAt) as skipped, 0 as conflicts_resolved
        from {_R} r left join {_L} l on l.id = r.id""",
    "lww_null_timestamp": f"""
        select coalesce(l.id, r.id) as id, case when l.id is null or coalesce(r.updatedAt, '') > coalesce(l.updatedAt, '') then r.updatedAt else l.updatedAt end as updatedAt,
          case when r.id is null then null when l.id is null then 'inserted' when coalesce(r.updatedAt, '') > coalesce(l.updatedAt, '') then 'updated' else 'skipped' end as action
        from {_NULLS[0]} l full join {_NULLS[1]} r on l.id = r.id""",
    "lww_string_order": """
        select cast(o_orderkey as varchar) as id, case when cast(n + 1 as varchar) > cast(n as varchar) then n + 1 else n end as updatedAt, case when cast(n + 1 as varchar) > cast(n as varchar) then 'updated' else 'skipped' end as action
        from (select *, o_orderkey % 20 as n from orders)""",
    "nway_lww_merge": "select id, status, price, updatedAt from ("
    + " union all ".join(f"select *, {n} as rank from {_replica(n)}" for n in (0, *REMOTES))
    + ") qualify row_number() over (partition by id order by updatedAt desc, rank) = 1",
    "nway_feed_apply_actions": _turns() + "select key, rank, action from a where rank > 0",
    "nway_feed_apply_state": _turns() + _STATE,
    "nway_feed_apply_counters": _turns() + "select rank, action, count(*) as n from a where rank > 0 group by 1, 2",
    "full_merge_table": f"select id, status, price, updatedAt from (select *, 0 as rank from {_L} union all select *, 1 from {_replica(2)}) qualify row_number() over (partition by id order by updatedAt desc, rank) = 1",
    "full_merge_fold": _FOLD + _STANDS,
    "tombstone_apply": f"""
        select l.* from {_L} l left join {_BURIED} t on t.recordId = l.id
        where t.recordId is null or not t.deletedAt > l.updatedAt or t.recordId in (select id from {_R} where cast(id as bigint) % 10 = 0)""",
    "unique_collision_pairs": f"select l.id as local_key, r.id as remote_key from {_parts('local')} l join {_parts('remote')} r using (brand, type, size) where l.id <> r.id",
    "unique_convergence": f"""
        select case when r.updatedAt > l.updatedAt then r.id else l.id end as id, brand, type, size, greatest(l.updatedAt, r.updatedAt) as updatedAt
        from {_parts("local")} l join {_parts("remote")} r using (brand, type, size)""",
    "heartbeat_upsert": f"select '{HEARTBEAT_ID}' as id, case when '2024-01-30T12:00:00.000Z' < '2024-01-31T12:00:00.000Z' then '2024-01-31T12:00:00.000Z' else '2024-01-30T12:00:00.000Z' end as updatedAt",
    "schema_hash": f"""
        with t as (select "table", "table" || '(' || string_agg("column" || ':' || type || ':' || "notnull" || ':' || pk, ',' order by cid) || ')' as shape from {_SHAPES} group by 1)
        select "table", substr(sha256(shape), 1, 16) as schema_hash from t
        union all select '*', substr(sha256(string_agg(shape, '|' order by "table")), 1, 16) from t""",
    "discover_tables": f"""
        select "table", case when bool_or("column" = case "table" when 'posts' then 'modifiedAt' else 'updatedAt' end) then 'synced' else 'no_timestamp' end as status
        from {_SHAPES} where "table" not like '\\_%' escape '\\' and "table" not like 'sqlite\\_%' escape '\\' group by 1 having bool_or("column" = 'id')""",
    "validate_tables": f"""
        with t as (select "table", bool_or("column" = 'id') as k, max(type) filter (where "column" = 'id') as kind, bool_or("column" = 'updatedAt') as t from {_SHAPES} group by 1)
        select "table", 'Primary key column ''id'' does not exist' as message from t where not k
        union all select "table", 'Primary key column ''id'' must be TEXT type, got ' || chr(39) || kind || chr(39) from t where k and upper(kind) <> 'TEXT'
        union all select "table", 'Column ''updatedAt'' does not exist' from t where k and not t
        union all select 'absent', 'Table does not exist'""",
    "version_gate": "select client_id, remote_version, remote_version is not distinct from 'v2' as usable from (values ('a', 'v1'), ('b', 'v2'), ('c', null)) v(client_id, remote_version)",
    "remote_listing": f"""
        select file, substr(file, 8, length(file) - 14) as client_id from (values {_values([(f,) for f in FILES])}) v(file)
        where file like 'client-%.sqlite' and length(file) > 14 and file <> 'client-me.sqlite'""",
}
