"""Configuration, results and the schemas of system tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PRIMARY_KEY, TIMESTAMP_COLUMN = "id", "updatedAt"
INTERVAL_MS, RETENTION_DAYS, HEARTBEAT_ENABLED = 30_000, 7, True
HEARTBEAT_ID = "00000000-0000-0000-0000-000000000000"
CHANGELOG, SYNC_STATE, TOMBSTONE, HEARTBEAT, SYNC_META = "_changelog", "_sync_state", "_tombstone", "_heartbeat", "_sync_meta"


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_S, _L = T.StringType(), T.LongType()
SYSTEM_TABLES = {
    CHANGELOG: _table(id=_L, tableName=_S, recordId=_S, operation=_S, changedAt=_S),
    SYNC_STATE: _table(remoteClientId=_S, lastSeenId=_L, lastSyncedAt=_S),
    TOMBSTONE: _table(tableName=_S, recordId=_S, deletedAt=_S),
    HEARTBEAT: _table(id=_S, updatedAt=_S),
    SYNC_META: _table(key=_S, value=_S),
}

#: What tells a system table's rows apart.
SYSTEM_KEYS = {SYNC_STATE: ["remoteClientId"], TOMBSTONE: ["tableName", "recordId"], HEARTBEAT: ["id"], SYNC_META: ["key"]}


@dataclass(frozen=True)
class ColumnInfo:
    """A declared column, in order; ``pk`` is its place in the primary key, from 1, or 0."""

    name: str
    type: str = "TEXT"
    notnull: int = 0
    pk: int = 0


@dataclass(frozen=True)
class TableMeta:
    """Declared columns, the column sets that are unique besides the key, and (column, table) for each column that refers to
    another table's key and whose rows go when that row is deleted."""

    columns: tuple[ColumnInfo, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    cascades: tuple[tuple[str, str], ...] = ()

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def required(self) -> list[str]:
        return [c.name for c in self.columns if c.notnull]


@dataclass(frozen=True)
class TableOptions:
    timestamp_column: str | None = None
    delete_protected: bool | None = None


@dataclass(frozen=True)
class TableConfig:
    name: str
    timestamp_column: str | None = None
    delete_protected: bool | None = None

    @property
    def ts(self) -> str:
        return self.timestamp_column or TIMESTAMP_COLUMN


@dataclass
class DiscoverOptions:
    primary_key: str = PRIMARY_KEY
    exclude_tables: tuple[str, ...] = ()
    table_options: dict[str, TableOptions] = field(default_factory=dict)
    on_warning: Callable[[str], None] | None = None


@dataclass
class SyncConfig:
    """``db_path``: the replica's own store, a folder or a SQLite file. ``nas_path``: the shared directory. ``publish_as``:
    ``parquet`` or ``sqlite``, the form of the copy there. ``now``: the clock, for tests."""

    db_path: str
    nas_path: str
    client_id: str
    exclude_tables: tuple[str, ...] = ()
    table_options: dict[str, TableOptions] = field(default_factory=dict)
    primary_key: str = PRIMARY_KEY
    interval_ms: int = INTERVAL_MS
    changelog_retention_days: int = RETENTION_DAYS
    on_after_sync: Callable | None = None
    schema_version: str | None = None
    heartbeat_enabled: bool = HEARTBEAT_ENABLED
    on_discovery_warning: Callable[[str], None] | None = None
    now: Callable[[], datetime] | None = None
    publish_as: str = "parquet"


@dataclass(frozen=True)
class SkippedRemote:
    client_id: str
    remote_version: str | None
    local_version: str


@dataclass(frozen=True)
class ConflictInfo:
    table: str
    record_id: str
    local_updated_at: str
    remote_updated_at: str
    resolution: str


@dataclass
class SyncResult:
    clients_synced: int = 0
    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    skipped: int = 0
    conflicts_resolved: int = 0
    warnings: list[str] = field(default_factory=list)
    skipped_remotes: list[SkippedRemote] = field(default_factory=list)
    had_changelog_gap: bool = False
    #: All conflicts of the round (columns of ``ConflictInfo``), also those that the warnings don't list; None if there are none.
    conflicts: DataFrame | None = None


@dataclass(frozen=True)
class SyncStatus:
    is_syncing: bool
    last_synced_at: datetime | None
    last_result: SyncResult | None
    is_running: bool


@dataclass(frozen=True)
class ValidationError:
    table: str
    message: str
