"""The façade: a replica that synchronises on demand or on a timer."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .model import DiscoverOptions, SyncConfig, SyncResult, SyncStatus
from .plans.catalog import discover_tables, schema_hash, validate
from .plans.sync import perform_sync
from .plans.writes import set_version
from .sources import sqlite
from .sources.store import Replica, set_up

EVENTS = ("sync:start", "sync:complete", "sync:error", "sync:conflict")
log = logging.getLogger(__name__)


class SyncInstance:
    """What ``setup_sync`` returns. Listeners' errors are swallowed; one round runs at a time."""

    def __init__(self, replica: Replica, config: SyncConfig, tables, file: str | None = None):
        self.replica, self._config, self._tables, self._file = replica, config, tables, file
        self._lock, self._stop, self._thread = threading.Lock(), threading.Event(), None
        self._last_at: datetime | None = None
        self._last: SyncResult | None = None
        self._listeners: dict[str, list[Callable]] = {}

    def sync_now(self) -> SyncResult:
        if not self._lock.acquire(blocking=False):
            raise RuntimeError("Sync already in progress")
        try:
            self._emit("sync:start", None)
            result = self._round()
            self._last, self._last_at = result, datetime.now(UTC).replace(tzinfo=None)
            self._emit("sync:complete", result)
            return result
        except Exception as e:
            self._emit("sync:error", e)
            raise
        finally:
            self._lock.release()

    def _round(self) -> SyncResult:
        if not self._file:
            return perform_sync(self.replica, self._config, self._tables)
        names, key, now = self.get_synced_tables(), self._config.primary_key, self._config.now
        sqlite.catch_up(self.replica, self._file, names, key, now() if now else None)
        result = perform_sync(self.replica, self._config, self._tables)
        sqlite.write_back(self.replica, self._file, names, key)
        return result

    def start(self) -> None:
        """A round every ``interval_ms``; starting twice does nothing."""
        if self._thread:
            return
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, args=(self._stop,), daemon=True)
        self._thread.start()

    def _run(self, stop: threading.Event) -> None:
        while not stop.wait(self._config.interval_ms / 1000):
            try:
                self.sync_now()
            except Exception:  # noqa: BLE001  told by sync:error
                log.debug("round failed", exc_info=True)

    def stop(self) -> None:
        self._stop.set()
        self._thread = None

    def get_status(self) -> SyncStatus:
        return SyncStatus(self._lock.locked(), self._last_at, self._last, self._thread is not None)

    def get_synced_tables(self) -> list[str]:
        return [t.name for t in self._tables]

    def on(self, event: str, callback: Callable) -> None:
        self._listeners.setdefault(event, []).append(callback)

    def _emit(self, event: str, data) -> None:
        for callback in self._listeners.get(event, []):
            try:
                callback(data)
            except Exception:  # noqa: BLE001
                log.debug("listener failed", exc_info=True)


def setup_sync(spark: SparkSession, config: SyncConfig) -> SyncInstance:
    """Discovers and checks the tables, makes the system tables and settles the schema version.

    Where ``db_path`` is a SQLite file, a replica in the folder beside it follows the file, and rounds are written back to it.
    """
    file = config.db_path if config.db_path.endswith((".sqlite", ".db")) else None
    replica = sqlite.import_file(spark, file, f"{file}.replica") if file else Replica(spark, config.db_path)
    tables = discover_tables(replica.metas, DiscoverOptions(config.primary_key, tuple(config.exclude_tables), config.table_options, config.on_discovery_warning))
    if not tables:
        raise ValueError(
            f'No sync tables discovered in {config.db_path}. Ensure tables exist with "{config.primary_key}" and "updatedAt" columns '
            "(or pass tableOptions to use a different timestamp column)."
        )
    log.info("Auto-detected %d sync table(s): %s", len(tables), ", ".join(t.name for t in tables))
    errors = validate(replica.metas, tables, config.primary_key)
    if errors:
        raise ValueError("Validation failed:\n" + "\n".join(f"  {e.table}: {e.message}" for e in errors))
    set_up(replica)
    version = config.schema_version or schema_hash(replica.metas, tables)
    set_version(replica, version)
    return SyncInstance(replica, replace(config, schema_version=version), tables, file)
