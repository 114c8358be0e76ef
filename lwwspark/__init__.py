"""lwwspark: converging independently edited copies of the same tables, as DataFrame plans."""

from .model import ConflictInfo, DiscoverOptions, SkippedRemote, SyncConfig, SyncResult, SyncStatus, TableConfig, TableMeta, TableOptions
from .operators.lww import apply_delete, apply_insert, apply_update
from .plans.catalog import discover_tables
from .session import SyncInstance, setup_sync

__all__ = [
    "ConflictInfo", "DiscoverOptions", "SkippedRemote", "SyncConfig", "SyncInstance", "SyncResult", "SyncStatus", "TableConfig", "TableMeta", "TableOptions",
    "apply_delete", "apply_insert", "apply_update", "discover_tables", "setup_sync",
]
