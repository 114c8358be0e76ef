"""Which tables take part, whether they are fit, and the schema version that says who can talk to whom."""

from __future__ import annotations

import hashlib
import locale
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import INTERNAL
from ..model import PRIMARY_KEY, DiscoverOptions, TableConfig, TableMeta, TableOptions, ValidationError


#: What users are told, and match on. Fixed values.
NO_TIMESTAMP = 'Table "{}" has "{}" but no "{}" column — excluded from sync. Add the column or list it in excludeTables to silence this warning.'
NO_TABLE = "Table does not exist"
NO_KEY = "Primary key column '{}' does not exist"
KEY_NOT_TEXT = "Primary key column '{}' must be TEXT type, got '{}'"
NO_COLUMN = "Column '{}' does not exist"


def discover_tables(metas: Mapping[str, TableMeta], options: DiscoverOptions | None = None) -> list[TableConfig]:
    """The tables to synchronise, by name; a table with a key but no timestamp column is reported."""
    o = options or DiscoverOptions()
    keyed = (n for n in sorted(metas) if not n.startswith(INTERNAL) and n not in set(o.exclude_tables) and o.primary_key in metas[n].names)
    configs = [TableConfig(n, m.timestamp_column, m.delete_protected) for n in keyed for m in [o.table_options.get(n, TableOptions())]]
    for t in configs:
        if t.ts not in metas[t.name].names:
            (o.on_warning or print)(NO_TIMESTAMP.format(t.name, o.primary_key, t.ts))
    return [t for t in configs if t.ts in metas[t.name].names]


def _faults(table: TableConfig, meta: TableMeta | None, key: str):
    if meta is None:
        yield NO_TABLE
        return
    kinds = {c.name: c.type for c in meta.columns}
    if key not in kinds:
        yield NO_KEY.format(key)
        return
    if kinds[key].upper() != "TEXT":
        yield KEY_NOT_TEXT.format(key, kinds[key])
    if table.ts not in kinds:
        yield NO_COLUMN.format(table.ts)


def validate(metas: Mapping[str, TableMeta], tables: list[TableConfig], primary_key: str = PRIMARY_KEY) -> list[ValidationError]:
    return [ValidationError(t.name, fault) for t in tables for fault in _faults(t, metas.get(t.name), primary_key)]


def schema_hash(metas: Mapping[str, TableMeta], tables: list[TableConfig]) -> str:
    """First 16 hex digits of the hash of the tables' declared columns."""
    names = sorted((t.name for t in tables if t.name in metas), key=lambda n: (locale.strxfrm(n.casefold()), n))
    shape = lambda m: ",".join(f"{c.name}:{c.type}:{c.notnull}:{c.pk}" for c in m.columns)
    return hashlib.sha256("|".join(f"{n}({shape(metas[n])})" for n in names).encode()).hexdigest()[:16]


def version_gate(remotes: DataFrame, version: str) -> DataFrame:
    """client_id, remote_version, usable: remotes with another version, or none, are passed over."""
    return remotes.select("client_id", "remote_version", F.col("remote_version").eqNullSafe(F.lit(version)).alias("usable"))
