"""SQLite files as sources and sinks, for replicas that live in them.

Reading: a Python data source cuts a table into ranges of rows, found in one pass over its rowids or, where it has none, its
primary key; each task opens the file read-only. The file must be in a folder that all executors see (SQLite reads local
files only). Writing makes one file, streamed through the driver a batch at a time, as a SQLite file has one writer; it is
made under another name and renamed when whole. A file that is a replica of its own is followed (``import_file``,
``catch_up``) and brought up to date in place (``write_back``), so its indexes and triggers stay.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import uuid
from collections.abc import Mapping
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import CHANGELOG, SYNC_META, SYSTEM_TABLES, ColumnInfo, TableMeta
from ..operators import capture
from ..operators.lineage import cut, forget, shared_dir
from .store import Replica, Version

_TYPES = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BLOB": "binary"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def local_path(path: str) -> str:
    path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"SQLite files are read from folders that every executor mounts, not from {path}")
    return path


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{local_path(path)}?mode=ro", uri=True)


def check(path: str) -> None:
    """Reads the whole file, as SQLite does it."""
    with closing(opened(path)) as db:
        if db.execute("pragma integrity_check").fetchone()[0] != "ok":
            raise ValueError(f"{path} is damaged")


def _meta(db: sqlite3.Connection, name: str) -> TableMeta:
    rows = db.execute(f"pragma table_info({quoted(name)})").fetchall()
    columns = tuple(ColumnInfo(c[1], c[2], c[3], c[5]) for c in rows)
    sets = []
    for _, index, unique, origin, partial in db.execute(f"pragma index_list({quoted(name)})").fetchall():
        of = [x[2] for x in db.execute(f"pragma index_info({quoted(index)})")]
        if unique and origin != "pk" and not partial and None not in of:  # not of some rows only, nor of expressions
            sets.append(tuple(of))
    keys: dict[int, list] = {}
    for k in db.execute(f"pragma foreign_key_list({quoted(name)})").fetchall():
        keys.setdefault(k[0], []).append(k)
    cascades = tuple((k[0][3], k[0][2]) for k in keys.values() if len(k) == 1 and k[0][6].upper() == "CASCADE")
    return TableMeta(columns, tuple(sets), cascades)


def declared(path: str) -> dict[str, TableMeta]:
    """Every table's declared columns, unique sets and cascades."""
    with closing(opened(path)) as db:
        names = [n for (n,) in db.execute("select name from sqlite_master where type = 'table' order by name").fetchall()]
        return {n: _meta(db, n) for n in names}


class Range(InputPartition):
    """Rows from one place on, up to another; None: no bound."""

    def __init__(self, by: list[str], first: tuple | None, after: tuple | None):
        super().__init__((by, first, after))
        self.by, self.first, self.after = by, first, after


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], rows: int):
        self.path, self.table, self.columns, self.rows = path, table, columns, rows

    def partitions(self):
        with closing(opened(self.path)) as db:
            key = [c.name for c in sorted((c for c in _meta(db, self.table).columns if c.pk), key=lambda c: c.pk)]
            try:
                db.execute(f"select rowid from {quoted(self.table)} limit 0")
                by = ["rowid"]
            except sqlite3.OperationalError:  # a table without rowids is its primary key's index
                by = [quoted(c) for c in key]
            names = ", ".join(by)
            numbered = f"select {names}, row_number() over (order by {names}) as n from {quoted(self.table)}"
            starts = [tuple(r) for r in db.execute(f"select {names} from ({numbered}) where (n - 1) % ? = 0 order by {names}", (self.rows,))]
        if not starts:
            return [Range(by, None, None)]
        return [Range(by, a, b) for a, b in zip(starts, [*starts[1:], None], strict=True)]

    def read(self, partition):
        where, values = [], []
        for bound, sign in ((partition.first, ">="), (partition.after, "<")):
            if bound is not None:
                where.append(f"({', '.join(partition.by)}) {sign} ({', '.join('?' * len(bound))})")
                values += bound
        with closing(opened(self.path)) as db:
            names = ", ".join(quoted(c) for c in self.columns)
            yield from db.execute(f"select {names} from {quoted(self.table)}" + (f" where {' and '.join(where)}" if where else ""), values)


class SqliteSource(DataSource):
    """Options: path, table, rows (in a partition)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with closing(opened(self.options["path"])) as db:
            meta = _meta(db, self.options["table"])
        return ", ".join(f"`{c.name}` {_TYPES.get(c.type.upper(), 'string')}" for c in meta.columns)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], [f.name for f in schema.fields], int(self.options.get("rows", 100_000)))


def read_table(spark: SparkSession, path: str, table: str, rows: int = 100_000) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("rows", rows).load()


class FileReplica(Replica):
    """A read-only replica over a SQLite file. ``cleanup`` removes the file if it is a copy."""

    def __init__(self, spark: SparkSession, path: str, copied: bool):
        self.spark, self.path, self.copied = spark, path, copied
        metas = declared(path)
        self.version = Version(1, {n: [] for n in metas}, metas={n: m for n, m in metas.items() if n not in SYSTEM_TABLES})

    def _value(self, table: str, query: str):
        if not self.has(table):
            return None
        with closing(opened(self.path)) as db:
            return db.execute(query).fetchone()

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path, name) if self.has(name) else self.spark.createDataFrame([], SYSTEM_TABLES[name])

    def schema_version(self) -> str | None:
        row = self._value(SYNC_META, f"select value from {SYNC_META} where key = 'schemaVersion'")
        return row[0] if row else None

    def feed_span(self) -> tuple[int, int] | None:
        row = self._value(CHANGELOG, f"select min(id), max(id) from {CHANGELOG}")
        return row if row and row[0] is not None else None

    def verify(self) -> None:
        check(self.path)

    def cleanup(self) -> None:
        if self.copied:
            os.remove(self.path)


def as_replica(spark: SparkSession, path: str, copied: bool = True) -> FileReplica:
    """A read-only replica over a copy of a SQLite file, in the folder that executors share, or over the file itself."""
    copy = local_path(path)
    if copied:
        copy = f"{local_path(shared_dir(spark))}/{uuid.uuid4().hex}.sqlite"
        os.makedirs(os.path.dirname(copy), exist_ok=True)
        shutil.copyfile(local_path(path), copy)
    try:
        check(copy)
        return FileReplica(spark, copy, copied)
    except Exception:
        if copied:
            os.remove(copy)
        raise


def write_file(path: str, tables: Mapping[str, tuple[DataFrame, TableMeta]], batch: int = 10_000) -> None:
    """A new SQLite file with these tables; an older one is replaced when the new one is whole."""
    target = local_path(path)
    draft = f"{target}.tmp"
    if os.path.exists(draft):
        os.remove(draft)
    with sqlite3.connect(draft) as db:
        for name, (df, meta) in tables.items():
            keys = [c.name for c in sorted((c for c in meta.columns if c.pk), key=lambda c: c.pk)]
            parts = [f"{quoted(c.name)} {c.type}{' not null' if c.notnull else ''}" for c in meta.columns]
            parts += [f"primary key ({', '.join(map(quoted, keys))})"] if keys else []
            parts += [f"unique ({', '.join(map(quoted, u))})" for u in meta.unique]
            db.execute(f"create table {quoted(name)} ({', '.join(parts)})")
            insert = f"insert into {quoted(name)} values ({', '.join('?' * len(meta.columns))})"
            held = []
            for row in df.select(*meta.names).toLocalIterator():
                held.append(tuple(row))
                if len(held) == batch:
                    db.executemany(insert, held)
                    held = []
            db.executemany(insert, held)
    db.close()
    os.replace(draft, target)


def export(replica, share: str, client_id: str) -> None:
    """Publishes a replica as ``client-{id}.sqlite``."""
    system = {n: TableMeta(tuple(ColumnInfo(f.name, "INTEGER" if f.dataType.typeName() == "long" else "TEXT") for f in s.fields)) for n, s in SYSTEM_TABLES.items()}
    metas = {**system, **replica.metas}
    os.makedirs(local_path(share), exist_ok=True)
    write_file(f"{local_path(share)}/client-{client_id}.sqlite", {n: (replica.table(n), m) for n, m in metas.items()})


def import_file(spark: SparkSession, path: str, folder: str) -> Replica:
    """A replica in a folder that holds what a SQLite file holds; if the folder has one, that."""
    replica = Replica(spark, folder)
    if not replica.version.number:
        file = as_replica(spark, path, copied=False)
        names = [n for n in file.version.tables if not n.startswith("sqlite_")]
        replica.commit({n: file.table(n) for n in names}, {n: file.metas[n] for n in names if n in file.metas}, feed_end=(file.feed_span() or (0, 0))[1])
    return replica


def _difference(of: DataFrame, to: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``to`` that ``of`` lacks or has otherwise, keys of ``of`` that ``to`` lacks)."""
    did = cut(capture.difference(of, to, key))
    rows = to.join(did.where("operation <> 'DELETE'").select(F.col("recordId").alias("_of")), F.col(key) == F.col("_of"), "left_semi")
    return rows, did.where("operation = 'DELETE'").select("recordId")


def catch_up(replica: Replica, path: str, tables: list[str], key: str, now) -> None:
    """Writes to a replica, with capture, what was done to its SQLite file since. Writes that changed nothing leave no trace."""
    from ..plans.writes import write

    file = as_replica(replica.spark, path, copied=False)
    for name in tables:
        rows, gone = _difference(replica.table(name), file.table(name).select(*replica.table(name).columns), key)
        rows, gone = cut(rows), cut(gone)
        if rows.limit(1).count() or gone.limit(1).count():
            write(replica, name, rows, gone, now, key)
        forget(rows, gone)


def write_back(replica: Replica, path: str, tables: list[str], key: str, batch: int = 10_000) -> None:
    """Brings a SQLite file's tables to the replica's state, in one transaction, row by row that differs."""
    file = as_replica(replica.spark, path, copied=False)
    with closing(sqlite3.connect(local_path(path))) as db, db:
        db.execute("pragma defer_foreign_keys = on")
        for name in tables:
            rows, gone = _difference(file.table(name), replica.table(name).select(*file.table(name).columns), key)
            columns = rows.columns
            out = f"delete from {quoted(name)} where {quoted(key)} = ?"
            put = f"insert into {quoted(name)} ({', '.join(map(quoted, columns))}) values ({', '.join('?' * len(columns))})"
            changed = rows.select(F.col(key).alias("recordId"))
            for df, statement in ((gone, out), (changed, out), (rows, put)):  # unique values may have moved between rows
                held = []
                for row in df.toLocalIterator():
                    held.append(tuple(row))
                    if len(held) == batch:
                        db.executemany(statement, held)
                        held = []
                db.executemany(statement, held)
