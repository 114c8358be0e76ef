"""Replicas as versioned snapshots in a folder that any Hadoop file system may hold.

A version is a manifest: for each table its schema and the layers that hold it, parquet folders with their files, numbers of
rows and, for feeds, spans of ids and times. A transaction writes layers under new names and then the next manifest; the
newest complete manifest is the replica. Readers hold the version they opened.

A table begins with layers of rows. Changes by key are layers on top, as large as the changes: what stands is the newest
entry of each key, and the rows below of all other keys. Where changes grow to a quarter of the rows they are folded into
them, and where layers grow many the small ones are folded into one, so the cost of a commit follows what changed.

What needs no data is asked of the manifest: the schema version, a feed's ends, whether all files are there and whole. Pages
are checked against their checksums as they are read.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import CHANGELOG, SYNC_META, SYSTEM_KEYS, SYSTEM_TABLES, ColumnInfo, TableMeta

_MANIFEST = re.compile(r"^v(\d{12})\.json$")
#: Changes are folded into the rows at this share of them; small layers are folded into one beyond this number.
FOLD_SHARE, MANY_LAYERS = 0.25, 8
GONE = "_gone"


class Folder:
    """File operations on a path, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def ensure(self) -> None:
        self.fs.mkdirs(self._path(self.path))

    def names(self) -> list[str]:
        if not self.fs.exists(self._path(self.path)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.path)))

    def sizes(self, name: str) -> dict[str, int]:
        """Length of each data file in a folder below."""
        listed = self.fs.listStatus(self._path(self.at(name)))
        return {n: s.getLen() for s in listed if not (n := s.getPath().getName()).startswith(("_", "."))}

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(self.at(name)))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Appears whole or not at all; False if the name is taken."""
        draft = self._path(self.at(f".{uuid.uuid4().hex}.tmp"))
        stream = self.fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(self._path(self.at(name))) or not self.fs.rename(draft, self._path(self.at(name))):
            self.fs.delete(draft, False)
            return False
        return True

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(self.at(name) if name else self.path))

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(self.at(name)), True)


class Busy(RuntimeError):
    """Another writer has committed meanwhile."""


class Damaged(RuntimeError):
    """Files of a version are missing or cut short."""


@dataclass
class Layer:
    """A parquet folder. ``key``: its rows are changes by these columns. ``span``: least and greatest id, then time, of a feed."""

    name: str
    rows: int
    files: dict[str, int] = field(default_factory=dict)
    key: list[str] | None = None
    span: list | None = None


@dataclass
class Change:
    """What to do to a table by key: whole rows to put, and keys to take out, none of them twice."""

    key: list[str]
    rows: DataFrame | None = None
    gone: DataFrame | None = None


@dataclass
class Version:
    number: int = 0
    tables: dict[str, list[Layer]] = field(default_factory=dict)  # system tables too
    schemas: dict[str, dict] = field(default_factory=dict)
    metas: dict[str, TableMeta] = field(default_factory=dict)
    feed_end: int = 0  # the highest id that the feed ever gave out
    schema_version: str | None = None

    def dump(self) -> str:
        layers = {k: [asdict(x) for x in v] for k, v in self.tables.items()}
        metas = {k: asdict(m) for k, m in self.metas.items()}
        return json.dumps({"number": self.number, "tables": layers, "schemas": self.schemas, "metas": metas, "feed_end": self.feed_end, "schema_version": self.schema_version})

    @classmethod
    def load(cls, text: str) -> Version:
        x = json.loads(text)
        metas = {k: TableMeta(tuple(ColumnInfo(**c) for c in m["columns"]), tuple(map(tuple, m["unique"])), tuple(map(tuple, m.get("cascades", ())))) for k, m in x["metas"].items()}
        tables = {k: [Layer(**v) for v in layers] for k, layers in x["tables"].items()}
        return cls(x["number"], tables, x["schemas"], metas, x["feed_end"], x["schema_version"])


def small_tail(sizes: list[int]) -> int:
    """How many of the newest layers to fold into one, so that each layer is over twice as large as all after it."""
    take = 1
    while take < len(sizes) and sizes[-take - 1] <= 2 * sum(sizes[-take:]):
        take += 1
    return take


class Replica:
    """A replica's newest version, and its next ones."""

    def __init__(self, spark: SparkSession, path: str, version: Version | None = None):
        self.spark, self.folder = spark, Folder(spark, path)
        self.version = version or self._newest() or Version()

    def _newest(self) -> Version | None:
        found = [n for n in self.folder.names() if _MANIFEST.match(n)]
        return Version.load(self.folder.read(found[-1])) if found else None

    @property
    def metas(self) -> dict[str, TableMeta]:
        return self.version.metas

    def has(self, name: str) -> bool:
        return name in self.version.tables

    def _read(self, layers: list[Layer], schema: StructType) -> DataFrame:
        paths = [self.folder.at(f"data/{x.name}") for x in layers]
        return self.spark.read.schema(schema).option("parquet.page.verify-checksum.enabled", "true").parquet(*paths)

    def _schema(self, name: str) -> StructType:
        return StructType.fromJson(self.version.schemas[name])

    def _changes(self, layers: list[Layer], schema: StructType) -> DataFrame:
        """The newest entry of each key among layers of changes."""
        marked = StructType([*schema.fields, *StructType.fromDDL(f"{GONE} boolean").fields])
        if len(layers) == 1:
            return self._read(layers, marked)
        every = None
        for i, x in enumerate(layers):
            one = self._read([x], marked).withColumn("_layer", F.lit(i))
            every = one if every is None else every.unionByName(one)
        best = F.max_by(F.struct(*marked.names), "_layer").alias("_best")
        return every.groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(layers[0].key))).agg(best).select("_best.*")

    def _standing(self, layers: list[Layer], schema: StructType) -> DataFrame:
        below, above = [x for x in layers if x.key is None], [x for x in layers if x.key]
        rows = self._read(below, schema) if below else self.spark.createDataFrame([], schema)
        if not above:
            return rows
        news, key = self._changes(above, schema), above[0].key
        same = None
        for i, c in enumerate(key):
            one = F.col(c) == F.col(f"_k{i}")
            same = one if same is None else same & one
        met = news.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)))
        return rows.join(met, same, "left_anti").unionByName(news.where(f"not {GONE}").drop(GONE))

    def table(self, name: str) -> DataFrame:
        if name in self.version.tables:
            return self._standing(self.version.tables[name], self._schema(name))
        return self.spark.createDataFrame([], SYSTEM_TABLES[name])

    def schema_version(self) -> str | None:
        return self.version.schema_version

    def feed_span(self) -> tuple[int, int] | None:
        """(least, greatest) id in the feed; None if it is empty."""
        spans = [x.span for x in self.version.tables.get(CHANGELOG, []) if x.span]
        return (min(s[0] for s in spans), max(s[1] for s in spans)) if spans else None

    def verify(self) -> None:
        """Whether all files are there and as long as they were written; reads no data."""
        for layers in self.version.tables.values():
            for x in layers:
                there = self.folder.sizes(f"data/{x.name}")
                if {n: there.get(n) for n in x.files} != x.files:
                    raise Damaged(f"{x.name} of {self.folder.path} isn't as it was written")

    def commit(
        self, changed: dict[str, DataFrame] | None = None, metas: dict[str, TableMeta] | None = None, feed_end: int | None = None,
        appended: dict[str, DataFrame] | None = None, changes: dict[str, Change] | None = None, layers: dict[str, list[Layer]] | None = None,
    ) -> None:
        """All or nothing: whole tables, rows added to tables, changes by key, or layers that are already here."""
        self.folder.ensure()
        old = self.version
        tables, schemas = {n: list(v) for n, v in old.tables.items()} | (layers or {}), dict(old.schemas)
        for name, df in (changed or {}).items():
            schemas[name] = df.schema.jsonValue()
            tables[name] = [self._write(name, df)]
        for name, df in (appended or {}).items():
            if not tables.get(name):
                schemas[name] = df.schema.jsonValue()
            tables[name] = self._fewer(name, [*tables.get(name, []), self._write(name, df)], StructType.fromJson(schemas[name]))
        for name, change in (changes or {}).items():
            if name not in schemas:
                schemas[name] = (SYSTEM_TABLES[name] if change.rows is None else change.rows.schema).jsonValue()
            tables[name] = self._layered(name, tables.get(name, []), change, StructType.fromJson(schemas[name]))
        version = old.schema_version
        if SYNC_META in (changed or {}) or SYNC_META in (changes or {}):
            rows = self._standing(tables[SYNC_META], SYSTEM_TABLES[SYNC_META]).where("key = 'schemaVersion'").select("value").take(1)
            version = rows[0][0] if rows else None
        new = Version(old.number + 1, tables, schemas, metas or old.metas, old.feed_end if feed_end is None else feed_end, version)
        if not self.folder.put(f"v{new.number:012d}.json", new.dump()):
            raise Busy(f"version {new.number} of {self.folder.path} is taken")
        self.version = new

    def _write(self, name: str, df: DataFrame, key: list[str] | None = None, label: str | None = None) -> Layer:
        """Writes a layer, and reads back what the manifest says about it."""
        label = label or f"{name}-{uuid.uuid4().hex}"
        path = self.folder.at(f"data/{label}")
        df.write.mode("overwrite").parquet(path)
        asked = [F.count("*")] + ([F.min("id"), F.max("id"), F.min("changedAt"), F.max("changedAt")] if name == CHANGELOG else [])
        rows, *span = self.spark.read.schema(df.schema).parquet(path).agg(*asked).first()
        return Layer(label, rows, self.folder.sizes(f"data/{label}"), key, span if rows and span else None)

    def _fewer(self, name: str, layers: list[Layer], schema: StructType) -> list[Layer]:
        """Layers of rows, the newest and smallest folded into one where they are many."""
        if len(layers) <= MANY_LAYERS or (take := small_tail([x.rows for x in layers])) == 1:
            return layers
        return [*layers[:-take], self._write(name, self._read(layers[-take:], schema))]

    def _layered(self, name: str, layers: list[Layer], change: Change, schema: StructType) -> list[Layer]:
        rows = None if change.rows is None else change.rows.select(*schema.names).withColumn(GONE, F.lit(False))
        if change.gone is not None:
            empty = [F.col(f.name) if f.name in change.key else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
            gone = change.gone.select(*empty, F.lit(True).alias(GONE))
            rows = gone if rows is None else rows.unionByName(gone)
        if rows is None:
            return layers
        below, above = [x for x in layers if x.key is None], [x for x in layers if x.key]
        above.append(self._write(name, rows, change.key))
        if not above[-1].rows:
            self.folder.drop(f"data/{above.pop().name}")
        if above and sum(x.rows for x in above) >= FOLD_SHARE * sum(x.rows for x in below):
            return [self._write(name, self._standing([*below, *above], schema))]
        if len(above) > MANY_LAYERS and (take := small_tail([x.rows for x in above])) > 1:
            above = [*above[:-take], self._write(name, self._changes(above[-take:], schema), change.key)]
        return [*below, *above]

    def drop_expired(self, since: str) -> int:
        """Drops the feed's entries from before ``since``: layers that are all older as they are, others by a filter."""
        kept, n = [], 0
        for x in self.version.tables.get(CHANGELOG, []):
            if x.span is None or x.span[2] >= since:
                kept.append(x)
                continue
            n += x.rows
            if x.span[3] >= since:
                left = self._write(CHANGELOG, self._read([x], SYSTEM_TABLES[CHANGELOG]).where(F.col("changedAt") >= since))
                n -= left.rows
                kept.append(left)
        if n:
            self.commit(layers={CHANGELOG: kept}) if kept else self.commit({CHANGELOG: self.spark.createDataFrame([], SYSTEM_TABLES[CHANGELOG])})
        return n

    def vacuum(self, keep: int = 2) -> None:
        """Drops all but the newest versions, and the layers that only they hold. Readers of older versions must be done."""
        found = [n for n in self.folder.names() if _MANIFEST.match(n)]
        alive = {x.name for n in found[-keep:] for layers in Version.load(self.folder.read(n)).tables.values() for x in layers}
        for n in found[:-keep]:
            self.folder.drop(n)
        data = Folder(self.spark, self.folder.at("data"))
        for n in data.names():
            if n not in alive:
                data.drop(n)

    def publish(self, share: str, client_id: str) -> None:
        """A full copy under ``client-{id}`` in the shared folder, from which others read; layers that are there stay."""
        Folder(self.spark, share).ensure()
        copy = Replica(self.spark, f"{share.rstrip('/')}/client-{client_id}")
        there = {x.name: x for layers in copy.version.tables.values() for x in layers}
        placed: dict[str, list[Layer]] = {}
        for name, layers in self.version.tables.items():
            placed[name] = []
            for x in layers:
                if x.name not in there:
                    schema = StructType.fromJson(self.version.schemas[name])
                    if x.key:
                        schema = StructType([*schema.fields, *StructType.fromDDL(f"{GONE} boolean").fields])
                    there[x.name] = copy._write(name, self._read([x], schema), x.key, x.name)
                placed[name].append(there[x.name])
        mine = self.version
        copy.version = Version(copy.version.number, {}, dict(mine.schemas), mine.metas, mine.feed_end, mine.schema_version)
        copy.commit(layers=placed)
        copy.vacuum()


def create(spark: SparkSession, path: str, tables: dict[str, tuple[DataFrame, TableMeta]]) -> Replica:
    """A new replica with these user tables."""
    r = Replica(spark, path)
    r.commit({n: df for n, (df, _) in tables.items()}, {n: m for n, (_, m) in tables.items()})
    return r


def set_up(replica: Replica) -> None:
    """The system tables, where they are missing; what is there stays."""
    missing = {n: replica.table(n) for n in SYSTEM_TABLES if not replica.has(n)}
    if missing:
        replica.commit(missing)


def client_of(name: str) -> str | None:
    """The client whose copy a file or folder of this name is."""
    m = None if name.endswith(".tmp") else re.match(r"^client-(.+)\.sqlite$", name) or (None if name.endswith(".sqlite") else re.match(r"^client-(.+)$", name))
    return m[1] if m else None


def remotes(spark: SparkSession, share: str, me: str) -> list[tuple[str, str]]:
    """(client id, path) of the other clients' copies, by id."""
    found = ((client_of(n), f"{share.rstrip('/')}/{n}") for n in Folder(spark, share).names())
    return sorted((c, p) for c, p in found if c is not None and c != me)


def open_remote(spark: SparkSession, path: str, copy: bool = True) -> Replica | None:
    """The copy as it is now, later versions don't show; None if it can't be read. ``copy=False`` reads a SQLite file in place."""
    try:
        if path.endswith(".sqlite"):
            from .sqlite import as_replica

            return as_replica(spark, path, copy)
        replica = Replica(spark, path)
        if not replica.version.tables:
            return None
        replica.verify()
        return replica
    except Exception:  # noqa: BLE001  whatever is wrong with the copy, its client is passed over with a warning
        return None


__all__ = ["SYSTEM_KEYS", "Busy", "Change", "Damaged", "Folder", "Layer", "Replica", "Version", "client_of", "create", "open_remote", "remotes", "set_up"]
