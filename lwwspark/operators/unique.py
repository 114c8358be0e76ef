"""Tables with unique columns besides the key: rows that collide there converge to one, in the order of operations.

Collisions are found by an equi-join on the unique values; nulls never collide. Rows that share no contended value go
their usual way, set by set. The others are labelled by component (rows linked by a key or a contended value) and each
component is folded in order, which gives what folding the whole table would give. If an operation can't be applied, all
of its remote's operations are taken back. Within each replica a value is unique, so a key meets at most two others by each
unique set and components are chains of contended rows, not groups that grow with a frequent value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components as connected
from .lineage import cut, forget

Sets = Sequence[Sequence[str]]


def collisions(local: DataFrame, remote: DataFrame, unique: Sequence[str], key: str = "id") -> DataFrame:
    """local_key, remote_key: rows with other keys but equal values in all the unique columns."""
    l = local.select(F.col(key).alias("local_key"), *(F.col(c).alias(f"_l{i}") for i, c in enumerate(unique)))
    r = remote.select(F.col(key).alias("remote_key"), *(F.col(c).alias(f"_r{i}") for i, c in enumerate(unique)))
    same = F.col("local_key") != F.col("remote_key")
    for i in range(len(unique)):
        same = (F.col(f"_l{i}") == F.col(f"_r{i}")) & same
    return l.join(r, same).select("local_key", "remote_key")


def _tokens(rows: DataFrame, sets: Sets, key: str) -> DataFrame:
    """_key and every value that ties rows: the key itself, and each unique tuple without nulls."""
    of = []
    for n, columns in enumerate(sets):
        held = F.lit(True)
        for c in columns:
            held = held & F.col(c).isNotNull()
        of.append(F.when(held, F.concat(F.lit(f"{n}:"), F.to_json(F.struct(*columns)))))
    return rows.select(F.col(key).alias("_key"), F.explode(F.array_compact(F.array(*of))).alias("_token"))


def components(local: DataFrame, incoming: DataFrame, sets: Sets, key: str = "id") -> DataFrame:
    """_key, component of every key that shares a contended unique value; others don't appear.

    ``incoming`` may hold rows of several remotes. A contended value hangs its keys on the least of them.
    """
    ties = _tokens(local, sets, key).unionByName(_tokens(incoming.select(*local.columns), sets, key)).distinct()
    least = ties.groupBy("_token").agg(F.min("_key").alias("b"), F.count("*").alias("_n")).where("_n > 1").select("_token", "b")
    links = cut(ties.join(least, "_token").select(F.col("_key").alias("a"), "b"))
    found = connected(links)
    # The least key of a component has no entry of its own there.
    out = cut(found.select(F.col("node").alias("_key"), "component").unionByName(found.select(F.col("component").alias("_key"), "component")).distinct())
    forget(links, found)
    return out


class Rows:
    """A component's rows while operations are applied one after the other, with an index for each unique set."""

    def __init__(self, key: str, ts: str, sets: Sets, required: Sequence[str] = ()):
        self.key, self.ts, self.sets, self.required, self.rows = key, ts, sets, required, {}
        self.index: list[dict] = [{} for _ in sets]
        self.touched: set = set()

    def stamp(self, row) -> str:
        return "" if row[self.ts] is None else str(row[self.ts])

    def _values(self, row):
        for n, columns in enumerate(self.sets):
            values = tuple(row[c] for c in columns)
            if None not in values:
                yield n, values

    def hold(self, row) -> None:
        k = row[self.key]
        self.drop(k)
        self.rows[k] = row
        self.touched.add(k)
        for n, values in self._values(row):
            self.index[n][values] = k

    def drop(self, k) -> bool:
        row = self.rows.pop(k, None)
        if row is None:
            return False
        self.touched.add(k)
        for n, values in self._values(row):
            if self.index[n].get(values) == k:
                del self.index[n][values]
        return True

    def clash(self, row, besides=None):
        """Key of a row that holds unique values of this one, by the first violated set."""
        for n, values in self._values(row):
            k = self.index[n].get(values)
            if k is not None and k != besides:
                return k
        return None

    def insert(self, row) -> tuple[str, tuple | None]:
        k = row[self.key]
        if k in self.rows:
            local, remote = self.stamp(self.rows[k]), self.stamp(row)
            if remote > local:
                self.put(row, besides=k)
            return "upserted", (k, local, remote, "remote_wins" if remote > local else "local_wins")
        loser = self.clash(row)
        if loser is None:
            self.put(row)
            return "inserted", None
        local, remote = self.stamp(self.rows[loser]), self.stamp(row)
        if remote <= local:
            return "upserted", (loser, local, remote, "local_wins")
        self.drop(loser)
        self.put(row)
        return "upserted", (k, local, remote, "remote_wins", loser)

    def put(self, row, besides=None):
        if any(row[c] is None for c in self.required):
            raise ValueError("NOT NULL constraint failed")
        if self.clash(row, besides) is not None:
            raise ValueError("UNIQUE constraint failed")
        self.hold(row)

    def update(self, row) -> tuple[str, tuple | None]:
        k = row[self.key]
        if k not in self.rows:
            action, conflict = self.insert(row)
            if action == "inserted":
                return action, None
            return ("updated" if conflict[3] == "remote_wins" else "skipped"), conflict
        local, remote = self.stamp(self.rows[k]), self.stamp(row)
        if remote > local:
            self.put(row, besides=k)
            return "updated", (k, local, remote, "remote_wins")
        return "skipped", ((k, local, remote, "local_wins") if remote != local else None)

    def delete(self, k) -> tuple[str, tuple | None]:
        return ("deleted" if self.drop(k) else "missed"), None

    def bury(self, k, at: str) -> tuple[str, tuple | None]:
        """A tombstone deletes what is older than it."""
        if k in self.rows and at > self.stamp(self.rows[k]):
            return self.delete(k)
        return "missed", None

    def apply(self, operation: str, key, row, at) -> tuple[str, tuple | None]:
        if operation == "DELETE":
            return self.delete(key)
        if operation == "BURY":
            return self.bury(key, at)
        return (self.insert if operation == "INSERT" else self.update)(row)


#: What a fold gives: outcomes of operations (``kind`` ``told``), and rows as they stand of keys that operations touched
#: (``put``, or ``gone`` without a row).
FOLDED = "kind string, rank int, pos bigint, recordId string, action string, local_updated_at string, remote_updated_at string, resolution string, loser string, at string, failure string"


def fold(local: DataFrame, ops: DataFrame, labels: DataFrame, sets: Sets, key: str = "id", ts: str = "updatedAt", required: Sequence[str] = ()) -> DataFrame:
    """Columns of ``FOLDED``, and row, of the labelled keys. ``ops``: rank, pos, recordId, operation, row, at (of a tombstone).

    Components are dealt out by label and stream through their task in order of rank and pos, the local rows of each first.
    After a failure nothing more of its component is applied.
    """
    row_type = ops.schema["row"].dataType.simpleString()
    columns = ["rank", "pos", "recordId", "operation", "row", "at"]
    nothing = lambda kind: F.lit(None).cast(kind)
    mine = local.select(F.lit(0).alias("rank"), nothing("bigint").alias("pos"), F.col(key).alias("recordId"), F.lit("LOCAL").alias("operation"), F.struct(*local.columns).alias("row"), nothing("string").alias("at"))
    dealt = mine.unionByName(ops.select(*columns)).join(labels, F.col("recordId") == F.col("_key")).select("component", *columns)
    names = [x.split()[0] for x in FOLDED.split(", ")] + ["row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, failed, at, row_kind = None, False, None, None

        def pack(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 8, row_kind]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        def result() -> list[tuple]:
            if state is None:
                return []
            return [("put" if (row := state.rows.get(k)) is not None else "gone", None, None, k, *[None] * 7, row) for k in sorted(state.touched, key=str)]

        for batch in batches:
            row_kind, out = batch.schema.field("row").type, []
            for component, rank, pos, record, operation, row, buried in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or component != at:
                    out += result()
                    state, failed, at = Rows(key, ts, sets, required), False, component
                if operation == "LOCAL":
                    state.hold(row)
                    state.touched.clear()
                elif not failed:
                    action, c, failure = None, None, None
                    try:
                        action, c = state.apply(operation, record, row, buried)
                    except ValueError as e:
                        failed, failure = True, str(e)
                    c = c or (None,) * 4
                    out.append(("told", rank, pos, record, action, c[1], c[2], c[3], c[4] if len(c) > 4 else None, buried, failure, None))
            if out:
                yield pack(out)
        if left := result():
            yield pack(left)

    ordered = dealt.repartition("component").sortWithinPartitions("component", "rank", F.col("pos").asc_nulls_first(), "recordId")
    return cut(ordered.mapInArrow(run, f"{FOLDED}, row {row_type}"))
