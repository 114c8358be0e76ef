"""Embedding near-duplicates by sorted projection passes.

Each pass draws its own random hyperplanes; the signs of a vector's projections, concatenated, are its hash. Vectors are
ordered by label and then lexicographically by hash, and each is compared with the rows of a bounded window of neighbours
before it. Verified pairs of all passes are united into components. The passes' orders are made by one range shuffle.

A window bounds what a pass compares, not what is linked: inside each component every pair is then compared in double
precision, in tiles of bounded size, so link counts are exact for all vectors that the passes have joined. What the passes
may miss is a component's only contact with another; recall against brute force is measured in the tests.

Identical vectors (same label and components) are one node with a multiplicity and are never expanded into pairs. What is
identical is told by two 64-bit hashes, so that vectors themselves travel only to be compared.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows with a null label or id, link
with nothing: no links, their own component, kept. Labels are of any type and equal if their texts are (a negative zero is
a zero). Vectors of different lengths don't link. Rows with one id are one vector for components; a repeated row counts as
a copy. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, stars
from .common import cut

THRESHOLD, PASSES, BITS, WINDOW, TILE, SEED = 0.98, 10, 32, 256, 256, 20_240
_PLANES: dict[int, np.ndarray] = {}


def planes(size: int) -> np.ndarray:
    """size x (PASSES * BITS) normal vectors, the same in every worker."""
    if size not in _PLANES:
        _PLANES[size] = np.random.default_rng(SEED + size).standard_normal((size, PASSES * BITS))
    return _PLANES[size]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of equal length, in double precision, of length one."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def signatures(embedding):
    """PASSES hashes of BITS bits each."""

    @F.arrow_udf("array<bigint>")
    def run(batch: pa.Array) -> pa.Array:
        sizes = np.asarray(pa.compute.list_value_length(batch))
        out = np.zeros((len(batch), PASSES), np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            signs = matrix(batch.take(pa.array(at)), int(size)) @ planes(int(size)) > 0
            out[at] = signs.reshape(-1, PASSES, BITS) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
        return pa.array(list(out), pa.list_(pa.int64()))

    return run(embedding)


def neighbour_links(rows: DataFrame) -> DataFrame:
    """a, b: verified links between neighbours, of rows (among, size, node, embedding) that stand in order, ``among`` by ``among``.

    Each block of ``WINDOW`` rows is compared with itself and the block before it; its links leave as stars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            among, nodes = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(pa.compute.not_equal(among[1:], among[:-1]).to_numpy(zero_copy_only=False)) + 1
            for s, e in zip([0, *edge], [*edge, len(nodes)], strict=True):
                x = matrix(batch.column(3).slice(s, e - s), batch.column(1)[s].as_py())
                if before is None or before[0] != among[s].as_py():
                    before = (among[s].as_py(), nodes[:0], x[:0])
                found = [], []
                for a in range(0, e - s, WINDOW):
                    new, ids = x[a : a + WINDOW], nodes[s + a : min(s + a + WINDOW, e)]
                    near, near_ids = np.concatenate([before[2], new]), np.concatenate([before[1], ids])
                    i, j = np.nonzero(new @ near.T >= THRESHOLD)
                    i, j = ids[i], near_ids[j]
                    differ = i != j
                    if differ.any():
                        low, high = stars(i[differ], j[differ])
                        found[0].append(low)
                        found[1].append(high)
                    before = (before[0], near_ids[-WINDOW:], near[-WINDOW:])
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def tile_counts(members: DataFrame) -> DataFrame:
    """node, key, n: for each member of a tile, the copies it links to in that tile.

    Rows (component, low, high, side, label, node, key, copies, embedding) stand in order; a tile pairs sides 0 and 1, or
    side 0 with itself.
    """

    def links(group: pa.Table) -> list[np.ndarray]:
        side, node, key, copies = (group.column(i).to_numpy() for i in (3, 5, 6, 7))
        label = np.unique(group.column(4).to_numpy(), return_inverse=True)[1]
        sizes = np.asarray(pa.compute.list_value_length(group.column(8)))
        n = np.zeros(len(node), np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            x = matrix(group.column(8).combine_chunks().take(pa.array(at)), int(size))
            left, right = at[side[at] == 0], at[side[at] == 1]
            a, b = x[side[at] == 0], x[side[at] == 1]
            own = not len(right) and (group.column(1)[0] == group.column(2)[0])
            if own:
                right, b = left, a
            met = (a @ b.T >= THRESHOLD) & (label[left][:, None] == label[right][None, :])
            if own:
                np.fill_diagonal(met, False)
                n[left] += met @ copies[left]
            else:
                n[left] += met @ copies[right]
                n[right] += met.T @ copies[left]
        return [node, key, n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(parts):
            done = [np.concatenate(c) for c in zip(*parts, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in done], ["node", "key", "n"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            keys = np.stack([table.column(i).to_numpy() for i in range(3)], axis=1)
            edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            parts = [links(table.slice(s, e - s)) for s, e in zip([0, *edge[:-1]], edge, strict=True)] if len(edge) else []
            held = table.slice(edge[-1] if len(edge) else 0)
            if parts:
                yield give(parts)
        if held is not None and held.num_rows:
            yield give([links(held)])

    return members.mapInArrow(run, "node bigint, key bigint, n bigint")


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    # Single-precision vectors travel as they are; every comparison widens them first.
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (embedding, label)}
    held = F.col(embedding) if kinds[embedding] == "array<float>" else F.col(embedding).cast("array<double>")
    name = F.when(F.col(label) == 0, F.lit("0")).otherwise(F.col(label).cast("string")) if kinds[label] in ("float", "double") else F.col(label).cast("string")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), name.alias("label"), held.alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    nonzero = F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(False)))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & nonzero
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    alike = ["key", "key2"]
    able = rows.where("fine").withColumns({"key": F.xxhash64("label", "embedding"), "key2": F.xxhash64("embedding", F.lit(2), "label")})

    nodes = able.groupBy(*alike).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = cut(nodes.withColumn("size", F.size("embedding")).withColumn("hashes", signatures(F.col("embedding"))))
    passes = nodes.select(F.posexplode("hashes").alias("pass", "hash"), "label", "size", "node", "embedding")
    order = ["pass", "label", "size", "hash", "node"]
    ordered = passes.repartitionByRange(*order).sortWithinPartitions(*order)
    tied = components(neighbour_links(ordered.select(F.concat_ws(" ", "pass", "size", "label").alias("among"), "size", "node", "embedding")))

    members = nodes.join(tied, "node").select("component", "label", "node", "key", "copies", "embedding")
    sizes = tied.groupBy("component").agg(F.count("*").alias("n")).select("component", F.ceil((F.col("n") + 1) / TILE).cast("int").alias("tiles"))
    roots = nodes.join(tied.select(F.col("component").alias("node")).distinct(), "node").select(F.col("node").alias("component"), "label", "node", "key", "copies", "embedding")
    dealt = members.unionByName(roots).join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node", "key"), "tiles").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tile = ["component", "low", "high"]
    dealt = dealt.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "label", "node", "key", "copies", "embedding")
    counts = tile_counts(dealt.repartition(*tile).sortWithinPartitions(*tile)).groupBy("node", "key").agg(F.sum("n").alias("n"))

    known = nodes.select(*alike, "node", "copies").join(counts, ["node", "key"], "left").join(tied, "node", "left")
    known = known.select(*alike, (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = able.select("vec_id", *alike).join(known, alike).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
