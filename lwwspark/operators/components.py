"""Connected components of a graph given by links, in rounds of joins; nothing is gathered on the driver or in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, forget

CHUNK = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components: (node, smallest node of its component), without the smallest nodes themselves."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(names))
    while True:
        m = np.minimum(low[x], low[y])
        before = low.copy()
        np.minimum.at(low, before[x], m)
        np.minimum.at(low, before[y], m)
        np.minimum.at(low, x, m)
        np.minimum.at(low, y, m)
        low = low[low]
        if (low == before).all():
            break
    node = np.flatnonzero(low != np.arange(len(names)))
    return names[node], names[low[node]]


def thinned(links: DataFrame) -> DataFrame:
    """Each task's links, as stars for every ``CHUNK`` of them: as many rows as nodes at most."""
    kind = links.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, of = [], 0, None

        def give():
            a, b = (np.concatenate([h.column(i).to_numpy(zero_copy_only=False) for h in held]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(c, of) for c in stars(a, b)], ["a", "b"])

        for batch in batches:
            of = batch.column(0).type
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                done = give()
                held, size = [done], done.num_rows
                if size >= CHUNK // 2:
                    yield done
                    held, size = [], 0
        if size:
            yield give()

    return links.mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node with a link, the smallest node that it reaches. ``links``: a, b, of one type, bigint or text.

    Rounds of large and small stars: each node hangs its larger neighbours, then its smaller ones, on the smallest node
    it knows, and each task's links are thinned out before a round; so rounds grow with the logarithm of the longest chain.
    Only minima are aggregated, so a node with very many links is pre-aggregated like any other. Ends when a
    round changes nothing. Links of a node with itself, repeated links and an empty table are fine.
    """
    links = cut(thinned(links.where("a <> b").select("a", "b")).distinct())
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            out = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out._cut_path = links._cut_path
            return out
        seen = tuple(state)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.where("b > a").join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lows, "a").select(F.explode(F.array(F.struct("a", "low"), F.struct(F.col("b").alias("a"), "low"))).alias("x"))
        older, links = links, cut(small.select("x.a", F.col("x.low").alias("b")).where("a <> b").distinct())
        forget(older)
