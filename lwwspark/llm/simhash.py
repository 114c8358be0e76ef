"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits. Its two halves of 32 bits index two tables. Fingerprints that differ in at most three bits
differ in at most one bit in one of the halves, so a small Hamming ball around each half, of radius one, fetches every
partner from a table; complete distances are verified in the same join. The ball is enumerated from one side only: of
two halves that differ in one bit just one has that bit, and it looks up its own half with the bit cleared.

Only distinct fingerprints take part (copies meet in an aggregation that is combined before its shuffle), components
are found in rounds of joins, and the smallest id of each is joined back.

Defined results: null texts count as empty and have fingerprint zero, which links like any other. Repeated rows get equal
results. Rows with a null id are linked, but never name a component (null if no row of it has an id). An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from ..operators.components import components
from .common import by_small_batches, cut, fresh

SEED, WORDS, RADIUS = 42, 3, 3
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Bits that over half of the shingles' hashes have. A-Z are lower-cased; words end at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return digest(b" ".join(words), SEED)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: 1 - WORDS].tolist(), end[WORDS - 1 :].tolist()
    counts, n = np.zeros(64, np.int64), len(first)
    for a in range(0, n, _BLOCK):
        hashes = np.array([digest(line[s:e], SEED) for s, e in zip(first[a : a + _BLOCK], last[a : a + _BLOCK], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.left_shift(np.uint64(1), np.flatnonzero(2 * counts > n).astype(np.uint64))).sum(dtype=np.uint64))


@F.arrow_udf(LongType())
def fingerprints(batch: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t.as_py()) for t in batch], np.uint64).view(np.int64))


def close_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: distinct fingerprints (bigint, column fp) at 1 to ``RADIUS`` differing bits, each pair at least once."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), low.alias("key")), F.struct(F.lit(1).alias("half"), high.alias("key"))))
    rows = nodes.select("fp", halves.alias("at")).select("fp", "at.half", "at.key")
    bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("key").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0)
    # Position -1 stands for the half itself. Probes are some 34 a fingerprint, but Spark's estimate leaves out what explode
    # adds and would broadcast them through the driver: so the join is told to shuffle and sort.
    steps = F.explode(F.concat(F.array(F.lit(-1)), bits))
    probes = rows.select("fp", "half", "key", steps.alias("bit")).select(
        F.col("fp").alias("a"), "half", F.when(F.col("bit") < 0, F.col("key")).otherwise(F.col("key") - F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("key"), (F.col("bit") < 0).alias("same")
    ).hint("merge")
    shelf = rows.select(F.col("fp").alias("b"), "half", "key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    met = probes.join(shelf, (probes.half == shelf.half) & (probes.key == shelf.key) & near & (~F.col("same") | (F.col("a") < F.col("b"))))
    return met.select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (bigint), root (smallest fingerprint reachable) and component_id (smallest id reachable), a row for each document."""
    prints = cut(by_small_batches(docs).select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(close_pairs(nodes.select("fp")))
    tied = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root"))
    ids = tied.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # Told to shuffle and sort as well: the documents' file may be far below its rows.
    return prints.hint("merge").join(tied.select("fp", "root").join(ids, "root"), "fp").select("doc_id", "fp", "root", "component_id")


def shown(result: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return result.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; rows without an id stay. Columns stay."""
    keep, rank = fresh(docs, "kept_id"), fresh(docs, "kept_rank")
    ids = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias(keep)).distinct()
    # Of a semi join only the right side, the ids, may be broadcast.
    kept = docs.join(ids, docs.doc_id == ids[keep], "left_semi")
    once = kept.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))).where(F.col(rank) == 1)
    return once.drop(rank).unionByName(docs.where("doc_id is null"))
