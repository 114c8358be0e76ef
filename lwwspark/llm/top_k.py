"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to whole numbers, of any size. Candidates are dealt out to blocks; a block keeps, for every
dimension, one bitmap for each bit of the value's distance from the block's smallest (a slice). A query adds up its score
for all rows of a block at once: each set bit of a weight adds that dimension's slices, complemented where the weight is
negative, with carry-save adders over whole bitmaps. The sum's slices are then read from the most significant downward,
which narrows the rows to the best k; rows that tie at the boundary are resolved by the smaller id. No score is rounded at
any point.

Queries are dealt out to packs, and every pack meets every block in an equi-join on both numbers, a task for each pair: a
block's slices travel once for each pack. Blocks and packs hold ``HELD`` numbers at most, whatever the vectors' length;
vectors with very large components have blocks of their own, so that they don't make the slices of others deeper. k rows
for each query and block enter the final ranking.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an
id. Vectors meet only vectors of the same length. A query doesn't meet rows with its own id; a repeated query id is asked
once, with its least vector; repeated candidates all count. Ties go to the smaller id. Fewer candidates than k: all of
them. Scores beyond 64 bits are ranked exactly, ``score`` then is the nearest 64-bit number and ``exact`` has its decimals
(null for all others). An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Rows of a block or pack, numbers that one may hold, tasks of a search at most, and the factor of quantisation.
BLOCK_ROWS, HELD, TASKS, SCALE = 1 << 16, 1 << 22, 100_000, 256
_RESULT = "query_id bigint, rank int, vec_id bigint, score bigint, exact string"


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest value of each dimension, bitmaps by dimension and bit) of rows x dimensions whole numbers."""
    base = values.min(axis=0)
    rest = values - base
    bits = max(1, int(rest.max()).bit_length())
    n, dims = values.shape
    words = -(-n // 64)
    out = np.zeros((dims, bits, words), np.uint64)
    padded = np.zeros((words * 64, dims), rest.dtype)
    padded[:n] = rest
    for b in range(bits):
        on = (padded >> b & 1).astype(np.uint8)
        out[:, b] = np.packbits(np.ascontiguousarray(on.T), axis=1, bitorder="little").view(np.uint64)
    return base, out


class Counter:
    """Adds bitmaps at powers of two: two wait at each power, a third makes a sum and a carry."""

    def __init__(self):
        self.waiting: list[list[np.ndarray]] = []

    def add(self, power: int, x: np.ndarray) -> None:
        while True:
            while len(self.waiting) <= power:
                self.waiting.append([])
            here = self.waiting[power]
            if len(here) < 2:
                here.append(x)
                return
            a, b = here
            half = a ^ b
            self.waiting[power] = [half ^ x]
            a &= b
            half &= x
            a |= half
            x, power = a, power + 1

    def total(self) -> list[np.ndarray]:
        """The sum's slices, least first."""
        power = 0
        while power < len(self.waiting):
            here = self.waiting[power]
            if len(here) == 2:
                self.waiting[power] = [here[0] ^ here[1]]
                self.add(power + 1, here[0] & here[1])
            power += 1
        return [x[0] if x else None for x in self.waiting]


def best_rows(total: list, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of the rows in a bitmap, ties by place, in no order."""
    sure, maybe = np.zeros_like(rows), rows.copy()
    have = 0
    for s in reversed(total):
        if s is None:
            continue
        on = maybe & s
        n = have + int(np.bitwise_count(on).sum())
        if n > k:
            maybe = on
        else:
            sure |= on
            have, maybe = n, maybe & ~s
            if n == k:
                break
    places = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    return np.concatenate([places(sure), places(maybe)[: k - have]])


def search_block(ids: np.ndarray, base: list[int], slices: np.ndarray, query_id: int, query: list[int], k: int) -> list[tuple[int, int]]:
    """(id, score) of the block's k best rows; ``ids`` ascending."""
    counter, shift = Counter(), 0
    for d, weight in enumerate(query):
        shift += weight * base[d]
        if not weight:
            continue
        planes = slices[d]
        if weight < 0:  # -w * y = w * (top - y) - w * top
            planes, weight = ~planes, -weight
            shift -= weight * ((1 << len(planes)) - 1)
        power = 0
        while weight >> power:
            if weight >> power & 1:
                for b, plane in enumerate(planes):
                    counter.add(power + b, plane.copy())
            power += 1
    total = counter.total()
    rows = np.zeros(slices.shape[2] * 64, np.uint8)
    rows[: len(ids)] = ids != query_id
    picked = best_rows(total, np.packbits(rows, bitorder="little").view(np.uint64), k)
    score = np.full(len(picked), shift, object)
    for p, s in enumerate(total):
        if s is not None:
            score += (s[picked >> 6] >> (picked & 63).astype(np.uint64) & np.uint64(1)).astype(object) << p
    return list(zip(ids[picked].tolist(), score.tolist(), strict=True))


def quantise(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly: 64-bit numbers where all fit, else Python's."""
    if not x.size or np.abs(x).max() < 2.0**54:
        return np.floor(x * SCALE).astype(np.int64)
    whole = lambda v: int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE)
    return np.array([whole(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def shown(score: int) -> tuple[int, int, bytes | None, str | None]:
    """(over, score, tail, exact): the order of (over, score, tail) is that of scores of any size.

    ``score`` stops at the ends of 64 bits; beyond them ``over`` is the signed length in bits, ``tail`` tells numbers of one
    length apart, and ``exact`` is the number in decimals.
    """
    if -(2**63) <= score < 2**63:
        return 0, score, None, None
    n = score.bit_length()
    raw = abs(score).to_bytes(-(-n // 8), "big")
    if score > 0:
        return n, 2**63 - 1, raw, str(score)
    return -n, -(2**63), bytes(255 - b for b in raw), str(score)


def taking_part(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, size, wide, x of the vectors that take part. ``wide``: 32-bit steps that the components need beyond 30 bits."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = F.forall(embedding, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & fine & (F.size(embedding) > 0))
    top = F.array_max(F.transform("x", lambda v: F.abs(v)))
    wide = F.greatest(F.lit(0), F.ceil((F.log2(F.greatest(top, F.lit(1.0))) + 8 - 30) / 32)).cast("int")
    return rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.size(embedding).alias("size"), x.alias("x")).withColumn("wide", wide)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def exact_top_k(vectors: DataFrame, query_of, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, exact. ``query_of``: condition on column vec_id that picks the queries."""
    spark = vectors.sparkSession
    rows = taking_part(vectors, vec_id, embedding)
    most = lambda bound, per: F.greatest(F.lit(1), F.least(F.lit(bound), F.floor(F.lit(HELD) / per))).cast("int")
    pieces = lambda n, each: F.ceil(n / each).cast("int")
    # Plain sizes: one row for each length of vectors (and each width of their components).
    blocks = rows.groupBy("size", "wide").agg(F.count("*").alias("n"))
    blocks = blocks.select("size", "wide", pieces(F.col("n"), most(BLOCK_ROWS, F.col("size") * (F.col("wide") + 1))).alias("blocks"))
    asked = rows.where(query_of).groupBy("vec_id").agg(F.min(F.struct("size", "x")).alias("v")).select("vec_id", "v.size", "v.x")
    packs = asked.groupBy("size").agg(F.count("*").alias("n")).join(blocks.groupBy("size").agg(F.sum("blocks").alias("all")), "size")
    # Packs are as large as may be held, but for small inputs, where every core shall have its tasks.
    spread = F.ceil(F.col("n") * F.col("all") / F.lit(2 * spark.sparkContext.defaultParallelism))
    packs = packs.select("size", pieces(F.col("n"), F.greatest(F.lit(1), F.least(spread, most(BLOCK_ROWS, F.col("size"))))).alias("packs"))
    plan = cut(blocks.join(packs, "size"))
    tasks = int(plan.agg(F.sum(F.col("blocks").cast("bigint") * F.col("packs"))).first()[0] or 0)
    if not tasks:
        return spark.createDataFrame([], _RESULT)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        base, slices = slices_of(quantise(_matrix(pdf["x"])))
        key = {c: [int(pdf[c].iloc[0])] for c in ("size", "wide", "block")}
        return pd.DataFrame({**key, "bits": [slices.shape[1]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "base": [",".join(map(str, base.tolist()))], "slices": [slices.tobytes()]})

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"size": [int(pdf["size"].iloc[0])], "pack": [int(pdf["pack"].iloc[0])], "asked": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "x": [_matrix(pdf["x"]).tobytes()]})

    key = ["size", "wide", "block", "pack"]
    shelf = rows.join(plan, ["size", "wide"]).withColumn("block", deal("blocks")).select("size", "wide", "block", "vec_id", "x")
    shelf = shelf.groupBy("size", "wide", "block").applyInPandas(index, "size int, wide int, block int, bits int, ids binary, base string, slices binary")
    # An index is built once and read by as many tasks as there are packs; tasks are counted, not left to be merged by size.
    shelf = shelf.join(plan.select("size", "wide", "packs"), ["size", "wide"]).withColumn("pack", each("packs")).drop("packs")
    heap = asked.join(plan.select("size", "packs").distinct(), "size").withColumn("pack", deal("packs")).select("size", "pack", "vec_id", "x")
    heap = heap.groupBy("size", "pack").applyInPandas(gather, "size int, pack int, asked binary, x binary")
    heap = heap.join(plan.select("size", "wide", "blocks"), "size").withColumn("block", each("blocks")).drop("blocks")
    parts = min(2 * tasks, TASKS)
    met = heap.repartition(parts, *key).join(shelf.repartition(parts, *key), key)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "vec_id", "over", "score", "tail", "exact"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for row in range(batch.num_rows):
                x = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                ids, base = np.frombuffer(x["ids"], np.int64), [int(v) for v in x["base"].split(",")]
                slices = np.frombuffer(x["slices"], np.uint64).reshape(x["size"], x["bits"], -1)
                vectors = np.frombuffer(x["x"], np.float64).reshape(-1, x["size"])
                out = []
                for q, v in zip(np.frombuffer(x["asked"], np.int64).tolist(), vectors, strict=True):
                    out += [(q, i, *shown(s)) for i, s in search_block(ids, base, slices, q, quantise(v).tolist(), k)]
                columns = list(zip(*out, strict=True)) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    found = met.select("size", "bits", "ids", "base", "slices", "asked", "x").mapInArrow(search, "query_id bigint, vec_id bigint, over int, score bigint, tail binary, exact string")
    best = Window.partitionBy("query_id").orderBy(F.desc("over"), F.desc("score"), F.desc("tail"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "exact")
