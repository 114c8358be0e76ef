"""Token counts from flat token files, by a separator scan.

A flat token file is a sequence of little-endian 16-bit ids in which every document ends with the end-of-document id;
there is no index. The scan cuts each file into blocks, searches every block for the separator with one vectorised
comparison, and stitches documents that cross blocks with a prefix scan: running counts of separators give the ordinals,
running maxima of their places give the starts. Only a block's separator places leave Python, and only one row for each
block enters the scan.

``write_token_files`` makes such files: a document's ids are the line, the separator's two bytes the line's end. A task
begins another file when ``FILE_BYTES`` are full, so a file, which is read as one row, is larger only by its last
document. Beside the tokens, in the same task and from the same rows, it writes each document's id with its place in its
file; so it doesn't matter in which order a table's rows come, or whether they would come so again.

Defined results: null texts are empty; an empty text has 0 tokens (its separator is not counted). Ids after the last
separator are a document too. A file without any document gives no row. Repeated rows are separate documents; a null id
stays null. An odd byte at a file's end is ignored. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import Folder
from .common import by_small_batches, cut, remove, scratch

SEPARATOR = 50_256
BLOCK_TOKENS, FILE_BYTES = 1 << 17, 1 << 25
#: Characters of an id's record: its place, a blank, and the id's UTF-8 in hexadecimal digits, or a hyphen for none.
_RECORD = b"0123456789abcdef -"
_KEPT: dict[str, object] = {}


def encoding(path: str | None = None):
    """Byte-level BPE from a file of ranks (None: the public 50k ranks for many languages, installed with every worker)."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    if path not in _KEPT:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _KEPT[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _KEPT[path]


def write_token_files(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None, separator: int = SEPARATOR) -> None:
    """Flat files under ``path/kind=0/part=N``, N counting each task's files, and the ids' records under ``path/kind=1``."""
    end = separator.to_bytes(2, "little")
    if all(b in _RECORD for b in end):
        raise ValueError("this separator could occur in the records of ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(ranks)
        part = place = size = 0
        for batch in batches:
            out = []
            for name, t in zip(*batch.columns, strict=True):
                if size >= FILE_BYTES:
                    part, place, size = part + 1, 0, 0
                ids = bpe.encode_to_numpy(t.as_py() or "").astype("<u2").tobytes()
                name = name.as_py()
                out.append((0, part, place, ids))
                out.append((1, part, place, f"{place} {'-' if name is None else name.encode().hex()}".encode()))
                place, size = place + 1, size + len(ids) + 2
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["kind", "part", "place", "value"])

    rows = by_small_batches(docs).select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    lines = rows.mapInArrow(encode, "kind int, part int, place bigint, value binary").sortWithinPartitions("kind", "part", "place")
    files = lines.select("kind", "part", F.col("value").cast("string").alias("value")).write.partitionBy("kind", "part")
    files.option("maxRecordsPerFile", 0).option("lineSep", end.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def file_of(path) -> list:
    """Columns file_no (the task) and part of a file's path."""
    pattern = r"part=(\d+)/part-(\d+)-"
    return [F.regexp_extract(path, pattern, 2).cast("int").alias("file_no"), F.regexp_extract(path, pattern, 1).cast("int").alias("part")]


def read_ids(spark: SparkSession, path: str, separator: int = SEPARATOR) -> DataFrame:
    """file_no, part, ordinal, name (a document's id as text) of all records under a path."""
    end = separator.to_bytes(2, "little").decode("latin-1")
    lines = spark.read.option("lineSep", end).option("encoding", "ISO-8859-1").text(path).select("value", F.col("_metadata.file_path").alias("at"))
    name = F.substring_index("value", " ", -1)
    return lines.select(*file_of(F.col("at")), F.substring_index("value", " ", 1).cast("bigint").alias("ordinal"), F.when(name != "-", F.decode(F.unhex(name), "UTF-8")).alias("name"))


def blocks_of(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, tokens (binary) of all files under a path."""
    size = 2 * block_tokens
    files = spark.read.format("binaryFile").load(path).where("length > 1").select("path", "content", "length")
    at = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))
    starts = files.select("path", "content", F.posexplode(at).alias("block", "at"))
    cuts = starts.select("path", "block", F.substring("content", (F.col("at") + 1).cast("int"), F.lit(size)).alias("tokens"))
    return cuts.select(F.col("path").alias("file"), "block", "tokens")


def scan(blocks: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, ordinal, start, n_tokens of every document; all blocks but a file's last have ``block_tokens`` ids."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, found = [], []
            for raw in batch.column(2):
                ids = np.frombuffer(raw.as_buffer(), "<u2", len(raw.as_buffer()) // 2)
                size.append(len(ids))
                found.append(np.flatnonzero(ids == separator).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["file", "block", "size", "found"])

    hits = blocks.select("file", "block", "tokens").mapInArrow(search, "file string, block int, size int, found array<int>")
    base = F.col("block").cast("bigint") * block_tokens
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("found") > 0, base + F.element_at("found", -1))
    stitched = hits.select(
        "file", "block", "found", base.alias("base"), (base + F.col("size")).alias("stop"),
        F.coalesce(F.sum(F.size("found")).over(before), F.lit(0)).alias("ordinal"),
        (F.coalesce(F.max(last).over(before), F.lit(-1)) + 1).alias("open"),
        F.lead("block").over(order).isNull().alias("final"),
    )
    places = F.transform("found", lambda p: p + F.col("base"))
    tail_from = F.when(F.size("found") > 0, F.element_at("places", -1) + 1).otherwise(F.col("open"))
    ends = stitched.withColumn("places", places)
    ends = ends.withColumn("places", F.when(F.col("final") & (tail_from < F.col("stop")), F.concat("places", F.array("stop"))).otherwise(F.col("places")))
    each = ends.select("file", "ordinal", "open", "places", F.posexplode("places").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.element_at("places", F.greatest("k", F.lit(1))) + 1)
    return each.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """doc_id, file_no, part, ordinal, start, n_tokens of every document.

    The table is written as flat token files in the shared folder, these are scanned, and removed. A task's number, its
    file's and a document's place there tell the document.
    """
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType
    path = scratch(spark, "tokens")
    write_token_files(docs, path, doc_id, text, ranks)
    if not Folder(spark, path).exists("kind=0"):
        remove(spark, path)
        schema = f"doc_id {kind.simpleString()}, file_no int, part int, ordinal bigint, start bigint, n_tokens bigint"
        return spark.createDataFrame([], schema)
    found = scan(blocks_of(spark, f"{path}/kind=0")).select(*file_of(F.col("file")), "ordinal", "start", "n_tokens")
    names = read_ids(spark, f"{path}/kind=1")
    out = cut(names.join(found, ["file_no", "part", "ordinal"], "full").select("name", "file_no", "part", "ordinal", "start", "n_tokens", F.col("name").cast(kind).alias("doc_id")))
    if out.where("start is null or n_tokens is null").limit(1).count():
        raise RuntimeError("token files and records of ids don't agree")
    remove(spark, path)
    return out.select("doc_id", "file_no", "part", "ordinal", "start", "n_tokens")
