"""From raw documents to encoded training data: five stages, each an operator of lwwspark.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lwwspark.llm.common import remove, scratch, table
from lwwspark.llm.language import keep_identified
from lwwspark.llm.mixing import labelled_domains, mixed
from lwwspark.llm.pieces import piece_digests
from lwwspark.llm.quality import keep_good
from lwwspark.llm.simhash import keep_one_of_each

#: Low quality has gone by the time documents are mixed, so it has no target.
TARGETS = {"clean": 0.98, "toxic": 0.02}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as its rate in the target mixture says."""
    return mixed(docs, labelled_domains(table(spark, sf_dir, "labels")), TARGETS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_source_bytes, ends, ids of every document."""
    return piece_digests(docs, with_ids=True)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if held:
            remove(spark, held)
        held = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None
