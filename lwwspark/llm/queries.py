"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations, read_back
from .common import table
from .embed_dedup import near_vectors
from .language import identify_languages
from .mixing import TARGETS, labelled_domains, mix
from .pieces import piece_digests
from .quality import classify_quality
from .simhash import near_duplicates, shown
from .token_scan import count_tokens
from .top_k import exact_top_k
from .url_rules import judge_urls

#: The extra conversation of op1: a user, then an assistant turn, both with this text.
MARKED = "\\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], "conv_id long, turn long, role string, text string")
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_conversations(log))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(near_duplicates(table(spark, sf_dir, "documents")))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).drop("exact")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), labelled_domains(table(spark, sf_dir, "labels")), TARGETS)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op1_chat": op1_chat, "op2_quality": op2_quality, "op3_token_counts": op3_token_counts, "op4_simhash": op4_simhash, "op5_embeddings": op5_embeddings, "op6_sentencepiece": op6_sentencepiece, "op7_top_k": op7_top_k, "op8_mixing": op8_mixing, "op9_language": op9_language, "op10_url_filter": op10_url_filter}
