"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, topk
from .bpe import encode_texts
from .language_id import predict
from .media import media_columns
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .secrets import find_secrets
from .sharding import shard_by_bytes
from .token_store import token_files


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=80)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=40)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), weights=[3, 1, 2], share=1.5, most=2)
    return mixed.drop("tie")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100, k=10)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chats.select("conv_id", "n_turns", "kept", F.md5("chat").alias("chat_md5"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_sharding": op2_sharding,
    "op3_mixing": op3_mixing,
    "op4_bpe": op4_bpe,
    "op5_top_k": op5_top_k,
    "op6_secrets": op6_secrets,
    "op7_chat": op7_chat,
    "op8_media": op8_media,
    "op9_token_files": op9_token_files,
    "op10_language_id": op10_language_id,
}

#: DuckDB SQL for those that SQL can express on whole tables.
ORACLES: dict[str, str] = {"op5_top_k": topk.ORACLE, "op7_chat": chat.ORACLE}
