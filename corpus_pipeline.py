"""From raw documents to token ids: language ID, near-duplicate removal, secret redaction, source mixing, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of `documents`, whatever further ones there are, and none minds
their names. Every stage takes null and repeated ids, null, empty and very long texts, equal rows and empty tables (which
give empty results); what it does with them is in its docstring and that of its operator.

The stages run one after another in the same executors and Python workers, so each first sets its session's limit of an
Arrow batch (small_batches); this changes no result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelattice.llm import bpe, language_id, mixing, near_dedup, secrets
from statelattice.llm.common import BROADCAST_ROWS, discard, materialize, small_batches

WEIGHTS = [3, 1, 2]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for those of the one-column table ids(doc_id); rows without an id stay."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_anti")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is null, empty or has no letters (`und`); fills in missing languages. Rows with a
    null id are held out of the fit and kept like others. Ties go to the language that is first by name."""
    small_batches(spark)
    learn = docs.where(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    found = language_id.identify(docs, language_id.fit(learn, order=F.col("doc_id")), prefix="__lang_")
    kept = found.where(F.col("__lang_pred") != "und").withColumn("lang", F.coalesce("lang", "__lang_pred"))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group, and one of the rows that have this id and one text. Rows
    without an id or without words are in no group and stay."""
    small_batches(spark)
    found = materialize(near_dedup.near_duplicates(docs), "pipeline-groups")
    gone = materialize(found.where(~F.col("kept")).select("doc_id").distinct(), "pipeline-gone")
    again = materialize(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "pipeline-again")
    kept = _without(docs, gone)
    repeated = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(kept, again).unionByName(repeated).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows (null for null texts). Every row stays."""
    small_batches(spark)
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each run of a document's words that the mix draws, and as often as it does; n_chars follows. Texts
    without words have no such run. A null source is one of the sources; equal rows may yield different runs."""
    parts = materialize(mixing.mix_parts(docs, WEIGHTS), "pipeline-mix")
    return mixing.drawn_documents(docs, parts).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row; a null text has none."""
    small_batches(spark)
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact),
    ("mixing", mix),
    ("bpe", encode),
]

#: SQL can't express the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
