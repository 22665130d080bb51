"""A corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and
returns a DataFrame. run() writes what a stage returns to the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import langid, mixing, neardup, pieces, secrets
from strataflow.llm.common import cut, dropped, table, text_or_empty

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; those without a letter and near ties go. A null lang is filled in."""
    model = langid.trained(docs, "doc_id", "text", "lang", F.lit(True))
    found = langid.identify(docs.select(*COLUMNS), "text", model)
    kept = found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous"))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on five-word shingles at a similarity of 0.8."""
    return neardup.deduplicate(docs.select(*COLUMNS), "doc_id", "text")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets masked in its text and n_chars counted anew."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's target takes; the one at the edge of the budget stays
    whole if at least half of it is inside."""
    sized = docs.select(*COLUMNS).withColumn("size", mixing.count_words(text_or_empty()))
    mixed = mixing.mix(sized, "doc_id", "size", "source", [3.0, 1.0, 2.0])
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    many = mixed.withColumn("copies", copies).where("copies > 0")
    return many.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's piece ids."""
    return pieces.encoded(docs.select("doc_id", "source", "text"), "text", pieces.model_at()).select("doc_id", "source", "n_pieces", "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Trained classifiers and similarity search aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = cut(stage(spark, docs, sf_dir), name)
        dropped(docs)  # what the stage before wrote
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
