"""The corpus pipeline: language ID, quality rules, near duplicates, repeated passages, packing.

Each stage takes what its predecessor kept, as reread from Parquet, and all but the last
return the columns of ``documents`` (extra columns, of whatever name, are passed on). Rows
with nulls: a text that is null or has no letter goes in the first stage; a document
without doc_id can be no one's duplicate and stays. Rows of equal doc_id count as one
document and stay or go together. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.llm import jaccard_join, langid, packing, risk_rules, span_dedup
from repolens.llm.queries import held_out, table
from repolens.llm.scratch import Scratch


def _packed(docs: DataFrame, *cols: str) -> DataFrame:
    """The row as one column, so that no name of its columns can clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *cols)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told without doubt; the languages are learned from the labelled four fifths."""
    model = langid.fit(docs.filter(~held_out()))
    return langid.predict(_packed(docs, "text"), model, "__row").filter(~F.col("ambiguous") & (F.col("lang_pred") != langid.UNKNOWN)).select("__row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs of their language."""
    scratch = Scratch(spark)
    # Texts are counted once, and nothing but them goes through Python; the counts lie beside their row.
    counted = scratch.table(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), risk_rules.counts_of(F.col("text")).alias("__counts")), "counted")
    counts = counted.select(F.col("__row.doc_id").alias("doc_id"), F.col("__row.lang").alias("lang"), "__counts.*")
    cutoffs = risk_rules.calibrate(counts, table(spark, sf_dir, "labels"), "lang")
    rows = counted.select("__row", F.col("__row.lang").alias("lang"), "__counts.*")
    return risk_rules.apply_rules(rows, cutoffs, "lang").filter("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id."""
    found = jaccard_join.near_duplicates(docs)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; n_chars is that of the text that is left."""
    out = span_dedup.clean(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the texts, one row for each piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", pack),
]

#: SQL can express neither the learned classifier nor the certified cutoffs; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        kept = scratch.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        docs = before = kept
    return docs
