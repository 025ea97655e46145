"""Corpus pipeline: language ID, exact and near deduplication, mixing and packing of ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridwright.llm.common import fold, written
from gridwright.llm.exact_dedup import drop_exact
from gridwright.llm.jaccard_join import drop_near
from gridwright.llm.language_id import learn_profiles, with_language, with_letter
from gridwright.llm.mixing import mixed
from gridwright.llm.packing import pack

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: what has no letter, or a null or empty text, goes; of repeated rows all stay or go.

    Learns from rows with a known language; where there are none, all with a letter stay. Whole texts
    of any length. An empty table stays empty. All columns come back unchanged, whatever their names.
    """
    profiles = learn_profiles(docs.where(fold() != 0))
    return with_language(docs, profiles) if profiles else with_letter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: that with the least doc_id, one of repeated rows.

    Null and empty texts are equal; a null id counts as the largest; texts of any length are hashed
    whole. An empty table stays empty. All columns come back unchanged, whatever their names.
    """
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8): that with the least doc_id.

    Texts without a word have no duplicates, rows without an id stay, repeated rows of a least id all
    stay; texts of any length are read whole. An empty table stays empty. All columns come back
    unchanged, whatever their names.
    """
    return drop_near(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so never those without a word; repeated rows take what they take together.

    A null source is a source of its own; texts of any length count whole; ties go by hashes. An empty
    table stays empty. All columns come back unchanged, whatever their names.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with the bins that they are packed into; equal texts never share one.

    Nulls, long texts, ties, repeated rows, empty tables and other columns go as in ``pack``.
    """
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [("language_id", language_id), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("source_mixing", mix), ("best_fit_packing", packing)]

#: SQL can express neither the learned languages nor the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
