"""Stages of the corpus pipeline; each takes (spark, docs, sf_dir) and calls one operator.

Corner cases, for all stages: rows may have any further columns, of any names, and all but the last stage
return the columns that they were given; repeated rows and ties are treated as the stage's operator says;
an empty table gives an empty table. Null texts and texts of fewer than 50 words go in the first stage, so
the others meet them only when called by themselves: line dedup and near dedup leave them as they are,
mixing counts no words in them, packing makes them the single end id. Rows with a null ``doc_id`` neither
lose lines nor count as copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm.decision_list import keep_good
from folioframe.llm.line_dedup import dedupe_lines
from folioframe.llm.minhash import drop_near_duplicates
from folioframe.llm.mixing import emit
from folioframe.llm.packing import pack


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more.

    That is what stages on word shingles take here. It differs from the three words and 0.85 of the
    ``op1`` query: one changed word touches five shingles instead of three.
    """
    return drop_near_duplicates(docs, width=5, per_cent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return emit(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines found in five documents or more stay only in the last of them."""
    return dedupe_lines(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; returns the pieces and their places."""
    return pack(docs)
