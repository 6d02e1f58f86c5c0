"""The corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm import stages
from folioframe.llm.runtime import save

STAGES = [
    ("quality rules", stages.quality_rules),
    ("line dedup", stages.line_dedup),
    ("near dedup", stages.near_dedup),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

#: SQL can express neither learning the rules nor the packing; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again.

    The corner cases are those of ``folioframe.llm.stages``; an empty ``documents`` gives no pieces, and
    without labels only the base rule rejects.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return stages.packing(spark, docs, sf_dir)
