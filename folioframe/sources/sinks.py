"""Sinks: vector collections, profiles, records, manifests, blobs; all writes may be repeated safely."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioframe.functions.text import uuid5
from folioframe.operators.relational import upsert


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ensure_collection(spark: SparkSession, path: str, schema: str | StructType) -> None:
    """An empty collection if there is none."""
    if not _exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)


def points(chunks: DataFrame, app: str = "documents", dimension: int | None = None) -> DataFrame:
    """Chunks with their deterministic ``point_id``; a vector of another dimension raises."""
    name = F.concat_ws(":", F.lit(app), F.col("document_id").cast("string"), F.col("chunk_id").cast("string"))
    out = chunks.withColumn("point_id", uuid5(name))
    if dimension is not None:
        bad = F.size("embedding") != dimension
        out = out.withColumn("embedding", F.when(bad, F.raise_error(F.lit("wrong dimension")).cast(out.schema["embedding"].dataType)).otherwise(F.col("embedding")))
    return out


def upsert_points(collection: str, fresh: DataFrame, version: int) -> str:
    """Merges points into a collection folder and returns the folder of the new version.

    The old version stays readable until the new one is complete.
    """
    spark = fresh.sparkSession
    new = fresh.withColumn("_version", F.lit(version))
    old = spark.read.parquet(f"{collection}/v={version - 1}").withColumn("_version", F.lit(version - 1)) if version and _exists(spark, f"{collection}/v={version - 1}") else new.limit(0)
    upsert(old, new, "point_id", "_version").drop("_version").write.mode("overwrite").parquet(f"{collection}/v={version}")
    return f"{collection}/v={version}"


def delete_documents(points_: DataFrame, gone: DataFrame) -> DataFrame:
    return points_.join(gone.select("document_id").distinct(), "document_id", "left_anti")


def write_by_document(df: DataFrame, path: str) -> None:
    """Rows in folders by document; a rerun replaces only the documents that it holds."""
    df.repartition("document_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(path)


def write_manifest(figures: DataFrame, path: str) -> None:
    from folioframe.operators.figures import manifest

    manifest(figures).write.mode("overwrite").json(path)


def write_blobs(df: DataFrame, folder: str, key: str = "blob_key", content: str = "content") -> None:
    """Each row's bytes as a file below ``folder`` (a path that all executors share), written in place
    under a temporary name first, so that a repeated task leaves whole files only."""

    def put(rows):
        for r in rows:
            to = os.path.join(folder, r[key])
            os.makedirs(os.path.dirname(to), exist_ok=True)
            part = f"{to}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(r[content])
            os.replace(part, to)

    df.select(key, content).foreachPartition(put)


def delete_blobs(spark: SparkSession, folder: str, keys: list[str]) -> None:
    for k in keys:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)


def append_statuses(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
