"""The ingestion worker as a stream: files of jobs in, processed documents and stage rows out."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

JOB = "document_id string, version_id string, meta string, queued_at timestamp"
STAGES = ("profile", "parse", "tables", "chunk", "index")


def job_source(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """Queue folder of JSON jobs, oldest files first, ``per_batch`` files at a time."""
    return spark.readStream.schema(JOB).option("maxFilesPerTrigger", per_batch).option("latestFirst", "false").json(folder)


def stage_rows(spark: SparkSession, batch: DataFrame, stage: str, status: str, millis: int | None = None, error: str | None = None) -> DataFrame:
    return batch.select(
        "document_id", F.lit(stage).alias("stage"), F.lit(status).alias("status"), F.lit(millis).cast("long").alias("duration_ms"),
        F.lit(error).cast("string").alias("error_message"), F.current_timestamp().alias("at"),
    )


def worker(jobs: DataFrame, process: dict[str, Callable[[DataFrame], None]], status_path: str, checkpoint: str) -> StreamingQuery:
    """Runs every stage over a micro-batch and appends its true duration; a failure marks stage and
    document as failed and stops the stream, which restarts from its checkpoint."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            for stage, run in process.items():
                began = time.time()
                try:
                    run(batch)
                except Exception as e:
                    stage_rows(spark, batch, stage, "failed", int(1000 * (time.time() - began)), str(e)[:500]).write.mode("append").parquet(status_path)
                    raise
                stage_rows(spark, batch, stage, "completed", int(1000 * (time.time() - began))).write.mode("append").parquet(status_path)
        finally:
            batch.unpersist()

    return jobs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_status(stages: DataFrame) -> DataFrame:
    """stages(document_id, stage, status, at) -> the document's own status from the last word of each stage."""
    last = stages.groupBy("document_id", "stage").agg(F.max_by("status", "at").alias("status"))
    n, failed = F.count("*"), F.count_if(F.col("status") == "failed")
    done = F.count_if(F.col("status") == "completed")
    status = F.when(failed > 0, "failed").when(done == len(STAGES), "ready").when(n > 0, "processing").otherwise("queued")
    return last.groupBy("document_id").agg(n.alias("n_stages"), status.alias("status"))
