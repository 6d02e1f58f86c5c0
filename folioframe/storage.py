"""Intermediate results in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Readers of sorted tables know their order; Spark 3 and later need to be told to look.
SORTED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}

_written: list[tuple[SparkSession, str]] = []
_open: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("folioframe_open", default=None)


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset a folder of this machine's own serves a local master alone; on a cluster every
    executor would write to its own disk, so that is refused.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="folioframe-")
        sc.setCheckpointDir(root)
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for one action; they are put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def save(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    ``by`` names a column to lay the files out by. The files survive the loss of any executor. They go when
    ``drop`` is called or the driver ends. The shuffle files behind them are removed as soon as they are
    written; left to the collection of the driver's garbage, those of several steps would pile up on the
    executors' disks.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/folioframe-{label}-{uuid.uuid4().hex}"
    with settings(spark, {SHUFFLE_CLEANUP: "true"}):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._folioframe_path = path
    return _noted(out)


def save_sorted(df: DataFrame, label: str, key: str) -> DataFrame:
    """``save`` as a table bucketed and sorted by ``key``: joins of such tables on it shuffle and sort nothing.

    There are as many buckets as shuffle partitions, so that what an aggregate or join by ``key`` has dealt
    out is written in place, one file a bucket. Plan and run readers under ``SORTED`` settings.
    """
    spark, name = df.sparkSession, f"folioframe_{label}_{uuid.uuid4().hex}"
    path = f"{shared_root(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with settings(spark, SORTED | {SHUFFLE_CLEANUP: "true"}):
        df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    _written.append((spark, path))
    out = spark.table(name)
    out._folioframe_path, out._folioframe_table = path, name
    return _noted(out)


def _noted(df: DataFrame) -> DataFrame:
    if (made := _open.get()) is not None:
        made.append(df)
    return df


@contextlib.contextmanager
def workspace() -> Iterator[Callable[..., None]]:
    """Deletes what is saved inside it at its end, but for the frames that it was told to keep.

    Frames that are kept belong to the workspace around it, if there is one; else they go when the driver
    ends. What a returned, lazy plan still reads must be kept.
    """
    outer, made, kept = _open.get(), [], set()
    token = _open.set(made)
    try:
        yield lambda *frames: kept.update(f._folioframe_path for f in frames)
    finally:
        _open.reset(token)
        there = {path for _, path in _written}
        for df in made:
            if df._folioframe_path in kept:
                if outer is not None:
                    outer.append(df)
            elif df._folioframe_path in there:
                drop(df)


def drop(*frames: DataFrame) -> None:
    """Delete what ``save`` wrote for these frames; nothing may read them afterwards."""
    for df in frames:
        if hasattr(df, "_folioframe_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._folioframe_table}")
        delete(df.sparkSession, df._folioframe_path)


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the driver ends."""
    _written.append((spark, path))


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)
    _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _delete_all() -> None:
    for spark, path in list(_written):
        try:
            delete(spark, path)
        except Exception:  # the gateway may be gone by now
            return
