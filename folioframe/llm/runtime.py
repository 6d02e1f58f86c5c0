"""Session plumbing shared by the corpus operators: shared storage and Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioframe.shipping import ship
from folioframe.storage import SORTED, drop, keep_until_exit, save, save_sorted, settings, shared_root, workspace  # noqa: F401  for the operators

#: Rows and bytes that one Arrow batch hands to a Python worker; bounds its memory for long texts.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20

#: Keys that ``join_heavy`` broadcasts, at most.
HEAVY = 4096

def prepare(spark: SparkSession) -> None:
    """Ship this package to the executors once per context and bound the Arrow batches."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def join_heavy(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with a (saved) table of one row per key, whose column ``n`` counts the key's rows.

    The counts add up to ``total`` at most, so fewer than ``HEAVY`` keys hold more than one ``HEAVY``-th of
    all rows; these are broadcast, and their rows stay where they are. All others are dealt by key, none of
    them to a hot task.
    """
    from pyspark.sql import functions as F  # noqa: PLC0415

    heavy = F.broadcast(per_key.filter(F.col(n) * HEAVY > total))
    rest = rows.join(heavy.select(key), key, "left_anti").join(per_key.filter(F.col(n) * HEAVY <= total), key)
    return rows.join(heavy, key).unionByName(rest)


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """``mapInArrow`` with plain columns: ``make()`` runs once per task and gives ``columns -> columns``.

    Input columns arrive as Python lists by name; the result may have any number of rows.
    """
    from pyspark.sql.types import _parse_datatype_string  # noqa: PLC0415
    from pyspark.sql.pandas.types import to_arrow_schema  # noqa: PLC0415

    prepare(df.sparkSession)
    names = df.columns
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            out = work({n: batch.column(i).to_pylist() for i, n in enumerate(names)})
            if out and len(next(iter(out.values()))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, schema)


def extend_batches(df: DataFrame, inputs: list[str], make: Callable[[], Callable[..., dict]], schema: str) -> DataFrame:
    """Every row of ``df`` as a struct ``row``, and beside it the new columns of ``schema``.

    ``make()`` gives a function from the input columns (lists) to the new ones (lists of the same
    length). The row passes through Arrow untouched, so its other columns may have any name and type.
    """
    from pyspark.sql import functions as F  # noqa: PLC0415
    from pyspark.sql.pandas.types import to_arrow_schema  # noqa: PLC0415
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string  # noqa: PLC0415

    prepare(df.sparkSession)
    fresh = _parse_datatype_string(schema)
    whole = StructType([StructField("row", df.schema), *fresh.fields])
    arrow = to_arrow_schema(fresh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            row = batch.column(0)
            got = work(*(row.field(n).to_pylist() for n in inputs))
            cols = [pa.array(got[f.name], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([row, *cols], names=["row", *arrow.names])

    return df.select(F.struct("*").alias("row")).mapInArrow(run, whole)
