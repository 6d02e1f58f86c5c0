"""Sequential rules that depend on earlier decisions, as one streaming pass over sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folioframe.shipping import ship


def running_fold(df: DataFrame, keys: list[str], order: list, inputs: list[str], start: Callable[[], Any], step: Callable[..., int], out: str) -> DataFrame:
    """Adds the long column ``out``: ``step(state, *inputs)`` for every row of a key in ``order``.

    A window's numbering brings the rows of a key together, in order, without a shuffle where they are
    partitioned by the key already. They stream through the task: only the state of the current key is
    held, so a key may be larger than memory.
    """
    ship(df.sparkSession)
    by = [F.col(k) if isinstance(k, str) else k for k in keys]
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))  # also partitions and sorts the rows
    placed = df.withColumn("_nth", nth).select("_nth", F.struct(*(F.col(c) for c in df.columns)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            row, values = batch.column(1), []
            for nth, *args in zip(batch.column(0).to_pylist(), *(row.field(c).to_pylist() for c in inputs)):
                if nth == 1:
                    state = start()
                values.append(step(state, *args))
            yield pa.RecordBatch.from_arrays([row, pa.array(values, pa.int64())], names=["row", out])

    schema = StructType([StructField("row", df.schema), StructField(out, LongType())])
    return placed.mapInArrow(run, schema).select("row.*", out)


def bucket_rule(tolerance: float) -> tuple[Callable[[], Any], Callable[..., int]]:
    """``start`` and ``step`` of the baseline rule for boxes (t, b) in order of their tops."""

    def start() -> tuple[dict, list, list]:
        return {}, [], []

    def step(state: tuple[dict, list, list], t: float, b: float) -> int:
        known, first, near = state  # equal boxes are in one bucket; near: buckets that words from here on can reach
        if (got := known.get((t, b))) is not None:
            return got
        mid = (t + b) / 2
        if near and t > near[0][1]:
            near[:] = [x for x in near if t <= x[1]]
        for k, _, t0, m0 in near if b >= t else first:
            if abs(mid - m0) <= tolerance or abs(t - t0) <= tolerance:
                break
        else:
            k = len(first)
            first.append((k, max(t, mid) + tolerance, t, mid))
            near.append(first[-1])
        known[t, b] = k
        return k

    return start, step
