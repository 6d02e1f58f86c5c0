"""Rate limiters and status views, in batch and streaming form with the same rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioframe.operators.folds import running_fold
from folioframe.shipping import ship


def _sliding(state: list, micros: int, times: int, seconds: int) -> int:
    """1 if the call is accepted; only accepted calls are remembered."""
    cut = micros - seconds * 1_000_000
    state[:] = [t for t in state if t > cut]
    if len(state) >= times:
        return 0
    state.append(micros)
    return 1


def _fixed(state: list, micros: int, times: int, seconds: int) -> int:
    """The window starts with the first call and counts refused calls too."""
    if not state or micros >= state[0] + seconds * 1_000_000:
        state[:] = [micros, 0]
    state[1] += 1
    return int(state[1] <= times)


RULES = {"sliding": _sliding, "fixed": _fixed}


def limited(calls: DataFrame, rule: str, times: int, seconds: int) -> DataFrame:
    """calls(client, at, call_id) -> the same with ``accepted`` (0 or 1), by client in order of time."""
    decide = RULES[rule]
    timed = calls.withColumn("_micros", F.unix_micros(F.col("at").cast("timestamp")))
    return running_fold(timed, ["client"], ["_micros", "call_id"], ["_micros"], list, lambda s, t: decide(s, t, times, seconds), "accepted").drop("_micros")


def limited_stream(calls: DataFrame, rule: str, times: int, seconds: int) -> DataFrame:
    """The same over a stream; the state of a client is at most ``times`` instants."""
    decide = RULES[rule]
    ship(calls.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for frame in frames:
            frame = frame.sort_values(["micros", "call_id"], kind="stable")
            frame["accepted"] = [decide(held, int(t), times, seconds) for t in frame["micros"]]
            yield frame[["client", "call_id", "micros", "accepted"]]
        state.update((held,))

    timed = calls.select("client", "call_id", F.unix_micros(F.col("at").cast("timestamp")).alias("micros"))
    return timed.groupBy("client").applyInPandasWithState(
        step, "client long, call_id long, micros long, accepted long", "held array<long>", "append", GroupStateTimeout.NoTimeout
    )


def latest_status(stages: DataFrame) -> DataFrame:
    """stages(document_id, stage, status, at): the last status of every stage (also over a stream)."""
    return stages.groupBy("document_id", "stage").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))


def windowed_counts(events: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
