"""Batch forms of the streaming operators; tests hold the streams against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.plans.registry import query, table
from folioframe.streaming import limits as S


def calls(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("client"), F.col("ts").alias("at"), F.col("event_id").alias("call_id"))


ORDERED = "o AS (SELECT user_id AS client, event_id AS call_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(
    "str03_sliding_log_limiter",
    f"""WITH RECURSIVE {ORDERED}, f AS (SELECT client, call_id, i, [us] AS kept, 1 AS accepted FROM o WHERE i = 1
  UNION ALL SELECT o.client, o.call_id, o.i, CASE WHEN len(list_filter(kept, lambda t: t > o.us - 21600000000)) >= 2 THEN list_filter(kept, lambda t: t > o.us - 21600000000)
    ELSE list_append(list_filter(kept, lambda t: t > o.us - 21600000000), o.us) END, CASE WHEN len(list_filter(kept, lambda t: t > o.us - 21600000000)) >= 2 THEN 0 ELSE 1 END
  FROM f JOIN o ON o.client = f.client AND o.i = f.i + 1)
SELECT client, call_id, CAST(accepted AS BIGINT) AS accepted FROM f""",
)
def sliding_log_limiter(spark, sf_dir):
    return S.limited(calls(spark, sf_dir), "sliding", 2, 6 * 3600).select("client", "call_id", "accepted")


@query(
    "str02_fixed_window_limiter",
    f"""WITH RECURSIVE {ORDERED}, f AS (SELECT client, call_id, i, us AS start, 1 AS n FROM o WHERE i = 1
  UNION ALL SELECT o.client, o.call_id, o.i, CASE WHEN o.us >= start + 86400000000 THEN o.us ELSE start END, CASE WHEN o.us >= start + 86400000000 THEN 1 ELSE n + 1 END FROM f JOIN o ON o.client = f.client AND o.i = f.i + 1)
SELECT client, call_id, CAST(n <= 2 AS BIGINT) AS accepted FROM f""",
)
def fixed_window_limiter(spark, sf_dir):
    return S.limited(calls(spark, sf_dir), "fixed", 2, 24 * 3600).select("client", "call_id", "accepted")


@query(
    "str04_stage_status_latest",
    "SELECT user_id AS document_id, event_type AS stage, arg_max(event_id, ts) AS status, max(ts) AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY ALL",
)
def stage_status_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id", "event_type", "ts").agg(F.max("event_id").alias("event_id"))
    return S.latest_status(last.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("status"), F.col("ts").alias("at")))


@query(
    "str05_tumbling_counts",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def tumbling_counts(spark, sf_dir):
    w = S.windowed_counts(table(spark, sf_dir, "events"), "1 hour")
    return w.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
