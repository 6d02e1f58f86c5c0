"""Document, permission and conversation operators over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_documents(documents: DataFrame, permissions: DataFrame, user: Column) -> DataFrame:
    """Documents that a user owns or was given, newest first."""
    given = permissions.filter(F.col("user_id") == user).select("document_id").distinct()
    mine = documents.filter(F.col("owner_id") == user)
    shared = documents.filter(~F.col("owner_id").eqNullSafe(user)).join(given, "document_id", "left_semi")
    return mine.unionByName(shared).orderBy(F.desc("created_at"), "document_id")


def access_check(requests: DataFrame, documents: DataFrame, permissions: DataFrame) -> DataFrame:
    """requests(user_id, is_admin, document_id, write) -> allowed: admin, owner, or a permission that suffices."""
    held = permissions.groupBy("document_id", "user_id").agg(F.max(F.col("permission_level").isin("write", "admin")).alias("may_write"))
    j = requests.join(documents.select("document_id", "owner_id"), "document_id", "left").join(held, ["document_id", "user_id"], "left")
    given = F.col("may_write").isNotNull() & (~F.col("write") | F.col("may_write"))
    return j.withColumn("allowed", F.coalesce(F.col("owner_id").isNotNull() & (F.col("is_admin") | (F.col("owner_id") == F.col("user_id")) | given), F.lit(False)))


def cascade_delete(gone: DataFrame, key: str, **children: DataFrame) -> dict[str, DataFrame]:
    """Every child table without the rows of the deleted documents (one anti-join each)."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in children.items()}


def conversation_summaries(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """One left join and count instead of a count per conversation."""
    counts = messages.groupBy("conversation_id").agg(F.count("*").alias("message_count"))
    return conversations.join(counts, "conversation_id", "left").withColumn("message_count", F.coalesce("message_count", F.lit(0)))


def history(messages: DataFrame, first: int = 6, last: int = 4) -> DataFrame:
    """The last ``last`` of a conversation's first ``first`` messages (the order in which they came)."""
    order = Window.partitionBy("conversation_id").orderBy("created_at", "message_id")
    back = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    head = messages.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= first)
    return head.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= last).drop("back")


def history_recent(messages: DataFrame, last: int = 4) -> DataFrame:
    back = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    return messages.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= last).drop("back")


def multiset_intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of the common rows, the smaller of both sides (INTERSECT ALL, aggregated)."""
    x, y = (d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in ((a, "na"), (b, "nb")))
    return x.join(y, keys).select(*keys, F.least("na", "nb").alias("n"))


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("document_id").agg(F.max_by("blob_key", "version_num").alias("blob_key"), F.max("version_num").alias("version_num"))


def figure_key(figures: DataFrame, wanted: Column, document: Column) -> DataFrame:
    """The blob key of a figure asked for by id, by suffix, or by convention; keys outside their folder go."""
    hit = (F.col("figure_id") == wanted) | F.endswith(F.col("figure_id"), F.concat(F.lit("_"), wanted)) | (F.concat(document, F.lit("_"), F.col("figure_id")) == wanted)
    fallback = F.concat(F.lit("figures/"), document, F.lit("/"), wanted, F.lit(".png"))
    key = F.coalesce(F.min(F.when(hit, F.col("blob_key"))), F.first(fallback))
    got = figures.groupBy(document.alias("document_id"), wanted.alias("wanted")).agg(key.alias("blob_key"))
    safe = F.startswith(F.col("blob_key"), F.concat(F.lit("figures/"), F.col("document_id"), F.lit("/"))) & ~F.col("blob_key").contains("..")
    return got.filter(safe)


def health(components: DataFrame) -> DataFrame:
    return components.agg(F.when(F.bool_and("up"), "ok").otherwise("degraded").alias("status"))


def upsert(target: DataFrame, fresh: DataFrame, key: str, version: str, arrival: tuple[str, ...] = ()) -> DataFrame:
    """Idempotent: one row per key, the one with the highest version; reruns change nothing.

    Of rows with equal versions the target's stays, then the first by the columns ``arrival``. Without these,
    which of several fresh rows of one version wins is open, as rows have no order.
    """
    both = target.withColumn("_side", F.lit(0)).unionByName(fresh.withColumn("_side", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc(version), "_side", *arrival)
    return both.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth", "_side")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Each left row with ``values`` of the last right row of its key at or before its time.

    One union, one shuffle on the key and a carry-forward window; no pairs are made.
    """
    value = F.to_json(F.struct(*values))
    schema = right.select(*values).schema
    r = right.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(0).alias("_side"), value.alias("_value"), F.lit(None).cast(left.schema).alias("_row"))
    x = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_value"), F.struct(*left.columns).alias("_row"))
    order = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = r.unionByName(x).withColumn("_value", F.last("_value", True).over(order)).filter("_side = 1")
    return carried.select("_row.*", F.from_json("_value", schema).alias("_v")).select("*", *(F.col(f"_v.{v}").alias(v) for v in values)).drop("_v")
