"""Mixing sources to target weights, with DataFrame functions only.

Corner cases: a null or empty text has size 0; a null source is a source of its own and comes last; rows
repeated with one ``doc_id`` draw the same number; a source without words has target 0; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.runtime import save, workspace

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
#: Sources up to which the rate table (some 60 bytes a row) is broadcast as a whole.
BROADCAST_SOURCES = 100_000
#: Beyond, only sources with more than one ``HOT``-th of all rows are; there are at most ``HOT`` of them.
HOT = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the document and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _running(table: DataFrame, order: list[Column], sums: tuple[str, ...]) -> DataFrame:
    """``table`` with ``nth`` (from 1) and, as ``before_<name>``, the sums over all earlier rows of ``order``.

    Rows are dealt by ranges of the order; only one row per range meets in one task, so a table of millions
    of sources is numbered in parallel.
    """
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = save(table.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy("part").agg(F.count("*").alias("nth"), *(F.sum(c).alias(c) for c in sums))
    bases = per.select("part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"base_{c}") for c in ("nth", *sums)))
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(bases), "part").select(
        *table.columns, (F.col("base_nth") + F.count("*").over(own) + 1).alias("nth"),
        *((F.col(f"base_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(f"before_{c}") for c in sums),
    )


def source_rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sized(source, size)`` -> per source ``source_size, rows, target, rate``.

    Sources in code point order (null last) take the weights in turn. A target is weight times a common
    level, but at most ``most`` times the source's size; the level solves sum(targets) = sum(sizes).
    Sources reach their caps in the order of cap / weight, so the level is found with running sums.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by_name = F.col("source").asc_nulls_last()
    per = _running(per, [by_name], ())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).cast("double")
    per = per.select("source", "source_size", "rows", weight.alias("weight")).withColumn("cap", most * F.col("source_size"))
    per = _running(per.withColumn("full_at", F.col("cap") / F.col("weight")), [F.col("full_at"), by_name], ("cap", "weight"))
    whole = per.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    tried = per.crossJoin(F.broadcast(whole)).withColumn("try", (F.col("all_size") - F.col("before_cap")) / (F.col("all_weight") - F.col("before_weight")))
    fits = F.col("try") <= F.col("full_at")
    level = tried.agg(F.min_by(F.when(fits, F.col("try")), F.when(fits, F.col("nth"))).alias("level"))
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.lit(0.0))
    return per.crossJoin(F.broadcast(level)).withColumn("target", target).select(
        "source", "source_size", "rows", "target",
        F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0).alias("rate"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Every row as a struct ``row``, with ``size``, its source's ``source_size`` and ``target``, and ``copies``.

    A row is to be emitted floor(rate) times, and once more with the probability of the rate's fraction.
    Only the per-source sums are shuffled (pre-aggregated on the map side, so a hot source is no hot
    task); the rate table is broadcast to the texts if it is small. If not, the texts of the largest
    sources, whose number is bounded, still meet their rates by broadcast, and only the others are dealt
    by source.
    """
    source, size = F.col("source").alias("source"), word_count(F.col("text")).alias("size")
    with workspace() as keep:
        rates = save(source_rates(docs.select(source, size), weights, most), "rates")
        keep(rates)
    rates = rates.withColumnRenamed("source", "rate_source")
    rows = docs.select(F.struct("*").alias("row"), source, size, draw(F.col("doc_id"), seed).alias("draw"))
    same = F.col("source").eqNullSafe(F.col("rate_source"))
    if rates.count() <= BROADCAST_SOURCES:
        met = rows.join(F.broadcast(rates), same)
    else:
        hot = rates.crossJoin(F.broadcast(rates.agg(F.sum("rows").alias("all_rows")))).filter(F.col("rows") * HOT > F.col("all_rows")).drop("all_rows")
        met = rows.join(F.broadcast(hot), same).unionByName(rows.join(F.broadcast(hot), same, "left_anti").join(rates, same))
    rate = F.col("rate")
    copies = F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long")
    return met.select("row", "size", "source_size", "target", copies.alias("copies"))


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of ``docs``."""
    each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed(docs).filter("copies > 0").withColumn("copy", each).select("row.*")
