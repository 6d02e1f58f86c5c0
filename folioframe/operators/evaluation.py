"""Evaluation metrics: character and token error measures, numeric recall, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import text as T


def aligned_cer(pairs: DataFrame, key: str) -> DataFrame:
    """pairs(key, truth, found) texts -> edits, chars, cer over best-matching cleaned lines.

    A truth line costs at most its own length, so lines whose lengths differ by that much need no
    comparison; the pairing stays within a page (an equi-join on the key).
    """
    keep = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: T.clean_line(x)), lambda x: F.length(x) > 3)
    truth = pairs.select(key, F.posexplode(keep(F.col("truth"))).alias("no", "line"))
    found = pairs.select(key, F.explode(F.array_distinct(F.transform(keep(F.col("found")), lambda x: F.lower(x)))).alias("other"))
    near = (F.abs(F.length("line") - F.length("other")) < F.length("line"))
    best = truth.join(found, key, "left").groupBy(key, "no", "line").agg(F.min(F.when(near, F.levenshtein(F.lower("line"), "other"))).alias("d"))
    n = F.length("line")
    return best.groupBy(key).agg(F.sum(F.least(n, F.coalesce("d", n))).alias("edits"), F.sum(n).alias("chars")).withColumn("cer", F.round(F.col("edits") / F.col("chars"), 6))


def token_counts(texts: DataFrame, key: str, column: str, name: str, tokens=T.normalised_tokens) -> DataFrame:
    return texts.select(key, F.explode(tokens(F.col(column))).alias("token")).groupBy(key, "token").agg(F.count("*").alias(name))


def token_f1(pairs: DataFrame, key: str, tokens=T.normalised_tokens) -> DataFrame:
    """Multiset precision, recall and F1 of ``found`` against ``truth``; both empty is perfect."""
    a, b = token_counts(pairs, key, "truth", "na", tokens), token_counts(pairs, key, "found", "nb", tokens)
    j = a.join(b, [key, "token"], "full").fillna(0, ["na", "nb"])
    s = j.groupBy(key).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum(F.least("na", "nb")).alias("m"))
    s = pairs.select(key).join(s, key, "left").fillna(0, ["na", "nb", "m"])
    both, one = (F.col("na") == 0) & (F.col("nb") == 0), (F.col("na") == 0) | (F.col("nb") == 0)
    ratio = lambda x, y: F.when(both, 1.0).when(one, 0.0).otherwise(F.try_divide(x, y))
    f1 = F.when(both, 1.0).otherwise(F.coalesce(F.try_divide(2 * F.col("m"), F.col("na") + F.col("nb")), F.lit(0.0)))
    return s.select(key, F.round(ratio(F.col("m"), F.col("nb")), 6).alias("precision"), F.round(ratio(F.col("m"), F.col("na")), 6).alias("recall"), F.round(F.when(~both & one, 0.0).otherwise(f1), 6).alias("f1"))


def numeric_recall(pairs: DataFrame, key: str) -> DataFrame:
    """Recall of numeric tokens with multiplicity, and the matched and missed ones in their order."""
    truth = pairs.select(key, F.posexplode(T.numeric_tokens(F.col("truth"))).alias("pos", "token"))
    found = token_counts(pairs, key, "found", "have", T.numeric_tokens)
    nth = F.row_number().over(Window.partitionBy(key, "token").orderBy("pos"))
    marked = truth.withColumn("nth", nth).join(found, [key, "token"], "left").withColumn("hit", F.coalesce(F.col("nth") <= F.col("have"), F.lit(False)))
    listed = lambda t: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(t, F.struct("pos", "token")))), lambda x: x["token"]), " ")
    per = marked.groupBy(key).agg(F.round(F.count_if("hit") / F.count("*"), 6).alias("recall"), listed(F.col("hit")).alias("matched"), listed(~F.col("hit")).alias("missed"))
    return pairs.select(key).join(per, key, "left").fillna({"recall": 1.0, "matched": "", "missed": ""})


def set_recall(pairs: DataFrame, key: str, tokens=T.normalised_tokens) -> DataFrame:
    """Share of the truth's token occurrences whose token occurs in ``found`` at all."""
    truth = token_counts(pairs, key, "truth", "n", tokens)
    found = token_counts(pairs, key, "found", "have", tokens)
    per = truth.join(found, [key, "token"], "left").groupBy(key).agg(F.round(F.sum(F.when(F.col("have") > 0, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("recall"))
    return pairs.select(key).join(per, key, "left").fillna({"recall": 1.0})


def page_report(measures: DataFrame, page: str, most_cer: float = 0.05, least_recall: float = 0.95) -> DataFrame:
    """Per page and overall (null page): mean measures and whether they pass."""
    r = measures.rollup(page).agg(F.round(F.avg("cer"), 9).alias("cer"), F.round(F.avg("recall"), 9).alias("recall"))
    return r.withColumn("passes", (F.col("cer") <= most_cer) & (F.col("recall") >= least_recall))


def confusion(predicted: Column, actual: Column) -> list[Column]:
    return [F.count_if((predicted == p) & (actual == a)).alias(f"p{p}_a{a}") for p in (0, 1) for a in (0, 1)]
