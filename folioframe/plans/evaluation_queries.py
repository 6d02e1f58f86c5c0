"""Evaluation queries: benchmark passages as ground truth, documents of the same id as found text."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators import evaluation as E
from folioframe.plans.registry import query, table
from folioframe.plans.text_queries import SAMPLE_ROWS, collapse, normalised, samples


def pairs(spark, sf_dir):
    """(id, truth, found): every benchmark passage with the document of its id, and neighbouring samples."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("truth"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("found"))
    a = samples(spark).select("id", F.col("text").alias("truth"))
    b = samples(spark).select((F.col("id") - 1).alias("id"), F.col("text").alias("found"))
    return items.join(docs, "id").unionByName(a.join(b, "id"))


PAIRS = f"""{SAMPLE_ROWS}, pairs AS (SELECT item_id AS id, b.text AS truth, d.text AS found FROM benchmark b JOIN documents d ON item_id = doc_id
  UNION ALL SELECT a.id, a.text, b.text FROM samples a JOIN samples b ON a.id = b.id - 1),
  tr AS (SELECT id, truth AS text FROM pairs), fo AS (SELECT id, found AS text FROM pairs)"""
COUNTS = f"na AS (SELECT id, token, count(*) AS na FROM {normalised('tr')} GROUP BY ALL), nb AS (SELECT id, token, count(*) AS nb FROM {normalised('fo')} GROUP BY ALL)"


def ascii_pairs(spark, sf_dir):
    """The pairs with one mark for every other character: the other engine's Levenshtein counts bytes."""
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?").alias(c)
    return pairs(spark, sf_dir).select("id", plain("truth"), plain("found"))


ASCII = r"plain AS (SELECT id, regexp_replace(truth, '[^\x00-\x7F]', '?', 'g') AS truth, regexp_replace(found, '[^\x00-\x7F]', '?', 'g') AS found FROM pairs)"
CLEAN = collapse(r"regexp_replace(regexp_replace(line, '^[\s•●⁃·\x{95}\-*]+', ''), '[\s•●⁃·\x{95}\-*]+$', '')")


ALIGNED = f"""WITH {PAIRS}, {ASCII}, a AS (SELECT id, no, {CLEAN} AS line FROM (SELECT id, generate_subscripts(p, 1) AS no, unnest(p) AS line FROM (SELECT id, string_split(truth, chr(10)) AS p FROM plain))),
  b AS (SELECT id, lower({CLEAN}) AS line FROM (SELECT id, unnest(string_split(found, chr(10))) AS line FROM plain)),
  d AS (SELECT a.id, a.no, length(a.line) AS n, min(levenshtein(lower(a.line), b.line)) AS d FROM a LEFT JOIN (SELECT DISTINCT * FROM b WHERE length(line) > 3) b ON a.id = b.id AND abs(length(a.line) - length(b.line)) < length(a.line) WHERE length(a.line) > 3 GROUP BY a.id, a.no, a.line)
SELECT id, CAST(sum(least(n, coalesce(d, n))) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS chars, round(CAST(sum(least(n, coalesce(d, n))) AS DOUBLE) / sum(n), 6) AS cer FROM d GROUP BY id"""


@query("evl01_aligned_cer", ALIGNED)
def aligned_cer(spark, sf_dir):
    return E.aligned_cer(ascii_pairs(spark, sf_dir), "id")


@query(
    "fn30_cer",
    f"""WITH {PAIRS}, {ASCII} SELECT id, round(CASE WHEN length(truth) = 0 THEN CASE WHEN length(found) = 0 THEN 0.0 ELSE 1.0 END ELSE CAST(levenshtein(truth, found) AS DOUBLE) / length(truth) END, 6) AS cer FROM plain""",
)
def cer(spark, sf_dir):
    p = ascii_pairs(spark, sf_dir)
    return p.select("id", F.round(T.cer(F.col("truth"), F.col("found")), 6).alias("cer"))


@query("fn29_levenshtein", "SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part")
def levenshtein(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


F1 = f"""WITH {PAIRS}, {COUNTS}, s AS (SELECT id, sum(coalesce(na, 0)) AS na, sum(coalesce(nb, 0)) AS nb, sum(least(coalesce(na, 0), coalesce(nb, 0))) AS m FROM na FULL JOIN nb USING (id, token) GROUP BY id),
  t AS (SELECT id, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb, coalesce(m, 0) AS m FROM pairs LEFT JOIN s USING (id))
SELECT id, round(CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE CAST(m AS DOUBLE) / nb END, 6) AS precision,
  round(CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE CAST(m AS DOUBLE) / na END, 6) AS recall,
  round(CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE 2.0 * CAST(m AS DOUBLE) / (na + nb) END, 6) AS f1 FROM t"""


@query("evl02_token_f1", F1)
def token_f1(spark, sf_dir):
    return E.token_f1(pairs(spark, sf_dir), "id")


@query(
    "evl03_numeric_recall",
    f"""WITH {PAIRS}, a AS (SELECT id, pos, token, row_number() OVER (PARTITION BY id, token ORDER BY pos) AS nth FROM {normalised('tr')} WHERE regexp_matches(token, '\\d')),
  b AS (SELECT id, token, count(*) AS have FROM {normalised('fo')} WHERE regexp_matches(token, '\\d') GROUP BY ALL),
  h AS (SELECT a.*, coalesce(nth <= have, false) AS hit FROM a LEFT JOIN b USING (id, token)),
  s AS (SELECT id, round(CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*), 6) AS recall, coalesce(string_agg(token, ' ' ORDER BY pos) FILTER (WHERE hit), '') AS matched,
    coalesce(string_agg(token, ' ' ORDER BY pos) FILTER (WHERE NOT hit), '') AS missed FROM h GROUP BY id)
SELECT id, coalesce(recall, 1.0) AS recall, coalesce(matched, '') AS matched, coalesce(missed, '') AS missed FROM pairs LEFT JOIN s USING (id)""",
)
def numeric_recall(spark, sf_dir):
    return E.numeric_recall(pairs(spark, sf_dir), "id")


SET_RECALL = f"""WITH {PAIRS}, {COUNTS}, s AS (SELECT id, round(CAST(sum(CASE WHEN nb > 0 THEN na ELSE 0 END) AS DOUBLE) / sum(na), 6) AS recall FROM na LEFT JOIN nb USING (id, token) GROUP BY id)
SELECT id, coalesce(recall, 1.0) AS recall FROM pairs LEFT JOIN s USING (id)"""


@query("evl04_set_recall", SET_RECALL)
def set_recall(spark, sf_dir):
    return E.set_recall(pairs(spark, sf_dir), "id")


@query(
    "evl05_page_report",
    f"""WITH f AS ({F1}), c AS ({ALIGNED}), m AS (SELECT CAST(id % 12 AS BIGINT) AS page, cer, recall FROM f JOIN c USING (id)),
  r AS (SELECT page, round(avg(cer), 9) AS cer, round(avg(recall), 9) AS recall FROM m GROUP BY ROLLUP (page))
SELECT page, cer, recall, cer <= 0.05 AND recall >= 0.95 AS passes FROM r""",
)
def page_report(spark, sf_dir):
    errors = E.aligned_cer(ascii_pairs(spark, sf_dir), "id").select("id", "cer")
    f = E.token_f1(pairs(spark, sf_dir), "id").join(errors, "id").select((F.col("id") % 12).alias("page"), "cer", "recall")
    return E.page_report(f, "page")


@query(
    "label_report",
    "SELECT lang, count(*) AS n, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic, round(avg(n_chars), 4) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)",
)
def label_report(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.rollup("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("evl07_health", "SELECT CASE WHEN bool_and(value IS NOT NULL AND ts IS NOT NULL) THEN 'ok' ELSE 'degraded' END AS status FROM events")
def health(spark, sf_dir):
    from folioframe.operators.relational import health as status

    return status(table(spark, sf_dir, "events").select((F.col("value").isNotNull() & F.col("ts").isNotNull()).alias("up")))
