"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioframe.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, per_cent=85)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS id, a AS c FROM edges UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.id
), least AS (
  SELECT id, min(c) AS c FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON id = d.doc_id
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioframe.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"), shards=8)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioframe.llm.rule_ensemble import score, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"), _fold(5) != 0)
    return score(docs, model).select(
        "doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioframe.llm.decision_list import judge

    judged = judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioframe.llm.line_dedup import repeated_lines, without_lines

    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = without_lines(docs, repeated_lines(docs), digest=True)
    return got.select("doc.doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioframe.llm.substrings import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents
), windows AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d)
), gone AS (
  SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1
), runs AS (
  SELECT doc_id, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run, p
  FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM gone)
), spans AS (
  SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY doc_id, run
), heads AS (
  SELECT s.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS head
  FROM spans s JOIN d ON d.doc_id = s.doc_id WINDOW w AS (PARTITION BY s.doc_id ORDER BY a)
), per AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(head, '' ORDER BY a) AS heads FROM heads GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(heads, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN per ON per.doc_id = d.doc_id
"""


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioframe.llm.bitsliced import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioframe.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioframe.llm.language_id import predict, train

    docs = _table(spark, sf_dir, "documents")
    languages, model = train(docs, _fold(3) != 1)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (_fold(3) == 1).alias("held_out"))
    return predict(narrow, languages, model).select("row.doc_id", "row.held_out", "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioframe.llm.mixing import mixed

    return mixed(_table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 3 * source_size AS cap, CAST(CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM per
), tried AS (
  SELECT *, row_number() OVER o AS nth,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS try
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), level AS (
  SELECT arg_min(try, nth) AS level FROM tried WHERE try <= cap / weight
), rates AS (
  SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), level * weight), 0.0) AS target FROM tried CROSS JOIN level
), rated AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN least(3.0, target / source_size) ELSE 0.0 END AS rate FROM rates
), drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.rate,
    CAST(CAST('0x' || substr(md5('mix-1' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
  size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken,
  CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies
FROM drawn
"""


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
  FROM (SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), keyed AS (
  SELECT doc_id, pos, line, CASE WHEN length(bare) >= 40
    THEN translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS key FROM lines
), heavy AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.last_doc AS gone FROM keyed k LEFT JOIN heavy h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_sharding": op2_sharding,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_quality_rules": op4_quality_rules,
        "op5_line_dedup": op5_line_dedup,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_exact_topk": op7_exact_topk,
        "op8_packing": op8_packing,
        "op9_language_id": op9_language_id,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1_SQL, "op5_line_dedup": OP5_SQL, "op6_suffix_dedup": OP6_SQL, "op7_exact_topk": OP7_SQL, "op10_mixing": OP10_SQL}
