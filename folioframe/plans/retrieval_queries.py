"""Retrieval queries over embeddings (chunks), documents, benchmark (questions) and part (records)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators import retrieval as R
from folioframe.plans.registry import query, table
from folioframe.plans.text_queries import SAMPLE_ROWS, TEXTS, WC, samples, texts, trim


def chunks(spark, sf_dir):
    """Every vector with the document of its id; document_id is the source, page its place in it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return vectors.join(docs, "chunk_id")


CHUNKS = "chunks AS (SELECT vec_id AS chunk_id, source AS document_id, text, CAST(embedding AS DOUBLE[]) AS e FROM embeddings JOIN documents ON vec_id = doc_id)"


def ready_sources(spark, sf_dir):
    """The authorised documents of the flagship: sources whose name ends in an even digit."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("document_id")).distinct().filter(F.substring("document_id", -1, 1).isin("0", "2", "4", "6", "8"))


IDS = "ids AS (SELECT DISTINCT source AS document_id FROM documents WHERE right(source, 1) IN ('0','2','4','6','8'))"


def first_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("query_vector"))


def first_question(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").filter("item_id = 0").select(F.col("text").alias("query"))


DENSE = """dense AS (SELECT *, row_number() OVER (ORDER BY dense_score DESC, chunk_id) AS dense_rank FROM
    (SELECT c.chunk_id, c.document_id, c.text, round(list_cosine_similarity(c.e, q.e), 9) AS dense_score FROM chunks c JOIN ids USING (document_id), (SELECT e FROM chunks_all WHERE chunk_id = 0) q)
    QUALIFY dense_rank <= 20)"""
ALL = "chunks_all AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
ASKED = f"asked AS (SELECT token, count(*) AS qf FROM (SELECT unnest(regexp_extract_all(lower(text), '[{WC}]{{2,}}')) AS token FROM benchmark WHERE item_id = 0) GROUP BY token)"
KEYWORD = f"""toks AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[{WC}]{{2,}}')) AS token FROM dense),
  sizes AS (SELECT chunk_id, len(regexp_extract_all(lower(text), '[{WC}]{{2,}}')) AS n FROM dense),
  tf AS (SELECT chunk_id, token, count(*) AS tf FROM toks GROUP BY ALL),
  kscore AS (SELECT chunk_id, round(sum(qf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / (SELECT avg(n) FROM sizes)))), 9) AS s FROM tf JOIN asked USING (token) JOIN sizes USING (chunk_id) GROUP BY chunk_id),
  kw AS (SELECT d.*, coalesce(s, 0.0) AS keyword_score, row_number() OVER (ORDER BY coalesce(s, 0.0) DESC, dense_rank) AS keyword_rank FROM dense d LEFT JOIN kscore USING (chunk_id))"""
FUSED = "fused AS (SELECT *, round(1.0 / (60 + dense_rank) + 1.0 / (60 + keyword_rank), 9) AS score FROM kw)"
HYBRID = f"WITH {ALL}, {CHUNKS}, {IDS}, {DENSE}, {ASKED}, {KEYWORD}, {FUSED}"


@query("hybrid_retrieve", f"{HYBRID} SELECT CAST(row_number() OVER (ORDER BY score DESC, dense_rank) AS INTEGER) AS rank, chunk_id, document_id, score FROM fused QUALIFY rank <= 6")
def hybrid_retrieve(spark, sf_dir):
    got = R.retrieve(chunks(spark, sf_dir), first_vector(spark, sf_dir), first_question(spark, sf_dir), ready_sources(spark, sf_dir))
    return got.select("rank", "chunk_id", "document_id", "score")


@query("ret02_dense_topk", f"WITH {ALL}, {CHUNKS}, {IDS}, {DENSE} SELECT CAST(dense_rank AS INTEGER) AS dense_rank, chunk_id, document_id, dense_score FROM dense")
def dense_topk(spark, sf_dir):
    got = R.dense_top_k(chunks(spark, sf_dir), first_vector(spark, sf_dir), 20, ids=ready_sources(spark, sf_dir))
    return got.select("dense_rank", "chunk_id", "document_id", "dense_score")


@query("ret03_bm25_tf_rank", f"{HYBRID} SELECT chunk_id, keyword_score, CAST(keyword_rank AS INTEGER) AS keyword_rank FROM kw")
def bm25_tf_rank(spark, sf_dir):
    pool = R.dense_top_k(chunks(spark, sf_dir), first_vector(spark, sf_dir), 20, ids=ready_sources(spark, sf_dir))
    scored = R.bm25_tf(pool, first_question(spark, sf_dir))
    order = Window.orderBy(F.desc("keyword_score"), "dense_rank")
    return scored.select("chunk_id", "keyword_score", F.row_number().over(order).alias("keyword_rank"))


@query(
    "ret05_rrf_fuse",
    """WITH l AS (SELECT vec_id AS chunk_id, label, 0 AS list_no, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings
  UNION ALL SELECT vec_id, label, 1, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) FROM embeddings),
  f AS (SELECT label, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) FILTER (WHERE list_no = 0) AS first_rank FROM l GROUP BY ALL)
SELECT label, chunk_id, score, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, first_rank) AS INTEGER) AS rank FROM f QUALIFY rank <= 10""",
)
def rrf_fuse(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding")[0].alias("x"))
    a = v.select("label", "chunk_id", F.lit(0).alias("list_no"), F.row_number().over(Window.partitionBy("label").orderBy("chunk_id")).alias("rank"))
    b = v.select("label", "chunk_id", F.lit(1).alias("list_no"), F.row_number().over(Window.partitionBy("label").orderBy(F.desc("x"), "chunk_id")).alias("rank"))
    return R.rrf(a.unionByName(b), ("label",)).filter("rank <= 10").select("label", "chunk_id", "score", "rank")


@query(
    "ret08_multi_query_retrieve",
    f"""WITH {CHUNKS}, sq AS (SELECT b.item_id AS sq, b.text AS query, CAST(v.embedding AS DOUBLE[]) AS q FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id),
  dense AS (SELECT sq, query, chunk_id, text, row_number() OVER (PARTITION BY sq ORDER BY s DESC, chunk_id) AS dense_rank FROM
    (SELECT sq, query, chunk_id, text, round(list_cosine_similarity(e, q), 9) AS s FROM chunks, sq) QUALIFY dense_rank <= 10),
  asked AS (SELECT sq, token, count(*) AS qf FROM (SELECT sq, unnest(regexp_extract_all(lower(query), '[{WC}]{{2,}}')) AS token FROM sq) GROUP BY ALL),
  sizes AS (SELECT sq, chunk_id, n, avg(n) OVER (PARTITION BY sq) AS a FROM (SELECT sq, chunk_id, len(regexp_extract_all(lower(text), '[{WC}]{{2,}}')) AS n FROM dense)),
  tf AS (SELECT sq, chunk_id, token, count(*) AS tf FROM (SELECT sq, chunk_id, unnest(regexp_extract_all(lower(text), '[{WC}]{{2,}}')) AS token FROM dense) GROUP BY ALL),
  ks AS (SELECT sq, chunk_id, round(sum(qf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / a))), 9) AS s FROM tf JOIN asked USING (sq, token) JOIN sizes USING (sq, chunk_id) GROUP BY ALL),
  kw AS (SELECT sq, chunk_id, dense_rank, row_number() OVER (PARTITION BY sq ORDER BY coalesce(s, 0.0) DESC, dense_rank) AS kr FROM dense LEFT JOIN ks USING (sq, chunk_id)),
  fused AS (SELECT sq, chunk_id, row_number() OVER (PARTITION BY sq ORDER BY round(1.0 / (60 + dense_rank) + 1.0 / (60 + kr), 9) DESC, dense_rank) AS rank FROM kw QUALIFY rank <= 6)
SELECT chunk_id, sq AS sub_query, CAST(rank AS INTEGER) AS rank FROM fused QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY sq, rank) = 1""",
)
def multi_query_retrieve(spark, sf_dir):
    """Every benchmark passage is a sub-query row: one job for all, first occurrence of a chunk wins."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sq"), F.col("embedding").alias("q"))
    sq = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sq"), F.col("text").alias("query")).join(v, "sq")
    known = chunks(spark, sf_dir)
    near = R.dense_many(known, sq.withColumnRenamed("q", "query_vector"), ("sq",), 10)
    pool = near.join(known.select("chunk_id", "text"), "chunk_id")
    fused = R.hybrid(pool, sq.select("sq", "query"), 6, ("sq",))
    first = Window.partitionBy("chunk_id").orderBy("sq", "rank")
    return fused.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("chunk_id", F.col("sq").alias("sub_query"), "rank")


EVIDENCE = "evidence AS (SELECT id AS answer_id, 'doc_' || (id % 7) AS document_id, CASE WHEN id % 2 = 0 THEN 'Manual.pdf' ELSE 'other guide' END AS filename, CAST(CASE WHEN id % 3 = 0 THEN 3 ELSE 12 END AS INTEGER) AS page_number FROM texts)"


def evidence_of(answers):
    a = F.col("answer_id")
    name = F.when(a % 2 == 0, "Manual.pdf").otherwise("other guide")
    return answers.select("answer_id", F.concat(F.lit("doc_"), a % 7).alias("document_id"), name.alias("filename"), F.when(a % 3 == 0, 3).otherwise(12).alias("page_number"))


@query(
    "ret10_citation_verify",
    rf"""WITH {TEXTS}, {EVIDENCE}, cited AS (SELECT id AS answer_id, row_number() OVER () AS no, lower({trim("document")}) AS doc, CAST(page AS INTEGER) AS page
    FROM (SELECT id, unnest(regexp_extract_all(text, '{T.CITATION}', 1)) AS document, unnest(regexp_extract_all(text, '{T.CITATION}', 2)) AS page FROM texts)),
  targets AS (SELECT answer_id, lower(filename) AS target, page_number FROM evidence UNION SELECT answer_id, lower(document_id), page_number FROM evidence),
  checked AS (SELECT c.answer_id, c.no, bool_or(coalesce(contains(target, doc) OR contains(doc, target), false)) AS valid FROM cited c LEFT JOIN targets t ON c.answer_id = t.answer_id AND c.page = t.page_number GROUP BY ALL),
  per AS (SELECT answer_id, count(*) AS n, count(*) FILTER (WHERE valid) AS ok FROM checked GROUP BY 1)
SELECT id AS answer_id, coalesce(n, 0) AS n_citations, coalesce(ok, 0) AS n_valid, CASE WHEN n IS NULL THEN 1.0 ELSE round(ok / n, 2) END AS coverage,
  coalesce(n, 0) = coalesce(ok, 0) AS is_verified, coalesce(n, 0) > 0 AND coalesce(ok, 0) = 0 AS recommend_retry FROM texts LEFT JOIN per ON id = answer_id""",
)
def citation_verify(spark, sf_dir):
    answers = texts(spark, sf_dir).select(F.col("id").alias("answer_id"), F.col("text").alias("answer"))
    return R.verify_citations(answers, evidence_of(answers))


@query("ret11_citation_dedupe", "SELECT source AS document_id, CAST(n_chars % 5 AS INTEGER) AS page_number, min(doc_id) AS chunk_id FROM documents GROUP BY ALL")
def citation_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), (F.col("n_chars") % 5).cast("int").alias("page_number"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("rank"))
    return R.first_per_page(d).select("document_id", "page_number", "chunk_id")


@query(
    "fn24_context_block",
    rf"""WITH e AS (SELECT conv_id, turn, 'conv_' || conv_id AS document_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rank FROM conversations)
SELECT conv_id, string_agg('[Source ' || rank || ' | Doc: ' || document_id || ' | Page: ' || turn || ' | Section: ' || CASE WHEN role = 'user' THEN 'General' ELSE role END || ']' || chr(10) || {trim("text")}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM e GROUP BY conv_id""",
)
def context_block(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    e = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("page_number"), F.concat(F.lit("conv_"), "conv_id").alias("document_id"), F.lit(None).cast("string").alias("filename"),
        F.when(F.col("role") == "user", None).otherwise(F.col("role")).alias("section"), "text", F.row_number().over(order).alias("rank"),
    )
    return R.evidence_context(e, ("conv_id",))


def records(spark, sf_dir):
    """EAV records of the part table: entity = brand, section = type, attribute = column."""
    p = table(spark, sf_dir, "part")
    pairs = F.array(F.struct(F.lit("size").alias("attribute"), F.col("p_size").cast("string").alias("value")), F.struct(F.lit("name").alias("attribute"), F.col("p_name").alias("value")))
    return p.select(F.col("p_brand").alias("entity"), F.col("p_type").alias("section"), F.explode(pairs).alias("x")).select("entity", "section", "x.*")


RECORDS = "records AS (SELECT p_brand AS entity, p_type AS section, 'size' AS attribute, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT p_brand, p_type, 'name', p_name FROM part)"


@query("ret15_table_lookup", f"WITH {RECORDS} SELECT * FROM records WHERE lower(entity) = (SELECT lower(min(p_brand)) FROM part) AND attribute = 'size'")
def table_lookup(spark, sf_dir):
    r = records(spark, sf_dir)
    least = table(spark, sf_dir, "part").agg(F.min("p_brand").alias("entity"))
    return r.join(F.broadcast(least), "entity", "left_semi").filter("attribute = 'size'").select("entity", "section", "attribute", "value")


@query("ret15_contradictions", f"WITH {RECORDS} SELECT entity, attribute, count(DISTINCT value) AS n_values FROM records GROUP BY ALL HAVING n_values > 1")
def contradictions(spark, sf_dir):
    return R.contradictions(records(spark, sf_dir))


@query(
    "true_bm25",
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[{WC}]{{2,}}') AS tokens FROM documents),
  st AS (SELECT count(*) AS n, avg(len(tokens)) AS a FROM t),
  asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[{WC}]{{2,}}')) AS token FROM benchmark),
  tf AS (SELECT doc_id, l, token, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS l, unnest(tokens) AS token FROM t) WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
  df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
  s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score FROM tf JOIN df USING (token) JOIN asked USING (token), st GROUP BY ALL)
SELECT query_id, doc_id AS chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""",
)
def true_bm25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return R.true_bm25(docs, q).withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("query_id", "chunk_id", "score", "rank")


@query(
    "ret09_figure_retrieve",
    f"""WITH {SAMPLE_ROWS}, man AS (SELECT source AS document_id, source || '.pdf' AS filename, source || '_fig' || doc_id AS figure_id, CAST(doc_id % 12 AS INTEGER) AS page_number, lang AS caption, text AS label FROM documents),
  asked AS (SELECT id AS query_id, {"regexp_matches(lower(text), '(^|[^" + WC + "])(" + "|".join(T.VISUAL_KEYWORDS) + ")($|[^" + WC + "])')"} AS visual,
    TRY_CAST(nullif(regexp_extract(lower(text), '(^|[^{WC}])(page|pg|p\\.?)\\s*(\\d+)($|[^{WC}])', 3), '') AS INTEGER) AS target,
    list_filter(list_distinct(regexp_extract_all(lower(text), '[{WC}]+')), lambda t: NOT list_contains([{", ".join("'" + w + "'" for w in T.FIGURE_STOP_WORDS)}], t)) AS tokens FROM samples),
  ev AS (SELECT -1 - item_id % (SELECT count(*) FROM samples) AS query_id, CAST(row_number() OVER (PARTITION BY item_id % (SELECT count(*) FROM samples) ORDER BY item_id) - 1 AS INTEGER) AS idx, source || '_fig' || doc_id AS figure_id, source AS document_id,
    CAST(doc_id % 12 AS INTEGER) AS page_number, (item_id * 37 % 100) / 100.0 AS score FROM benchmark JOIN documents ON item_id = doc_id),
  open_ AS (SELECT * FROM asked WHERE visual OR target IS NOT NULL OR query_id IN (SELECT query_id FROM ev WHERE score > 0.85)),
  k AS (SELECT query_id, figure_id, document_id, page_number, visual,
    CAST((CASE WHEN target IS NULL THEN 0.0 WHEN page_number = target THEN 120.0 ELSE -50.0 END) + 15.0 * len(list_filter(tokens, lambda t: contains(lower(caption || ' ' || label || ' ' || filename), t))) AS DOUBLE) AS score
    FROM man, open_ WHERE TRUE),
  e AS (SELECT ev.*, visual, 50.0 - 3.0 * idx + 20.0 * ev.score + CASE WHEN page_number = target THEN 100.0 ELSE 0.0 END AS s FROM ev JOIN open_ USING (query_id)),
  b AS (SELECT coalesce(e.query_id, k.query_id) AS query_id, coalesce(e.figure_id, k.figure_id) AS figure_id, coalesce(e.document_id, k.document_id) AS document_id, coalesce(e.page_number, k.page_number) AS page_number,
    coalesce(e.visual, k.visual) AS visual, idx, coalesce(s, 0.0) + coalesce(k.score, 0.0) AS score FROM e FULL JOIN k ON e.query_id = k.query_id AND e.figure_id = k.figure_id AND e.document_id = k.document_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(idx, 1000000000), document_id, figure_id) AS rank FROM b WHERE idx IS NOT NULL OR score > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, figure_id, document_id, page_number, round(score, 6) AS score FROM r WHERE rank <= 3 AND NOT (score <= 0 AND visual AND rank > 1)""",
)
def figure_retrieve(spark, sf_dir):
    """The sample questions against a manifest with a figure for every document; every benchmark passage
    is a retrieved figure chunk of one of them."""
    d = table(spark, sf_dir, "documents")
    manifest = d.select(
        F.col("source").alias("document_id"), F.concat("source", F.lit(".pdf")).alias("filename"), F.concat("source", F.lit("_fig"), "doc_id").alias("figure_id"),
        (F.col("doc_id") % 12).cast("int").alias("page_number"), F.col("lang").alias("caption"), F.array("text").alias("nearby_labels"),
    )
    asked = samples(spark).select(F.col("id").alias("query_id"), F.col("text").alias("query"))
    item = table(spark, sf_dir, "benchmark").join(d, F.col("item_id") == F.col("doc_id"))
    q = -1 - F.col("item_id") % asked.count()
    nth = F.row_number().over(Window.partitionBy(q).orderBy("item_id")) - 1
    shown = item.select(
        q.cast("long").alias("query_id"), nth.alias("idx"), F.concat("source", F.lit("_fig"), "doc_id").alias("figure_id"), F.col("source").alias("document_id"),
        (F.col("doc_id") % 12).cast("int").alias("page_number"), (F.col("item_id") * 37 % 100 / 100).alias("score"),
    )
    return R.figures(manifest, shown, asked)
