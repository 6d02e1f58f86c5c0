"""The agent over all benchmark questions, and embeddings by the default model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioframe.operators import qa
from folioframe.plans.registry import query, table


@query("ret13_agent_answer")
def agent_answer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), (F.col("doc_id") % 12).cast("int").alias("page_number"), "text")
    chunks = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("query_vector"))
    return qa.agent(questions, chunks, vectors).select("question_id", "answer", "n_citations", "coverage", "is_verified", "retries")


@query("doc08_embed_texts")
def embed_texts(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = qa.embed_texts(items, "text")
    return e.select("doc_id", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"))


@query(
    "ret06_rerank",
    "SELECT label, vec_id AS chunk_id, CAST(row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS INTEGER) AS final_rank FROM embeddings QUALIFY final_rank <= 6",
)
def rerank(spark, sf_dir):
    """Without a scorer the order of before stands and the first six pass."""
    e = table(spark, sf_dir, "embeddings")
    c = e.select("label", F.col("vec_id").alias("chunk_id"), F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.col("embedding")[0]), "vec_id")).alias("rank"))
    return qa.rerank(c, 6, keys=("label",)).select("label", "chunk_id", "final_rank")


class LengthScorer:
    """Prefers texts that are as long as the question; stands for a model in the query below."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        return [-float(abs(len(query) - len(t))) for t in texts]


@query(
    "ret06_rerank_scored",
    """WITH c AS (SELECT item_id, doc_id, length(b.text) - length(d.text) AS apart FROM documents d JOIN benchmark b ON item_id = doc_id % (SELECT count(*) FROM benchmark))
SELECT item_id, doc_id AS chunk_id, CAST(-abs(apart) AS DOUBLE) AS rerank_score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY abs(apart), doc_id) AS INTEGER) AS final_rank FROM c QUALIFY final_rank <= 8""",
)
def rerank_scored(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % items.count()).alias("item_id"), F.col("doc_id").alias("chunk_id"), "text")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("chunk_id"))
    found = qa.rerank(docs.join(items, "item_id").withColumn("rank", rank), 8, LengthScorer, ("item_id",))
    return found.select("item_id", "chunk_id", "rerank_score", "final_rank")


@query(
    "ret12_extractive_answer",
    r"""WITH e AS (SELECT conv_id, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations),
  c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM e WHERE k = 1)
SELECT c_custkey AS question_id, CASE WHEN conv_id IS NULL THEN 'Insufficient evidence in authorized documents to answer this question.' ELSE
  CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END || ' [Doc: conv' || conv_id || ', Page: ' || turn || ']' END AS answer FROM customer LEFT JOIN c ON conv_id = c_custkey""",
)
def extractive_answer(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    ev = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), F.concat(F.lit("conv"), "conv_id").alias("document_id"), F.col("turn").alias("page_number"), "text", F.row_number().over(order).alias("position"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), F.col("c_name").alias("query"))
    return qa.extractive_answers(asked, ev).select("question_id", "answer")
