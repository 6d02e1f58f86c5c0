"""Questions to answers: model plug-ins with deterministic defaults, and the agent's steps.

Models are plug-ins behind small protocols; the defaults need none, so results repeat. All questions of a
run go through one plan: sub-queries are rows, not a loop.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators import retrieval as R
from folioframe.shipping import ship
from folioframe.storage import save

NO_EVIDENCE = "Insufficient evidence in authorized documents to answer this question."
DIMENSION = 64


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Scorer(Protocol):
    def score(self, query: str, texts: Sequence[str]) -> list[float]: ...


class Answerer(Protocol):
    def answer(self, query: str, context: str, history: Sequence[dict]) -> str: ...


class Captioner(Protocol):
    def describe(self, image: bytes, mime: str) -> str | None: ...


class HashingEmbedder:
    """Signed feature hashing of lower-case words, normalised."""

    def __init__(self, dimension: int = DIMENSION) -> None:
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


def with_retries(call: Callable, tries: int = 3, base: float = 1.5, retryable: tuple[type[Exception], ...] = (TimeoutError, ConnectionError)):
    """Calls with exponential waits after failures that may pass."""
    for n in range(tries):
        try:
            return call()
        except retryable:
            if n + 1 == tries:
                raise
            time.sleep(base * 2**n)
    return None


def embed_texts(df: DataFrame, column: str, make: Callable[[], Embedder] = HashingEmbedder, dimension: int = DIMENSION, batch: int = 8) -> DataFrame:
    """Adds ``embedding``; the model is made once for each task and called with small batches."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    ship(df.sparkSession)
    whole = StructType([StructField("row", df.schema), StructField("embedding", ArrayType(FloatType()))])

    def run(batches):
        model = make()
        for b in batches:
            row = b.column(0)
            texts = [t if t and t.strip() else " " for t in row.field(column).to_pylist()]
            got: list[list[float]] = []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                vectors = with_retries(lambda part=part: model.embed(part))
                if len(vectors) != len(part) or any(len(v) != dimension for v in vectors):
                    raise ValueError("the embedder returned a wrong number of vectors or dimensions")
                got += vectors
            yield pa.RecordBatch.from_arrays([row, pa.array(got, pa.list_(pa.float32()))], names=["row", "embedding"])

    return df.select(F.struct("*").alias("row")).mapInArrow(run, whole).select("row.*", "embedding")


def rerank(candidates: DataFrame, top_n: int, make: Callable[[], Scorer] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first ``top_n`` by a scorer, or by their ``rank`` when there is none or it fails."""
    if make is None:
        order = Window.partitionBy(*keys).orderBy("rank", "chunk_id")
    else:
        ship(candidates.sparkSession)

        def run(batches):
            model = make()
            for b in batches:
                row = b.column(0)
                try:
                    scores = [float(model.score(q, [t])[0]) for q, t in zip(row.field("query").to_pylist(), row.field("text").to_pylist())]
                except Exception:  # noqa: BLE001  the order of before is the fallback
                    scores = [-float(r) for r in row.field("rank").to_pylist()]
                yield pa.RecordBatch.from_arrays([row, pa.array(scores, pa.float64())], names=["row", "rerank_score"])

        from pyspark.sql.types import DoubleType, StructField, StructType

        whole = StructType([StructField("row", candidates.schema), StructField("rerank_score", DoubleType())])
        candidates = candidates.select(F.struct("*").alias("row")).mapInArrow(run, whole).select("row.*", "rerank_score")
        order = Window.partitionBy(*keys).orderBy(F.desc("rerank_score"), "rank", "chunk_id")
    return candidates.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= top_n)


def plan_queries(questions: DataFrame) -> DataFrame:
    """questions(question_id, query) -> a row for each sub-query (sq from 0)."""
    p = questions.select("question_id", F.col("query").alias("question"), T.query_plan(F.col("query")).alias("p"))
    return p.select("question_id", "question", F.col("p.plan").alias("plan"), F.posexplode("p.sub_queries").alias("sq", "query"))


def retrieve_evidence(sub_queries: DataFrame, chunks: DataFrame, pool: int = 10, fused: int = 6, top_n: int = 8) -> DataFrame:
    """sub_queries(question_id, sq, query, query_vector), chunks(chunk_id, document_id, page_number, text, embedding).

    The first occurrence of a chunk over a question's sub-queries wins; the order is by sub-query, then rank.
    """
    keys = ("question_id", "sq")
    near = R.dense_many(chunks, sub_queries, keys, pool)
    dense = near.join(chunks.drop("embedding"), "chunk_id")
    best = R.hybrid(dense, sub_queries.select(*keys, "query"), fused, keys, carry=("document_id", "page_number"))
    found = best.join(chunks.select("chunk_id", "text"), "chunk_id")
    first = Window.partitionBy("question_id", "chunk_id").orderBy("sq", "rank")
    found = found.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
    order = Window.partitionBy("question_id").orderBy("sq", "rank", "chunk_id")
    return found.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top_n)


def extractive_answers(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """The default generator: the snippet of the first chunk with its citation tag, or the fixed refusal."""
    top = evidence.filter("position = 1").select(
        "question_id", F.concat(T.snippet(T.collapse(F.col("text"))), F.lit(" [Doc: "), "document_id", F.lit(", Page: "), F.col("page_number").cast("string"), F.lit("]")).alias("answer")
    )
    return questions.select("question_id", "query").join(top, "question_id", "left").withColumn("answer", F.coalesce("answer", F.lit(NO_EVIDENCE)))


def agent(questions: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """plan -> retrieve -> answer -> verify -> at most one retry with a wider pool -> finalise.

    questions(question_id, query); vectors(question_id, query_vector). Only unverified questions go
    through the retry; citations are cleared where the evidence is insufficient.
    """
    planned = plan_queries(questions).join(vectors, "question_id")

    def attempt(sub: DataFrame, asked: DataFrame, pool: int) -> DataFrame:
        evidence = save(retrieve_evidence(sub, chunks, pool), "evidence")  # a few rows a question, used twice
        answers = extractive_answers(asked, evidence)
        cited = evidence.select(F.col("question_id").alias("answer_id"), F.col("document_id").cast("string").alias("document_id"), F.col("document_id").cast("string").alias("filename"), "page_number")
        verdict = R.verify_citations(answers.select(F.col("question_id").alias("answer_id"), "answer"), cited)
        return answers.join(verdict.withColumnRenamed("answer_id", "question_id"), "question_id")

    first = save(attempt(planned, questions, 10), "answers")
    again = first.filter("recommend_retry").select("question_id")
    done = first.filter("not recommend_retry").withColumn("retries", F.lit(0))
    if not again.isEmpty():
        second = attempt(planned.join(again, "question_id", "left_semi"), questions.join(again, "question_id", "left_semi"), 20)
        done = done.unionByName(second.withColumn("retries", F.lit(1)))
    refused = T.says_insufficient(F.col("answer"))
    return done.withColumn("n_citations", F.when(refused, F.lit(0)).otherwise(F.col("n_citations")))


@dataclass
class Reply:
    answer: str
    citations: list[dict] = field(default_factory=list)
    model: str = "extractive"


def generate(query: str, evidence: Sequence[dict], history: Sequence[dict] = (), chain: Sequence[tuple[str, Answerer]] = (), tries: int = 2) -> Reply:
    """One grounded answer on the driver: the first model of the chain that replies, else the extract.

    evidence: rows (document_id, filename, page_number, section, text, chunk_id) in rank order.
    """
    if not evidence:
        return Reply(NO_EVIDENCE)
    seen: dict[tuple, dict] = {}
    for e in evidence:
        seen.setdefault((e["document_id"], e["page_number"]), e)
    cites = [{"document_id": d, "page": p, "chunk_id": e["chunk_id"], "snippet": e["text"][:200] + ("..." if len(e["text"]) > 200 else "")} for (d, p), e in seen.items()]
    name = lambda e: e.get("filename") or e["document_id"]
    context = "\n\n---\n\n".join(f"[Source {i} | Doc: {name(e)} | Page: {e['page_number']} | Section: {e.get('section') or 'General'}]\n{e['text'].strip()}" for i, e in enumerate(evidence, 1))
    for model, answerer in chain:
        for _ in range(tries):
            try:
                text = answerer.answer(query, context, list(history)[-4:])
            except Exception:  # noqa: BLE001  the next try or model takes over
                continue
            if "insufficient evidence in authorized documents" in text.lower():
                return Reply(text, [], model)
            return Reply(text, cites, model)
    e = evidence[0]
    return Reply(f"{e['text'][:200]} [Doc: {name(e)}, Page: {e['page_number']}]", cites)
