"""Retrieval: access, dense and lexical ranking, fusion, figures, citation checks.

Chunks are rows (chunk_id, document_id, page_number, text, embedding...). Rankings break ties by an
explicit ordinal, so they do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.shipping import ship
from folioframe.storage import save

RRF_K = 60
K1, B = 1.5, 0.75


def authorised(documents: DataFrame, permissions: DataFrame, user: Column, admin: bool = False, requested: DataFrame | None = None) -> DataFrame:
    """Ids of the ready documents a user owns or was given; an admin sees all ready ones.

    documents(document_id, owner_id, status), permissions(document_id, user_id). An empty result stays
    empty downstream, since it is only ever used as the right side of a semi-join.
    """
    ready = documents.filter(F.col("status") == "ready")
    if admin:
        ids = ready.select("document_id")
    else:
        owned = ready.filter(F.col("owner_id") == user).select("document_id")
        given = permissions.filter(F.col("user_id") == user).select("document_id")
        ids = owned.unionByName(ready.select("document_id").join(given, "document_id", "left_semi")).distinct()
    if requested is not None:
        ids = ids.join(requested.select("document_id"), "document_id", "left_semi")
    return ids


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def dense_top_k(chunks: DataFrame, vector: DataFrame, k: int, threshold: float = 0.0, ids: DataFrame | None = None) -> DataFrame:
    """The k chunks nearest to the single query ``vector(query_vector)``, with ``dense_rank`` from 1.

    The access list is a semi-join below the scoring; the order is a take-ordered, so every task sends k
    rows at most. The embedding is dropped right after scoring.
    """
    if ids is not None:
        chunks = chunks.join(ids, "document_id", "left_semi")
    scored = chunks.crossJoin(F.broadcast(vector.limit(1))).withColumn("dense_score", F.round(cosine(F.col("embedding"), F.col("query_vector")), 9)).drop("embedding", "query_vector")
    if threshold > 0:
        scored = scored.filter(F.col("dense_score") >= threshold)
    top = scored.orderBy(F.desc("dense_score"), "chunk_id").limit(k)
    order = Window.orderBy(F.desc("dense_score"), "chunk_id")  # over k rows
    return top.withColumn("dense_rank", F.row_number().over(order))


#: Query vectors, and chunk vectors, that meet in one matrix product.
QUERY_BLOCK = 512
CHUNK_BLOCK = 8192


def dense_many(chunks: DataFrame, queries: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    """The k nearest chunks of every query: ``*keys, chunk_id, dense_score, dense_rank``.

    chunks(chunk_id, embedding), queries(*keys, query_vector). Both sides are packed into blocks of rows
    where they lie; every block of queries meets every block of chunks in one matrix product, and k rows a
    query and block go on to the ranking. Nothing is collected, and a task holds one block of each side.
    """
    asked = _packed(queries.select(*keys, "query_vector"), QUERY_BLOCK, "query")
    known = _packed(chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding"), CHUNK_BLOCK, "known")
    pairs = known.hint("shuffle_replicate_nl").crossJoin(asked)
    names = queries.select(*keys).schema

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def unit(v):
            v = np.array(v.to_pylist(), float)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

        held = None
        for b in batches:
            for blob, query in zip(*(b.column(c).to_pylist() for c in range(2))):
                if held is None or held[0] != blob:
                    rows = pa.ipc.open_stream(blob).read_all()
                    held = blob, rows.column("chunk_id").to_numpy(), unit(rows.column("embedding"))
                q = pa.ipc.open_stream(query).read_all().combine_chunks()
                scores = np.round(unit(q.column("query_vector")) @ held[2].T, 9) + 0.0
                best = [np.lexsort((held[1], -row))[:k] for row in scores]
                of, at = np.repeat(np.arange(len(best)), [len(x) for x in best]), np.concatenate(best)
                out = q.select(list(keys)).take(pa.array(of)).append_column("chunk_id", pa.array(held[1][at])).append_column("dense_score", pa.array(scores[of, at]))
                yield from out.combine_chunks().to_batches()

    found = pairs.mapInArrow(run, names.add("chunk_id", "long").add("dense_score", "double"))
    order = Window.partitionBy(*keys).orderBy(F.desc("dense_score"), "chunk_id")
    return found.withColumn("dense_rank", F.row_number().over(order)).filter(F.col("dense_rank") <= k)


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """The rows of each partition in blocks of at most ``size``, each as one Arrow stream in a cell."""
    ship(rows.sparkSession)

    def run(batches):
        import pyarrow as pa

        def cell(table):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[name])

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= size:
                table = pa.Table.from_batches(held)
                yield cell(table.slice(0, size))
                held, n = table.slice(size).to_batches(), n - size
        if n:
            yield cell(pa.Table.from_batches(held))

    return rows.mapInArrow(run, f"{name} binary")


def bm25_tf(pool: DataFrame, query: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Term-frequency BM25 without document frequencies, average length over the pool.

    pool(*keys, chunk_id, text, ...), query(*keys, query). Query tokens that occur twice count twice. With
    ``keys`` there is one pool per key. Gives the pool without its text, and ``keyword_score``; the rows are
    scored where they are counted, so the scan behind a pool runs once.
    """
    asked = query.select(*keys, F.explode(T.tokens(F.col("query"))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("qf"))
    kept = [c for c in pool.columns if c not in (*keys, "chunk_id", "text")]
    sized = pool.select(*keys, "chunk_id", F.struct(F.lit(0).alias("_"), *kept).alias("row"), T.tokens(F.col("text")).alias("tokens")).withColumn("len", F.size("tokens"))
    sized = sized.withColumn("avg_len", F.avg("len").over(Window.partitionBy(*keys)))
    tf = sized.select(*keys, "chunk_id", "row", "len", "avg_len", F.explode_outer("tokens").alias("token")).groupBy(*keys, "chunk_id", "token").agg(F.count("token").alias("tf"), *(F.first(c).alias(c) for c in ("row", "len", "avg_len")))
    hits = tf.join(asked, [*keys, "token"], "left")
    part = F.col("qf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = hits.groupBy(*keys, "chunk_id").agg(F.first("row").alias("row"), F.round(F.coalesce(F.sum(part), F.lit(0.0)), 9).alias("keyword_score"))
    return scored.select(*keys, "chunk_id", *(F.col(f"row.{c}").alias(c) for c in kept), "keyword_score")


def rrf(ranked: DataFrame, keys: tuple[str, ...] = (), k: int = RRF_K, carry: tuple[str, ...] = ()) -> DataFrame:
    """ranked(*keys, chunk_id, list_no, rank) -> fused score and rank; ties in first-seen order.

    ``carry`` names columns of a chunk that come along.
    """
    seen = F.min(F.struct("list_no", "rank"))
    fused = ranked.groupBy(*keys, "chunk_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"), seen.alias("seen"), *(F.first(c).alias(c) for c in carry))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "seen")
    return fused.withColumn("rank", F.row_number().over(order)).drop("seen")


def hybrid(pool: DataFrame, query: DataFrame, top_n: int, keys: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """Fuses the dense order of a (small) pool with its lexical order; pool has ``dense_rank``."""
    scored = bm25_tf(pool.select(*keys, "chunk_id", "text", "dense_rank", *carry), query, keys)
    order = Window.partitionBy(*keys).orderBy(F.desc("keyword_score"), "dense_rank")
    lists = scored.withColumn("keyword_rank", F.row_number().over(order))
    both = F.array(F.struct(F.lit(0).alias("list_no"), F.col("dense_rank").alias("rank")), F.struct(F.lit(1).alias("list_no"), F.col("keyword_rank").alias("rank")))
    ranked = lists.select(*keys, "chunk_id", *carry, F.explode(both).alias("x")).select(*keys, "chunk_id", *carry, "x.*")
    return rrf(ranked, keys, carry=carry).filter(F.col("rank") <= top_n)


def retrieve(chunks: DataFrame, vector: DataFrame, query: DataFrame, ids: DataFrame, pool: int = 20, top_k: int = 6) -> DataFrame:
    """The flagship: access -> dense pool -> lexical rank -> fusion -> the first ``top_k``."""
    dense = dense_top_k(chunks, vector, pool, ids=ids)
    return hybrid(dense, query, max(top_k, 10), carry=("document_id",)).filter(F.col("rank") <= top_k)


def true_bm25(chunks: DataFrame, query: DataFrame) -> DataFrame:
    """BM25 over the whole corpus with document frequencies; only query tokens are shuffled.

    Their counts feed both the frequencies and the scores, so they are stored once in the shared folder;
    lengths of all chunks come from the same pass (a chunk without query tokens has a row without one).
    """
    asked = query.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("token"))
    wanted = asked.select("token").distinct().withColumn("asked", F.lit(True))
    sized = chunks.select("chunk_id", T.tokens(F.col("text")).alias("tokens")).select("chunk_id", F.size("tokens").alias("len"), F.explode_outer("tokens").alias("token"))
    tf = sized.join(wanted, "token", "left").withColumn("token", F.when(F.col("asked"), F.col("token")))
    tf = save(tf.groupBy("chunk_id", "len", "token").agg(F.count("*").alias("tf")), "bm25")
    total = tf.select("chunk_id", "len").distinct().agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    tf = tf.filter("token is not null")
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(total)).withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    hits = tf.join(idf, "token").join(asked, "token")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))


def verify_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answers(answer_id, answer), evidence(answer_id, document_id, filename, page_number) -> verdicts.

    A citation holds if some evidence has its page and one name contains the other. Answers without
    citations, or without evidence, count as verified.
    """
    cited = answers.select("answer_id", F.posexplode(T.citations(F.col("answer"))).alias("no", "c")).select("answer_id", "no", F.lower("c.document").alias("doc"), F.col("c.page").alias("page"))
    name = F.coalesce(F.nullif(F.lower("filename"), F.lit("")), F.lower("document_id"))
    targets = evidence.select("answer_id", F.explode(F.array(name, F.lower("document_id"))).alias("target"), F.col("page_number").alias("page")).filter("target is not null").distinct()
    has = evidence.select("answer_id").distinct().withColumn("has", F.lit(True))
    joined = cited.join(targets, ["answer_id", "page"], "left")
    match = F.coalesce(F.col("target").contains(F.col("doc")) | F.col("doc").contains(F.col("target")), F.lit(False))
    checked = joined.groupBy("answer_id", "no").agg(F.max(match).alias("valid")).join(has, "answer_id")
    per = checked.groupBy("answer_id").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"))
    n, ok = F.coalesce("n", F.lit(0)), F.coalesce("n_valid", F.lit(0))
    return answers.select("answer_id").join(per, "answer_id", "left").select(
        "answer_id", n.alias("n_citations"), ok.alias("n_valid"),
        F.when(n == 0, 1.0).otherwise(F.round(ok / F.greatest(n, F.lit(1)), 2)).alias("coverage"),
        (n == ok).alias("is_verified"), ((n > 0) & (ok == 0)).alias("recommend_retry"),
    )


def first_per_page(evidence: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One citation per document and page: its best-ranked chunk."""
    order = Window.partitionBy(*keys, "document_id", "page_number").orderBy("rank", "chunk_id")
    return evidence.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def evidence_context(evidence: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The numbered source blocks of an answer, joined in rank order."""
    head = F.concat(
        F.lit("[Source "), F.col("rank"), F.lit(" | Doc: "), F.coalesce(F.nullif(F.col("filename"), F.lit("")), F.col("document_id")),
        F.lit(" | Page: "), F.col("page_number"), F.lit(" | Section: "), F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("General")), F.lit("]\n"), T.strip(F.col("text")),
    )
    blocks = F.array_sort(F.collect_list(F.struct("rank", head.alias("block"))))
    return evidence.groupBy(*keys).agg(F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n---\n\n").alias("context"))


#: Query tokens that are looked for in a figure's text at a time.
TOKEN_BLOCK = 512


def _manifest_pairs(manifest: DataFrame, asked: DataFrame, seen: DataFrame) -> DataFrame:
    """Figures with the queries that they share a page or a token with, and the number of such tokens.

    Only these can have a score, beside the pairs that are ``seen`` as evidence. Distinct tokens of all queries are looked for in blocks, one pass over a
    figure's text for each block, and the hits meet the queries by token; pairs by page meet by page.
    """
    word = asked.select(F.explode("tokens").alias("token")).distinct()
    blocks = word.groupBy(F.pmod(F.xxhash64("token"), F.ceil(F.lit(word.count() / TOKEN_BLOCK) + 1).cast("int"))).agg(F.collect_list("token").alias("block")).select("block")
    rows = manifest.withColumn("_row", F.struct("figure_id", "document_id", "page_number"))
    hits = rows.crossJoin(blocks).select("_row", F.explode(F.filter("block", lambda t: F.col("full_text").contains(t))).alias("token"))
    queries = asked.select("query_id", "visual", "target", F.explode("tokens").alias("token"))
    shared = hits.join(queries, "token").select("_row", "query_id", "visual", "target", F.lit(1).alias("n"))
    paged = rows.join(asked, rows["page_number"] == asked["target"]).select("_row", "query_id", "visual", "target", F.lit(0).alias("n"))
    shown = rows.join(seen, ["figure_id", "document_id"]).join(asked, "query_id").select("_row", "query_id", "visual", "target", F.lit(0).alias("n"))
    met = shared.unionByName(paged).unionByName(shown).groupBy("_row", "query_id", "visual", "target").agg(F.sum("n").alias("n_tokens"))
    return met.select("query_id", "visual", "target", "n_tokens", "_row.*")


def figures(manifest: DataFrame, evidence: DataFrame, query: DataFrame, top_k: int = 3) -> DataFrame:
    """Figures for each query(query_id, query).

    manifest(document_id, filename, figure_id, page_number, caption, nearby_labels), already limited to
    the authorised documents; evidence(query_id, idx, figure_id, document_id, page_number, score) holds
    the retrieved figure chunks. Evidence and manifest scores of a figure add up; a query that is not
    visual and names no page only gets figures if a figure chunk scores above 0.85.
    """
    asked = query.select("query_id", T.is_visual(F.col("query")).alias("visual"), T.page_reference(F.col("query")).alias("target"), T.figure_tokens(F.col("query")).alias("tokens"))
    strong = evidence.filter("score > 0.85").select("query_id").distinct().withColumn("strong", F.lit(True))
    asked = asked.join(strong, "query_id", "left").filter("visual or target is not null or strong").drop("strong")
    bonus = F.when(F.col("page_number") == F.col("target"), 100.0).otherwise(0.0)
    seen = evidence.join(asked, "query_id").select("query_id", "figure_id", "document_id", F.col("page_number").alias("seen_page"), F.col("visual").alias("seen_visual"), (50.0 - 3.0 * F.col("idx") + 20.0 * F.col("score") + bonus).alias("evidence_score"), "idx")
    text = F.lower(F.concat_ws(" ", F.coalesce("caption", F.lit("")), F.array_join(F.coalesce("nearby_labels", F.array().cast("array<string>")), " "), "filename"))
    page = F.when(F.col("target").isNull(), 0.0).when(F.col("page_number") == F.col("target"), 120.0).otherwise(-50.0)
    known = _manifest_pairs(manifest.withColumn("full_text", text), asked, evidence.select("query_id", "figure_id", "document_id").distinct())
    known = known.select("query_id", "figure_id", "document_id", "page_number", "visual", (page + 15.0 * F.col("n_tokens")).alias("manifest_score"))
    both = seen.join(known, ["query_id", "figure_id", "document_id"], "full").select(
        "query_id", "figure_id", "document_id", F.coalesce("seen_page", "page_number").alias("page_number"),
        F.coalesce("seen_visual", "visual").alias("visual"), "idx",
        (F.coalesce("evidence_score", F.lit(0.0)) + F.coalesce("manifest_score", F.lit(0.0))).alias("score"),
    ).filter("idx is not null or score > 0")
    clean = F.element_at(F.split("figure_id", F.concat("document_id", F.lit("_"))), -1)
    same = Window.partitionBy("query_id", "document_id", clean).orderBy(F.desc("score"), F.coalesce("idx", F.lit(1 << 30)), "figure_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce("idx", F.lit(1 << 30)), "document_id", "figure_id")
    ranked = both.withColumn("nth", F.row_number().over(same)).filter("nth = 1").withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("rank") <= top_k) & ~((F.col("score") <= 0) & F.col("visual") & (F.col("rank") > 1))).select("query_id", "rank", "figure_id", "document_id", "page_number", F.round("score", 6).alias("score"))


def table_lookup(records: DataFrame, entity: Column | str, attribute: Column | str, section: str | None = None) -> DataFrame:
    """Rows of an entity and attribute (ignoring case), and whether the values contradict each other."""
    got = records.filter((F.lower("entity") == F.lower(F.lit(entity))) & (F.lower("attribute") == F.lower(F.lit(attribute))))
    return got.filter(F.lower("section") == section.lower()) if section else got


def contradictions(records: DataFrame) -> DataFrame:
    return records.groupBy("entity", "attribute").agg(F.countDistinct("value").alias("n_values")).filter("n_values > 1")
