"""Sources and sinks as round trips: rows are written to the shared folder in the source's own format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioframe.plans.registry import query, table
from folioframe.sources import readers, sinks
from folioframe.storage import keep_until_exit, shared_root
from folioframe.streaming import ingest


def scratch(spark, name: str) -> str:
    path = f"{shared_root(spark)}/folioframe-{name}-{uuid.uuid4().hex}"
    keep_until_exit(spark, path)
    return path


def one_file_each(df, spark, name: str) -> str:
    """Rows (item_id, value) as files of their own."""
    path = scratch(spark, name)
    df.select("item_id", "value").write.partitionBy("item_id").text(path)
    return path


@query(
    "src04_word_boxes",
    """WITH w AS (SELECT item_id, generate_subscripts(p, 1) - 1 AS i, unnest(p) AS text FROM (SELECT item_id, string_split(text, ' ') AS p FROM benchmark))
SELECT CAST(600 + item_id AS DOUBLE) AS page_width, CAST(i AS BIGINT) AS word_no, CAST(CASE WHEN i % 5 = 0 THEN 1 ELSE 1 + i // 40 END AS INTEGER) AS page_number, text, CAST(10 * i AS DOUBLE) AS l, CAST(10 * i + 8 AS DOUBLE) AS r,
  CASE WHEN i % 4 = 0 THEN 'BOTTOMLEFT' ELSE 'TOPRIGHT' END AS coord_origin, CAST(CASE WHEN i % 3 = 0 THEN 10.0 ELSE 7.5 END AS DOUBLE) AS font_size, CAST(CASE WHEN i % 6 = 0 THEN 1.0 ELSE 0.25 END AS DOUBLE) AS confidence FROM w""",
)
def word_boxes(spark, sf_dir):
    """Each benchmark passage as a JSON page whose words lack a page, origin, size or confidence by turns."""
    num = lambda x: x.cast("double")
    word = lambda t, i: F.struct(
        t.alias("text"), num(10 * i).alias("l"), F.lit(1.0).alias("t"), num(10 * i + 8).alias("r"), F.lit(9.0).alias("b"), F.when(i % 5 != 0, 1 + F.floor(i / 40)).alias("page"),
        F.when(i % 4 == 0, "BOTTOMLEFT").alias("coord_origin"), F.when(i % 3 != 0, 7.5).alias("font_size"), F.when(i % 6 != 0, 0.25).alias("confidence"),
    )
    page = F.struct((600.0 + F.col("item_id")).alias("page_width"), F.lit(792.0).alias("page_height"), F.lit("TOPRIGHT").alias("coord_origin"), F.transform(F.split("text", " "), word).alias("words"))
    path = one_file_each(table(spark, sf_dir, "benchmark").select("item_id", F.to_json(page).alias("value")), spark, "word-boxes")
    return readers.word_boxes(spark, path).select("page_width", "word_no", "page_number", "text", "l", "r", "coord_origin", "font_size", "confidence")


@query(
    "src03_tree_nodes",
    """WITH w AS (SELECT item_id, generate_subscripts(p, 1) - 1 AS i, unnest(p) AS text FROM (SELECT item_id, string_split(text, ' ') AS p FROM benchmark))
SELECT CAST(700 + item_id AS DOUBLE) AS page_height, CAST(i AS BIGINT) AS word_no, CAST(CASE WHEN i % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS page_number, text, CAST(CASE WHEN i % 3 = 0 THEN 0 ELSE 5 * i END AS DOUBLE) AS l,
  CAST(CASE WHEN i % 3 = 0 THEN 100 ELSE 5 * i + 4 END AS DOUBLE) AS r, CASE WHEN i % 3 = 0 THEN 'BOTTOMLEFT' ELSE 'TOPLEFT' END AS coord_origin FROM w WHERE text <> '' AND i % 7 <> 0""",
)
def tree_nodes(spark, sf_dir):
    """Each passage as a text tree: every third node without a place, every seventh blank."""
    num = lambda x: x.cast("double")

    def node(t, i):
        box = F.struct(num(5 * i).alias("l"), F.lit(1.0).alias("t"), num(5 * i + 4).alias("r"), F.lit(2.0).alias("b"), F.lit("TOPLEFT").alias("coord_origin"))
        place = F.array(F.struct(F.lit(2).alias("page_no"), box.alias("bbox")), F.struct(F.lit(9).alias("page_no"), box.alias("bbox")))
        return F.struct(F.lit("text").alias("label"), F.when(i % 7 == 0, " \n").otherwise(F.concat(F.lit(" "), t)).alias("text"), F.when(i % 3 != 0, place).alias("prov"))

    tree = F.struct(F.lit(600.0).alias("page_width"), (700.0 + F.col("item_id")).alias("page_height"), F.transform(F.split("text", " "), node).alias("texts"))
    path = one_file_each(table(spark, sf_dir, "benchmark").select("item_id", F.to_json(tree).alias("value")), spark, "trees")
    return readers.tree_nodes(spark, path).select("page_height", "word_no", "page_number", "text", "l", "r", "coord_origin")


KINDS = ", ".join(f"'{x}'" for x in readers.GOLDEN_TYPES)


@query(
    "src05_golden_questions",
    f"SELECT 'G' || (item_id + 10) AS id, text AS question, [CAST(item_id AS INTEGER), 2] AS expected_pages, [{KINDS}][1 + item_id % {len(readers.GOLDEN_TYPES)}] AS type FROM benchmark",
)
def golden_questions(spark, sf_dir):
    """The passages as question lines, between comments and blank lines."""
    kinds = F.array(*map(F.lit, readers.GOLDEN_TYPES))
    kind = F.element_at(kinds, (1 + F.col("item_id") % len(readers.GOLDEN_TYPES)).cast("int"))
    line = F.to_json(F.struct(F.concat(F.lit("G"), F.col("item_id") + 10).alias("id"), F.col("text").alias("question"), F.array("item_id", F.lit(2)).alias("expected_pages"), kind.alias("type")))
    lines = table(spark, sf_dir, "benchmark").select(F.explode(F.array(F.lit("// a comment"), line, F.lit("  "))).alias("value"))
    path = scratch(spark, "golden")
    lines.write.text(path)
    return readers.golden_questions(spark, path).select("id", "question", "expected_pages", "type")


@query(
    "src06_blob_round_trip",
    "SELECT item_id || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS length, sha256(text) AS hash FROM benchmark WHERE item_id <> (SELECT min(item_id) FROM benchmark)",
)
def blob_round_trip(spark, sf_dir):
    """Passages put as objects, the first one deleted, the others listed and read (SRC6, SNK5)."""
    items = table(spark, sf_dir, "benchmark")
    path = scratch(spark, "blobs")
    sinks.write_blobs(items.select(F.concat("item_id", F.lit(".txt")).alias("blob_key"), F.col("text").cast("binary").alias("content")), path.removeprefix("file://"))
    sinks.delete_blobs(spark, path, [f"{items.agg(F.min('item_id')).first()[0]}.txt"])
    found = readers.blobs(spark, path, "*.txt")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("hash"))


@query(
    "snk01_vector_upsert",
    """SELECT vec_id AS chunk_id, label % 3 AS document_id, CASE WHEN vec_id % 2 = 0 THEN label + 100 ELSE label END AS label, CAST(len(embedding) AS INTEGER) AS dimension FROM embeddings WHERE label % 3 <> 1
UNION ALL SELECT vec_id + 1000000000, label % 3, label, CAST(len(embedding) AS INTEGER) FROM embeddings WHERE label % 3 <> 1 AND vec_id % 10 = 0""",
)
def vector_upsert(spark, sf_dir):
    """Two versions of a collection: the second changes the even points and adds some; read by document ids
    (SNK1, SNK10, SRC8)."""
    path = scratch(spark, "collection")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("label") % 3).alias("document_id"), "label", "embedding")
    first = sinks.points(e)
    sinks.ensure_collection(spark, f"{path}/v=0", first.schema)
    sinks.upsert_points(path, first, 0)
    even = e.filter("chunk_id % 2 = 0").withColumn("label", F.col("label") + 100)
    more = e.filter("chunk_id % 10 = 0").withColumn("chunk_id", F.col("chunk_id") + 1_000_000_000)
    now = sinks.upsert_points(path, sinks.points(even.unionByName(more)), 1)
    ids = e.select("document_id").distinct().filter("document_id <> 1")
    return readers.vectors(spark, now, ids).select("chunk_id", "document_id", "label", F.size("embedding").alias("dimension"))


@query("str01_ingest_worker", "SELECT CAST(item_id AS VARCHAR) AS document_id, 5 AS n_stages, 'ready' AS status FROM benchmark")
def ingest_worker(spark, sf_dir):
    """Every passage is a queued job; the worker runs all stages over them as a stream (SRC9, STR1)."""
    path = scratch(spark, "worker")
    jobs = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("document_id"), F.lit("v1").alias("version_id"), F.lit("{}").alias("meta"), F.current_timestamp().alias("queued_at"))
    jobs.write.json(f"{path}/jobs")
    stages = {name: lambda batch, name=name: batch.select("document_id").write.mode("append").parquet(f"{path}/{name}") for name in ingest.STAGES}
    ingest.worker(ingest.job_source(spark, f"{path}/jobs"), stages, f"{path}/status", f"{path}/checkpoint").awaitTermination()
    return ingest.document_status(spark.read.parquet(f"{path}/status")).select("document_id", F.col("n_stages").cast("int").alias("n_stages"), "status")
