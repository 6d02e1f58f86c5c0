"""Sources: word boxes, text trees, question lists, blobs, vectors, job queues, settings, PDF plug-ins."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.shipping import ship

WORD_PAGE = "page_width double, page_height double, unit string, coord_origin string, words array<struct<text:string,l:double,t:double,r:double,b:double,page:int,coord_origin:string,font_size:double,confidence:double>>"
TREE = (
    "page_width double, page_height double, texts array<struct<label:string,text:string,prov:array<struct<page_no:int,"
    "bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>>>"
)
GOLDEN = "id string, question string, expected_answer string, expected_pages array<int>, type string, notes string, document string"
# The kinds of questions.
GOLDEN_TYPES = ("spec", "text", "image-retrieval", "compare", "layout", "legend", "list", "unanswerable", "trap", "figure", "inconsistency")


def word_boxes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each word of JSON pages; the file name is the document."""
    p = spark.read.schema(WORD_PAGE).option("multiLine", True).json(path).withColumn("document_id", F.col("_metadata.file_name"))
    w = p.select("document_id", "page_width", "page_height", F.col("coord_origin").alias("page_origin"), F.posexplode("words").alias("word_no", "w"))
    return w.select(
        "document_id", F.coalesce("w.page", F.lit(1)).alias("page_number"), F.col("word_no").cast("long").alias("word_no"), "w.text", "w.l", "w.t", "w.r", "w.b",
        F.coalesce("w.coord_origin", "page_origin", F.lit("TOPLEFT")).alias("coord_origin"), F.coalesce("w.font_size", F.lit(10.0)).alias("font_size"),
        F.coalesce("w.confidence", F.lit(1.0)).alias("confidence"), "page_width", "page_height",
    )


def tree_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Word boxes of a text tree: the first place of every node, a default box without one, no blank text."""
    p = spark.read.schema(TREE).option("multiLine", True).json(path).withColumn("document_id", F.col("_metadata.file_name"))
    w = p.select("document_id", "page_width", "page_height", F.posexplode("texts").alias("word_no", "x"))
    prov = F.get("x.prov", 0)
    box = lambda c, default: F.coalesce(prov["bbox"][c], F.lit(default)).alias(c)
    return w.select(
        "document_id", F.coalesce(prov["page_no"], F.lit(1)).alias("page_number"), F.col("word_no").cast("long").alias("word_no"), F.regexp_replace("x.text", r"^\s+|\s+$", "").alias("text"),
        box("l", 0.0), box("t", 0.0), box("r", 100.0), box("b", 20.0), F.coalesce(prov["bbox"]["coord_origin"], F.lit("BOTTOMLEFT")).alias("coord_origin"), "page_height",
    ).filter("text <> ''")


def golden_questions(spark: SparkSession, path: str) -> DataFrame:
    """Validated question lines; a bad id, type or a repeated id raises with file and line."""
    raw = spark.read.text(path).withColumn("file", F.col("_metadata.file_name")).withColumn("line_no", F.monotonically_increasing_id() + 1)
    raw = raw.filter((F.trim("value") != "") & ~F.ltrim("value").startswith("//"))
    q = raw.select("file", "line_no", F.from_json("value", GOLDEN).alias("q")).select("file", "line_no", "q.*")
    from pyspark.sql import Window

    q = q.withColumn("_same", F.count("*").over(Window.partitionBy("id")))
    wrong = F.when(~F.coalesce(F.col("id").rlike(r"^G\d{2,}$"), F.lit(False)), F.lit("bad id")).when(~F.coalesce(F.col("type").isin(*GOLDEN_TYPES), F.lit(False)), F.lit("bad type")).when(F.col("_same") > 1, F.lit("duplicate id"))
    where = F.concat_ws(":", "file", F.col("line_no").cast("string"), wrong)
    return q.withColumn("id", F.when(wrong.isNull(), F.col("id")).otherwise(F.raise_error(where).cast("string"))).drop("_same")


def blobs(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Objects below a prefix: path, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)


def vectors(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    points = spark.read.parquet(path)
    return points if ids is None else points.join(ids, "document_id", "left_semi")


def relational(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 1 << 31, parts: int = 16) -> DataFrame:
    """A table over JDBC, read in ranges of ``key`` if one is given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key:
        r = r.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()


class PageReader(Protocol):
    """A PDF library or OCR engine: bytes of a document -> (page, width, height, words as dicts).

    A reader may also have ``clip(content, page, box) -> words``, which reads one part of a page closer.
    """

    def pages(self, content: bytes) -> Iterator[tuple[int, float, float, list[dict]]]: ...


#: The bottom margin, and the width of the corners in it, as shares of the page (fixed values).
BOTTOM, CORNER = 0.90, 0.15


def with_page_digits(reader: PageReader, content: bytes, page: int, width: float, height: float, words: list[dict]) -> list[dict]:
    """The words of a page, and the numbers that a closer look at its bottom corners (right, then left) finds.

    Only readers with ``clip`` look closer, and only where no number stands alone in the bottom margin.
    """
    number = lambda w: w["text"].strip().isdigit()
    if not hasattr(reader, "clip") or any(w["b"] > BOTTOM * height and number(w) for w in words):
        return words
    corners = [((1 - CORNER) * width, BOTTOM * height, width, height), (0.0, BOTTOM * height, CORNER * width, height)]
    return words + [w | {"text": w["text"].strip()} for box in corners for w in reader.clip(content, page, box) if number(w)]


def read_pages(files: DataFrame, readers: Callable[[], list[PageReader]]) -> DataFrame:
    """Words of documents by the first reader of the chain that yields some; failures move on to the next.

    Documents stream through a task one by one; the readers are made once for each task.
    """
    schema = "document_id string, page_number int, page_width double, page_height double, word_no long, text string, l double, t double, r double, b double, confidence double"
    names = [x.split()[0] for x in schema.split(", ")]
    ship(files.sparkSession)

    def run(batches):
        chain = readers()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for reader in chain:
                    try:
                        for page, width, height, words in reader.pages(content):
                            words = with_page_digits(reader, content, page, width, height, words)
                            rows += [(path, page, width, height, n, w["text"], round(w["l"], 2), round(w["t"], 2), round(w["r"], 2), round(w["b"], 2), w.get("confidence", 1.0)) for n, w in enumerate(words)]
                    except Exception:  # noqa: BLE001  a reader that fails is one without words
                        rows = []
                    if rows:
                        break
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows], schema=pa.schema([("document_id", pa.string()), ("page_number", pa.int32()), ("page_width", pa.float64()), ("page_height", pa.float64()), ("word_no", pa.int64()), ("text", pa.string()), *((c, pa.float64()) for c in ("l", "t", "r", "b", "confidence"))]))

    return files.select(F.col("path").alias("document_id"), "content").mapInArrow(run, schema)


@dataclass(frozen=True)
class Endpoint:
    name: str
    url: str
    model: str
    key: str

    @property
    def configured(self) -> bool:
        return bool(self.url and self.model and self.key)


def settings(path: str | None = None) -> dict[str, str]:
    """Names and values of an env file, overridden by the process environment."""
    out: dict[str, str] = {}
    if path and os.path.exists(path):
        with open(path) as f:
            for line in f:
                name, eq, value = line.strip().partition("=")
                if eq and not name.startswith("#"):
                    out[name.strip()] = value.strip().strip("'\"")
    return out | dict(os.environ)


def endpoint_chain(values: dict[str, str], order: list[str]) -> list[Endpoint]:
    """Ordered model endpoints from ``LLM_<n>_*`` blocks; blocks that lack something are left out."""
    found = [Endpoint(n, *(values.get(f"LLM_{n}_{part}", "") for part in ("BASE_URL", "MODEL", "API_KEY"))) for n in order]
    return [e for e in found if e.configured]


def upload_checks(files: DataFrame, mime: Column | None = None, most: int = 50 << 20) -> DataFrame:
    from folioframe.functions.text import fails_upload

    kind = F.lit(None).cast("string") if mime is None else mime
    return files.select("path", "length", F.sha2("content", 256).alias("file_hash"), fails_upload(F.col("path"), kind, F.col("content"), most).alias("refused"))
