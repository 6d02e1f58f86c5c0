"""The engine's own functions over a folder of tables.

Tables are Parquet folders below ``root``: documents, permissions, document_versions, page_profiles,
table_records, chunks (with embeddings), figures, conversations, messages, processing_statuses. Reads are
lazy DataFrames; a change writes a new version of the tables that it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.operators import documents as D
from folioframe.operators import qa
from folioframe.operators import relational as R
from folioframe.operators import retrieval as V
from folioframe.streaming.limits import latest_status

CHILDREN = ("permissions", "document_versions", "page_profiles", "table_records", "chunks", "figures", "processing_statuses")


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder: Callable[[], qa.Embedder] = qa.HashingEmbedder) -> None:
        self.spark, self.root, self.embedder = spark, root, embedder

    # --- tables ---------------------------------------------------------------------------------------

    def _versions(self, name: str) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n.startswith("v=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def table(self, name: str) -> DataFrame:
        """The latest complete version of a table."""
        return self.spark.read.parquet(f"{self.root}/{name}/v={self._versions(name)[-1]}")

    def has(self, name: str) -> bool:
        return bool(self._versions(name))

    def put(self, name: str, df: DataFrame) -> None:
        """Write the next version; readers of the one before are not disturbed."""
        version = (self._versions(name) or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={version}")

    # --- documents ------------------------------------------------------------------------------------

    def ingest(self, words: DataFrame, width: float, height: float) -> None:
        """Words of documents through the document pipeline; records, chunks and their vectors are merged in."""
        out = D.process(words, width, height)
        chunks = qa.embed_texts(out["chunks"].withColumn("document_id", F.col("document_id").cast("string")), "text", self.embedder)
        fresh = {"chunks": (chunks, "chunk_id"), "table_records": (out["records"].withColumn("document_id", F.col("document_id").cast("string")).withColumn("row_no", F.col("row_no").cast("long")), None)}
        ids = words.select(F.col("document_id").cast("string").alias("document_id")).distinct()
        for name, (df, _) in fresh.items():
            old = self.table(name).join(ids, "document_id", "left_anti") if self.has(name) else None
            self.put(name, df if old is None else old.unionByName(df))
        D.release(out)

    def authorised(self, user: int | str, admin: bool = False, requested: list | None = None) -> DataFrame:
        docs = self.table("documents")
        wanted = None if requested is None else docs.filter(F.col("document_id").isin(*requested)) if requested else docs.limit(0)
        return V.authorised(docs, self.table("permissions"), F.lit(user), admin, wanted)

    def list_documents(self, user: int | str) -> DataFrame:
        return R.list_documents(self.table("documents"), self.table("permissions"), F.lit(user))

    def _allowed(self, user: int | str, document: int | str, admin: bool, write: bool) -> bool:
        docs = self.table("documents").filter(F.col("document_id") == document)
        req = docs.select(F.lit(user).alias("user_id"), F.lit(admin).alias("is_admin"), "document_id", F.lit(write).alias("write"))
        rows = R.access_check(req, docs, self.table("permissions")).select("allowed").take(1)
        return bool(rows and rows[0][0])

    def document_detail(self, user: int | str, document: int | str, admin: bool = False) -> DataFrame:
        """The document with its latest version; no row without access."""
        docs = self.table("documents").filter(F.col("document_id") == document)
        if not self._allowed(user, document, admin, False):
            return docs.limit(0)
        return docs.join(R.latest_version(self.table("document_versions")), "document_id", "left")

    def status(self, document: int | str) -> DataFrame:
        return latest_status(self.table("processing_statuses").filter(F.col("document_id") == document))

    def delete_document(self, user: int | str, document: int | str, admin: bool = False) -> bool:
        """Removes the document and its rows in every child table; False without write access."""
        if not self._allowed(user, document, admin, True):
            return False
        gone = self.table("documents").filter(F.col("document_id") == document).select("document_id")
        children = {n: self.table(n) for n in CHILDREN if self.has(n)}
        for name, left in R.cascade_delete(gone, "document_id", **children).items():
            self.put(name, left)
        self.put("documents", self.table("documents").join(gone, "document_id", "left_anti"))
        return True

    def figure_bytes(self, user: int | str, document: int | str, figure: str, blobs: DataFrame, admin: bool = False) -> bytes | None:
        if not self._allowed(user, document, admin, False):
            return None
        figs = self.table("figures").filter(F.col("document_id") == document)
        key = R.figure_key(figs, F.lit(figure), F.col("document_id")).select("blob_key").take(1)
        got = blobs.filter(F.col("path").endswith("/" + key[0][0])).select("content").take(1) if key else []
        return bytes(got[0][0]) if got else None

    # --- questions ------------------------------------------------------------------------------------

    def ask(self, query: str, user: int | str, document_ids: list | None = None, agent: bool = False, admin: bool = False, top_k: int = 6) -> qa.Reply:
        """A grounded answer over the documents that the user may read; one collect of a few rows."""
        ids = self.authorised(user, admin, document_ids)
        chunks = self.table("chunks").join(ids.select(F.col("document_id").cast("string").alias("document_id")), "document_id", "left_semi")
        question = self.spark.createDataFrame([(0, query)], "question_id int, query string")
        model = self.embedder()
        asked = qa.plan_queries(question) if agent else question.select("question_id", F.lit("direct").alias("plan"), F.lit(0).alias("sq"), "query")
        subs = [(r["question_id"], r["sq"], r["query"]) for r in asked.collect()]
        vectors = model.embed([s[2] for s in subs])
        sub = self.spark.createDataFrame([(*s, [float(x) for x in v]) for s, v in zip(subs, vectors)], "question_id int, sq int, query string, query_vector array<double>")
        numbered = chunks.withColumn("name", F.col("chunk_id")).withColumn("chunk_id", F.xxhash64("chunk_id"))
        found = qa.retrieve_evidence(sub, numbered, pool=10 if agent else 20, fused=6 if agent else max(top_k, 10), top_n=8 if agent else top_k)
        rows = found.join(numbered.select("chunk_id", "name", "section_path"), "chunk_id").orderBy("position").collect()
        evidence = [{"chunk_id": r["name"], "document_id": r["document_id"], "filename": None, "page_number": r["page_number"], "section": " > ".join(r["section_path"] or []), "text": r["text"]} for r in rows]
        return qa.generate(query, evidence)

    # --- conversations --------------------------------------------------------------------------------

    def list_conversations(self, user: int | str) -> DataFrame:
        mine = self.table("conversations").filter(F.col("user_id") == user)
        return R.conversation_summaries(mine, self.table("messages")).orderBy(F.desc("updated_at"), "conversation_id")

    def conversation(self, user: int | str, conversation: int | str) -> DataFrame:
        mine = self.table("conversations").filter((F.col("user_id") == user) & (F.col("conversation_id") == conversation))
        return self.table("messages").join(mine.select("conversation_id"), "conversation_id", "left_semi").orderBy("created_at", "message_id")

    def delete_conversation(self, user: int | str, conversation: int | str) -> bool:
        mine = self.table("conversations").filter((F.col("user_id") == user) & (F.col("conversation_id") == conversation)).select("conversation_id")
        if mine.isEmpty():
            return False
        left = R.cascade_delete(mine, "conversation_id", conversations=self.table("conversations"), messages=self.table("messages"))
        for name, df in left.items():
            self.put(name, df)
        return True


#: Planned resident megabytes of the process, and of its local models (fixed values); models run one at a time.
BASE_MB = 450
STAGE_MB = {"layout": 1800, "ocr": 350, "image_embed": 1700, "text_embed": 2400, "rerank": 2400}
ALWAYS_LOCAL = ("layout", "ocr")


def is_placeholder(value: str | None) -> bool:
    return not value or value.startswith(("your-", "change-me"))


def settings_report(values: dict[str, str], needs: dict[str, tuple[str, ...]], secrets: tuple[str, ...] = (), chain: list[str] | None = None) -> list[tuple[str, str]]:
    """(level, message) findings: OK, WARN or FAIL.

    A provider is OK when all its settings are there, FAIL when a place or model lacks, WARN when only a key
    (a setting that ends in ``KEY``) lacks or is a placeholder. A secret shorter than 32 characters is a
    warning, and so is an endpoint of the ``chain`` without a key; an empty chain is a failure.
    """
    out = [("WARN", f"{n}: placeholder or shorter than 32 characters") for n in secrets if is_placeholder(values.get(n)) or len(values[n]) < 32]
    if chain is not None and not chain:
        out.append(("FAIL", "no model endpoints"))
    for n in chain or ():
        needs = needs | {f"LLM {n}": tuple(f"LLM_{n}_{part}" for part in ("BASE_URL", "MODEL", "API_KEY"))}
    for provider, names in needs.items():
        lacking = [n for n in names if not values.get(n) or n.endswith("KEY") and is_placeholder(values[n])]
        soft = all(n.endswith("KEY") for n in lacking)
        level = "OK" if not lacking else "WARN" if soft and len(names) > 1 else "FAIL"
        out.append((level, f"{provider}: {', '.join(lacking)}" if lacking else provider))
    return out


def memory_report(available_mb: int, headroom_mb: int = 0, local: tuple[str, ...] = ()) -> tuple[str, int]:
    """(level, estimated peak): the process and the largest of the models that run locally."""
    peak = BASE_MB + max(STAGE_MB[s] for s in (*ALWAYS_LOCAL, *local))
    return ("OK" if peak <= available_mb - headroom_mb else "WARN"), peak


def exit_code(findings: list[tuple[str, str]]) -> int:
    return int(any(level == "FAIL" for level, _ in findings))
