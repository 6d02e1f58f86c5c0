"""Line dedup over levelled sorted runs of line hashes.

Every batch of documents adds one run of (line key, number of documents, document that keeps the line),
bucketed and sorted by key. A new batch merge-anti-joins the runs to find the keys that none of them holds:
of these the batch's largest ``doc_id`` is the keeper; of all others it adds counts alone. When a level
holds two runs they are merged, in order of their keys, into one run of the next level, so a key is
rewritten a logarithmic number of times; merging and joining shuffle and sort nothing. A line's key is the
line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased, held as a 128-bit hash; keys of fewer than
``MIN_CHARS`` code points are never looked at.

The corpus query takes batches from the largest ``doc_id`` downward, so a line's keeper is the largest
document that holds it; whether a line is too frequent is known when all batches are in. ``admit`` is the
incremental form, where a batch loses at once what earlier batches have shown.

Corner cases: a null or empty text is one empty line and stays as it is; rows repeated with one
``doc_id`` count as one document and are treated alike; rows with a null ``doc_id`` neither count nor
lose lines; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.runtime import drop, extend_batches, join_heavy, map_batches, save, save_sorted, workspace
from folioframe.llm.textstats import SPACE

MIN_CHARS = 40
MIN_DOCS = 5
#: Documents of a batch of a table this large; the number of batches grows with the root of the table.
BATCH_DOCS = 50_000


def line_key(line: str) -> bytes | None:
    bare = line.strip(SPACE)
    if len(bare) < MIN_CHARS:
        return None
    return hashlib.blake2b(bare.encode().lower(), digest_size=16).digest()


def line_table(docs: DataFrame) -> DataFrame:
    """``key, doc_id``: the distinct keys of every row."""

    def make():
        def work(x):
            out = {"key": [], "doc_id": []}
            for doc, text in zip(x["doc_id"], x["text"]):
                keys = set(map(line_key, text.split("\n"))) - {None} if text else ()
                out["key"] += sorted(keys)
                out["doc_id"] += [doc] * len(keys)
            return out

        return work

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return map_batches(narrow, make, "key binary, doc_id long")


class LineRuns:
    """Levels of sorted runs ``key, n_docs, last_doc``; a run is a table in the shared folder.

    ``last_doc`` is the largest document of the batch that brought the key first, and null in the runs of
    later batches.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.levels: list[DataFrame | None] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [run for run in self.levels if run is not None]

    @staticmethod
    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one: a merge join of both, in the order of their keys."""
        a, b = a.toDF("key", "n_a", "last_a"), b.toDF("key", "n_b", "last_b")
        n = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))
        return a.join(b, "key", "full").select("key", n.alias("n_docs"), F.coalesce("last_a", "last_b").alias("last_doc"))

    def _put(self, run: DataFrame) -> None:
        level = 0
        while level < len(self.levels) and (old := self.levels[level]) is not None:
            whole = save_sorted(self.merged(old, run), f"run{level + 1}", "key")
            drop(old, run)
            self.levels[level], run, level = None, whole, level + 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = run

    def unseen(self, keyed: DataFrame) -> DataFrame:
        """The rows of a batch whose key no run holds: one merge anti-join for each run."""
        for run in self.runs:
            keyed = keyed.join(run.select("key"), "key", "left_anti")
        return keyed

    def add(self, lines: DataFrame) -> None:
        """Add a batch of distinct ``key, doc_id``; a hot key is combined before the shuffle."""
        own = save_sorted(lines.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")), "batch", "key")
        if not self.runs:
            return self._put(own)
        fresh = save_sorted(self.unseen(own.select("key", "last_doc")), "fresh", "key")
        run = save_sorted(own.select("key", "n_docs").join(fresh, "key", "left").select("key", "n_docs", "last_doc"), "run0", "key")
        drop(own, fresh)
        self._put(run)

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """``key, n_docs, last_doc`` of the keys in ``min_docs`` documents or more; all runs become one."""
        if not self.runs:
            return self.spark.createDataFrame([], "key binary, n_docs long, last_doc long")
        runs, top = self.runs, len(self.levels) - 1
        whole = runs[0]
        for run in runs[1:]:
            whole, old = save_sorted(self.merged(run, whole), "whole", "key"), (run, whole)
            drop(*old)
        self.levels = [None] * top + [whole]
        return whole.filter(F.col("n_docs") >= min_docs)

    def clear(self) -> None:
        drop(*self.runs)
        self.levels = []


def without_lines(docs: DataFrame, gone: DataFrame, digest: bool = False) -> DataFrame:
    """Rows of ``docs`` as ``row``, with ``n_lines, n_dropped`` and the kept text (or its SHA-256).

    ``gone(doc_id, key)`` says which keys a document loses. Only keys travel to the documents; a
    document's keys meet in one row, which is no larger than its text.
    """
    per = gone.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list("key").alias("_gone"))
    packed = docs.select(F.struct("*").alias("doc"), "text", F.col("doc_id").cast("long").alias("_id"))
    spread = F.coalesce("_id", F.xxhash64("text"))  # rows without an id match nothing, and must not meet in one task
    packed = packed.join(per, (spread == F.col("_doc")) & F.col("_id").isNotNull(), "left").select("doc", "text", "_gone")

    def make():
        def work(texts, gone):
            out = {"n_lines": [], "n_dropped": [], "kept": []}
            for text, keys in zip(texts, gone):
                lines = (text or "").split("\n")
                if keys:
                    keys = set(keys)
                    left = [x for x in lines if (k := line_key(x)) is None or k not in keys]
                    kept = "\n".join(left)
                else:
                    left, kept = lines, text
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(lines) - len(left))
                out["kept"].append(hashlib.sha256((kept or "").encode()).hexdigest() if digest else kept)
            return out

        return work

    return extend_batches(packed, ["text", "_gone"], make, "n_lines long, n_dropped long, kept string").select("row.doc", "n_lines", "n_dropped", "kept")


def _batch(docs: DataFrame, batches: int) -> Column:
    """0 for the largest ids, and so on; a document is in one batch whatever the number of its rows."""
    if batches == 1:
        return F.lit(0)
    cuts = docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)
    return F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(map(int, cuts))))), lambda c: F.col("doc_id") < c)) if cuts else F.lit(0)


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """``doc_id, key`` of the lines to drop: all in ``min_docs`` documents or more, but in the last one."""
    spark = docs.sparkSession
    batches = batches or max(1, math.ceil(math.sqrt(docs.count() / BATCH_DOCS)))
    parts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // batches))
    lines = line_table(docs).withColumn("batch", _batch(docs, batches)).withColumn("part", F.pmod(F.xxhash64("key", "doc_id"), F.lit(parts)))
    lines = lines.repartition(batches * parts, "batch", "part").dropDuplicates(["batch", "part", "key", "doc_id"])
    with workspace() as keep:
        lines, store = save(lines.select("key", "doc_id", "batch"), "lines", "batch"), LineRuns(spark)
        for b in range(batches):
            store.add(lines.filter(F.col("batch") == b).select("key", "doc_id"))
        heavy = save(store.frequent(min_docs), "frequent")
        keep(lines, heavy)
    met = join_heavy(lines, heavy, "key", "n_docs", lines.count())
    return met.filter("doc_id <> last_doc").select("doc_id", "key")


def dedupe_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text`` (and ``n_chars`` counted again)."""
    got = without_lines(docs, repeated_lines(docs))
    fresh = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return got.select(*(fresh.get(n, F.col(f"doc.`{n}`")).alias(n) for n in docs.columns))


def admit(docs: DataFrame, store: LineRuns) -> DataFrame:
    """Incremental form: the batch without the lines that earlier batches hold; its own lines are added."""
    lines = save(line_table(docs).distinct(), "lines")
    fresh = save(store.unseen(lines.select("key").distinct()), "fresh")
    gone = save(lines.join(fresh, "key", "left_anti").select("doc_id", "key"), "seen")
    store.add(lines)
    drop(lines, fresh)
    got = without_lines(docs, gone)
    return got.select(*((F.col("kept") if n == "text" else F.col(f"doc.`{n}`")).alias(n) for n in docs.columns))
