"""Exact top-k inner products over a bit-sliced index.

Rows are quantised to integers and stored in blocks: one bitmap per attribute and binary digit. A query
adds up its weighted slices with bitmap arithmetic (carry-save adders, so every bitmap operation handles
64 rows a word), which gives the score of all rows of a block as slices again. The best rows are then
selected from the most significant slice downward; rows that tie at the boundary are resolved by id.

Corner cases: vectors that are null or hold null or non-finite components take no part; vectors are
compared only with those of their own length (empty ones score 0); repeated rows are candidates of their
own, and each distinct (id, vector) among the queries is a query; a query without candidates has no rows.
Components must stay below 2**40 in magnitude after quantising, so that scores fit 64 bits.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.runtime import prepare, save

#: Rows of an index block (some 4 MB at 64 attributes) and queries of a query block.
BLOCK = 32_768
QUERY_BLOCK = 32
SCALE = 1024


class Block:
    """Bit slices of ``values`` (rows x attributes), rows in the order of their ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.n, self.d = values.shape
        words = -(-self.n // 64)
        self.low = values.min(0) if self.d else np.zeros(0, np.int64)
        shifted = values - self.low
        self.width = [int(x).bit_length() for x in (shifted.max(0) if self.d else ())]
        bits = np.zeros((sum(self.width) + 1, words * 64), np.uint8)
        bits[-1, : self.n] = 1
        k = 0
        for a, width in enumerate(self.width):
            for b in range(width):
                bits[k, : self.n] = (shifted[:, a] >> b) & 1
                k += 1
        self.slices = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        self._prepare()

    def _prepare(self) -> None:
        self.valid, self.inverse = self.slices[-1], ~self.slices
        self.start = np.concatenate(([0], np.cumsum(self.width))).astype(int).tolist()

    def dump(self) -> bytes:
        head = np.array([self.n, self.d, self.slices.shape[1]], "<i8")
        parts = (head, self.ids.astype("<i8"), self.low.astype("<i8"), np.array(self.width, "<i8"), self.slices)
        return b"".join(x.tobytes() for x in parts)

    @classmethod
    def load(cls, blob: bytes) -> Block:
        self = cls.__new__(cls)
        self.n, self.d, words = np.frombuffer(blob, "<i8", 3).tolist()
        rest = np.frombuffer(blob, "<i8", self.n + 2 * self.d, 24)
        self.ids, self.low, self.width = rest[: self.n], rest[self.n : self.n + self.d], rest[self.n + self.d :].tolist()
        self.slices = np.frombuffer(blob, np.uint64, offset=24 + 8 * len(rest)).reshape(-1, words)
        self._prepare()
        return self

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of a non-negative integer, least significant first, and the constant to add to it."""
        columns: list[list[np.ndarray]] = [[]]
        constant = int((query * self.low).sum())
        for a in np.nonzero(query)[0].tolist():
            weight, source = int(query[a]), self.slices
            if weight < 0:  # -w * v == w * (top - v) - w * top, and top - v has the inverted slices
                weight, source = -weight, self.inverse
                constant -= weight * ((1 << self.width[a]) - 1)
            own = [source[k] for k in range(self.start[a], self.start[a + 1])]
            shift = 0
            while weight:
                if weight & 1:
                    while len(columns) < shift + len(own):
                        columns.append([])
                    for b, s in enumerate(own):
                        columns[shift + b].append(s)
                weight >>= 1
                shift += 1
        out, w = [], 0
        while w < len(columns):
            todo = columns[w]
            carry: list[np.ndarray] = []
            while len(todo) > 2:
                x, y, z = todo.pop(), todo.pop(), todo.pop()
                half = x ^ y
                carry.append((x & y) | (half & z))
                todo.append(half ^ z)
            if len(todo) == 2:
                x, y = todo
                carry.append(x & y)
                todo = [x ^ y]
            if carry:
                if w + 1 == len(columns):
                    columns.append([])
                columns[w + 1] += carry
            out.append(todo[0] if todo else np.zeros_like(self.valid))
            columns[w] = []
            w += 1
        return out, constant

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """At most ``k`` pairs (id, score), the highest scores, ties to smaller ids; not the query's id."""
        slices, constant = self.scores(query)
        open_ = self.valid.copy()
        a, b = np.searchsorted(self.ids, (query_id, query_id + 1))
        for r in range(a, b):
            open_[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        sure, n_sure = np.zeros_like(open_), 0
        for s in reversed(slices):
            high = open_ & s
            n = int(np.bitwise_count(high).sum())
            if n_sure + n > k:
                open_ = high
            else:
                sure, n_sure, open_ = sure | high, n_sure + n, open_ & ~s
                if n_sure == k:
                    break
        rows = self._rows(sure) + (self._rows(open_)[: k - n_sure] if n_sure < k else [])
        one = np.uint64(1)
        value = lambda r: constant + sum(int((s[r >> 6] >> np.uint64(r & 63)) & one) << w for w, s in enumerate(slices))
        return [(int(self.ids[r]), value(r)) for r in rows]

    def _rows(self, bitmap: np.ndarray) -> list[int]:
        return np.nonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))[0].tolist()


def quantised(vector: Column) -> Column:
    """floor(1024 * x) of every component, or null if the vector takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ints = F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")))
    return F.when(vector.isNotNull() & fine, ints)


def _blocks(rows: DataFrame, size: int, index: bool) -> DataFrame:
    """Rows ``vec_id, v`` of a partition in blocks of ``size`` as blobs; narrow, nothing is shuffled."""
    prepare(rows.sparkSession)

    def run(batches):
        import pyarrow as pa

        held: dict[int, list] = {}

        def blob(d, got):
            ids, v = np.array([i for i, _ in got], np.int64), np.array([x for _, x in got], np.int64).reshape(len(got), d)
            out = Block(ids, v).dump() if index else np.concatenate(([len(got), d], ids, v.ravel())).astype("<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([out], pa.binary())], names=["d", "blob"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = held.setdefault(len(v), [])
                got.append((i, v))
                if len(got) == size:
                    yield blob(len(v), held.pop(len(v)))
        for d, got in held.items():
            yield blob(d, got)

    return rows.mapInArrow(run, "d int, blob binary")


def top_k(vectors: DataFrame, queries: Column, k: int = 10, block: int = BLOCK) -> DataFrame:
    """For every row where ``queries`` holds, the ``k`` rows with the highest inner products.

    The stated query set meets all rows in blocks: a block of the index with a block of queries gives
    k rows a query, and only those are shuffled to be ranked. No row of either side is collected.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).filter("v is not null and vec_id is not null")
    rows = save(rows, "quantised")
    parts = max(1, -(-rows.count() // block))
    index = save(_blocks(rows.coalesce(parts), block, True), "bitslices")
    asked = save(_blocks(rows.filter(queries).distinct().coalesce(parts), QUERY_BLOCK, False), "queries")
    ask = asked.select(F.col("d").alias("qd"), F.col("blob").alias("query")).repartition(min(64, max(1, asked.count())))
    pairs = index.repartition(parts).hint("shuffle_replicate_nl").crossJoin(ask).filter("d = qd").select("blob", "query")

    def run(batches):
        import pyarrow as pa

        last, at = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                blob = batch.column(0)[r].as_buffer()
                if last is None or not last.equals(blob):
                    last, at = blob, Block.load(blob.to_pybytes())
                flat = np.frombuffer(batch.column(1)[r].as_buffer(), "<i8")
                n, d = int(flat[0]), int(flat[1])
                ids, v = flat[2 : 2 + n], flat[2 + n :].reshape(n, d)
                got = [(q, j, *x) for j, q in enumerate(ids.tolist()) for x in at.top(q, v[j], k)]
                tag = [zlib.crc32(v[j].tobytes()) for j in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in got], pa.int64()), pa.array([tag[g[1]] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64())],
                    names=["query_id", "tag", "vec_id", "score"],
                )

    prepare(vectors.sparkSession)
    found = pairs.mapInArrow(run, "query_id long, tag long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
