"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents become pieces of at most ``CAPACITY`` tokens; pieces that fill a sequence are done. The others
are dealt by hash to cells of some ``CELL`` pieces, each a packing problem of its own that several islands
of a population work on in separate tasks. A chromosome is a list of bins, a bin the lengths in it (pieces
of one length are interchangeable). Crossover puts the best-filled bins of one parent in front, removes
the other parent's bins that need a length already used up, and best-fits the displaced lengths. After
each epoch every island receives the elite of its neighbour. An island stops where its packing reaches the
least possible number of bins, or after ``PATIENCE`` generations without a better one; ``generations`` in
the result is the number that the cell's islands bred in all (0: best fit was already optimal). Cells bound the memory of a task at any
size of the input and cost at most about one partly filled sequence each.

Corner cases: a null or empty text is the single id 0; repeated rows are packed one by one; an empty
table gives an empty table.
"""

from __future__ import annotations

import functools
import random
import struct
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.runtime import map_batches, save, workspace

CAPACITY = 2048
CELL = 16_384
ISLANDS = 3
EPOCHS = 2
POPULATION = 8
GENERATIONS = 40
PATIENCE = 4
INJECT = 0.3
END_ID = 0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of a byte-level BPE file, as ``Tokenizer.from_file(path)`` gives them.

    The ranks of the same vocabulary beside the file (``.tiktoken``) give the same ids several times
    faster; they take the file's special tokens, whose strings in a text are these tokens. Without the
    ranks, with special tokens that strip or need word ends, or if a text makes the fast coder fail, the
    file itself is used.
    """

    def __init__(self, path: str) -> None:
        self.path, self.slow, self.fast = path, None, None
        try:
            import base64
            import json

            import public_tokenizers
            import tiktoken

            with open(path, encoding="utf-8") as f:
                added = json.load(f).get("added_tokens") or []
            if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
                return
            with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t["content"]: t["id"] for t in added}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        except (ImportError, FileNotFoundError):
            pass

    @classmethod
    @functools.lru_cache(maxsize=1)
    def of(cls, path: str) -> Encoder:
        """One coder a worker process, whatever the number of its tasks."""
        return cls(path)

    def _slowly(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.full(1, END_ID, "<u4")
        got = None
        if self.fast is not None:
            try:
                got = self.fast.encode(text, allowed_special="all")
            except BaseException as e:  # the coder panics where its stack gives out on very long runs
                if type(e).__name__ != "PanicException":  # a class that cannot be imported, beside Exception
                    raise
        if got is None:
            got = self._slowly(text)
        got.append(END_ID)
        return np.array(got, "<u4")


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``; only the first piece of a cut document may be shorter."""

    def make():
        coder = Encoder.of(vocabulary)

        def work(x):
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for doc, text in zip(x["doc_id"], x["text"]):
                ids = coder.ids(text)
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for name, v in (("doc_id", doc), ("piece", k), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(ids[a:b].tobytes()))):
                        out[name].append(v)
            return out

        return work

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(narrow, make, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Open bins by free space; best fit takes the fullest bin with room."""

    def __init__(self, bins: list[list[int]], capacity: int) -> None:
        self.bins, self.capacity = bins, capacity
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for k, b in enumerate(bins):
            self._open(k, capacity - sum(b))

    def _open(self, k: int, room: int) -> None:
        if room:
            self.free[room].append(k)
            self.mask |= 1 << room

    def put(self, length: int) -> None:
        m = self.mask >> length
        if m:
            room = length + (m & -m).bit_length() - 1
            k = self.free[room].pop()
            if not self.free[room]:
                self.mask &= ~(1 << room)
            self.bins[k].append(length)
            self._open(k, room - length)
        else:
            self.bins.append([length])
            self._open(len(self.bins) - 1, self.capacity - length)


def best_fit(lengths: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    packed = Bins(bins or [], capacity)
    for x in lengths:
        packed.put(x)
    return packed.bins


def fitness(bins: list[list[int]], capacity: int) -> float:
    """Mean squared fill: rewards full bins, and so few bins."""
    return sum((sum(b) / capacity) ** 2 for b in bins) / len(bins) if bins else 1.0


def crossover(a: list[list[int]], b: list[list[int]], need: Counter, capacity: int, rng: random.Random) -> list[list[int]]:
    """The best-filled bins of ``a``, the bins of ``b`` that still fit the stock, the rest by best fit."""
    ranked = sorted(a, key=sum, reverse=True)
    full = [x for x in ranked[: max(1, int(len(ranked) * INJECT * 2))] if rng.random() < 0.5] or ranked[:1]
    left, child = Counter(need), []
    for source in (full, b):
        for x in source:
            want = Counter(x)
            if all(left[k] >= n for k, n in want.items()):
                left.subtract(want)
                child.append(list(x))
    return best_fit(sorted(left.elements(), reverse=True), capacity, child)


def evolve(
    lengths: list[int], capacity: int, seed: int, start: list[list[list[int]]], generations: int = GENERATIONS, size: int = POPULATION, patience: int = PATIENCE
) -> tuple[list[list[list[int]]], int]:
    """One epoch of one island: its packings, best first, and the number of generations bred."""
    need, rng, least = Counter(lengths), random.Random(seed), -(-sum(lengths) // capacity)
    population = list(start)
    down = sorted(lengths, reverse=True)
    while len(population) < size:
        spread = 0.0 if not population and seed % ISLANDS == 0 else 0.25 * rng.random()
        order = sorted(down, key=lambda x: -x * (1 + spread * (rng.random() - 0.5))) if spread else down
        population.append(best_fit(order, capacity))
        if len(population[-1]) <= least:
            break
    rank = lambda p: (len(p), -fitness(p, capacity))
    population.sort(key=rank)
    bred, idle = 0, 0
    while bred < generations and idle < patience and len(population[0]) > least and len(population) > 1:
        before = rank(population[0])
        a, b = population[0], population[1 + rng.randrange(len(population) - 1)]
        population += [crossover(a, b, need, capacity, rng), crossover(b, a, need, capacity, rng)]
        population = sorted(population, key=rank)[:size]
        bred += 1
        idle = 0 if rank(population[0]) < before else idle + 1
    return population, bred


def dump(bins: list[list[int]]) -> bytes:
    sizes = np.array([len(b) for b in bins], "<u4")
    return struct.pack("<I", len(bins)) + sizes.tobytes() + np.array([x for b in bins for x in b], "<u4").tobytes()


def load(blob: bytes) -> list[list[int]]:
    n = struct.unpack_from("<I", blob)[0]
    sizes = np.frombuffer(blob, "<u4", n, 4)
    flat, ends = np.frombuffer(blob, "<u4", offset=4 + 4 * n).tolist(), np.cumsum(sizes).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def _epoch(state: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """``cell, island, lengths, elites`` -> the same with this epoch's elites, best first."""

    def make():
        def work(x):
            out = {"cell": x["cell"], "island": x["island"], "lengths": x["lengths"], "elites": [], "n_bins": [], "fitness": [], "bred": []}
            for cell, island, lengths, elites, bred in zip(x["cell"], x["island"], x["lengths"], x["elites"], x["bred"]):
                seed = (cell * 1009 + epoch) * ISLANDS + island
                best, more = evolve(lengths, capacity, seed, [load(e) for e in elites or ()])
                out["elites"].append([dump(p) for p in best[:2]])
                out["n_bins"].append(len(best[0]))
                out["fitness"].append(fitness(best[0], capacity))
                out["bred"].append(bred + more)
            return out

        return work

    return map_batches(state.select("cell", "island", "lengths", "elites", "bred"), make, "cell long, island int, lengths array<long>, elites array<binary>, n_bins long, fitness double, bred long")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all rows with ``sequence_id``, their ``offset`` in it and the ``generations`` bred for it.

    Texts are read once and never shuffled; what is shuffled are pieces of some 40 bytes, by cell.
    """
    with workspace() as keep:
        numbered = pieces(docs, vocabulary or default_vocabulary(), capacity).withColumn("number", F.monotonically_increasing_id())
        got, number = save(numbered, "pieces"), F.col("number")  # stored, so that every later reader sees the same numbers
        full = got.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - number).withColumn("offset", F.lit(0).cast("long")).withColumn("generations", F.lit(0).cast("long"))
        rest = got.filter(F.col("length") < capacity)
        cells = max(1, -(-rest.count() // CELL))
        rest = rest.withColumn("cell", F.pmod(F.xxhash64(number), F.lit(cells)))
        lots = save(rest.groupBy("cell").agg(F.sort_array(F.collect_list("length")).alias("lengths")), "cells")
        islands = F.explode(F.array(*(F.lit(i) for i in range(ISLANDS))))
        state = lots.select("cell", islands.alias("island"), "lengths", F.array().cast("array<binary>").alias("elites"), F.lit(0).cast("long").alias("bred")).repartition(cells * ISLANDS)
        for epoch in range(EPOCHS):
            if epoch:
                migrants = state.select("cell", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("elites", 1, 1).alias("migrant"))
                state = state.join(migrants, ["cell", "island"]).withColumn("elites", F.concat("elites", "migrant")).repartition(cells * ISLANDS)
            state = save(_epoch(state, capacity, epoch), f"epoch{epoch}")
        keep(got, state)
    best = state.groupBy("cell").agg(F.max_by(F.element_at("elites", 1), F.struct(-F.col("n_bins"), "fitness", "island")).alias("bins"), F.sum("bred").alias("generations"))

    def place(left, right):
        import pyarrow as pa

        by_length: dict[int, list[int]] = {}
        lengths, doc, piece = (left.column(n).to_pylist() for n in ("length", "doc_id", "piece"))
        order = sorted(range(len(lengths)), key=lambda r: (doc[r] is None, doc[r] or 0, piece[r]), reverse=True)
        for r in order:
            by_length.setdefault(lengths[r], []).append(r)
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        cell = left.column("cell")[0].as_py()
        for k, b in enumerate(load(right.column("bins")[0].as_py())):
            at = 0
            for x in b:
                r = by_length[x].pop()
                sequence[r], offset[r] = (cell << 32) + k, at
                at += x
        cols = {n: left.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        return pa.table(cols | {"sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()), "generations": pa.repeat(right.column("generations")[0], len(lengths))})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, generations long"
    placed = rest.groupBy("cell").cogroup(best.groupBy("cell")).applyInArrow(place, schema)
    return placed.unionByName(full.select(*placed.columns))
