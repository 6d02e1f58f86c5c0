"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full sets, union-find.

Results in the corner cases: a null, empty or white-space text has an empty set, links with nothing and
stays; a text with fewer words than a shingle is one shingle; rows that share a ``doc_id`` are grouped by
their own texts; a null ``doc_id`` is never linked and stays; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.graph import UnionFind, components
from folioframe.llm.runtime import join_heavy, map_batches, save, workspace
from folioframe.llm.words import GOLD, WordHashes, lower_words, mix, shingle_hashes

ROWS = 8
#: Chance that a pair exactly at the threshold shares no band.
MISS = 1e-5
#: Distinct texts, and bytes of them, that one verification task compares with as many others.
BLOCK = 128
BLOCK_BYTES = 8 << 20
#: Columns of the incidence matrix held at once while verifying.
COLUMNS = 4096
#: Shingles sketched together, and levels after which the permutations are written out.
TOGETHER = 1 << 15
SPARSE_LEVELS = 16


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that keep the chance of missing a pair at the threshold below ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def super_minhash(shingles: np.ndarray, sizes: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (sets x slots) of sets of 64-bit hashes that lie one behind the other, after Ertl's SuperMinHash.

    Every element deals its ranks 0, 1, 2... to the slots along its own random permutation, each with a
    random fraction; a slot keeps the least rank and fraction. All elements go one level at a time, and
    those of a set stop as soon as every slot of it holds a lower rank than the next level could offer,
    which for long texts is after a few. A permutation grows by one swap a level, so its first levels are
    kept as the swaps alone and only what small sets need beyond is written out. Returned as
    rank << 32 | fraction; empty sets keep the largest number.
    """
    sig = np.full((len(sizes), slots), np.iinfo(np.uint64).max, np.uint64)
    of, low, top = np.repeat(np.arange(len(sizes)), sizes), np.uint64(0xFFFFFFFF), np.uint64(32)
    swaps: list[tuple[np.ndarray, np.ndarray]] = []  # (place, what moved there) of every level
    perm, flat = None, sig.reshape(-1)
    with np.errstate(over="ignore"):
        for level in range(slots):
            r = mix(shingles + GOLD * np.uint64(level + 1))
            place = level + (((r & low) * np.uint64(slots - level)) >> top).astype(np.int16)
            if level == SPARSE_LEVELS:
                perm = np.tile(np.arange(slots, dtype=np.int16), (len(shingles), 1))
                for to, what in swaps:
                    perm[np.arange(len(shingles)), to] = what
            if perm is None:
                held, own = place.copy(), np.full(len(shingles), level, np.int16)
                for to, what in swaps:
                    np.copyto(held, what, where=to == place)
                    np.copyto(own, what, where=to == level)
                swaps.append((place, own))
            else:
                at = np.arange(len(shingles))
                held = perm[at, place]
                perm[at, place] = perm[:, level]
            np.minimum.at(flat, of * slots + held, (np.uint64(level) << top) | (r >> top))
            open_ = (sig.max(1) >> top) > np.uint64(level)
            keep = open_[of]
            left = np.count_nonzero(keep)
            if not left:
                break
            if left < 0.75 * len(keep):
                shingles, of = shingles[keep], of[keep]
                swaps = [(to[keep], what[keep]) for to, what in swaps]
                perm = None if perm is None else perm[keep]
    return sig


def band_keys(sets: list[np.ndarray], bands: int, rows: int = ROWS) -> np.ndarray:
    """Signed 64-bit keys, sets x bands; sets of similar size are sketched together."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.empty((len(sets), bands), np.int64)
    order, at = np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[order[at:]]), TOGETHER)))
        some = order[at:end]
        sig = super_minhash(np.concatenate([sets[k] for k in some]), sizes[some], bands * rows).reshape(len(some), bands, rows)
        with np.errstate(over="ignore"):
            key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * GOLD, (len(some), 1))
            for i in range(rows):
                key = mix((key ^ sig[:, :, i]) + GOLD)
        out[some] = key.view(np.int64)
        at = end
    return out


def fingerprint(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _sketches(docs: DataFrame, width: int, bands: int) -> DataFrame:
    def make():
        memo = WordHashes()

        def work(x):
            every = [lower_words(t) for t in x["text"]]
            sets = [shingle_hashes(w, width, memo) for w in every]
            keys = band_keys(sets, bands)
            return {
                "doc_id": x["doc_id"], "n_shingles": [len(s) for s in sets], "print": [fingerprint(w) if w else None for w in every],
                "bytes": [len(t) if t else 0 for t in x["text"]], "keys": [k if w else None for w, k in zip(every, keys)],
            }

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n_shingles long, print binary, bytes long, keys array<long>")


def linked_pairs(sets: list[np.ndarray], split: int, per_cent: int) -> list[tuple[int, int]]:
    """Pairs (i, j) with 100 * |i & j| >= per_cent * |i | j|; with 0 < split, only i < split <= j.

    Counts every intersection exactly as a product of incidence matrices over the hashes that occur
    twice or more, a slice of columns at a time.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    dense = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], dense[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    top = n if split == 0 else split
    inter = np.zeros((top, n - split), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        m = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - start)), np.float32)
        m[row[a:b], column[a:b] - start] = 1
        inter += m[:top] @ m[split:].T
    inter = inter.astype(np.int64)
    union = sizes[:top, None] + sizes[None, split:] - inter
    i, j = np.nonzero(100 * inter >= per_cent * union)
    return [(a, b + split) for a, b in zip(i.tolist(), j.tolist()) if a < b + split]


def _verified(members: DataFrame, width: int, per_cent: int) -> DataFrame:
    """Links within each (cluster, i, j) group of texts, thinned to a spanning forest."""

    def check(table):
        import pyarrow as pa

        memo, ids, halves, sets = WordHashes(), [], [], []
        x = table.to_pydict()
        for doc, half, mark, text in zip(x["doc_id"], x["half"], x["print"], x["text"]):
            words = lower_words(text)
            if fingerprint(words) == mark:  # else another row with the same doc_id
                ids.append(doc), halves.append(half), sets.append(shingle_hashes(words, width, memo))
        order = sorted(range(len(ids)), key=lambda k: (halves[k], ids[k]))
        ids, sets = [ids[k] for k in order], [sets[k] for k in order]
        split = sum(1 for k in halves if k == 0) if any(halves) else 0
        alone = len(ids) < 2 or (any(halves) and split in (0, len(ids)))
        groups, links = UnionFind(), []
        for a, b in [] if alone else linked_pairs(sets, split, per_cent):
            if ids[a] != ids[b] and groups.union(ids[a], ids[b]):
                links.append((ids[a], ids[b]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return members.groupBy("cluster", "i", "j").applyInArrow(check, "a long, b long")


def _block(n) -> Column:
    return F.pmod(F.xxhash64("id"), n.cast("int")).cast("int")


def _blocks(n: str, size: str, block: int) -> Column:
    """Blocks of at most some ``block`` texts and ``BLOCK_BYTES`` for ``n`` texts of ``size`` bytes in all."""
    return F.ceil(F.greatest(F.col(n) / block, F.col(size) / BLOCK_BYTES, F.lit(1))).cast("int")


def _across(members: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """Block pairs of large clusters for what links within blocks have left apart.

    The members outside a cluster's largest group meet each other and that group, block by block; members
    of the largest group, which may be nearly all, do not meet each other again.
    """
    known = groups.select("id", F.col("component").alias("g"))
    m = save(members.select("cluster", "id", "bytes").join(known, "id", "left").withColumn("g", F.coalesce("g", "id")), "grouped")
    each = m.groupBy("cluster", "g").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    main = each.groupBy("cluster").agg(F.max_by(F.struct("g", "n", "size"), F.struct("n", -F.col("g"))).alias("main"), F.sum("n").alias("n_all"), F.sum("size").alias("size_all"))
    main = main.select("cluster", F.col("main.g").alias("main"), F.col("main.n").alias("n_main"), F.col("main.size").alias("size_main"), (F.col("n_all") - F.col("main.n")).alias("n_rest"), (F.col("size_all") - F.col("main.size")).alias("size_rest"))
    main = save(main.withColumn("n_all", F.col("n_main") + F.col("n_rest")).filter("n_rest > 0"), "main")
    m = join_heavy(m, main, "cluster", "n_all", m.count())
    rest, full = _blocks("n_rest", "size_rest", block), _blocks("n_main", "size_main", block)
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    inside = m.filter("g = main").withColumn("at", _block(full))
    outside = m.filter("g <> main").withColumn("at", _block(rest))
    pair = lambda i, j, half: F.struct(i.alias("i"), j.alias("j"), half.cast("int").alias("half"))
    with_rest = F.transform(up_to(rest), lambda b: pair(F.least("at", b), F.greatest(F.col("at"), b), F.col("at") > b))
    with_main = F.transform(up_to(full), lambda b: pair(F.col("at"), rest + b, F.lit(0)))
    from_main = F.transform(up_to(rest), lambda a: pair(a, rest + F.col("at"), F.lit(1)))
    placed = outside.select("cluster", "id", F.explode(F.concat(with_rest, with_main)).alias("p")).unionByName(inside.select("cluster", "id", F.explode(from_main).alias("p")))
    return placed.select("cluster", "id", "p.i", "p.j", "p.half")


def near_duplicates(docs: DataFrame, width: int = 5, per_cent: int = 80, block: int = BLOCK) -> DataFrame:
    """Adds to every row's ``doc_id`` its ``n_shingles``, ``component_id`` and ``kept``.

    1. One Arrow pass sketches each text; rows with the same word sequence become one class, whose
       least ``doc_id`` stands for it (a combining aggregate, whatever the size of the class).
    2. Classes that share a band key meet at the key's least member: one candidate edge per class and
       band, never all pairs. Components of these edges are the candidate clusters.
    3. The representatives of a cluster are compared exactly on their full sets, in blocks of ``block``;
       only a spanning forest of the confirmed links leaves a task. What a large cluster's blocks leave
       outside its largest group then meets the other blocks, so a cluster that is one group, however
       large, costs in proportion to its size, and no link is lost.
    4. Components of the confirmed links give the groups; the least ``doc_id`` of a group stays.

    ``n_shingles`` counts distinct 64-bit hashes.
    """
    with workspace() as keep:
        bands = bands_for(per_cent / 100)
        sketch = save(_sketches(docs, width, bands), "sketch")
        some = sketch.filter("print is not null and doc_id is not null")
        classes = save(some.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.max("bytes").alias("bytes"), F.count("*").alias("n")), "classes")
        slots = classes.select("rep", F.explode("keys").alias("key"))
        hubs = save(slots.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1"), "hubs")
        met = join_heavy(slots, hubs, "key", "n", bands * classes.count())
        clusters = save(components(met.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))), "clusters")
        marks = classes.select(F.col("rep").alias("id"), "print", "bytes")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        members = clusters.select("id").join(marks, "id").join(texts, F.col("id") == F.col("doc_id"))
        members = save(members.select("doc_id", "print", "bytes", "text"), "members")  # all texts are shuffled this once

        def verify(placed: DataFrame) -> DataFrame:
            texts_of = placed.join(members, F.col("id") == F.col("doc_id")).select("cluster", "i", "j", "half", "doc_id", "print", "text")
            return save(_verified(texts_of, width, per_cent), "confirmed")

        each = save(clusters.select(F.col("component").alias("cluster"), "id").join(marks.select("id", "bytes"), "id"), "each")
        sizes = save(each.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")), "sizes")
        sized = join_heavy(each, sizes, "cluster", "n", each.count())
        at = _block(_blocks("n", "size", block // 2))  # half as many, as blocks may share a task; the others meet later
        links = verify(sized.select("cluster", "id", at.alias("i"), at.alias("j"), F.lit(0).alias("half")))
        several = _blocks("n", "size", block // 2) > 1
        if not sizes.filter(several).isEmpty():
            across = verify(save(_across(sized.filter(several), components(links), block), "across"))
            links = links.unionByName(across)
        groups = save(components(links), "groups").select(F.col("id").alias("rep"), "component")
        named = classes.select("print", "rep", "n").join(groups, "rep", "left").select("print", "n", F.coalesce("component", "rep").alias("component_id"))
        named = save(named, "named")
        keep(sketch, named)
    known = sketch.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("print")).alias("print"))
    met = join_heavy(known.filter("print is not null"), named, "print", "n", sketch.count()).select("doc_id", "n_shingles", "component_id")
    alone = known.filter("print is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return met.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, all columns unchanged."""
    gone = near_duplicates(docs, width, per_cent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
