"""Removal of repeated substrings by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if it is covered by a ``WINDOW``-byte string that also starts earlier (in a smaller
``doc_id``, or before in the same document). Sorting every suffix of a corpus would move each text a
hundred times over, so suffixes are taken at anchors only, without losing a match: in every window the
``GRAM``-byte substring with the least hash (all of them, if tied) is an anchor, equal windows hold equal
anchors at equal places, and an anchor whose gram occurs once cannot lie in a repeated window.

1. Whole copies: the least ``doc_id`` of a text stands for it, the copies are covered completely.
2. Anchors are exchanged as packed arrays by gram hash; the ones that occur twice are the sites.
3. Every task sorts the suffixes at its sites, front-codes the sorted run and sends it, cut at splitters
   (quantiles of a bounded sample of grams), to the mergers, each of which holds one range of the order. Up
   to ``RANGES`` splitters are used; beyond that a range is shared by several mergers, by gram. Suffixes with
   the same bytes before and after them are combined on the way: all but the first are covered, and only
   the first travels, so a passage in a third of all documents does not pile up. A gram that fills more
   than one ``RANGES``-th of the sample in different surroundings is dealt twice: by the bytes behind it,
   for windows that reach ``HALF`` bytes or more beyond it, and by those before it for the others.
4. A merger combines its runs with a loser tree whose matches start behind the prefix already known to be
   common; it yields the sorted suffixes and the common prefix of every neighbouring pair.
5. For each distance between a window's start and its anchor, suffixes that share enough bytes to the
   right and to the left are one window; all but the earliest are covered. Both sides are decided by the
   bytes themselves: common prefixes of the sorted suffixes, and of the sorted reversed left contexts.

The sample decides only who does what; results do not depend on it.

Corner cases: a null or empty text has no bytes; texts shorter than a window lose nothing; identical rows
are one document; different texts under one ``doc_id`` are ordered by their digests; rows with a null
``doc_id`` neither lose bytes nor count; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.runtime import extend_batches, prepare, save, workspace
from folioframe.llm.words import GOLD, mix

WINDOW = 100
GRAM = 32
SPAN = WINDOW - GRAM
#: Bytes of text whose anchors, or whose sites, one merger handles.
MERGER_BYTES = 8 << 20
#: Suffixes that a task sorts into one run.
RUN = 50_000
#: Ranges of the sorted order, and the sample that sets their bounds: documents, and grams of each.
RANGES = 1024
SAMPLE_DOCS = 4096
SAMPLE_GRAMS = 16
#: Bytes of text that a task of the joins reads.
JOIN_BYTES = 16 << 20
#: Every window reaches this far beyond its anchor gram on one side at least.
HALF = SPAN // 2

_BASE = np.uint64(0x9E6C63D0876A9A47)
_BASE_INVERSE = np.uint64(pow(0x9E6C63D0876A9A47, -1, 1 << 64))


class Anchors:
    """Anchors of byte strings; remembers the powers of the rolling hash."""

    def __init__(self) -> None:
        with np.errstate(over="ignore"):
            self.letters = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, _BASE))))
                self.down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, _BASE_INVERSE))))

    def grams(self, raw: bytes) -> np.ndarray:
        """Hash of the gram at every position."""
        n = len(raw)
        self._powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.letters[np.frombuffer(raw, np.uint8)] * self.up[:n], out=total[1:])
            return mix((total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1])

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Positions and gram hashes of the anchors of a text of ``WINDOW`` bytes or more."""
        h = self.grams(raw)
        least = _slide(h, SPAN + 1, np.minimum, np.iinfo(np.uint64).max)[: len(h) - SPAN]
        edge = np.zeros(SPAN, np.uint64)
        most = _slide(np.concatenate((edge, least, edge)), SPAN + 1, np.maximum, 0)[: len(h)]
        at = np.nonzero(h == most)[0]
        return at, h[at]


def _slide(x: np.ndarray, width: int, least, fill: int) -> np.ndarray:
    """least(x[i : i + width]) for every i (beyond the end filled up), in a constant number of passes."""
    n = len(x)
    rows = -(-n // width) + 1
    padded = np.full(rows * width, fill, x.dtype)
    padded[:n] = x
    grid = padded.reshape(rows, width)
    ahead = least.accumulate(grid, axis=1).ravel()
    behind = least.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return least(behind[:n], ahead[width - 1 : width - 1 + n])


def _anchor_blobs(texts: DataFrame, mergers: int) -> DataFrame:
    """``r, blob``: the anchors of a batch of texts, by gram hash."""
    prepare(texts.sparkSession)

    def run(batches):
        import pyarrow as pa

        find = Anchors()
        for batch in batches:
            keys, docs, where, hashes = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, h = find(text.encode())
                docs.append(np.full(len(at), len(keys), np.uint32))
                keys.append(key)
                where.append(at.astype(np.uint32))
                hashes.append(h)
            if not keys:
                continue
            docs, where, hashes = np.concatenate(docs), np.concatenate(where), np.concatenate(hashes)
            with np.errstate(over="ignore"):  # anchors have low hashes, so they are dealt by another one
                r = ((mix(hashes + GOLD) >> np.uint64(32)) * np.uint64(mergers)) >> np.uint64(32)
            order = np.argsort(r, kind="stable")
            met, starts = np.unique(r[order], return_index=True)
            rs, blobs = met.astype(np.int32), []
            for a, b in zip(starts.tolist(), [*starts.tolist()[1:], len(order)]):
                some = order[a:b]
                own, local = np.unique(docs[some], return_inverse=True)
                table = b"".join(keys[i] for i in own.tolist())
                blobs.append(struct.pack("<II", len(own), len(some)) + table + hashes[some].tobytes() + local.astype("<u4").tobytes() + where[some].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rs), pa.array(blobs, pa.binary())], names=["r", "blob"])

    return texts.select("key", "text").mapInArrow(run, "r int, blob binary")


def _twice(table):
    """The anchors of one merger whose gram occurs at two places or more: ``key, positions``."""
    import pyarrow as pa

    number: dict[bytes, int] = {}
    docs, where, hashes = [], [], []
    for blob in table.column("blob").to_pylist():
        n, m = struct.unpack_from("<II", blob)
        own = np.array([number.setdefault(blob[8 + 16 * i : 24 + 16 * i], len(number)) for i in range(n)], np.int64)
        at = 8 + 16 * n
        hashes.append(np.frombuffer(blob, "<u8", m, at))
        docs.append(own[np.frombuffer(blob, "<u4", m, at + 8 * m)])
        where.append(np.frombuffer(blob, "<u4", m, at + 12 * m))
    docs, where, hashes = np.concatenate(docs), np.concatenate(where), np.concatenate(hashes)
    place = (docs << 32) | where
    order = np.lexsort((place, hashes))
    h, place = hashes[order], place[order]
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (place[1:] != place[:-1])))  # copies of a text agree in both
    h, place = h[fresh], place[fresh]
    same = h[1:] == h[:-1]
    both = np.concatenate((same, [False])) | np.concatenate(([False], same))
    place = np.sort(place[both])
    names = list(number)
    docs, where = place >> 32, (place & 0xFFFFFFFF).astype(np.int32)
    starts = np.nonzero(np.concatenate(([True], docs[1:] != docs[:-1])))[0] if len(docs) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(docs))
    return pa.table({
        "key": pa.array([names[docs[a]] for a in starts.tolist()], pa.binary()),
        "positions": pa.array([where[a:b].tolist() for a, b in zip(starts.tolist(), ends.tolist())], pa.list_(pa.int32())),
    })


def common(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix, of which ``h`` bytes are known."""
    n = min(len(a), len(b))
    while h < n and a[h : h + 16] == b[h : h + 16]:
        h += 16
    if h >= n:
        return n
    while h < n and a[h] == b[h]:
        h += 1
    return h


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> list[tuple[int, int, int]]:
    """Merges sorted runs of (strings, common prefix with the string before): (run, index, common prefix).

    A loser tree in which every waiting string carries the length of its common prefix with the last
    output. The string with the longer one is smaller; only equal ones are compared, from there on.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    head = [0] * k
    known = [0 if i < len(runs) and runs[i][0] else -1 for i in range(k)]  # -1: run at its end

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser), and notes the loser's common prefix with the winner."""
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = runs[a][0][head[a]], runs[b][0][head[b]]
        h = common(s, t, x)
        if s[h : h + 1] <= t[h : h + 1]:
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    losers, winners = [0] * k, [0] * (2 * k)
    winners[k:] = range(k)
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    now, out = winners[1] if k > 1 else 0, []
    while known[now] >= 0:
        at = head[now]
        out.append((now, at, known[now]))
        strings, prefixes = runs[now]
        head[now] = at = at + 1
        known[now] = prefixes[at] if at < len(strings) else -1
        node = (now + k) >> 1
        while node:
            other = losers[node]
            x, y = known[now], known[other]
            if x > y:
                pass
            elif x < y:
                losers[node], now = now, other
            else:
                now, losers[node] = play(now, other)
            node >>= 1
    return out


def front_code(entries: list[tuple], covers: list[tuple], keys: list[tuple[int, bytes]]) -> bytes:
    """One sorted run as bytes. entries: (suffix, left, doc, position, side); covers: (doc, start, end)."""
    prefixes, rests, last = [], [], b""
    for suffix, *_ in entries:
        h = common(last, suffix, 0)
        prefixes.append(h)
        rests.append(suffix[h:])
        last = suffix
    own = sorted({e[2] for e in entries} | {c[0] for c in covers})
    local = {d: i for i, d in enumerate(own)}
    return b"".join((
        struct.pack("<IIIII", len(own), len(entries), len(covers), sum(map(len, rests)), sum(len(e[1]) for e in entries)),
        b"".join(keys[d][1] for d in own), np.array([keys[d][0] for d in own], "<i8").tobytes(),
        bytes(prefixes), bytes(map(len, rests)), bytes(len(e[1]) for e in entries), bytes(e[4] for e in entries),
        np.array([local[e[2]] for e in entries], "<u4").tobytes(), np.array([e[3] for e in entries], "<u4").tobytes(),
        np.array([(local[d], a, b) for d, a, b in covers], "<u4").tobytes(),
        b"".join(rests), b"".join(e[1] for e in entries),
    ))


def read_run(blob: bytes):
    n, m, c, size, _ = struct.unpack_from("<IIIII", blob)
    at = 20
    keys = [blob[at + 16 * i : at + 16 * i + 16] for i in range(n)]
    at += 16 * n
    ids = np.frombuffer(blob, "<i8", n, at).tolist()
    at += 8 * n
    prefixes, rests, lefts, sides = (list(blob[at + k * m : at + k * m + m]) for k in range(4))
    at += 4 * m
    docs, where = np.frombuffer(blob, "<u4", m, at).tolist(), np.frombuffer(blob, "<u4", m, at + 4 * m).tolist()
    at += 8 * m
    covers = np.frombuffer(blob, "<u4", 3 * c, at).reshape(c, 3)
    at += 12 * c
    strings, left, to, last = [], [], at + size, b""
    for h, r, k in zip(prefixes, rests, lefts):
        last = last[:h] + blob[at : at + r]
        strings.append(last)
        left.append(blob[to : to + k])
        at += r
        to += k
    return [(ids[d], keys[d]) for d in range(n)], strings, prefixes, left, docs, where, sides, covers


class Route:
    """Which mergers a suffix goes to."""

    def __init__(self, sample: list[bytes], mergers: int) -> None:
        ranges = min(mergers, RANGES)
        self.shared = -(-mergers // ranges)
        ordered = sorted(sample)
        self.bounds = sorted({ordered[len(ordered) * k // ranges] for k in range(1, ranges)} if ordered else ())
        self.crowded = {g for g, n in Counter(ordered).items() if n * RANGES > len(ordered) and n > SAMPLE_GRAMS}
        self.mergers = (len(self.bounds) + 1) * self.shared

    def __call__(self, suffix: bytes, left: bytes) -> list[tuple[int, int]]:
        """(merger, side): 0 for all windows, 1 or 2 for those that reach far behind or before the gram."""
        gram = suffix[:GRAM]
        if gram in self.crowded:
            return [(zlib.crc32(suffix[: GRAM + HALF]) % self.mergers, 1), (zlib.crc32(left[-HALF:], zlib.crc32(gram)) % self.mergers, 2)]
        at = bisect.bisect_right(self.bounds, gram) * self.shared
        return [(at + zlib.crc32(gram) % self.shared if self.shared > 1 else at, 0)]


def _sample(keyed: DataFrame, sites: DataFrame) -> list[bytes]:
    """Grams at sites of some documents, the first by a hash of their keys; bounded by both parameters."""
    some = sites.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_DOCS)
    some = some.select(F.col("first").alias("_doc"), F.col("key").alias("_key"), F.col("positions").alias("_at"))
    step = F.ceil(F.size("_at") / SAMPLE_GRAMS).cast("int")
    some = some.withColumn("_at", F.filter("_at", lambda x, k: k % step == 0))
    rows = keyed.join(F.broadcast(some), F.col("doc_id") == F.col("_doc")).filter("key = _key").dropDuplicates(["_key"])
    raw = F.col("text").cast("binary")
    grams = rows.select(F.explode(F.transform("_at", lambda p: F.substring(raw, p + 1, F.lit(GRAM)))).alias("gram"))
    return [bytes(r[0]) for r in grams.collect()]


def _run_blobs(texts: DataFrame, route: Route) -> DataFrame:
    """``r, blob``: front-coded sorted runs of the suffixes at the sites."""
    prepare(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(route)  # RANGES grams at most, and as many crowded ones

    def run(batches):
        import pyarrow as pa

        way, held, keys = shared.value, [], []

        def flush():
            held.sort(key=lambda e: (e[0], e[1], e[2], e[3], e[4], keys[e[5]], e[6]))
            rs, blobs, at = [], [], 0
            while at < len(held):
                r, entries, covers, last = held[at][0], [], [], None
                while at < len(held) and held[at][0] == r:
                    _, suffix, left, side, _, doc, pos = held[at]
                    if last is not None and last[0] == suffix and last[1] == left and last[4] == side:
                        if keys[last[2]] != keys[doc] or last[3] != pos:
                            if len(left) + len(suffix) >= WINDOW:
                                covers.append((doc, pos - len(left), pos + len(suffix)))
                    else:
                        last = (suffix, left, doc, pos, side)
                        entries.append(last)
                    at += 1
                rs.append(r)
                blobs.append(front_code(entries, covers, keys))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rs, pa.int32()), pa.array(blobs, pa.binary())], names=["r", "blob"])

        for batch in batches:
            for doc_id, key, text, sites in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = text.encode()
                keys.append((doc_id, key))
                for p in sorted(sites):
                    suffix, left = raw[p : p + WINDOW], raw[max(0, p - SPAN) : p]
                    for r, side in way(suffix, left):
                        held.append((r, suffix, left, side, doc_id, len(keys) - 1, p))
                    if len(held) >= RUN:  # also within a long text
                        yield flush()
                        keys[:] = keys[-1:]
                if not held:
                    keys.clear()
        if held:
            yield flush()

    return texts.select("doc_id", "key", "text", "positions").mapInArrow(run, "r int, blob binary")


def _common_heads(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the columns of a byte matrix, read downward, and each one's common head with the one before."""
    rows, n = grid.shape
    order = np.argsort(np.ascontiguousarray(grid.T).view(f"S{rows}").ravel(), kind="stable")
    ordered = grid[:, order]
    head = np.zeros(n, np.int64)
    head[1:] = np.logical_and.accumulate(ordered[:, 1:] == ordered[:, :-1], axis=0).sum(0)
    return order, head


def decide(prefix: np.ndarray, lengths: np.ndarray, lefts: list[bytes], rank: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which sorted suffixes are covered, and how far to the left and the right of their anchors.

    ``prefix[i]`` is the common prefix of suffixes i - 1 and i; ``rank`` orders the places in the corpus.
    Left contexts are sorted from the anchor backward, so those that share ``off`` bytes lie together too.
    """
    n = len(lengths)
    width = np.fromiter(map(len, lefts), np.int64, n)
    flat = np.frombuffer(b"".join(x[::-1].ljust(SPAN, b"\0") for x in lefts), np.uint8)
    before, after = np.full(n, -1), np.full(n, -1)
    if not n:
        return before >= 0, before, after
    order, head = _common_heads(flat.reshape(n, SPAN).T)
    group = np.empty(n, np.int64)
    for off in range(SPAN + 1):
        block = np.cumsum(prefix < WINDOW - off)
        group[order] = np.cumsum(head < off)
        apart = (sides == 0) | ((sides == 1) & (off <= HALF)) | ((sides == 2) & (off >= HALF))
        ok = np.nonzero((width >= off) & (lengths >= WINDOW - off) & apart)[0]
        if len(ok) < 2:
            continue
        label = (block[ok] * (n + 1) + group[ok]) * 3 + sides[ok]
        by = np.lexsort((rank[ok], label))
        s, r = label[by], rank[ok][by]
        first = np.concatenate(([True], s[1:] != s[:-1]))
        lead = r[np.nonzero(first)[0]][np.cumsum(first) - 1]
        hit = ok[by[r != lead]]
        before[hit] = off
        after[hit] = np.where(after[hit] < 0, WINDOW - off, after[hit])
    return before >= 0, before, after


def _merge(table):
    """The covered stretches that one merger finds: ``key, start, stop``."""
    import pyarrow as pa

    number: dict[tuple[int, bytes], int] = {}
    runs, lefts, docs, wheres, sides, out = [], [], [], [], [], []
    for blob in table.column("blob").to_pylist():
        own, strings, prefixes, left, doc, where, side, covers = read_run(blob)
        own = [number.setdefault(k, len(number)) for k in own]
        out += [(own[d], a, b) for d, a, b in covers.tolist()]
        if strings:
            runs.append((strings, prefixes))
            lefts.append(left)
            docs.append([own[d] for d in doc])
            wheres.append(where)
            sides.append(side)
    names = list(number)
    if runs:
        merged = merge_runs(runs)
        order = np.empty(len(names), np.int64)
        order[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        doc = np.array([docs[r][i] for r, i, _ in merged])
        where = np.array([wheres[r][i] for r, i, _ in merged])
        hit, before, after = decide(
            np.array([h for _, _, h in merged]), np.array([len(runs[r][0][i]) for r, i, _ in merged]),
            [lefts[r][i] for r, i, _ in merged], (order[doc] << 32) | where, np.array([sides[r][i] for r, i, _ in merged]),
        )
        hit = np.nonzero(hit)[0]
        out += zip(doc[hit].tolist(), (where[hit] - before[hit]).tolist(), (where[hit] + after[hit]).tolist())
    return pa.table({
        "key": pa.array([names[d][1] for d, _, _ in out], pa.binary()),
        "start": pa.array([a for _, a, _ in out], pa.int32()), "stop": pa.array([b for _, _, b in out], pa.int32()),
    })


def cut(raw: bytes, stretches: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of ``raw``, and the number of maximal removed runs."""
    kept, at, spans, reach = [], 0, 0, -1
    for a, b in sorted(stretches):
        if a > reach:
            spans += 1
            kept.append(raw[at:a])
        reach = max(reach, b)
        at = max(at, reach)
    return b"".join([*kept, raw[at:]]), spans


def remove_repeats(docs: DataFrame, kept_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row (and the kept bytes)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long_ = F.col("doc_id").isNotNull() & (F.octet_length("text") >= WINDOW)
    keyed = keyed.withColumn("key", F.when(long_, F.unhex(F.md5(F.col("text").cast("binary")))))
    with workspace() as keep:
        owners = save(
            keyed.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.first(F.octet_length("text")).cast("long").alias("bytes"), F.count("*").alias("n")),
            "owners",
        )
        total = owners.agg(F.coalesce(F.sum(F.col("bytes") * F.col("n")), F.lit(0))).first()[0]
        mergers, parts = max(8, -(-total // MERGER_BYTES)), max(8, -(-total // JOIN_BYTES))
        long_texts = keyed.filter("key is not null")
        found = _anchor_blobs(long_texts, mergers).repartition(mergers, "r").groupBy("r").applyInArrow(_twice, "key binary, positions array<int>")
        sites = found.groupBy("key").agg(F.flatten(F.collect_list("positions")).alias("positions"))
        sites = save(sites.join(owners.select("key", "first"), "key"), "sites")
        route = Route(_sample(long_texts, sites), mergers)
        at = long_texts.repartition(parts, "key", "doc_id").join(sites.withColumnRenamed("first", "doc_id"), ["key", "doc_id"])
        covers = _run_blobs(at, route).repartition(route.mergers, "r").groupBy("r").applyInArrow(_merge, "key binary, start int, stop int")
        per = covers.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("stretches"))
        marks = save(owners.select("key", "first").join(per, "key", "left").withColumnRenamed("key", "_key"), "marks")
        keep(marks)
    # by key and document: the copies of a text do not meet in one task, nor do the texts without a key
    spread = keyed.withColumn("_id", F.coalesce("doc_id", F.xxhash64("text"))).repartition(parts, "key", "_id")
    joined = spread.join(marks, (F.col("key") == F.col("_key")) & (F.col("_id") == F.col("first")), "left")

    def make():
        def work(keys, texts, firsts, stretches):
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for key, text, first, marked in zip(keys, texts, firsts, stretches):
                raw = text.encode() if text else b""
                if key is not None and first is None:  # a copy: not the document that stands for the text
                    kept, spans = b"", 1
                elif marked:
                    kept, spans = cut(raw, [(x["start"], x["stop"]) for x in marked])
                else:
                    kept, spans = raw, 0
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(kept))
                out["n_spans"].append(spans)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if kept_text else None)
            return out

        return work

    got = extend_batches(joined.select("doc_id", "key", "text", "first", "stretches"), ["key", "text", "first", "stretches"], make, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return got.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if kept_text else []))
