"""Rules over the words of whole pages, in blocks of pages.

The words of a page are brought together by at most one shuffle (none where they are dealt out by document
or page already) and pass through Python once, as arrays; only what is found leaves the task. A task holds
one Arrow batch of words and, at least, one page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioframe.operators.folds import bucket_rule
from folioframe.shipping import ship

PAGE = ["document_id", "page_number"]
BOX = ["l", "t", "r", "b"]


class Lines(NamedTuple):
    """Line fragments: those of a page follow each other in the order of their numbers."""

    page: np.ndarray
    l: np.ndarray  # noqa: E741
    t: np.ndarray
    r: np.ndarray
    b: np.ndarray
    word: np.ndarray  # positions of the lines' words, line by line, from left to right
    cuts: np.ndarray  # where those of each line begin, and the end

    def of(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``word`` and ``cuts`` of these lines."""
        return self.word[spans(self.cuts[lines], self.cuts[lines + 1])], np.append(0, np.cumsum(self.cuts[lines + 1] - self.cuts[lines]))


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The positions from each start to its end, one after the other."""
    size = ends - starts
    return np.arange(size.sum()) + np.repeat(starts - np.cumsum(size) + size, size)


def codes(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Whole numbers in the order of the values, and their bound."""
    if not len(x):
        return np.empty(0, np.int64), 1
    low, high = x.min(), x.max()
    if high - low < 1 << 20:  # false for NaN
        whole = (x - low).astype(np.int64)
        if x.dtype.kind != "f" or np.array_equal(whole + low, x):
            return whole, int(high - low) + 1
    known, nth = np.unique(x, return_inverse=True)
    return nth, len(known)


def sorted_by(*keys: np.ndarray) -> np.ndarray:
    """The stable order by these keys, the first one first: one sort of whole numbers where they fit."""
    bound, key = 1, np.zeros(len(keys[0]), np.int64)
    for k in keys:
        code, n = codes(k)
        bound *= n
        if bound >= 1 << 62:
            return np.lexsort(keys[::-1])
        key = key * n + code
    return np.argsort(key, kind="stable")


class Block:
    """Words of whole pages as arrays; ``page`` numbers the pages of the block."""

    def __init__(self, table: pa.Table):
        self.table = table.combine_chunks()
        self.first = np.flatnonzero(self["_nth"] == 1)
        self.page = np.cumsum(self["_nth"] == 1) - 1
        self.l, self.t, self.r, self.b = (self[c] for c in BOX)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()

    def texts(self, word: np.ndarray, cuts: np.ndarray) -> pa.Array:
        """The texts of lines as ``Lines.of`` gives them; words without text are left out."""
        text = self.table.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        if text.null_count:
            known = text.is_valid().to_numpy(zero_copy_only=False)[word]
            word, cuts = word[known], np.append(0, np.cumsum(known))[cuts]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), text.take(pa.array(word))), " ")

    def only(self, mask: np.ndarray) -> Block:
        """The block of these words alone."""
        page = self.page[mask]
        nth = np.full(len(page), 2)
        nth[runs(page)] = 1
        table = self.table.filter(pa.array(mask))
        return Block(table.set_column(table.column_names.index("_nth"), "_nth", pa.array(nth)))

    def keys(self, pages: np.ndarray) -> list[pa.Array]:
        return [self.table.column(c).take(pa.array(self.first[pages])).combine_chunks() for c in PAGE]


def by_page(words: DataFrame, f: Callable[[Block], list[pa.Array]], schema: StructType, more: tuple[str, ...] = ()) -> DataFrame:
    """PAGE and the columns of ``schema`` as ``f`` gives them for blocks of whole pages.

    Words without a page or a full box take no part; ``more`` columns of theirs go along.
    """
    ship(words.sparkSession)
    full = words.dropna(subset=[*PAGE, *BOX])
    nth = F.row_number().over(Window.partitionBy(*PAGE).orderBy("word_no"))  # also partitions and sorts the rows
    placed = full.select(*PAGE, F.col("word_no").cast("long").alias("word_no"), "text", *(F.col(c).cast("double").alias(c) for c in BOX), *more, nth.alias("_nth"))
    out = StructType([placed.schema[c] for c in PAGE] + schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(f(Block(pa.Table.from_batches(parts))), names=out.names)

        held = []  # the last page, which may go on in the next batch
        for batch in batches:
            starts = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy() == 1)
            if len(starts) and (held or starts[-1]):
                yield found([*held, batch.slice(0, starts[-1])] if starts[-1] else held)
                held = []
            held.append(batch.slice(starts[-1]) if len(starts) else batch)
        if held:
            yield found(held)

    return placed.mapInArrow(run, out)


def by_text(texts: DataFrame, lay_out: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], f: Callable[..., list[pa.Array]], schema: StructType, more: str | None = None, most: int = 3 << 19) -> DataFrame:
    """As ``by_page``, for the words of ``texts`` (document_id, text), which are laid out here and never are rows.

    ``lay_out`` takes the numbers of words in their texts and their lengths, and gives ``page_number`` and the
    boxes. ``f`` gets blocks of whole documents of some ``most`` bytes, and at least one document; with ``more``
    also a list of structs (of that column, alike in all rows of a document) that begin with their page, and the
    page of the block for each. The texts of a document must be in one partition.
    """
    ship(texts.sparkSession)
    small_batches(texts.sparkSession)
    names = ["document_id", "text", *([more] if more else [])]
    placed = texts.select(*names).dropna(subset=["document_id"]).sortWithinPartitions("document_id")
    out = StructType([placed.schema["document_id"]] + StructType.fromDDL("page_number int").fields + schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                if size > most and row.column(0)[0].as_py() != held[-1].column(0)[0].as_py():
                    yield from found(held)
                    held, size = [], 0
                held.append(row)
                size += 200 + row.column(1).nbytes
        if held:
            yield from found(held)

    def found(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        ids = table.column("document_id").combine_chunks()
        document = np.append(0, np.cumsum(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)))
        row, word_no, words, length = split_words(table.column("text").combine_chunks())
        if not len(row):
            return
        laid = lay_out(word_no, length)
        of, number = document[row], laid["page_number"]
        order = sorted_by(of, number, word_no)
        of, number = of[order], number[order]
        heads = runs(of, number)
        nth = np.full(len(order), 2)
        nth[heads] = 1
        columns = {"document_id": ids.take(pa.array(row[order])), "page_number": pa.array(number, pa.int32()), "word_no": pa.array(word_no[order], pa.int64()), "text": words if np.all(order[1:] > order[:-1]) else words.take(pa.array(order))}
        block = Block(pa.table(columns | {c: laid[c][order] for c in BOX} | {"_nth": nth}))
        if more:
            first = runs(document)
            lists = table.column(more).combine_chunks().take(pa.array(first))
            many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            structs = lists.flatten()
            on = structs.field(0).to_numpy()
            key, want = of[heads].astype(np.int64) << 32 | number[heads], np.repeat(np.arange(len(first)), many).astype(np.int64) << 32 | on
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            columns = f(block, structs, np.where(key[at] == want, at, -1))
        else:
            columns = f(block)
        yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return placed.mapInArrow(run, out)


WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Words between ASCII white space: their texts' rows, their numbers there (from 0), they and their lengths.

    A blank text has one empty word, null none.
    """
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    ink = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(ink & (edge[:-1] | ~np.append(False, ink[:-1])))
    ends = np.flatnonzero(ink & (edge[1:] | ~np.append(ink[1:], False))) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    size, length = ends - starts, chars[ends] - chars[starts]
    blank = valid.copy()
    blank[row] = False
    if blank.any():
        blank = np.flatnonzero(blank)
        order = np.argsort(np.append(row, blank), kind="stable")
        row, size, length = (np.append(x, y)[order] for x, y in ((row, blank), (size, 0 * blank), (length, 0 * blank)))
    cuts = np.append(0, np.cumsum(size)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(cuts), pa.py_buffer(data[ink])])
    heads = runs(row)
    word_no = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
    return row, word_no, words, length


def few(batches: Iterator[pa.RecordBatch], most: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows: a row that holds a page is some hundred lines as Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, most):
            yield batch.slice(k, most)


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bound Arrow batches by bytes: 10,000 rows that hold a page each would take an executor's memory.

    The setting stays, as the plans run after this.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def buckets(page: np.ndarray, word_no: np.ndarray, l: np.ndarray, t: np.ndarray, b: np.ndarray, tolerance: float) -> np.ndarray:  # noqa: E741
    """The bucket of each word in its page, as ``layout.bucketed`` numbers them."""
    order = sorted_by(page, t, l, word_no)
    got = np.empty(len(page), np.int64)
    if len(page) and page[order[-1]] - page[order[0]] >= 8 and np.all(b >= t):
        got[order] = bucket_rounds(page[order], t[order], b[order], tolerance)
        return got
    start, step = bucket_rule(tolerance)
    out, at, state = [], None, None
    for p, top, bottom in zip(page[order].tolist(), t[order].tolist(), b[order].tolist()):
        if p != at:
            at, state = p, start()
        out.append(step(state, top, bottom))
    got[order] = out
    return got


def bucket_rounds(page: np.ndarray, t: np.ndarray, b: np.ndarray, tolerance: float) -> np.ndarray:
    """``bucket_rule`` for boxes sorted by page and top, none upside down: a bucket of every page in each round.

    The first word left founds a bucket, and all words left that are near it go there: no bucket before takes
    them, and none after comes first. Only words down to where the rule gives a bucket up can be near.
    """
    mid, n = (t + b) / 2, len(page)
    known, top = np.unique(t, return_inverse=True)
    key = page * (len(known) + 1) + top
    heads = runs(page)
    stop = np.append(heads[1:], n)
    got = np.full(n + 1, -1)
    got[n] = 0
    at, k = heads, 0
    while len(at):
        lowest = np.searchsorted(known, np.maximum(t[at], mid[at]) + tolerance, "right")
        end = np.searchsorted(key, page[at] * (len(known) + 1) + lowest)
        near, size = spans(at, end), end - at
        founder = np.repeat(at, size)
        hit = (got[near] < 0) & ((np.abs(mid[near] - mid[founder]) <= tolerance) | (np.abs(t[near] - t[founder]) <= tolerance))
        got[near[hit]] = k
        left = np.where(got[near] < 0, near, n)
        at = np.minimum(np.minimum.reduceat(left, np.cumsum(size) - size), end)
        while len(past := np.flatnonzero((at < stop) & (got[at] >= 0))):
            at[past] += 1
        at, stop = at[at < stop], stop[at < stop]
        k += 1
    return got[:n]


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def lines(page: np.ndarray, word_no: np.ndarray, l: np.ndarray, t: np.ndarray, r: np.ndarray, b: np.ndarray, bucket: np.ndarray, max_gap: float | np.ndarray) -> Lines:  # noqa: E741
    """The line fragments of ``layout.lines``: a word starts a new one after a gap that is negative or larger."""
    if not len(page):
        return Lines(page, l, t, r, b, np.empty(0, np.int64), np.zeros(1, np.int64))
    across = sorted_by(page, bucket, l, t, word_no)
    gap = np.empty(len(page))
    gap[1:] = l[across][1:] - r[across][:-1]
    most = max_gap[across] if isinstance(max_gap, np.ndarray) else max_gap
    new = ~((gap >= 0) & (gap <= most))
    new[runs(page[across], bucket[across])] = True
    starts = np.flatnonzero(new)
    left, top, right, bottom = (f.reduceat(x[across], starts) for f, x in ((np.minimum, l), (np.minimum, t), (np.maximum, r), (np.maximum, b)))
    of = page[across][starts]
    down = sorted_by(of, top, left)  # fragments stand in order of bucket and place already
    ends = np.append(starts[1:], len(page))
    cuts = np.append(0, np.cumsum((ends - starts)[down]))
    return Lines(of[down], left[down], top[down], right[down], bottom[down], across[spans(starts[down], ends[down])], cuts)


def reach(page: np.ndarray, r: np.ndarray) -> np.ndarray:
    """For boxes sorted by page and left edge: the largest right edge before each in its page, -inf for the first."""
    edges, rank = np.unique(r, return_inverse=True)
    top = np.maximum.accumulate(page * len(edges) + rank)  # as whole numbers, so that no edge is rounded
    out = np.full(len(r), -np.inf)
    out[1:] = edges[top[:-1] % len(edges)]
    out[runs(page)] = -np.inf
    return out


class Zones(NamedTuple):
    """Table zones (page, number in the page) and the words in them, a word in each zone that holds it."""

    page: np.ndarray
    number: np.ndarray
    word: np.ndarray
    zone: np.ndarray


def zoned(page: np.ndarray, l: np.ndarray, r: np.ndarray, width: float, least: float) -> Zones:  # noqa: E741
    """The zones of ``layout.zoned`` for the words within the margins."""
    wide = r - l >= 0.45 * width
    narrow = np.zeros(int(page.max(initial=-1)) + 1, bool)
    narrow[page[~wide]] = True
    use = np.flatnonzero(~wide | ~narrow[page])
    use = use[sorted_by(page[use], l[use], r[use])]
    of, left, right = page[use], l[use], r[use]
    before = reach(of, right)
    first = np.zeros(len(use), bool)
    heads = runs(of)
    first[heads] = True
    gap = left - before
    cut = first | ((gap > 0) & (gap >= least))
    zone_page, zone_l, stop = of[cut], left[cut], before[cut]
    zone_start = runs(zone_page)
    zone_r = np.empty(len(zone_l))
    zone_r[:-1] = stop[1:]
    if len(heads):
        zone_r[np.append(zone_start[1:], len(zone_l)) - 1] = np.maximum.reduceat(right, heads)
    number = np.arange(len(zone_l)) - np.repeat(zone_start, np.diff(np.append(zone_start, len(zone_l))))
    start, many = np.zeros(len(narrow), np.int64), np.zeros(len(narrow), np.int64)
    start[zone_page[zone_start]] = zone_start
    many[zone_page[zone_start]] = np.diff(np.append(zone_start, len(zone_l)))
    mid, word, zone = (l + r) / 2, [], []
    rest = np.arange(len(page))
    for k in range(int(many.max(initial=0))):
        rest = rest[many[page[rest]] > k]
        z = start[page[rest]] + k
        hit = (mid[rest] >= zone_l[z] - 2) & (mid[rest] <= zone_r[z] + 2)
        word.append(rest[hit])
        zone.append(z[hit])
    word, zone = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (word, zone))
    full = np.bincount(zone, minlength=len(zone_l)) >= 2
    new = np.cumsum(full) - 1
    keep = full[zone]
    order = sorted_by(zone[keep], word[keep])
    return Zones(zone_page[full], number[full], word[keep][order], new[zone[keep]][order])


def first_bucket(zone: np.ndarray, word_no: np.ndarray, t: np.ndarray, b: np.ndarray, l: np.ndarray, word: np.ndarray, top: np.ndarray, tolerance: float) -> np.ndarray:  # noqa: E741
    """Which of the words of the zones (sorted by zone) are in the first bucket of their zone.

    The first line is one of that bucket: its founder is the first word at the zone's top, all words at the top
    are near it, and no word asks another bucket before it.
    """
    high = np.flatnonzero(t[word] == top[zone])
    high = high[np.lexsort((word_no[word[high]], l[word[high]], zone[high]))]
    founder = word[high[runs(zone[high])]]
    mid = (t + b) / 2
    return np.flatnonzero((np.abs(mid[word] - mid[founder][zone]) <= tolerance) | (np.abs(t[word] - top[zone]) <= tolerance))


def reached(page: np.ndarray, t: np.ndarray, b: np.ndarray, lowest: np.ndarray, tolerance: float) -> np.ndarray:
    """For each page the top down to which words can share a line with one whose box begins at ``lowest`` or above.

    Boxes that are upside down may be near any bucket; pages with some are needed in full.
    """
    high = t <= lowest[page]
    out = np.full(len(lowest), -np.inf)
    np.maximum.at(out, page[high], np.maximum(t, (t + b) / 2)[high] + tolerance)
    out[page[b < t]] = np.inf
    return out


def zone_titles(block: Block, width: float, least: float, stops: tuple[str, ...]) -> list[pa.Array]:
    """For words within the margins: zones with their boxes, their first lines and the nearest lines above them (null where there is none)."""
    page, word_no, l, t, r, b = block.page, block["word_no"], block.l, block.t, block.r, block.b  # noqa: E741
    z = zoned(page, l, r, width, least)
    w, heads = z.word, runs(z.zone)
    zl, zt, zr, zb = (f.reduceat(x[w], heads) if len(heads) else np.empty(0) for f, x in ((np.minimum, l), (np.minimum, t), (np.maximum, r), (np.maximum, b)))
    n_words = np.diff(np.append(heads, len(w)))
    w = first_bucket(z.zone, word_no, t, b, l, w, zt, 3.5)
    own = lines(z.zone[w], *(x[z.word[w]] for x in (word_no, l, t, r, b)), np.zeros(len(w), np.int64), 15.0)
    word, cuts = own.of(runs(own.page))
    first = block.texts(z.word[w[word]], cuts)

    lowest = np.full(int(page.max(initial=-1)) + 1, -np.inf)
    np.maximum.at(lowest, z.page, zt + 15)
    top = np.flatnonzero(t <= reached(page, t, b, lowest, 4.0)[page])
    box = tuple(x[top] for x in (page, word_no, l, t, r, b))
    every = lines(*box, buckets(*box[:4], box[5], 4.0), 20.0)
    lo, hi = np.searchsorted(every.page, z.page), np.searchsorted(every.page, z.page, "right")
    zone = np.repeat(np.arange(len(z.page)), hi - lo)
    line = np.arange(len(zone)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    above, mid = zt[zone] - every.b[line], (every.l[line] + every.r[line]) / 2
    near = (every.b[line] <= zt[zone] + 15) & (above <= 50) & (mid >= zl[zone] - 25) & (mid <= zr[zone] + 25)
    zone, line, far = zone[near], line[near], np.abs(above[near])
    seen, nth = np.unique(line, return_inverse=True)
    word, cuts = every.of(seen)
    texts = block.texts(top[word], cuts)
    plain = np.ones(len(seen), bool)
    for x in stops:
        plain &= ~pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
    plain = plain[nth]
    zone, line, far, nth = zone[plain], line[plain], far[plain], nth[plain]
    order = np.lexsort((line, far, zone))
    best = order[runs(zone[order])]
    title = np.full(len(z.page), -1)
    title[zone[best]] = nth[best]
    title = texts.take(pa.array(title, mask=title < 0))
    found = [pa.array(z.number, pa.int32()), title, first, *(pa.array(x, pa.float64()) for x in (zl, zt, zr, zb)), pa.array(n_words, pa.int64())]
    return [*block.keys(z.page), *found]


def block_lines(block: Block, max_gap: float | None, tolerance: float, median_gap: float) -> tuple[Lines, np.ndarray]:
    """Lines of the block's pages and where those of each page start; without ``max_gap`` ``median_gap`` medians."""
    most: float | np.ndarray = 0.0 if max_gap is None else max_gap
    if max_gap is None:
        h, cuts = block.b - block.t, np.append(block.first, len(block.page))
        most = np.repeat(median_gap * medians(block.page, h, len(block.first)), np.diff(cuts))
    box = (block.page, block["word_no"], block.l, block.t, block.r, block.b)
    found = lines(*box, buckets(*box[:4], box[5], tolerance), most)
    return found, np.searchsorted(found.page, np.arange(len(block.first) + 1))


def median(heights: np.ndarray) -> float:
    high = heights[heights > 2]
    return float(np.median(high)) if len(high) else 10.0


def medians(page: np.ndarray, heights: np.ndarray, n: int) -> np.ndarray:
    """``median`` of each page."""
    high = heights > 2
    of, h = page[high], heights[high]
    h = h[sorted_by(of, h)]
    many = np.bincount(of, minlength=n)
    start, out = np.cumsum(many) - many, np.full(n, 10.0)
    has = many > 0
    out[has] = (h[(start + (many - 1) // 2)[has]] + h[(start + many // 2)[has]]) / 2
    return out


def line_lists(block: Block, max_gap: float | None, tolerance: float, median_gap: float) -> list[pa.Array]:
    """One row a page: its lines in order."""
    found, cuts = block_lines(block, max_gap, tolerance, median_gap)
    fields = [block.texts(found.word, found.cuts), *(pa.array(x, pa.float64()) for x in (found.l, found.t, found.r, found.b)), pa.array(np.diff(found.cuts), pa.int64())]
    held = pa.StructArray.from_arrays(fields, names=["text", *BOX, "n_words"])
    return [*block.keys(np.arange(len(block.first))), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), held)]


def rows_of(block: Block, z: Zones, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of zones as rows by baseline: the order of ``z.word``, where rows start, and the words' buckets."""
    l, t, b, word_no = (x[z.word] for x in (block.l, block.t, block.b, block["word_no"]))  # noqa: E741
    bucket = buckets(z.zone, word_no, l, t, b, tolerance)
    order = sorted_by(z.zone, bucket, l, t, word_no)
    return order, runs(z.zone[order], bucket[order]), bucket


def zone_rows(block: Block, width: float, least: float, tolerance: float) -> list[pa.Array]:
    """The words of zones as rows by baseline, with their confidence if there is one."""
    z = zoned(block.page, block.l, block.r, width, least)
    order, starts, bucket = rows_of(block, z, tolerance)
    zone = z.zone[order][starts]
    c = block["confidence"].astype(float)[z.word][order] if "confidence" in block.table.column_names else np.ones(len(order))
    if len(starts):
        known = np.add.reduceat((~np.isnan(c)).astype(float), starts)
        mean, low = np.divide(np.add.reduceat(np.nan_to_num(c), starts), known, out=np.full(len(starts), np.nan), where=known > 0), np.fmin.reduceat(c, starts)
    else:
        mean = low = np.empty(0)
    texts = block.texts(z.word[order], np.append(starts, len(order)))
    found = [pa.array(z.number[zone], pa.int32()), pa.array(bucket[order][starts], pa.int64()), texts, *(pa.array(x, pa.float64(), from_pandas=True) for x in (mean, low))]
    return [*block.keys(z.page[zone]), *found]


def outside(block: Block, boxes: list[np.ndarray], page: np.ndarray) -> np.ndarray:
    """Which words are in none of the boxes (l, t, r, b) of their page."""
    known, top = np.unique(block.t, return_inverse=True)
    key = block.page * (len(known) + 1) + top
    order = np.argsort(key, kind="stable")
    key = key[order]
    l, t, r, b = boxes  # noqa: E741
    lo, hi = (np.searchsorted(key, page * (len(known) + 1) + np.searchsorted(known, x, side)) for x, side in ((t, "left"), (b, "right")))
    hi = np.maximum(lo, hi)
    word, box = order[spans(lo, hi)], np.repeat(np.arange(len(page)), hi - lo)
    out = np.ones(len(key), bool)
    out[word[(block.l[word] >= l[box]) & (block.r[word] <= r[box]) & (block.b[word] <= b[box])]] = False
    return out


def in_order(text: list[str], l: np.ndarray, t: np.ndarray, r: np.ndarray, b: np.ndarray, prefix: list, primary: list, secondary: list, width: float, height: float, rule: tuple) -> list[tuple]:  # noqa: E741
    """Reading order of a page's lines: (line, section path, band, column)."""
    start, step, gutter, heading_height = rule
    med = median(b - t)
    heading = (b - t >= heading_height * med) | (r - l >= 0.35 * width) | np.array([bool(x) for x in prefix], bool)
    state, band = start(), []
    for h, top, bottom in zip(heading.tolist(), t.tolist(), b.tolist()):
        band.append(step(state, h, top > 0.88 * height, top, bottom, med))
    band = np.array(band)
    out = []
    for own in np.split(np.arange(len(band)), runs(band)[1:]):
        head = next((i for i in own.tolist() if heading[i]), None)
        head_line = head if head is None else next(i for i in own.tolist() if text[i] == text[head])
        body = own[own != head_line] if head is not None else own
        narrow = body[r[body] - l[body] < 0.65 * width]
        narrow = narrow[np.lexsort((r[narrow], l[narrow]))]
        before = np.maximum.accumulate(r[narrow])[:-1]
        gap = l[narrow][1:] - before
        cut = (gap > 5.0) & (gap >= gutter)
        gutters = (before[cut] + l[narrow][1:][cut]) / 2
        left = np.searchsorted(gutters, (l[body] + r[body]) / 2)
        column = np.unique(left, return_inverse=True)[1]
        top_path = [] if head is None else [text[head]]
        if head_line is not None:
            out.append((head_line, top_path, int(band[head_line]), 0))
        at, p, s = None, None, None
        for j in np.lexsort((body, l[body], t[body], column)).tolist():
            i = int(body[j])
            if column[j] != at:
                at, p, s = column[j], None, None
            if primary[i]:
                p, s = text[i], None  # a level below starts anew
            elif secondary[i]:
                s = text[i]
            out.append((i, top_path + [x for x in (p, s) if x is not None], int(band[i]), int(column[j])))
    return out


class Ordered(NamedTuple):
    """The lines of a block in reading order, with the line that heads their band (-1: none)."""

    line: np.ndarray
    head: np.ndarray


def in_order_all(found: Lines, prefix: np.ndarray, width: float, height: float, gutter: float, heading_height: float, band_gap: float) -> Ordered:
    """``in_order`` without headings within columns, for all pages of a block."""
    page, l, t, r, b = found[:5]  # noqa: E741
    n, starts = len(page), runs(page)
    first = np.zeros(n, bool)
    first[starts] = True
    med = medians(page, b - t, int(page.max(initial=-1)) + 1)[page]
    heading = (b - t >= heading_height * med) | (r - l >= 0.35 * width) | prefix
    new = first | heading | (t > 0.88 * height)
    wide = np.zeros(n, bool)
    wide[1:] = t[1:] - b[:-1] > (band_gap * med)[1:]
    at = np.flatnonzero(new)
    opened = at[np.cumsum(new) - 1] if n else at  # where a band begins that its first line alone decides
    loose = np.flatnonzero(wide & ~new & ~heading[opened])
    last, begun = -1, 0
    for i, o in zip(loose.tolist(), opened[loose].tolist()):  # three lines at least, then a wide gap
        begun = begun if o == last else o
        last = o
        if i - begun >= 3:
            new[i] = True
            begun = i
    band = np.cumsum(new) - 1
    opens = np.flatnonzero(new)
    head = np.where(heading[opens], opens, -1)[band]
    body = head != np.arange(n)
    narrow = np.flatnonzero(body & (r - l < 0.65 * width))
    narrow = narrow[sorted_by(band[narrow], l[narrow], r[narrow])]
    before = reach(band[narrow], r[narrow])
    gap = l[narrow] - before
    cut = np.isfinite(before) & (gap > 5.0) & (gap >= gutter)
    of, at = band[narrow][cut], ((before + l[narrow]) / 2)[cut]
    many = np.bincount(of, minlength=len(opens))
    start, left, mid = np.cumsum(many) - many, np.zeros(n, np.int64), (l + r) / 2
    rest, k = np.flatnonzero(body & (many[band] > 0)), 0
    while len(rest):  # gutters from left to right: a line left of one is left of all that follow
        rest = rest[at[start[band[rest]] + k] < mid[rest]]
        left[rest] += 1
        k += 1
        rest = rest[many[band[rest]] > k]
    return Ordered(line := sorted_by(band, np.where(body, left + 1, 0)), head[line])


def packs(page: np.ndarray, path: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """Where ``documents.chunk_rule`` starts packs, for the blocks of all pages in order."""
    total = np.append(0, np.cumsum(length))
    heads = runs(page, path)
    starts = []
    for a, z in zip(heads.tolist(), np.append(heads[1:], len(page)).tolist()):
        while a < z:
            starts.append(a)
            a = min(z, max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1))
    return np.array(starts, np.int64)
