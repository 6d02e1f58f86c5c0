"""Page layout from word boxes: lines, bands, columns, reading order, legends, tables.

A word is a row (document_id, page_number, word_no, text, l, t, r, b, ...) with the origin at the top
left. Everything is partitioned by (document_id, page_number) once; rules over neighbours are window
functions, and the two rules that depend on earlier decisions are streaming folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioframe.functions import text as T
from folioframe.operators import pages
from folioframe.operators.folds import bucket_rule, running_fold

PAGE = ["document_id", "page_number"]
LINE_GAP, BAND_GAP, GUTTER, HEADING = 2.5, 3.5, 0.0227, 2.5


def derived(words: DataFrame) -> DataFrame:
    return words.withColumns({
        "width": F.greatest(F.lit(0.0), F.col("r") - F.col("l")), "height": F.greatest(F.lit(0.0), F.col("b") - F.col("t")),
        "mid_x": (F.col("l") + F.col("r")) / 2, "mid_y": (F.col("t") + F.col("b")) / 2,
    })


def flipped(words: DataFrame, page_height: Column) -> DataFrame:
    """Boxes with a bottom-left origin turned over; every other column (confidence too) stays."""
    up = F.upper(F.coalesce(F.col("coord_origin"), F.lit("TOPLEFT"))).contains("BOTTOMLEFT")
    t, b = F.round(page_height - F.greatest("t", "b"), 2), F.round(page_height - F.least("t", "b"), 2)
    return words.withColumns({"t": F.when(up, t).otherwise(F.col("t")), "b": F.when(up, b).otherwise(F.col("b")), "coord_origin": F.lit("TOPLEFT")})


def perturbed(words: DataFrame, scale_x: float = 1.0, scale_y: float = 1.0, shift_x: float = 0.0, shift_y: float = 0.0) -> DataFrame:
    move = lambda c, k, s: F.round(F.col(c) * k + s, 3)
    return words.withColumns({"l": move("l", scale_x, shift_x), "r": move("r", scale_x, shift_x), "t": move("t", scale_y, shift_y), "b": move("b", scale_y, shift_y)})


def median_height(boxes: DataFrame) -> DataFrame:
    h = F.col("b") - F.col("t")
    return boxes.groupBy(*PAGE).agg(F.coalesce(F.percentile(F.when(h > 2, h), 0.5), F.lit(10.0)).alias("median_height"))


def bucketed(words: DataFrame, tolerance: float) -> DataFrame:
    """Adds ``bucket``: the first earlier bucket whose first word is near in top or middle, else a new one."""
    return running_fold(words, PAGE, ["t", "l", "word_no"], ["t", "b"], *bucket_rule(tolerance), "bucket")


def lines(words: DataFrame, max_gap: float | None = None, tolerance: float = 5.0) -> DataFrame:
    """Line fragments (text, l, t, r, b, n_words, line_no): a word starts a new one after a gap that is
    negative or larger than ``max_gap`` (by default 2.5 median heights of the page)."""
    page = Window.partitionBy(*PAGE)
    w = words
    if max_gap is None:
        h = F.col("b") - F.col("t")
        w = w.withColumn("_most", LINE_GAP * F.coalesce(F.percentile(F.when(h > 2, h), 0.5).over(page), F.lit(10.0)))
    else:
        w = w.withColumn("_most", F.lit(float(max_gap)))
    w = bucketed(w, tolerance).repartition(*PAGE)  # serves the windows and the aggregate below
    across = Window.partitionBy(*PAGE, "bucket").orderBy("l", "t", "word_no")
    gap = F.col("l") - F.lag("r").over(across)
    w = w.withColumn("_new", F.when((gap >= 0) & (gap <= F.col("_most")), 0).otherwise(1))
    w = w.withColumn("fragment", F.sum("_new").over(across))
    word = F.struct("l", "t", "word_no", "text")
    agg = [F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"), F.count("*").alias("n_words"), F.array_sort(F.collect_list(word)).alias("ws")]
    if "confidence" in words.columns:
        agg += [F.avg("confidence").alias("confidence"), F.min("confidence").alias("least_confidence")]
    out = w.groupBy(*PAGE, "bucket", "fragment").agg(*agg)
    out = out.withColumn("text", T.collapse(F.array_join(F.transform("ws", lambda x: x["text"]), " "))).drop("ws")
    order = Window.partitionBy(*PAGE).orderBy("t", "l", "bucket", "fragment")
    return out.withColumn("line_no", F.row_number().over(order).cast("long")).drop("bucket", "fragment")


def new_band() -> dict:
    return {"band": 0, "n": 0, "headed": False, "b": None}


def next_band(s: dict, heading: bool, footer: bool, t: float, b: float, med: float) -> int:
    wide = s["b"] is not None and t - s["b"] > BAND_GAP * med and s["n"] >= 3 and not s["headed"]
    if s["b"] is not None and s["n"] and (heading or footer or wide):
        s["band"] += 1
        s["n"], s["headed"] = 0, False
    s["headed"] = s["headed"] or heading
    s["n"] += 1
    s["b"] = b
    return s["band"]


def bands(page_lines: DataFrame, width: float, height: float, prefix: str = T.HEADING_PREFIX) -> DataFrame:
    """Adds ``band`` (from 0) and the band's ``heading`` (its first heading line, or null)."""
    page = Window.partitionBy(*PAGE)
    h = F.col("b") - F.col("t")
    marked = page_lines.withColumn("_med", F.coalesce(F.percentile(F.when(h > 2, h), 0.5).over(page), F.lit(10.0)))
    marked = marked.withColumn("is_heading", (h >= HEADING * F.col("_med")) | (F.col("r") - F.col("l") >= 0.35 * width) | F.col("text").rlike(prefix))
    marked = marked.withColumn("_footer", F.col("t") > 0.88 * height)

    out = running_fold(marked, PAGE, ["line_no"], ["is_heading", "_footer", "t", "b", "_med"], new_band, next_band, "band")
    inside = Window.partitionBy(*PAGE, "band").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heading = F.first(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(inside)
    return out.withColumn("heading", heading).drop("_med", "_footer")


def interval_gaps(boxes: DataFrame, keys: list[str], slack: float, least: Column) -> DataFrame:
    """Gaps (gap_l, gap_r) of the union of the boxes' x-intervals: wider than ``slack``, at least ``least``."""
    order = Window.partitionBy(*keys).orderBy("l", "r").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("r").over(order)
    found = boxes.withColumn("gap_l", reach).withColumn("gap_r", F.col("l"))
    gap = F.col("gap_r") - F.col("gap_l")
    return found.filter((gap > slack) & (gap >= least)).select(*keys, "gap_l", "gap_r")


def columns(banded: DataFrame, width: float, least: float | None = None) -> DataFrame:
    """Adds ``column``: dense number of the gutters left of a line's middle, within its band.

    Lines marked ``is_band_heading`` make no gutter and are in column 0. Gutters are the gaps of
    ``interval_gaps`` over narrow lines, found by windows on the rows themselves, so nothing is joined.
    """
    if "is_band_heading" not in banded.columns:
        return columns(banded.withColumn("is_band_heading", F.lit(False)), width, least).drop("is_band_heading")
    keys, head = [*PAGE, "band"], F.col("is_band_heading")
    narrow = ~head & (F.col("r") - F.col("l") < 0.65 * width)
    earlier = Window.partitionBy(*keys).orderBy("l", "r").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(narrow, F.col("r"))).over(earlier)
    gap = F.col("l") - F.col("_reach")
    found = narrow & (gap > 5.0) & (gap >= (GUTTER * width if least is None else least))
    gutter = F.when(found, (F.col("_reach") + F.col("l")) / 2)
    mid = (F.col("l") + F.col("r")) / 2
    placed = banded.withColumn("_reach", reach).withColumn("_gutters", F.collect_list(gutter).over(Window.partitionBy(*keys)))
    placed = placed.withColumn("_left", F.size(F.filter("_gutters", lambda g: g < mid)))
    nth = F.dense_rank().over(Window.partitionBy(*keys, "is_band_heading").orderBy("_left")) - 1
    return placed.withColumn("column", F.when(head, 0).otherwise(nth)).drop("_reach", "_gutters", "_left")


def reading_order(words: DataFrame, width: float, height: float, primary: str | None = None, secondary: tuple[str, ...] = ()) -> DataFrame:
    """Blocks in reading order (block_no) with their section path: band heading, primary, secondary heading.

    ``primary`` is a pattern of headings within a column, ``secondary`` the texts of the level below.
    """
    every = ordered_pages(words, width, height, primary, secondary).select(*PAGE, F.posexplode("blocks").alias("_at", "_block"))
    return every.select(*PAGE, (F.col("_at") + 1).cast("long").alias("block_no"), "_block.*")


LINE_LIST = "array<struct<text:string,l:double,t:double,r:double,b:double,n_words:bigint>>"
BLOCK_LIST = "array<struct<text:string,section_path:array<string>,band:bigint,column:int,l:double,t:double,r:double,b:double,n_words:bigint>>"


def line_pages(words: DataFrame, max_gap: float | None = None, tolerance: float = 5.0) -> DataFrame:
    """The lines of ``lines`` as one row a page (PAGE, lines), in order: no rule on a page's lines deals them out."""
    listed = pages.by_page(words, lambda block: pages.line_lists(block, max_gap, tolerance, LINE_GAP), StructType.fromDDL(f"lines {LINE_LIST}"))
    return listed.withColumn("lines", F.transform("lines", lambda x: x.withField("text", T.collapse(x["text"]))))


def ordered_pages(words: DataFrame, width: float, height: float, primary: str | None = None, secondary: tuple[str, ...] = ()) -> DataFrame:
    """The blocks of ``reading_order`` as one row a page (PAGE, blocks)."""
    is_primary = lambda c: F.coalesce(c.rlike(primary), F.lit(False)) if primary else F.lit(False)
    is_secondary = lambda c: c.isin(*secondary) if secondary else F.lit(False)
    flags = lambda f: F.transform("lines", lambda x: f(x["text"]))
    listed = line_pages(words).select(*PAGE, "lines", flags(lambda c: c.rlike(T.HEADING_PREFIX)).alias("prefix"), flags(is_primary).alias("primary"), flags(is_secondary).alias("secondary"))
    rule = (new_band, next_band, GUTTER * width, HEADING)
    pages.small_batches(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pages.few(batches):
            held = batch.column(2)
            cuts, at = held.offsets.to_numpy() - held.offsets[0].as_py(), held.flatten()
            text = at.field("text").to_pylist()
            box = [at.field(c).to_numpy() for c in "ltrb"]
            flag = [batch.column(k).flatten().to_pylist() for k in (3, 4, 5)]
            rows = []
            for a, z in zip(cuts.tolist(), cuts[1:].tolist()):
                rows += [(a + i, *x) for i, *x in pages.in_order(text[a:z], *(c[a:z] for c in box), *(f[a:z] for f in flag), width, height, rule)]
            line, path, band, column = zip(*rows) if rows else ((), (), (), ())
            own = at.take(pa.array(line, pa.int64()))
            fields = [own.field("text"), pa.array(path, pa.list_(pa.string())), pa.array(band, pa.int64()), pa.array(column, pa.int32()), *(own.field(c) for c in (*"ltrb", "n_words"))]
            blocks = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(fields, names=["text", "section_path", "band", "column", *"ltrb", "n_words"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blocks], names=[*PAGE, "blocks"])

    return listed.mapInArrow(run, StructType([listed.schema[c] for c in PAGE] + StructType.fromDDL(f"blocks {BLOCK_LIST}").fields))


def zone_rows(words: DataFrame, width: float, height: float, tolerance: float = 4.0) -> DataFrame:
    """``table_rows`` of the words of ``zoned``, the zones as pages of their own."""
    more = ("confidence",) if "confidence" in words.columns else ()
    found = StructType.fromDDL("zone_id int, row_no long, text string, mean_confidence double, least double")
    rows = pages.by_page(content(words, height), lambda block: pages.zone_rows(block, width, max(2.5, 0.003 * width), tolerance), found, more)
    return zone_pages(rows.withColumn("text", T.strip(F.col("text"))).filter("text <> ''")).drop("zone_id")


def legend(words: DataFrame) -> DataFrame:
    """Numbered items (1..50, the topmost of each number) with the footnote of their marker."""
    found = lines(words, 35.0, 7.0).withColumn("text", T.strip(F.col("text")))
    note = r"^(\*+|†|‡)\s*(.+)$"
    notes = found.filter(F.col("text").rlike(note)).select(*PAGE, F.regexp_extract("text", note, 1).alias("marker"), T.strip(F.regexp_extract("text", note, 2)).alias("footnote"), "line_no")
    notes = notes.groupBy(*PAGE, "marker").agg(F.max_by("footnote", "line_no").alias("footnote"))
    item = r"^(\d{1,2})[.):\-\s]*\s*(\*+|†)?\s*(.+)$"
    items = found.filter(F.col("text").rlike(item)).withColumns({"number": F.regexp_extract("text", item, 1).cast("int"), "marker": F.regexp_extract("text", item, 2), "label": T.strip(F.regexp_extract("text", item, 3))})
    starred = (F.col("marker") != "") | F.substring_index("text", ":", 1).contains("*")
    items = items.withColumn("has_marker", starred).withColumn("marker", F.when(F.col("marker") != "", F.col("marker")).when(starred, "*").otherwise(""))
    top = Window.partitionBy(*PAGE, "number").orderBy("t", "line_no")
    items = items.withColumn("nth", F.row_number().over(top)).filter("nth = 1 and number between 1 and 50").drop("nth")
    out = items.join(notes, [*PAGE, "marker"], "left")
    return out.select(*PAGE, "number", T.strip(F.substring_index("label", ":", 1)).alias("name"), F.col("text").alias("full_text"), "has_marker", "marker", F.coalesce("footnote", F.lit("")).alias("footnote"), "l", "t", "r", "b")


def content(words: DataFrame, height: float, margin: float = 0.08) -> DataFrame:
    return words.filter((F.col("t") >= height * margin) & (F.col("b") <= height * (1 - margin)))


def x_gaps(words: DataFrame, width: float, ratio: float = 0.003, points: float = 2.5) -> DataFrame:
    return interval_gaps(words, PAGE, 0.0, F.lit(max(points, ratio * width)))


def zoned(words: DataFrame, width: float, height: float) -> DataFrame:
    """Words of table zones (zone_id, zone_l, zone_r): every zone whose range, widened by 2, holds the middle."""
    inside = content(words, height)
    wide = F.col("r") - F.col("l") >= 0.45 * width
    page = Window.partitionBy(*PAGE)
    use = inside.withColumn("_narrow", F.count_if(~wide).over(page)).filter(~wide | (F.col("_narrow") == 0)).drop("_narrow")
    ends = use.groupBy(*PAGE).agg(F.min("l").alias("first"), F.max("r").alias("last"))
    gaps = x_gaps(use, width).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("gap_l", "gap_r"))).alias("gaps"))
    none = F.array().cast("array<struct<gap_l:double,gap_r:double>>")
    g = F.coalesce("gaps", none)
    starts = F.concat(F.array("first"), F.transform(g, lambda x: x["gap_r"]))
    stops = F.concat(F.transform(g, lambda x: x["gap_l"]), F.array("last"))
    ranges = ends.join(gaps, PAGE, "left").select(*PAGE, F.posexplode(F.arrays_zip(starts.alias("zone_l"), stops.alias("zone_r"))).alias("zone_id", "z")).select(*PAGE, "zone_id", "z.*")
    mid = (F.col("l") + F.col("r")) / 2
    placed = inside.join(ranges, PAGE).filter(mid.between(F.col("zone_l") - 2, F.col("zone_r") + 2))
    full = Window.partitionBy(*PAGE, "zone_id")
    return placed.withColumn("_n", F.count("*").over(full)).filter("_n >= 2").drop("_n")


def zone_pages(words: DataFrame) -> DataFrame:
    """Zones as pages of their own, so that the page operators work within them."""
    return words.withColumn("document_id", F.struct("document_id", "page_number")).withColumn("page_number", F.col("zone_id"))


def table_zones(words: DataFrame, width: float, height: float) -> DataFrame:
    """Zones (zone_id, title, box, n_words): the title is the nearest line above, else the first line.

    A page's words are read once, as a block: the words of its zones (``zoned``), the lines of these and those
    of the page need no further shuffle or join. Words without a full box take no part.
    """
    found = StructType.fromDDL("zone_id int, title string, first_line string, zl double, zt double, zr double, zb double, n_words long")
    least, stops = max(2.5, 0.003 * width), (":", "lbs", "rpm", "hp")
    z = pages.by_page(content(words, height), lambda block: pages.zone_titles(block, width, least, stops), found)
    first, title = T.collapse(F.col("first_line")), T.collapse(F.col("title"))
    return z.select(*PAGE, "zone_id", F.coalesce(title, first).alias("title"), first.alias("first_line"), "zl", "zt", "zr", "zb", "n_words")


def table_rows(words: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Rows of a zone's words by baseline (row_no in order of appearance), with their confidence."""
    w = words if "confidence" in words.columns else words.withColumn("confidence", F.lit(1.0))
    b = bucketed(w, tolerance)
    word = F.struct("l", "t", "word_no", "text")
    rows = b.groupBy(*PAGE, F.col("bucket").alias("row_no")).agg(F.array_sort(F.collect_list(word)).alias("ws"), F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("least"))
    return rows.select(*PAGE, "row_no", T.strip(F.array_join(F.transform("ws", lambda x: x["text"]), " ")).alias("text"), "mean_confidence", "least").filter("text <> ''")


def table_records(rows: DataFrame) -> DataFrame:
    """Key/value records of the rows of a page (or zone), with section, units, footnotes and confidence.

    A row is a footnote, else a section header, else a record. A footnote goes to the latest record that
    holds a marker, else to the latest record.
    """
    kv = T.key_value(F.col("text"))
    note, header = T.is_footnote(F.col("text")), T.is_section_header(F.col("text"))
    r = rows.withColumns({"is_note": note, "is_header": ~note & header, "kv": F.when(~note & ~header, kv)})
    r = r.filter("is_note or is_header or kv is not null")  # others decide nothing and stay where they are
    down = Window.partitionBy(*PAGE).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    marker = F.lit(False)
    for m in ("*", '"', "”", "Run Time"):
        marker = marker | F.col("kv.attribute").contains(m) | F.col("kv.value").contains(m)
    r = r.withColumns({
        "section": F.coalesce(F.last(F.when(F.col("is_header"), F.col("text")), True).over(down), F.lit("GENERAL")),
        "_any": F.last(F.when(F.col("kv").isNotNull(), F.col("row_no")), True).over(down),
        "_marked": F.last(F.when(F.col("kv").isNotNull() & marker, F.col("row_no")), True).over(down),
    })
    notes = r.filter("is_note").select(*PAGE, F.coalesce("_marked", "_any").alias("to"), F.struct("row_no", T.footnote_text(F.col("text")).alias("text")).alias("note")).filter("to is not null")
    notes = notes.groupBy(*PAGE, F.col("to").alias("row_no")).agg(F.transform(F.array_sort(F.collect_list("note")), lambda x: x["text"]).alias("footnotes"))
    out = r.filter("kv is not null").join(notes, [*PAGE, "row_no"], "left")
    low = (F.col("mean_confidence") < 0.75) | (F.col("least") < 0.60)
    return out.select(
        *PAGE, "row_no", "section", "kv.attribute", "kv.value", T.unit_variants(F.col("kv.value")).alias("units"),
        F.array_join(F.coalesce("footnotes", F.array().cast("array<string>")), "; ").alias("footnotes"), F.round("mean_confidence", 3).alias("confidence"), low.alias("low_confidence"),
    )


def markdown(records: DataFrame, keys: list[str], title: str = "title") -> DataFrame:
    """One Markdown table for each key, rows in order of ``row_no``, pipes escaped."""
    esc = lambda c: F.replace(F.col(c), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.col("section"), F.lit(" | "), esc("attribute"), F.lit(" | "), esc("value"), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", line.alias("line")))), lambda x: x["line"]), "\n")
    return records.groupBy(*keys, title).agg(body.alias("body")).select(*keys, F.concat(F.lit("### "), F.col(title), F.lit("\n\n| Section | Attribute | Value |\n| --- | --- | --- |\n"), "body").alias("markdown"))


def column_estimate(blocks: DataFrame, width: float) -> DataFrame:
    """1 to 3 columns from thirds of the page that hold enough narrow blocks."""
    narrow = F.col("r") - F.col("l") < 0.75 * width
    third = F.least(F.lit(2), F.floor((F.col("l") + F.col("r")) / 2 / (width / 3)).cast("int"))
    per = blocks.groupBy(*PAGE).agg(F.count("*").alias("n"), F.count_if(narrow).alias("body"), *(F.count_if(narrow & (third == k)).alias(f"c{k}") for k in range(3)))
    enough = F.greatest(F.lit(2.0), 0.15 * F.col("body"))
    active = sum((F.col(f"c{k}") >= enough).cast("int") for k in range(3))
    return per.select(*PAGE, F.when((F.col("n") < 3) | (F.col("body") < 3), 1).otherwise(F.greatest(F.lit(1), active)).alias("column_count"))


def union_area(rects: DataFrame, width: float, height: float) -> DataFrame:
    """Area of the union of rectangles clipped to the page, by vertical slabs between distinct edges."""
    clip = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(most)))
    c = rects.select(*PAGE, clip("l", width).alias("l"), clip("t", height).alias("t"), clip("r", width).alias("r"), clip("b", height).alias("b")).filter("r > l and b > t")
    edges = c.select(*PAGE, F.explode(F.array("l", "r")).alias("x")).distinct()
    slabs = edges.withColumn("x2", F.lead("x").over(Window.partitionBy(*PAGE).orderBy("x"))).filter("x2 is not null")
    inside = slabs.join(c, PAGE).filter("l <= x and r >= x2")
    order = Window.partitionBy(*PAGE, "x", "x2").orderBy("t", "b").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("b").over(order), F.col("t"))
    part = F.greatest(F.lit(0.0), F.col("b") - F.greatest("t", reach)) * (F.col("x2") - F.col("x"))
    area = inside.withColumn("part", part).groupBy(*PAGE).agg(F.round(F.sum("part"), 6).alias("area"))
    return rects.select(*PAGE).distinct().join(area, PAGE, "left").fillna({"area": 0.0})


def has_ruled_grid(drawings: DataFrame, least: int = 2) -> DataFrame:
    tall = (F.col("b") - F.col("t") > 25) & (F.col("r") - F.col("l") < 3.5)
    return drawings.groupBy(*PAGE).agg((F.count_if(tall) >= least).alias("ruled"))


def needs_fallback(n_tables: Column, expected: int = 2) -> Column:
    return F.coalesce(n_tables, F.lit(0)) < expected


def detect_tables(words: DataFrame, ruled: DataFrame, library_tables: DataFrame, width: float, height: float) -> DataFrame:
    """Zones with their ``method``: a library's tables on ruled pages that have some, else X-gaps."""
    own = library_tables.join(ruled.filter("ruled").select(*PAGE), PAGE, "left_semi").withColumn("method", F.lit("ruled"))
    rest = words.join(own.select(*PAGE).distinct(), PAGE, "left_anti")
    return own.unionByName(table_zones(rest, width, height).withColumn("method", F.lit("x_gaps")), allowMissingColumns=True)
