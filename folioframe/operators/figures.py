"""Figure triage, duplicate removal, trimming and selection; boxes are structs (l, t, r, b, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators.layout import PAGE
from folioframe.shipping import ship


def triage(l: Column, t: Column, r: Column, b: Column, width: float, height: float, px_w: Column, px_h: Column, drawings: Column, words: Column) -> Column:  # noqa: E741
    """struct(informative, score, reason) of the first rule that applies."""
    w, h = F.greatest(F.lit(0.0), r - l), F.greatest(F.lit(0.0), b - t)
    area = w * h / max(1.0, width * height)
    aspect = w / F.greatest(F.lit(1.0), h)
    out = lambda ok, score, why: F.struct(F.lit(ok).alias("informative"), (score if isinstance(score, Column) else F.lit(float(score))).alias("score"), F.lit(why).alias("reason"))
    return (
        F.when((px_w < 250) & (px_h < 250), out(False, 0, "pixels"))
        .when((area < 0.008) | (w < 30) | (h < 30), out(False, 0, "small"))
        .when((aspect > 4) | (aspect < 0.25), out(False, 0, "aspect"))
        .when((area > 0.65) & (drawings >= 10) & (words >= 20), out(True, 100, "full page schematic"))
        .when(area > 0.65, out(False, 0, "background"))
        .when((w / width >= 0.88) & (area > 0.15) & (words < 20), out(False, 0, "banner"))
        .when((drawings >= 3) | ((words >= 3) & (area >= 0.04)), out(True, 85 + F.least(F.lit(15.0), drawings * 0.5 + words * 0.2), "schematic"))
        .when(area.between(0.008, 0.65) & aspect.between(0.35, 3.5), out(True, 70 + area * 25, "illustration"))
        .otherwise(out(False, 0, "other"))
    )


def _overlap(a: Column, b: Column) -> Column:
    w = F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"])
    h = F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def _area(a: Column) -> Column:
    return (a["r"] - a["l"]) * (a["b"] - a["t"])


def _kept(boxes: Column, same) -> Column:
    """Greedy: a box goes if it is the ``same`` as one kept before it. A page's boxes are few."""
    none = F.slice(boxes, 1, 0)
    return F.aggregate(boxes, none, lambda kept, x: F.when(F.exists(kept, lambda k: same(x, k)), kept).otherwise(F.concat(kept, F.array(x))))


def without_contained(boxes: Column, threshold: float = 0.85) -> Column:
    """Of boxes that contain each other for the most part, the tighter stays (ascending area first)."""
    bare = boxes
    keyed = F.array_sort(F.transform(bare, lambda x, i: F.struct(_area(x).alias("area"), i.alias("i"), x.alias("x"))))
    ordered = F.transform(keyed, lambda k: k["x"])
    one = F.lit(1.0)
    same = lambda x, k: (_overlap(x, k) / F.greatest(one, _area(x)) >= threshold) | (_overlap(x, k) / F.greatest(one, _area(k)) >= threshold)
    return _kept(ordered, same)


def without_overlapping(boxes: Column, threshold: float = 0.75) -> Column:
    """In order, a box goes if its intersection over union with a kept one exceeds the threshold."""
    iou = lambda x, k: F.try_divide(_overlap(x, k), _area(x) + _area(k) - _overlap(x, k))
    return _kept(boxes, lambda x, k: F.coalesce(iou(x, k) > threshold, F.lit(False)))


def trimmed(box: Column, words: Column) -> Column:
    """Moves the edges inward past words that straddle them, in word order, if 25 points remain."""
    def step(s, w):
        l, t, r, b = s["l"], s["t"], s["r"], s["b"]  # noqa: E741
        hits = (w["l"] < r) & (w["r"] > l) & (w["t"] < b) & (w["b"] > t)
        inside = (w["l"] >= l) & (w["r"] <= r) & (w["t"] >= t) & (w["b"] <= b)
        act = hits & ~inside
        l2 = F.when(act & (w["l"] < l) & (l < w["r"]) & (w["r"] + 1 < r - 25), w["r"] + 1).otherwise(l)
        r2 = F.when(act & (w["l"] < r) & (r < w["r"]) & (w["l"] - 1 > l2 + 25), w["l"] - 1).otherwise(r)
        t2 = F.when(act & (w["t"] < t) & (t < w["b"]) & (w["b"] + 1 < b - 25), w["b"] + 1).otherwise(t)
        b2 = F.when(act & (w["t"] < b) & (b < w["b"]) & (w["t"] - 1 > t2 + 25), w["t"] - 1).otherwise(b)
        return F.struct(l2.alias("l"), t2.alias("t"), r2.alias("r"), b2.alias("b"))

    start = F.struct(*(box[c].cast("double").alias(c) for c in "ltrb"))
    end = F.aggregate(words, start, step)
    return F.struct(*(F.round(end[c], 2).alias(c) for c in "ltrb"))


def overlap_counts(boxes: DataFrame, others: DataFrame, key: str, count: str, width: float, height: float, points: bool = False) -> DataFrame:
    """Per box, the other boxes of its page that touch it (or whose top-left lies in it), padded by 5."""
    o = others.select(*PAGE, *(F.col(c).alias(f"o_{c}") for c in "ltrb"))
    l, t = F.greatest(F.lit(0.0), F.col("l") - 5), F.greatest(F.lit(0.0), F.col("t") - 5)  # noqa: E741
    r, b = F.least(F.lit(float(width)), F.col("r") + 5), F.least(F.lit(float(height)), F.col("b") + 5)
    if points:
        test = (F.col("o_l") >= l) & (F.col("o_l") < r) & (F.col("o_t") >= t) & (F.col("o_t") < b)
    else:
        test = (F.col("o_l") < r) & (F.col("o_r") > l) & (F.col("o_t") < b) & (F.col("o_b") > t)
    hits = boxes.join(o, PAGE).filter(test).groupBy(*PAGE, key).agg(F.count("*").alias(count))
    return boxes.join(hits, [*PAGE, key], "left").fillna(0, [count])


def budgeted(candidates: DataFrame, budget: int = 30) -> DataFrame:
    """The best figure of every page first, then the best of the rest, up to the budget of a document."""
    page = Window.partitionBy(*PAGE).orderBy(F.desc("score"), F.desc("area"), "figure_no")
    c = candidates.withColumn("_top", F.row_number().over(page) == 1)
    doc = Window.partitionBy("document_id").orderBy(F.desc("_top"), F.desc("score"), F.desc("area"), "page_number", "figure_no")
    c = c.withColumn("_nth", F.row_number().over(doc)).filter(F.col("_nth") <= budget)
    down = Window.partitionBy(*PAGE).orderBy("t", "figure_no")
    return c.withColumn("number", F.row_number().over(down)).drop("_top", "_nth")


def manifest(figures: DataFrame) -> DataFrame:
    """A document's figures as one ordered list of structs."""
    item = F.struct("page_number", "number", *[c for c in figures.columns if c not in (*PAGE, "number")])
    return figures.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("figures"))


def described(crops: DataFrame, make, column: str = "content", mime: str = "image/png") -> DataFrame:
    """Adds ``caption`` from an image model made once for each task; a failure is a null, and after a
    refusal for quota the task asks no more (the fallback sentence then serves)."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType

    ship(crops.sparkSession)
    whole = StructType([StructField("row", crops.schema), StructField("caption", StringType())])

    def run(batches):
        model, open_ = make(), True
        for b in batches:
            row, out = b.column(0), []
            for content in row.field(column).to_pylist():
                text = None
                if open_ and content:
                    try:
                        text = model.describe(content, mime)
                    except ResourceWarning:
                        open_ = False
                    except Exception:  # noqa: BLE001  a failed description is none
                        text = None
                out.append(text)
            yield pa.RecordBatch.from_arrays([row, pa.array(out, pa.string())], names=["row", "caption"])

    return crops.select(F.struct("*").alias("row")).mapInArrow(run, whole).select("row.*", "caption")


def rendered(figures: DataFrame, files: DataFrame, make, dpi: int = 150) -> DataFrame:
    """Adds ``png, width_px, height_px`` of every figure's box, from a renderer made once for each task.

    files(document_id, content); the renderer has ``crop(content, page, box, dpi) -> (png, width, height)``.
    """
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

    whole = StructType([StructField("row", figures.schema), StructField("png", BinaryType()), StructField("width_px", IntegerType()), StructField("height_px", IntegerType())])
    ship(figures.sparkSession)
    both = figures.select("document_id", F.struct("*").alias("row")).join(files.select("document_id", "content"), "document_id").select("row", "content")

    def run(batches):
        renderer = make()
        for b in batches:
            row = b.column(0)
            got = [renderer.crop(c, x["page_number"], tuple(x[k] for k in "ltrb"), dpi) for x, c in zip(row.to_pylist(), b.column(1).to_pylist())]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([row, *cols], names=["row", "png", "width_px", "height_px"])

    return both.mapInArrow(run, whole).select("row.*", "png", "width_px", "height_px")
