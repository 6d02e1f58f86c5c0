"""Layout, tables, figures and chunks on hand-made pages and against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.operators import documents as D
from folioframe.operators import figures as G
from folioframe.operators import layout as L

WORD = "document_id int, page_number int, word_no long, text string, l double, t double, r double, b double"


def place(texts, step=30, x=50.0, y=100.0, height=12.0):
    """Words of lines: 5 points a character, 4 between words."""
    out = []
    for n, line in enumerate(texts):
        left, top = (line[1], line[2]) if isinstance(line, tuple) else (x, y + step * n)
        for w in (line[0] if isinstance(line, tuple) else line).split():
            out.append((w, left, top, left + 5.0 * len(w), top + height))
            left += 5.0 * len(w) + 4
    return out


def page(spark, boxes, number=1):
    return spark.createDataFrame([(1, number, i, *w) for i, w in enumerate(boxes)], WORD)


def brute_lines(words, gap, tol):
    buckets = []
    for w in sorted(words, key=lambda w: (w[3], w[2])):
        for b in buckets:
            if abs((w[3] + w[5]) / 2 - (b[0][3] + b[0][5]) / 2) <= tol or abs(w[3] - b[0][3]) <= tol:
                b.append(w)
                break
        else:
            buckets.append([w])
    out = []
    for b in buckets:
        b = sorted(b, key=lambda w: w[2])
        cur = [b[0]]
        for w in b[1:]:
            if 0 <= w[2] - cur[-1][4] <= gap:
                cur.append(w)
            else:
                out.append(cur)
                cur = [w]
        out.append(cur)
    return sorted((min(w[3] for w in f), min(w[2] for w in f), " ".join(w[1] for w in f)) for f in out)


def test_lines_are_those_of_brute_force(spark):
    rng = random.Random(7)
    words = [(i, f"w{i}", float(rng.randrange(500)), float(rng.randrange(300)), 0.0, 0.0) for i in range(250)]
    words = [(i, x, l, t, l + rng.randrange(5, 60), t + rng.randrange(6, 14)) for i, x, l, t, _, _ in words]
    df = spark.createDataFrame([(1, 1, *w) for w in words], WORD)
    for tol in (4.0, 6.0):
        got = sorted((r.t, r.l, r.text) for r in L.lines(df, 35.0, tol).collect())
        assert got == brute_lines(words, 35.0, tol)


def test_two_column_article(spark):
    boxes = place([("A Title Over The Whole Page Of The Article", 50.0, 40.0)], height=30.0)
    boxes += place([("left one here", 50.0, 120.0), ("left two here", 50.0, 140.0), ("left three here", 50.0, 160.0)])
    boxes += place([("right one here", 330.0, 120.0), ("right two here", 330.0, 140.0), ("right three here", 330.0, 160.0)])
    boxes += place([("page footer", 50.0, 760.0)])
    got = L.reading_order(page(spark, boxes), 612.0, 792.0).orderBy("block_no").collect()
    assert [r.text for r in got] == ["A Title Over The Whole Page Of The Article", "left one here", "left two here", "left three here", "right one here", "right two here", "right three here", "page footer"]
    assert [r.column for r in got] == [0, 0, 0, 0, 1, 1, 1, 0]
    assert got[1].section_path == ["A Title Over The Whole Page Of The Article"] and got[-1].band == 1


def test_sections_within_a_column(spark):
    boxes = place(["Alpha", "text one", "Uses", "text two", "Beta", "text three"], step=20)
    got = L.reading_order(page(spark, boxes), 612.0, 792.0, primary="^(Alpha|Beta)$", secondary=("Uses",)).orderBy("block_no").collect()
    assert [r.section_path for r in got] == [["Alpha"], ["Alpha"], ["Alpha", "Uses"], ["Alpha", "Uses"], ["Beta"], ["Beta"]]


def test_fruit_legend(spark):
    boxes = place(["1. Apple: red", "2. *Pear: green", "3 Plum", "4) Fig*: sweet", "5. Lime", "* Not in season"])
    got = L.legend(page(spark, boxes)).orderBy("number").collect()
    assert [r.name for r in got] == ["Apple", "Pear", "Plum", "Fig*", "Lime"]
    assert [r.footnote for r in got] == ["", "Not in season", "", "Not in season", ""]


def test_gaps(spark):
    df = page(spark, [("a", 10.0, 0.0, 30.0, 9.0), ("b", 25.0, 0.0, 50.0, 9.0), ("c", 70.0, 0.0, 90.0, 9.0), ("d", 91.0, 0.0, 99.0, 9.0)])
    assert [(r.gap_l, r.gap_r) for r in L.x_gaps(df, 100.0).collect()] == [(50.0, 70.0)]


def tables(spark):
    boxes = []
    for x, name in ((40.0, "Alpha"), (240.0, "Beta"), (440.0, "Gamma")):
        boxes += place([(f"{name} unit", x, 100.0), ("MOTOR", x, 130.0), ("Power: 2 hp", x, 150.0), ("Run Time*: 2.5 Hours", x, 170.0), ("* Based on load", x, 190.0)])
    return page(spark, boxes)


@pytest.mark.parametrize("move", [(1.0, 1.0, 0.0, 0.0), (1.35, 0.85, 0.0, 0.0), (1.0, 1.0, 50.0, 50.0)])
def test_tables_and_their_moves(spark, move):
    words = L.perturbed(tables(spark), *move)
    z = L.table_zones(words, 700.0 * move[0], 792.0 * move[1]).orderBy("zone_id").collect()
    assert [(r.zone_id, r.title, r.n_words) for r in z] == [(0, "Alpha unit", 14), (1, "Beta unit", 14), (2, "Gamma unit", 14)]
    recs = L.table_records(L.table_rows(L.zone_pages(L.zoned(words, 700.0 * move[0], 792.0 * move[1])))).collect()
    assert len(recs) == 6
    run = [r for r in recs if r.attribute == "Run Time*"]
    assert all(r.section == "MOTOR" and r.units.minutes == "150" and r.footnotes == "* Based on load" for r in run)


def test_table_zones_are_those_of_zones_and_lines(spark):
    """Random pages, some with boxes upside down: blocks of pages against the zones and lines as plans of their own."""
    rng, rows = random.Random(11), []
    for p in range(1, 70):
        for i in range(rng.choice((1, 2, 3, 40, 120))):
            l, t = float(rng.choice((40, 240, 440)) + rng.randrange(90)), float(rng.randrange(40, 760))
            rows.append((p % 3, p, i, rng.choice(("a", "bc", "2 hp", "x:", "Run")), l, t, l + rng.randrange(2, 60 if p % 4 else 400), t + rng.randrange(-9 if p % 5 == 0 else 1, 16)))
    words = spark.createDataFrame(rows, WORD).repartition(3)
    got = {(r.document_id, r.page_number, r.zone_id): (r.title, r.first_line, r.zl, r.zt, r.zr, r.zb, r.n_words) for r in L.table_zones(words, 660.0, 792.0).collect()}
    zones = L.zoned(words, 660.0, 792.0)
    own = {(*r.document_id, r.page_number): r.text for r in L.lines(L.zone_pages(zones), 15.0, 3.5).filter("line_no = 1").collect()}
    every, boxes, want = {}, {}, {}
    for r in L.lines(L.content(words, 792.0), 20.0, 4.0).collect():
        every.setdefault((r.document_id, r.page_number), []).append(r)
    for r in zones.collect():
        boxes.setdefault((r.document_id, r.page_number, r.zone_id), []).append(r)
    for key, ws in boxes.items():
        zl, zt, zr, zb = min(w.l for w in ws), min(w.t for w in ws), max(w.r for w in ws), max(w.b for w in ws)
        near = [(abs(zt - e.b), e.line_no, e.text) for e in every[key[:2]] if e.b <= zt + 15 and zt - e.b <= 50 and zl - 25 <= (e.l + e.r) / 2 <= zr + 25 and not any(s in e.text for s in (":", "lbs", "rpm", "hp"))]
        want[key] = (min(near)[2] if near else own[key], own[key], zl, zt, zr, zb, len(ws))
    assert got == want and len(want) > 30


def test_table_zones_deal_out_no_words(spark, sf_dir):
    """The texts are dealt out once, by document; words are not: at 0.1 GB they took more than 7 times the input."""
    from folioframe.plans import layout_queries as Q

    plan = Q.title_link(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION_BY_COL" in plan and "Join" not in plan


def test_pipeline_deals_out_texts_alone(spark, sf_dir):
    """Words and lines of text are never dealt out: every pass begins with the texts, dealt out by document."""
    from folioframe.plans import layout_queries as Q

    out = D.process(Q.words(spark, sf_dir, dealt=True), Q.W, Q.H)
    for name in ("blocks", "zones"):
        plan = out[name]._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert plan.count("Exchange ") <= 2 and "SortMergeJoin" not in plan
    D.release(out)


def test_pipeline_chunks_hold_no_word_as_a_row(spark, sf_dir):
    """Words as rows, once for every output, took 4472 CPU seconds a GB."""
    from folioframe.plans import layout_queries as Q

    plan = Q.pipeline_chunks(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("way", ["laid_out", "scattered"])
def test_chunks_of_texts_are_those_of_the_pipeline(spark, way):
    """Odd texts: the plan over texts gives all that the plan over words gives."""
    from folioframe.plans import layout_queries as Q

    def scattered(word_no, length):
        """Boxes all over the page: bands by gaps, several columns, lines that run into each other."""
        n = word_no
        l = (40 + 200 * (n * 31 % 3) + n * 37 % 90).astype(float)
        t = 40 + n * n * 53 % 1400 / 2 + 60 * (n * 7 % 4 == 0) * (n // 60 % 2)
        return {"page_number": n // 60 + 1, "l": l, "t": t, "r": l + 2 + np.minimum(4 * length, 44) + 200 * (n % 29 == 0), "b": t + 9 + n * 7 % 5 + 30 * (n % 41 == 0)}

    lay_out = Q.laid_out if way == "laid_out" else scattered
    rng = random.Random(3)
    pool = ("a", "Section", "sections", "chapter", "PART", "part 7", "Uses:", "Weight: 3 kg", "MOTOR", "MOTOR UNIT", "*", "Based on", "www.x.org", "© 2020", "Inc.", "inc\u00e9", "call 262-681-3583", "\u00e9t\u00e9", "\u2028", "x\u00a0y", "53182", "page 2", "\U0001f600", "\u017fection", "hp", "o" * 60)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "\u00a0"), (None, "no key")]
    texts += [(10 + k, " \n"[k % 2].join(rng.choice(pool) for _ in range(rng.choice((3, 40, 400, 1500))))) for k in range(14)]
    texts += [(40, " ".join("head line" if i % 600 < 12 else f"w{i % 97}" for i in range(2600))), (41, "page\x0b1\x0c" * 700)]
    rows = []
    for k, text in texts:
        words = [] if text is None or k is None else [w.decode() for w in text.encode().split()] or [""]
        at = lay_out(np.arange(len(words)), np.array([len(w) for w in words], int))
        rows += [(k, int(at["page_number"][i]), i, w, *(float(at[c][i]) for c in "ltrb")) for i, w in enumerate(words)]
    out = D.process(spark.createDataFrame(rows, WORD), Q.W, Q.H, 50)
    want = sorted((r.document_id, r.page_number, r.chunk_id, r.section_path, r.text, r.tokens, r.chunk_type) for r in out["chunks"].collect())
    stripped = out["stripped"].count()
    D.release(out)
    chunks = D.text_chunks(spark.createDataFrame(texts, "document_id int, text string").repartition(3), lay_out, Q.W, Q.H, 50)
    got = sorted((r.document_id, r.page_number, r.chunk_id, r.section_path, r.text, r.tokens, r.chunk_type) for r in chunks.collect())
    assert got == want
    assert stripped and any(r[3] for r in got) and any("\n[MOTOR" in r[4] for r in got) and len({r[0] for r in got}) > 15


def test_bucket_rounds_are_the_rule(spark):
    from folioframe.operators import pages as P
    from folioframe.operators.folds import bucket_rule

    rng = np.random.default_rng(4)
    for tolerance in (0.5, 4.0, 30.0):
        n = 3000
        page, l, t = np.sort(rng.integers(0, 20, n)), rng.integers(0, 600, n) / 2, rng.integers(0, 3000, n) / 4
        b, word_no = t + rng.choice((0.0, 9.0, 11.5, 80.0), n), np.arange(n)
        start, step = bucket_rule(tolerance)
        want = np.empty(n, int)
        for p in range(20):
            own, state = np.flatnonzero(page == p), start()
            for i in own[np.lexsort((word_no[own], l[own], t[own]))]:
                want[i] = step(state, float(t[i]), float(b[i]))
        assert np.array_equal(P.buckets(page, word_no, l, t, b, tolerance), want)


def test_blocks_are_those_of_lines_bands_and_columns(spark):
    """Random pages: reading order and chunks of pages as rows against the plans over lines."""
    rng, rows = random.Random(5), []
    for p in range(1, 30):
        for i in range(rng.choice((1, 5, 60))):
            l, t = float(rng.choice((40, 240, 440)) + rng.randrange(90)), float(rng.randrange(40, 760))
            rows.append((p % 3, p, i, rng.choice(("a", "bc", "section", "Alpha", "Uses" * 40)), l, t, l + rng.randrange(2, 250), t + rng.choice((9.0, 10.0, 40.0))))
    words = spark.createDataFrame(rows, WORD).repartition(3)
    got = L.reading_order(words, 660.0, 792.0, "^Alpha", ("Uses",)).collect()
    lines = L.bands(L.lines(words), 660.0, 792.0)
    first = {}
    for r in lines.orderBy("line_no").collect():
        if r.heading is not None and r.text == r.heading:
            first.setdefault((r.document_id, r.page_number, r.band), r.line_no)
    heads = spark.createDataFrame([(*k, n) for k, n in first.items()], "document_id int, page_number int, band long, line_no long").withColumn("is_band_heading", F.lit(True))
    placed = L.columns(lines.join(heads, [*L.PAGE, "band", "line_no"], "left").fillna({"is_band_heading": False}), 660.0)
    want, n, state, at = [], {}, [None, None], None
    for r in sorted(placed.collect(), key=lambda r: (r.document_id, r.page_number, r.band, not r.is_band_heading, r.column, r.t, r.l, r.line_no)):
        key = (r.document_id, r.page_number)
        n[key] = n.get(key, 0) + 1
        if (place := (key, r.band, r.is_band_heading, r.column)) != at:
            at, state = place, [None, None]
        if not r.is_band_heading and r.text.startswith("Alpha"):
            state = [r.text, None]
        elif not r.is_band_heading and r.text == "Uses":
            state[1] = r.text
        want.append((*key, n[key], r.text, [x for x in (r.heading, *state) if x is not None], r.band, r.column, r.n_words))
    assert sorted((r.document_id, r.page_number, r.block_no, r.text, r.section_path, r.band, r.column, r.n_words) for r in got) == sorted(want) and len(got) > 200
    ordered = L.ordered_pages(words, 660.0, 792.0, "^Alpha", ("Uses",))
    a, b = (sorted((r.chunk_id, r.section_path, r.text, r.tokens, r.n_blocks) for r in x.collect()) for x in (D.chunk_pages(ordered, 300), D.chunk_text(spark.createDataFrame(got), 300)))
    assert a == b and a


def test_low_confidence(spark):
    rows = [(1, 1, i, w, 10.0 + 40 * i, 100.0, 40.0 + 40 * i, 110.0, c) for i, (w, c) in enumerate([("Key:", 0.45), ("a", 0.5), ("b", 0.55), ("c", 0.5)])]
    df = spark.createDataFrame(rows, WORD + ", confidence double")
    r = L.table_records(L.table_rows(df)).first()
    assert r.low_confidence and r.confidence == 0.5


def test_markdown(spark):
    df = spark.createDataFrame([(1, "T", 2, "S", "a|b", "c"), (1, "T", 1, "S", "x", "y")], "k int, title string, row_no int, section string, attribute string, value string")
    assert L.markdown(df, ["k"]).first().markdown == "### T\n\n| Section | Attribute | Value |\n| --- | --- | --- |\n| S | x | y |\n| S | a\\|b | c |"


def test_union_area(spark):
    rng = random.Random(2)
    rects = [(rng.randrange(-10, 60), rng.randrange(-10, 60)) for _ in range(25)]
    rects = [(float(l), float(t), float(l + rng.randrange(1, 25)), float(t + rng.randrange(1, 25))) for l, t in rects]
    cells = {(x, y) for l, t, r, b in rects for x in range(int(max(l, 0)), int(min(r, 64))) for y in range(int(max(t, 0)), int(min(b, 64)))}
    df = page(spark, [("", *r) for r in rects])
    assert L.union_area(df, 64.0, 64.0).first().area == len(cells)


def test_figures(spark):
    boxes = [(0.0, 0.0, 400.0, 300.0), (10.0, 10.0, 390.0, 290.0), (500.0, 50.0, 700.0, 250.0)]
    arr = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(x, "ltrb"))) for x in boxes))
    one = spark.range(1)
    assert [r.l for r in one.select(G.without_contained(arr).alias("k")).first().k] == [500.0, 10.0]
    assert len(one.select(G.without_overlapping(arr).alias("k")).first().k) == 2
    words = [(395.0, 120.0, 420.0, 135.0), (150.0, 150.0, 200.0, 165.0), (500.0, 500.0, 550.0, 520.0)]
    ws = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(x, "ltrb"))) for x in words))
    box = F.struct(*(F.lit(v).alias(c) for v, c in zip((100.0, 100.0, 400.0, 300.0), "ltrb")))
    assert tuple(one.select(G.trimmed(box, ws).alias("x")).first().x) == (100.0, 100.0, 394.0, 300.0)


def test_column_estimate_and_ruled(spark):
    cols = [("", 10.0 + 200 * k, 20.0 * i, 110.0 + 200 * k, 20.0 * i + 9) for k in range(3) for i in range(4)]
    assert L.column_estimate(page(spark, cols), 600.0).first().column_count == 3
    assert L.column_estimate(page(spark, cols[:2]), 600.0).first().column_count == 1
    assert L.has_ruled_grid(page(spark, [("", 1.0, 0.0, 2.0, 30.0), ("", 5.0, 0.0, 6.0, 30.0)])).first().ruled


def test_flip_keeps_confidence(spark):
    df = spark.createDataFrame([(1, 1, 0, "a", 0.0, 700.0, 10.0, 690.0, "CoordOrigin.BOTTOMLEFT", 0.4)], WORD + ", coord_origin string, confidence double")
    r = L.flipped(df, F.lit(792.0)).first()
    assert (r.t, r.b, r.confidence) == (92.0, 102.0, 0.4)


def test_chunks(spark):
    rows = [(1, 1, 1, "a" * 700, ["s"]), (1, 1, 2, "b" * 700, ["s"]), (1, 1, 3, "c", ["t"]), (1, 1, 4, "  ", ["u"]), (1, 1, 5, "d" * 2000, ["v"])]
    df = spark.createDataFrame(rows, "document_id int, page_number int, block_no long, text string, section_path array<string>")
    got = D.chunk_text(df).orderBy("chunk_no").collect()
    assert [(r.chunk_id, r.section_path, len(r.text)) for r in got] == [("1_p1_c1", ["s"], 700), ("1_p1_c2", ["s"], 700), ("1_p1_c3", ["t"], 1), ("1_p1_c4", ["v"], 2000)]
    zones = spark.createDataFrame([(1, 1, 0, "T")], "document_id int, page_number int, zone_id int, title string")
    recs = spark.createDataFrame([(1, 1, 0, 1, "S", "a", "b")], "document_id int, page_number int, zone_id int, row_no int, section string, attribute string, value string")
    t = D.chunk_tables(zones, recs, D.chunk_text(df)).first()
    assert (t.chunk_id, t.text) == ("1_p1_tbl5", "Table: T\n[S] a: b")


def test_boilerplate(spark):
    rows = []
    for p in (1, 2, 3):
        rows += [(7, p, 1, f"Guide part {p}", 5.0, 15.0), (7, p, 2, f"body {p}", 300.0, 310.0), (7, p, 3, "call 262-681-3583", 400.0, 410.0), (7, p, 4, str(p), 780.0, 790.0), (7, p, 5, f"unique {'xyz'[p - 1]}", 2.0, 12.0)]
    df = spark.createDataFrame(rows, "document_id int, page_number int, line_no long, text string, t double, b double")
    t = D.learn_boilerplate(df, 792.0)
    assert {r.template: r.n_pages for r in t.collect()} == {"guide part #": 3, "#": 3}
    left = D.strip_boilerplate(df, t, 792.0).collect()
    assert sorted(r.text for r in left) == ["body 1", "body 2", "body 3", "unique x", "unique y", "unique z"]
    assert {(r.page_number, r.printed) for r in D.printed_pages(D.mark_boilerplate(df, t, 792.0)).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_ruled_pages_go_to_the_library(spark):
    """Page 1 has a ruled grid and library tables, page 2 a grid alone, page 3 tables of the library alone."""
    words = tables(spark)
    for n in (2, 3):
        words = words.unionByName(tables(spark).withColumn("page_number", F.lit(n)))
    grid = [(1, n, x, 90.0, x + 1.0, 400.0) for n in (1, 2) for x in (30.0, 600.0)] + [(1, 3, 30.0, 90.0, 31.0, 100.0)]
    drawings = spark.createDataFrame(grid, "document_id int, page_number int, l double, t double, r double, b double")
    zones = spark.createDataFrame([(1, n, 7, "Library table", 30.0, 90.0, 600.0, 400.0, 4) for n in (1, 3)], "document_id int, page_number int, zone_id int, title string, zl double, zt double, zr double, zb double, n_words int")
    rows = spark.createDataFrame([(1, n, 7, k, t, 1.0, 1.0) for n in (1, 3) for k, t in enumerate(("MOTOR", "Weight: 3 kg"))], "document_id int, page_number int, zone_id int, row_no long, text string, mean_confidence double, least double")
    found = L.detect_tables(words, L.has_ruled_grid(drawings), zones, 700.0, 792.0)
    assert sorted((r.page_number, r.method, r.zone_id) for r in found.collect()) == [(1, "ruled", 7), *((n, "x_gaps", k) for n in (2, 3) for k in range(3))]
    out = D.process(words, 700.0, 792.0, 10, drawings, (zones, rows))
    kept = sorted((r.page_number, r.zone_id, r.attribute) for r in out["records"].collect())
    assert [x for x in kept if x[0] == 1] == [(1, 7, "Weight")] and len(kept) == 13
    text = [r.text for r in out["chunks"].filter("page_number = 1 and chunk_type = 'table'").collect()]
    assert text == ["Table: Library table\n[MOTOR] Weight: 3 kg"]
    D.release(out)


def test_pipeline_keeps_every_clean_word(spark, sf_dir):
    """Each word that is not boilerplate is in one text chunk of its page, in one place."""
    from collections import Counter

    from folioframe.plans import layout_queries as Q

    out = D.process(Q.words(spark, sf_dir), Q.W, Q.H)
    words, texts = Counter(), Counter()
    for r in out["clean"].select("document_id", "page_number", "text").collect():
        words[r.document_id, r.page_number, r.text] += 1
    for r in out["chunks"].filter("chunk_type = 'text'").select("document_id", "page_number", "text", "tokens").collect():
        assert r.tokens == len(r.text) // 4
        for w in r.text.split():
            texts[r.document_id, r.page_number, w] += 1
    assert texts == words and words
    D.release(out)
