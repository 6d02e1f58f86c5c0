"""Text functions on the values that their rules state."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from folioframe.functions import text as T


def values(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_boilerplate(spark):
    assert values(spark, T.boilerplate_template, "Page 11 of 12", " www.x.com   262-681-3583 ") == ["page # of #", "www.x.com #-#-#"]
    assert values(spark, T.printed_page_number, "2", "11", "Page 4", "p. 12", "chapter", "1234") == [2, 11, 4, 12, None, None]
    legal = values(spark, T.is_contact_or_legal, "www.example.com", "262-681-3583", "Acme Inc", "All  rights reserved", "© 2020", "at 53154 now", "increase", "plain", None)
    assert legal == [True] * 6 + [False] * 3


def test_quality(spark):
    got = values(spark, T.text_quality, "", "   ", "A plain sentence of words.", "ΩΩΩΩ ΩΩΩΩ", "x" * 40)
    assert got == [0.0, 0.0, 1.0, pytest.approx(0.7 / 9 + 0.3, abs=1e-4), 0.7]
    df = spark.createDataFrame([(60, 0.9, 0.0), (60, 0.9, 0.4), (60, 0.5, 0.2), (60, 0.5, 0.05), (10, 0.9, 0.9)], "c long, q double, r double")
    assert [r[0] for r in df.select(T.page_route(F.col("c"), F.col("q"), F.col("r"))).collect()] == ["text_native", "hybrid", "hybrid", "scanned", "scanned"]


def test_tables(spark):
    assert values(spark, T.is_section_header, "BATTERY", "ABC", "WEIGHT LBS", "Battery", "1234", "A B C D") == [True, False, False, False, False, True]
    kv = values(spark, T.key_value, "Weight: 441: x", "System Voltage/Amps 24 VDC", "none", ": v", "k:")
    assert [x and tuple(x) for x in kv] == [("Weight", "441: x"), ("System Voltage/Amps", "24 VDC"), None, None, None]
    units = [tuple(x) for x in values(spark, T.unit_variants, "441-481 lbs (200-218 kg)", "up to 2.5 Hours", "red")]
    assert units == [("441-481 lbs", "200-218 kg", None, None), (None, None, "2.5", "150"), (None,) * 4]
    assert values(spark, T.footnote_text, "** Based on x", "“Based off y") == ["* Based on x", "* Based off y"]


def test_tokens(spark):
    assert values(spark, T.tokens, "Über né a_b x 42", None) == [["über", "né", "a_b", "42"], []]
    a, b = values(spark, T.normalised_tokens, "Weight: 441-481lbs (200-218kg)", "Weight: 441 - 481 lbs (200 - 218 kg)")
    assert a == b
    assert values(spark, T.numeric_tokens, "Weight: 441-481lbs (200-218kg)", "1,200 and 24VDC") == [["441", "481", "200", "218"], ["1200", "24"]]
    assert values(spark, T.clean_line, " • a   line - ") == ["a line"]
    assert values(spark, T.figure_tokens, "Show me the pump of the pump") == [["pump"]]


def test_queries(spark):
    assert values(spark, T.is_visual, "what does it look like", "a photo", "photon", "VIEW it") == [True, True, False, True]
    assert values(spark, T.page_reference, "on page 11", "see p.3", "pg 7", "pages 4", "x") == [11, 3, 7, None, None]
    plans = values(spark, T.query_plan, "Compare A vs B", "compare a VS b", "x and y", "a b c d e f g h i j and k")
    assert [(p.plan, list(p.sub_queries)) for p in plans] == [
        ("compare", ["Compare A", "B", "Compare A vs B"]), ("compare", ["compare a VS b"]), ("direct", ["x and y"]), ("unified", ["a b c d e f g h i j and k"])]
    got = values(spark, T.citations, "[Doc: a.pdf, Page: 3] 【doc: B c, page 12】")[0]
    assert [tuple(x) for x in got] == [("a.pdf", 3), ("B c", 12)]


def test_measures(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("", "x"), ("né", "ne")], "a string, b string")
    assert [r[0] for r in df.select(T.cer(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 1.0, 0.5]


def test_ids_and_uploads(spark):
    name = "documents:d1:c1"
    assert values(spark, T.uuid5, name) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, name))]
    assert values(spark, T.snippet, "x" * 201, "y") == ["x" * 200 + "...", "y"]
    assert values(spark, T.conversation_title, "  hi  ", "   ") == ["hi", "New conversation"]
    df = spark.createDataFrame([("a.PDF", None, b"%PDF-1"), ("a.txt", "application/pdf", b"zzzz"), ("a.pdf", None, b""), ("a.txt", "text/plain", b"%PDF")], "n string, m string, c binary")
    assert [r[0] for r in df.select(T.fails_upload(F.col("n"), F.col("m"), F.col("c"))).collect()] == [None, "signature", "empty", "type"]
    assert values(spark, lambda c: T.without_lines(c, (r"www\.x\.com",)), "a\n\n WWW.X.com \nb") == ["a\nb"]
