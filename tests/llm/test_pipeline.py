"""The corpus pipeline, stage by stage against what each stage promises."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import LONG, brute_components, check_packing

import corpus_pipeline
from folioframe.llm import line_dedup, queries


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
    given, good, lines, near, mix, packed = seen

    kept = {r.doc_id for r in queries.op4_quality_rules(spark, sf_dir).collect() if r.kept}
    assert {r.doc_id for r in good} == kept and {tuple(r) for r in good} <= {tuple(r) for r in given}

    at, last = Counter(), {}
    for r in good:
        for key in {line_dedup.line_key(x) for x in r.text.split("\n")} - {None}:
            at[key] += 1
            last[key] = max(last.get(key, -1), r.doc_id)
    for a, b in zip(sorted(good), sorted(lines)):
        keep = [x for x in a.text.split("\n") if (k := line_dedup.line_key(x)) is None or at[k] < 5 or last[k] == a.doc_id]
        assert b.text == "\n".join(keep) and b.n_chars == len(b.text)

    groups = brute_components([(r.doc_id, r.text) for r in lines], 5, 80)
    assert {r.doc_id for r in near} == {i for i, (_, c) in groups.items() if i == c}

    assert {tuple(r) for r in mix} <= {tuple(r) for r in near} and max(Counter(r.doc_id for r in mix).values()) <= 3
    check_packing(packed, [(r.doc_id, r.text) for r in mix])


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def odd_tables(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    shared = "one long line that many of the documents of this table hold in common"
    a, b = text(200), text(80)
    rows = [(1, None, None), (2, "", "s0"), (3, "  \n", "s0"), (4, "too short", "s1"), (5, a, "s0"), (6, a, "s1"), (7, a + " more", None), (8, LONG, "s2"), (None, b, "s0"), (10, b, "s0"), (10, b, "s0")]
    rows += [(20 + k, f"{text(60)}\n{shared}\n{text(60)}", "s0") for k in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    clashing = "row doc key size rate copies draw kept rank batch part print cluster bytes component_id n_words cell length".split()
    docs = docs.withColumns({n: F.lit("x") for n in clashing} | {"a.b": F.lit(1)})

    def write(name, docs, labels):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        return f"{tmp_path}/{name}"

    labels = spark.createDataFrame([(5, 1, 0), (None, 0, 0), (4, None, 1), (77, 0, 0)], LABELS)
    return write("odd", docs, labels), write("none", docs.limit(0), labels.limit(0))


def test_pipeline_corner_cases(spark, odd_tables, tmp_path):
    odd, none = odd_tables
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    names, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, odd)
        assert out.columns == names
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append(docs.collect())
    ids = [sorted(str(r.doc_id) for r in rows) for rows in kept]
    assert ids[0] == ids[1] == sorted(map(str, [5, 6, 7, 8, None, 10, 10, *range(20, 27)]))
    assert [r.doc_id for r in kept[1] if "in common" in r.text] == [26]
    assert ids[2] == sorted(map(str, [5, 8, None, 10, 10, *range(20, 27)]))
    assert {r["a.b"] for r in kept[3]} == {1}
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, odd).collect(), [(r.doc_id, r.text) for r in kept[3]])
    check_packing(corpus_pipeline.run(spark, odd).collect(), [(r.doc_id, r.text) for r in kept[3]])
    assert corpus_pipeline.run(spark, none).collect() == []


def test_stages_take_what_the_first_would_drop(spark, odd_tables):
    odd, _ = odd_tables
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, odd)
        assert got.count() > 0
        if name == "line dedup":
            assert got.count() == docs.count()
        if name == "near dedup":
            assert {1, 2, 3, 4, 5, 8, 10} <= {r.doc_id for r in got.collect()}
