"""Retrieval, evaluation, agent, sources, sinks and streams."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from folioframe.operators import evaluation as E
from folioframe.operators import qa
from folioframe.operators import relational as R
from folioframe.operators import retrieval as V
from folioframe.sources import readers, sinks
from folioframe.streaming import ingest, limits


def test_access(spark):
    docs = spark.createDataFrame([(1, 5, "ready"), (2, 6, "ready"), (3, 6, "queued"), (4, 5, "queued")], "document_id int, owner_id int, status string")
    perms = spark.createDataFrame([(2, 5, "read"), (3, 5, "write")], "document_id int, user_id int, permission_level string")
    ids = lambda **k: sorted(r[0] for r in V.authorised(docs, perms, F.lit(5), **k).collect())
    assert ids() == [1, 2] and ids(admin=True) == [1, 2]
    assert ids(requested=docs.filter("document_id = 2")) == [2] and ids(requested=docs.limit(0)) == []
    req = spark.createDataFrame([(5, False, 1, True), (5, False, 2, False), (5, False, 2, True), (7, False, 1, False), (7, True, 1, True), (5, True, 99, False)], "user_id int, is_admin boolean, document_id int, write boolean")
    got = {(r.user_id, r.is_admin, r.document_id, r.write): r.allowed for r in R.access_check(req, docs, perms).collect()}
    assert list(got.values()).count(True) == 3 and not got[(5, True, 99, False)] and not got[(5, False, 2, True)]


def test_citations(spark):
    answers = spark.createDataFrame([(1, "x [Doc: manual, Page: 3]"), (2, "x [Doc: other, Page: 3] [Doc: manual, Page: 3]"), (3, "no tags"), (4, "x [Doc: zzz, Page: 9]"), (5, "x [Doc: manual, Page: 3]")], "answer_id int, answer string")
    ev = spark.createDataFrame([(i, "d1", "Manual.pdf", 3) for i in (1, 2, 3, 4)], "answer_id int, document_id string, filename string, page_number int")
    got = {r.answer_id: (r.coverage, r.is_verified, r.recommend_retry) for r in V.verify_citations(answers, ev).collect()}
    assert got == {1: (1.0, True, False), 2: (0.5, False, False), 3: (1.0, True, False), 4: (0.0, False, True), 5: (1.0, True, False)}


def test_many_queries_are_single_queries(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = e.filter("chunk_id < 5").select(F.col("chunk_id").alias("q"), F.col("embedding").alias("query_vector"))
    many = {(r.q, r.dense_rank): r.chunk_id for r in V.dense_many(e, q, ("q",), 7).collect()}
    for k in range(5):
        one = V.dense_top_k(e, q.filter(F.col("q") == k).drop("q"), 7).collect()
        assert {(k, r.dense_rank): r.chunk_id for r in one} == {x: c for x, c in many.items() if x[0] == k}


def test_figures_gate(spark):
    man = spark.createDataFrame([("d1", "pump.pdf", "d1_f1", 3, "pump drawing", ["valve"]), ("d1", "pump.pdf", "f1", 4, "other", [])], "document_id string, filename string, figure_id string, page_number int, caption string, nearby_labels array<string>")
    ev = spark.createDataFrame([(3, 0, "d1_f1", "d1", 3, 0.9)], "query_id int, idx int, figure_id string, document_id string, page_number int, score double")
    q = spark.createDataFrame([(1, "show me the pump on page 3"), (2, "the pump"), (3, "the pump")], "query_id int, query string")
    got = {(r.query_id, r.rank): (r.figure_id, r.score) for r in V.figures(man, ev, q).collect()}
    assert got[(1, 1)] == ("d1_f1", 135.0) and not any(k[0] == 2 for k in got) and got[(3, 1)] == ("d1_f1", 83.0)


def test_measures(spark):
    rows = [(1, "24,24,36".replace(",", " "), "24 36"), (2, "24 36", "24 24 24 36"), (3, "", ""), (4, "a b", ""), (5, "2.5 3.5 5.0 130 210", "2.5 3.5 5.0 130")]
    p = spark.createDataFrame(rows, "id int, truth string, found string")
    f = {r.id: (r.precision, r.recall, r.f1) for r in E.token_f1(p, "id").collect()}
    assert f[1] == (1.0, 0.666667, 0.8) and f[2] == (0.5, 1.0, 0.666667) and f[3] == (1.0, 1.0, 1.0) and f[4] == (0.0, 0.0, 0.0)
    n = {r.id: (r.recall, r.matched, r.missed) for r in E.numeric_recall(p, "id").collect()}
    assert n[1] == (0.666667, "24 36", "24") and n[5] == (0.8, "2.5 3.5 5.0 130", "210") and n[3] == (1.0, "", "")
    c = {r.id: (r.edits, r.chars) for r in E.aligned_cer(spark.createDataFrame([(1, "Hello world\nabc\nsecond line", "second lime\nhello world")], "id int, truth string, found string"), "id").collect()}
    assert c == {1: (1, 22)}


def test_plugins(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "  ")], "id int, text string")
    got = {r.id: r.embedding for r in qa.embed_texts(df, "text").collect()}
    assert len(got[1]) == qa.DIMENSION and got[2] == got[3] == [0.0] * qa.DIMENSION

    class Wrong:
        def embed(self, texts):
            return [[1.0]] * len(texts)

    with pytest.raises(Exception, match="wrong number"):
        qa.embed_texts(df, "text", Wrong).collect()

    class ByLength:
        def score(self, query, texts):
            return [float(len(t)) for t in texts]

    c = spark.createDataFrame([(1, 1, "q", "short"), (2, 2, "q", "a longer text")], "chunk_id int, rank int, query string, text string")
    assert [r.chunk_id for r in qa.rerank(c, 1).collect()] == [1] and [r.chunk_id for r in qa.rerank(c, 1, ByLength).collect()] == [2]
    ev = [{"document_id": "d", "filename": "f.pdf", "page_number": 2, "text": "some text", "chunk_id": "c"}] * 2
    reply = qa.generate("q", ev)
    assert reply.answer.endswith("[Doc: f.pdf, Page: 2]") and len(reply.citations) == 1

    class Broken:
        def answer(self, *_):
            raise TimeoutError

    class Refuses:
        def answer(self, *_):
            return "Insufficient evidence in authorized documents."

    assert qa.generate("q", ev, chain=[("a", Broken()), ("b", Refuses())]) == qa.Reply("Insufficient evidence in authorized documents.", [], "b")
    assert qa.generate("q", []).answer == qa.NO_EVIDENCE


def test_history(spark):
    m = spark.createDataFrame([(1, i, i) for i in range(1, 9)], "conversation_id int, created_at int, message_id int")
    assert sorted(r.created_at for r in R.history(m).collect()) == [3, 4, 5, 6]
    assert sorted(r.created_at for r in R.history_recent(m).collect()) == [5, 6, 7, 8]
    figs = spark.createDataFrame([("d", "x", "p1_f1", "figures/d/a.png")], "document_id string, wanted string, figure_id string, blob_key string")
    assert R.figure_key(figs, F.lit("f1"), F.lit("d")).first().blob_key == "figures/d/a.png"
    assert R.figure_key(figs, F.lit("zz"), F.lit("d")).first().blob_key == "figures/d/zz.png"
    assert R.figure_key(figs, F.lit("../zz"), F.lit("d")).collect() == []


def test_sources(spark, tmp_path):
    page = {"page_width": 633.6, "page_height": 792.0, "unit": "pt", "coord_origin": "TOPLEFT", "words": [{"text": "a", "l": 1, "t": 2, "r": 3, "b": 4, "page": 2}]}
    (tmp_path / "p.json").write_text(json.dumps(page, indent=1))
    r = readers.word_boxes(spark, str(tmp_path / "p.json")).first()
    assert (r.page_number, r.text, r.font_size, r.confidence, r.coord_origin) == (2, "a", 10.0, 1.0, "TOPLEFT")
    tree = {"page_height": 792.0, "texts": [{"text": " x ", "prov": [{"page_no": 4, "bbox": {"l": 1, "t": 9, "r": 2, "b": 3, "coord_origin": "BOTTOMLEFT"}}]}, {"text": " ", "prov": []}, {"text": "y", "prov": []}]}
    (tmp_path / "t.json").write_text(json.dumps(tree))
    got = readers.tree_nodes(spark, str(tmp_path / "t.json")).orderBy("word_no").collect()
    assert [(x.text, x.page_number, x.l, x.r) for x in got] == [("x", 4, 1.0, 2.0), ("y", 1, 0.0, 100.0)]
    good = '// comment\n\n{"id":"G01","question":"q","type":"spec","expected_pages":[1]}\n'
    (tmp_path / "g.jsonl").write_text(good)
    assert readers.golden_questions(spark, str(tmp_path / "g.jsonl")).first().id == "G01"
    for bad in ('{"id":"X1","type":"spec"}', '{"id":"G02","type":"none"}', '{"id":"G01","type":"spec"}'):
        (tmp_path / "b.jsonl").write_text(good + bad)
        with pytest.raises(Exception, match="bad id|bad type|duplicate id"):
            readers.golden_questions(spark, str(tmp_path / "b.jsonl")).collect()
    (tmp_path / "env").write_text("# c\nA='1'\nLLM_x_BASE_URL=u\nLLM_x_MODEL=m\nLLM_x_API_KEY=k\n")
    values = readers.settings(str(tmp_path / "env"))
    assert values["A"] == "1" and [e.name for e in readers.endpoint_chain(values, ["y", "x"])] == ["x"]

    class Reader:
        def __init__(self, fails):
            self.fails = fails

        def pages(self, content):
            if self.fails:
                raise ValueError
            yield 1, 10.0, 20.0, [{"text": content.decode(), "l": 0.123, "t": 0.0, "r": 1.0, "b": 1.0}]

    (tmp_path / "pdfs").mkdir()
    (tmp_path / "pdfs" / "a.pdf").write_bytes(b"%PDF")
    files = readers.blobs(spark, str(tmp_path / "pdfs"), "*.pdf")
    r = readers.read_pages(files, lambda: [Reader(True), Reader(False)]).first()
    assert (r.text, r.l, r.page_width) == ("%PDF", 0.12, 10.0)
    assert readers.upload_checks(files).first().refused is None


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([("d1", "c1", [1.0, 2.0]), ("d2", "c1", [1.0, 2.0])], "document_id string, chunk_id string, embedding array<float>")
    p = sinks.points(chunks, dimension=2)
    base = str(tmp_path / "coll")
    sinks.upsert_points(base, p, 0)
    out = sinks.upsert_points(base, p.filter("document_id = 'd1'"), 1)
    assert spark.read.parquet(out).count() == 2
    assert sinks.delete_documents(spark.read.parquet(out), chunks.filter("document_id = 'd1'")).count() == 1
    with pytest.raises(Exception, match="wrong dimension"):
        sinks.points(chunks, dimension=3).collect()
    sinks.write_blobs(spark.createDataFrame([("figures/d/x.png", b"z")], "blob_key string, content binary"), str(tmp_path))
    assert (tmp_path / "figures/d/x.png").read_bytes() == b"z"
    sinks.delete_blobs(spark, str(tmp_path), ["figures/d/x.png"])
    assert not os.path.exists(tmp_path / "figures/d/x.png")
    sinks.ensure_collection(spark, str(tmp_path / "empty"), "a int")
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0


def test_upsert_takes_the_first_of_equal_versions(spark, tmp_path):
    """Two files, of which Spark reads the second, larger one first; ties go to the first row in file order."""
    import duckdb

    from folioframe.plans import catalogue

    line = "l_orderkey long, l_extendedprice double, l_linenumber int"
    parts = [[(k, 1.0 * k, 3) for k in range(50)], [(k, 1000.0 + n, 3) for n in range(40) for k in range(60)]]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, line).coalesce(1).write.parquet(f"{tmp_path}/raw{n}")
        (part,) = (f for f in os.listdir(f"{tmp_path}/raw{n}") if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/lineitem.parquet", exist_ok=True)
        os.rename(f"{tmp_path}/raw{n}/{part}", f"{tmp_path}/lineitem.parquet/part-{n}.parquet")
    orders = [(k, 0.5 + k) for k in range(70)]
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.document_id: r.size for r in catalogue.QUERIES["rel22_upsert"](spark, str(tmp_path)).collect()}
    assert got == dict(orders) | {k: 1000.0 for k in range(60)} | {k: 1.0 * k for k in range(50)}
    con = duckdb.connect()
    con.sql("SET threads = 1")
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == dict(con.sql(catalogue.ORACLES["rel22_upsert"]).fetchall())


def test_upsert_passes_rows_without_a_size_or_version_over(spark, tmp_path):
    import duckdb

    from folioframe.plans import catalogue

    lines = [(1, None, 3), (1, 7.0, 2), (2, 5.0, None), (3, None, 1), (4, None, None), (None, 6.0, 1), (None, None, 2), (6, float("nan"), 2), (6, 1.0, 1), (7, 3.0, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_extendedprice double, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 0.5), (2, 0.25), (3, 0.75), (5, None)], "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(str, map(tuple, catalogue.QUERIES["rel22_upsert"](spark, str(tmp_path)).collect())))
    assert got == sorted(map(str, con.execute(catalogue.ORACLES["rel22_upsert"]).fetchall()))
    assert {"(1, 7.0)", "(2, 0.25)", "(3, 0.75)", "(4, None)", "(5, None)", "(None, 6.0)", "(6, nan)", "(7, None)"} == set(got)


def test_upsert_keeps_the_target_at_equal_versions(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "k int, v int, x string, n int")
    old, new = frame((1, 1, "old", 9), (2, 1, "old", 9)), frame((1, 1, "b", 2), (2, 2, "b", 2), (2, 2, "a", 1), (3, 1, "b", 2), (3, 1, "a", 1))
    first = R.upsert(old, new, "k", "v", ("n",))
    assert sorted((r.k, r.x) for r in first.collect()) == [(1, "old"), (2, "a"), (3, "a")]
    assert sorted((r.k, r.x) for r in R.upsert(first, new, "k", "v", ("n",)).collect()) == [(1, "old"), (2, "a"), (3, "a")]


def test_limiter_stream_is_the_batch(spark, sf_dir, tmp_path):
    calls = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("client"), F.col("ts").alias("at"), F.col("event_id").alias("call_id"))
    calls.orderBy("at", "call_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    for rule, times, seconds in (("sliding", 2, 6 * 3600), ("fixed", 2, 24 * 3600)):
        q = limits.limited_stream(stream, rule, times, seconds).writeStream.format("memory").queryName(f"limit_{rule}").option("checkpointLocation", str(tmp_path / rule)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(r.client, r.call_id): r.accepted for r in spark.table(f"limit_{rule}").collect()}
        want = {(r.client, r.call_id): r.accepted for r in limits.limited(calls, rule, times, seconds).collect()}
        assert got == want and 0 in got.values()


def test_limiter_against_plain_python(spark):
    import random

    rng = random.Random(1)
    rows = [(c, t, i) for i, (c, t) in enumerate((rng.randrange(3), rng.randrange(2000)) for _ in range(200))]
    df = spark.createDataFrame(rows, "client long, t long, call_id long").select("client", F.timestamp_seconds("t").alias("at"), "call_id")
    kept, want = {}, {}
    for c, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        kept[c] = [x for x in kept.get(c, []) if x > t - 60]
        want[i] = int(len(kept[c]) < 3)
        kept[c] += [t] * want[i]
    assert {r.call_id: r.accepted for r in limits.limited(df, "sliding", 3, 60).collect()} == want


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "jobs").mkdir()
    for i in range(3):
        (tmp_path / "jobs" / f"{i}.json").write_text(json.dumps({"document_id": f"d{i}", "version_id": "1", "queued_at": "2024-01-01T00:00:00Z"}))
    seen = []
    jobs = ingest.job_source(spark, str(tmp_path / "jobs"))
    q = ingest.worker(jobs, {s: (lambda b, s=s: seen.append((s, b.first().document_id))) for s in ingest.STAGES}, str(tmp_path / "status"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert len(seen) == 3 * len(ingest.STAGES)
    last = limits.latest_status(spark.read.parquet(str(tmp_path / "status")))
    assert last.count() == 15 and {r.status for r in last.collect()} == {"completed"}
    assert R.health(spark.createDataFrame([(True,), (False,)], "up boolean")).first().status == "degraded"


def test_engine(spark, tmp_path):
    from folioframe.api import Engine, settings_report

    e = Engine(spark, str(tmp_path / "root"))
    docs = [("d1", 5, "ready", 1), ("d2", 6, "ready", 2), ("d3", 6, "ready", 3)]
    e.put("documents", spark.createDataFrame(docs, "document_id string, owner_id int, status string, created_at int"))
    e.put("permissions", spark.createDataFrame([("d2", 5, "read")], "document_id string, user_id int, permission_level string"))
    e.put("document_versions", spark.createDataFrame([("d1", 1, "a"), ("d1", 2, "b")], "document_id string, version_num int, blob_key string"))
    e.put("processing_statuses", spark.createDataFrame([("d1", "parse", "running", 1), ("d1", "parse", "completed", 2)], "document_id string, stage string, status string, at int"))
    texts = {"d1": "the red pump moves water", "d2": "a blue valve stops water", "d3": "secret figures of the firm"}
    words = [(d, 1, n, w, 50.0 + 40 * n, 100.0, 50.0 + 40 * n + 5 * len(w), 112.0) for d, t in texts.items() for n, w in enumerate(t.split())]
    e.ingest(spark.createDataFrame(words, "document_id string, page_number int, word_no long, text string, l double, t double, r double, b double"), 612.0, 792.0)
    e.put("figures", spark.createDataFrame([("d1", "p1_f1", "figures/d1/p1_f1.png")], "document_id string, figure_id string, blob_key string"))
    assert [r.document_id for r in e.list_documents(5).collect()] == ["d2", "d1"]
    assert e.document_detail(5, "d1").first().blob_key == "b" and e.document_detail(5, "d3").isEmpty()
    assert e.status("d1").first().status == "completed"
    reply = e.ask("red pump", 5)
    assert reply.answer.startswith("the red pump moves water") and {c["document_id"] for c in reply.citations} == {"d1", "d2"}
    assert e.ask("secret figures", 5, ["d3"]).answer == qa.NO_EVIDENCE
    assert e.ask("red pump vs blue valve", 5, agent=True).citations[0]["document_id"] == "d1"
    (tmp_path / "figures/d1").mkdir(parents=True)
    (tmp_path / "figures/d1/p1_f1.png").write_bytes(b"png")
    blobs = readers.blobs(spark, str(tmp_path / "figures"))
    assert e.figure_bytes(5, "d1", "f1", blobs) == b"png" and e.figure_bytes(9, "d1", "f1", blobs) is None
    assert not e.delete_document(5, "d2") and e.delete_document(5, "d1")
    assert [r.document_id for r in e.list_documents(5).collect()] == ["d2"] and e.table("chunks").filter("document_id = 'd1'").isEmpty()
    e.put("conversations", spark.createDataFrame([(1, 5, 9), (2, 6, 8)], "conversation_id int, user_id int, updated_at int"))
    e.put("messages", spark.createDataFrame([(1, 1, 1, "hi"), (1, 2, 2, "yo")], "conversation_id int, created_at int, message_id int, text string"))
    assert [(r.conversation_id, r.message_count) for r in e.list_conversations(5).collect()] == [(1, 2)]
    assert [r.text for r in e.conversation(5, 1).collect()] == ["hi", "yo"] and e.conversation(6, 1).isEmpty()
    assert not e.delete_conversation(6, 1) and e.delete_conversation(5, 1) and e.table("messages").isEmpty()
    assert settings_report({"A": "1"}, {"x": ("A",), "y": ("A", "B")}) == [("OK", "x"), ("FAIL", "y: B")]


def test_image_plugins(spark):
    from folioframe.operators import figures as G

    class Model:
        def __init__(self):
            self.n = 0

        def describe(self, image, mime):
            self.n += 1
            if self.n == 2:
                raise ValueError
            if self.n == 3:
                raise ResourceWarning
            return image.decode()

    crops = spark.createDataFrame([(i, b"c%d" % i) for i in range(5)], "i int, content binary").coalesce(1)
    assert [r.caption for r in G.described(crops, Model).orderBy("i").collect()] == ["c0", None, None, None, None]

    class Renderer:
        def crop(self, content, page, box, dpi):
            return content, int(box[2] - box[0]), dpi

    figs = spark.createDataFrame([("d", 2, 1.0, 2.0, 11.0, 22.0)], "document_id string, page_number int, l double, t double, r double, b double")
    r = G.rendered(figs, spark.createDataFrame([("d", b"x")], "document_id string, content binary"), Renderer).first()
    assert (bytes(r.png), r.width_px, r.height_px) == (b"x", 10, 150)


def test_default_embeddings_are_those_of_the_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "  ")], "doc_id long, text string"))
    model = qa.HashingEmbedder()
    for r in qa.embed_texts(docs, "text").collect():
        want = model.embed([r.text if r.text and r.text.strip() else " "])[0]
        assert r.embedding == pytest.approx(want, abs=1e-6)


def test_agent_is_that_of_plain_python(spark, sf_dir):
    """Every question's first answer, with retrieval, fusion and the choice of evidence written out."""
    from folioframe.plans import qa_queries
    from folioframe.plans.text_queries import WC

    import numpy as np
    import regex

    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    known = sorted(i for i in vectors if i in rows)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("question_id"), F.col("text").alias("query"))
    planned = {}
    for r in qa.plan_queries(items).collect():
        planned.setdefault(r.question_id, {})[r.sq] = r.query
    tokens = lambda t: regex.findall(f"[{WC}]{{2,}}", (t or "").lower())
    want = {}
    for q, subs in planned.items():
        if q not in vectors:
            continue
        found = {}
        for sq in sorted(subs):
            v = vectors[q]
            cos = {i: round(float(v @ vectors[i] / (np.linalg.norm(v) * np.linalg.norm(vectors[i]))), 9) for i in known}
            pool = sorted(known, key=lambda i: (-cos[i], i))[:10]
            words = {i: tokens(rows[i].text) for i in pool}
            mean = sum(map(len, words.values())) / len(pool)
            score = {i: round(sum(words[i].count(t) * 2.5 / (words[i].count(t) + 1.5 * (0.25 + 0.75 * len(words[i]) / mean)) for t in tokens(subs[sq])), 9) for i in pool}
            lexical = sorted(pool, key=lambda i: (-score[i], pool.index(i)))
            fused = {i: round(1 / (61 + pool.index(i)) + 1 / (61 + lexical.index(i)), 9) for i in pool}
            for n, i in enumerate(sorted(pool, key=lambda i: (-fused[i], pool.index(i)))[:6]):
                found.setdefault(i, (sq, n, i))
        first = rows[min(found, key=found.get)]
        text = " ".join(first.text.split())
        want[q] = f"{text[:200]}{'...' if len(text) > 200 else ''} [Doc: {first.source}, Page: {first.doc_id % 12}]"
    got = {r.question_id: r for r in qa_queries.agent_answer(spark, sf_dir).collect()}
    assert {q: r.answer for q, r in got.items()} == want and want
    assert all(r.is_verified and r.retries == 0 for r in got.values())


def test_settings_and_memory_findings():
    from folioframe.api import exit_code, memory_report, settings_report

    needs = {"embedder": ("EMBED_URL", "EMBED_MODEL", "EMBED_KEY"), "store": ("STORE_URL",)}
    good = {"EMBED_URL": "u", "EMBED_MODEL": "m", "EMBED_KEY": "k", "STORE_URL": "s", "SECRET": "x" * 32, "LLM_1_BASE_URL": "u", "LLM_1_MODEL": "m", "LLM_1_API_KEY": "your-key"}
    found = settings_report(good, needs, ("SECRET",), ["1"])
    assert found == [("OK", "embedder"), ("OK", "store"), ("WARN", "LLM 1: LLM_1_API_KEY")] and exit_code(found) == 0
    bad = settings_report({"EMBED_URL": "u", "EMBED_MODEL": "m", "EMBED_KEY": "change-me", "SECRET": "short"}, needs, ("SECRET",), [])
    assert [x[0] for x in bad] == ["WARN", "FAIL", "WARN", "FAIL"] and exit_code(bad) == 1
    assert memory_report(3000) == ("OK", 2250) and memory_report(3000, 1000) == ("WARN", 2250) and memory_report(2500, 0, ("rerank",)) == ("WARN", 2850)


def test_page_digits_are_looked_for_in_the_corners():
    word = lambda t, x, b: {"text": t, "l": x, "t": b - 9.0, "r": x + 9.0, "b": b}

    class Reader:
        asked = []

        def clip(self, content, page, box):
            self.asked.append(box)
            return [word(" 7 ", box[0] + 1, 790.0), word("vii", box[0] + 20, 790.0)]

    words = [word("12", 50.0, 300.0), word("body", 50.0, 780.0)]
    got = readers.with_page_digits(Reader(), b"", 1, 600.0, 800.0, words)
    assert [w["text"] for w in got] == ["12", "body", "7", "7"] and Reader.asked == [(510.0, 720.0, 600.0, 800.0), (0.0, 720.0, 90.0, 800.0)]
    assert readers.with_page_digits(Reader(), b"", 1, 600.0, 800.0, [*words, word("7", 300.0, 790.0)])[-1]["l"] == 300.0 and len(Reader.asked) == 2
    assert readers.with_page_digits(object(), b"", 1, 600.0, 800.0, words) == words
