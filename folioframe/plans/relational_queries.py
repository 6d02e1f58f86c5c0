"""Access, listing, conversation and set queries; documents are orders, their owners customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.operators import relational as R
from folioframe.operators import retrieval
from folioframe.plans.registry import query, table


def documents(spark, sf_dir):
    """Orders as documents: owner = customer, ready when finished."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("owner_id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("queued").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("size"),
    )


def permissions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("user_id"), F.when(F.col("l_linenumber") == 1, "write").otherwise("read").alias("permission_level"))


def messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("created_at"), F.col("turn").alias("message_id"), "role", "text")


DOCS = "docs AS (SELECT o_orderkey AS document_id, o_custkey AS owner_id, CASE WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'queued' END AS status, o_orderdate AS created_at FROM orders)"
PERMS = "perms AS (SELECT l_orderkey AS document_id, l_suppkey AS user_id, CASE WHEN l_linenumber = 1 THEN 'write' ELSE 'read' END AS permission_level FROM lineitem)"


@query(
    "ret01_acl_resolve",
    f"""WITH {DOCS}, {PERMS} SELECT document_id FROM docs WHERE status = 'ready' AND owner_id = 5
UNION SELECT document_id FROM docs WHERE status = 'ready' AND document_id IN (SELECT document_id FROM perms WHERE user_id = 5)""",
)
def acl_resolve(spark, sf_dir):
    return retrieval.authorised(documents(spark, sf_dir), permissions(spark, sf_dir), F.lit(5))


@query("ret01_acl_admin", f"WITH {DOCS} SELECT document_id FROM docs WHERE status = 'ready'")
def acl_admin(spark, sf_dir):
    return retrieval.authorised(documents(spark, sf_dir), permissions(spark, sf_dir), F.lit(5), admin=True)


@query("rel03_list_documents", f"WITH {DOCS}, {PERMS} SELECT document_id, owner_id, status, created_at FROM docs WHERE owner_id = 5 OR document_id IN (SELECT document_id FROM perms WHERE user_id = 5)")
def list_documents(spark, sf_dir):
    return R.list_documents(documents(spark, sf_dir), permissions(spark, sf_dir), F.lit(5)).select("document_id", "owner_id", "status", "created_at")


@query("rel01_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice")


@query("rel02_conjunction", "SELECT o_orderkey FROM orders WHERE o_orderkey = 7 AND o_custkey = (SELECT min(o_custkey) FROM orders WHERE o_orderkey = 7)")
def conjunction(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    owner = o.filter("o_orderkey = 7").agg(F.min("o_custkey").alias("o_custkey"))
    return o.filter("o_orderkey = 7").join(F.broadcast(owner), "o_custkey", "left_semi").select("o_orderkey")


@query("rel04_in_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 3, 5, 7, 11)")
def in_list(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter(F.col("o_orderkey").isin(1, 3, 5, 7, 11)).select("o_orderkey", "o_orderstatus")


@query("rel05_permission_join", f"WITH {DOCS}, {PERMS} SELECT user_id, count(*) AS n, count(DISTINCT document_id) AS n_documents FROM perms JOIN docs USING (document_id) WHERE status = 'ready' GROUP BY user_id")
def permission_join(spark, sf_dir):
    j = permissions(spark, sf_dir).join(documents(spark, sf_dir).filter("status = 'ready'").select("document_id"), "document_id")
    return j.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("n_documents"))


@query(
    "rel06_document_children",
    "SELECT o_orderkey AS document_id, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber), '') AS children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
)
def document_children(spark, sf_dir):
    kids = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.array_join(F.sort_array(F.collect_list("l_linenumber")), ",").alias("children"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id")).join(kids, "document_id", "left").fillna({"children": ""})


@query("rel08_semi_acl", f"WITH {DOCS}, {PERMS} SELECT document_id, owner_id FROM docs WHERE document_id IN (SELECT document_id FROM perms WHERE permission_level = 'write')")
def semi_acl(spark, sf_dir):
    return documents(spark, sf_dir).join(permissions(spark, sf_dir).filter("permission_level = 'write'"), "document_id", "left_semi").select("document_id", "owner_id")


@query("rel09_anti_fallback", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_fallback(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query(
    "rel10_outer_score_merge",
    "SELECT coalesce(doc_id, vec_id) AS id, coalesce(quality, 0) + coalesce(label, 0) AS score FROM labels FULL JOIN embeddings ON doc_id = vec_id",
)
def outer_score_merge(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"), "full")
    return j.select(F.coalesce("doc_id", "vec_id").alias("id"), (F.coalesce("quality", F.lit(0)) + F.coalesce("label", F.lit(0))).alias("score"))


@query("rel13_set_union", "SELECT o_custkey AS id FROM orders UNION SELECT l_suppkey FROM lineitem")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).union(table(spark, sf_dir, "lineitem").select("l_suppkey")).distinct()


@query("rel14_intersect_all", "SELECT id, count(*) AS n FROM (SELECT o_custkey AS id FROM orders INTERSECT ALL SELECT l_suppkey FROM lineitem) GROUP BY id")
def intersect_all(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return R.multiset_intersection(a, table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id")), ["id"])


@query("rel15_except", "SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 49")
def set_except(spark, sf_dir):
    large = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select("l_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).subtract(large)


@query("rel16_conversation_messages", "SELECT conv_id AS conversation_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INTEGER) AS nth, role, text FROM conversations")
def conversation_messages(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("conversation_id").orderBy("created_at", "role", "text")
    return messages(spark, sf_dir).select("conversation_id", F.row_number().over(order).alias("nth"), "role", "text")


@query("rel17_top_documents", f"WITH {DOCS} SELECT document_id, created_at FROM docs ORDER BY created_at DESC, document_id LIMIT 20")
def top_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", "created_at").orderBy(F.desc("created_at"), "document_id").limit(20)


@query("rel18_conversation_summaries", "SELECT c_custkey AS conversation_id, count(conv_id) AS message_count FROM customer LEFT JOIN conversations ON conv_id = c_custkey GROUP BY c_custkey")
def conversation_summaries(spark, sf_dir):
    conv = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("conversation_id"))
    return R.conversation_summaries(conv, messages(spark, sf_dir))


@query(
    "q03_history_first6_last4",
    """WITH h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations QUALIFY nth <= 6)
SELECT conv_id AS conversation_id, CAST(nth AS INTEGER) AS nth, role, text FROM h QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4""",
)
def history_first6_last4(spark, sf_dir):
    return R.history(messages(spark, sf_dir)).select("conversation_id", "nth", "role", "text")


@query("q03_history_recent", "SELECT conv_id AS conversation_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def history_recent(spark, sf_dir):
    return R.history_recent(messages(spark, sf_dir)).select("conversation_id", F.col("created_at").alias("turn"), "text")


@query("rel19_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("rel20_having", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 HAVING n >= 2")
def having(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("n")).filter("n >= 2")


@query(
    "rel21_aggregates",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_discount), 6) AS mean, min(l_tax) AS low, max(l_tax) AS high,
  round(median(l_extendedprice), 6) AS middle FROM lineitem GROUP BY ALL""",
)
def aggregates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_discount"), 6).alias("mean"),
        F.min("l_tax").alias("low"), F.max("l_tax").alias("high"), F.round(F.median("l_extendedprice"), 6).alias("middle"),
    )


@query("rel22_upsert", "SELECT document_id, max_by(size, v) AS size FROM (SELECT o_orderkey AS document_id, o_totalprice AS size, 1 AS v FROM orders UNION ALL SELECT l_orderkey, l_extendedprice, 1 + l_linenumber FROM lineitem) GROUP BY document_id")
def upsert(spark, sf_dir):
    """Rows of one order and line number are told apart by their places in the files: the first one wins.

    Rows without a size have no version either, as the SQL passes over rows without one of both.
    """
    version = lambda v, size: F.when(F.col(size).isNotNull(), v).alias("v")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_no")]
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_totalprice").alias("size"), version(F.lit(1), "o_totalprice"), *place)
    new = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_extendedprice").alias("size"), version(F.col("l_linenumber") + 1, "l_extendedprice"), *place)
    out = R.upsert(old, new, "document_id", "v", ("file", "row_no"))
    return out.select("document_id", F.when(F.col("v").isNotNull(), F.col("size")).alias("size"))


@query("rel23_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("rel26_json", "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def json_value(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("rel27_durations", "SELECT user_id, date_diff('second', min(ts), max(ts)) AS seconds, min(ts) + INTERVAL 1 DAY AS expires FROM events GROUP BY user_id")
def durations(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.expr("timestampdiff(SECOND, date_trunc('SECOND', min(ts)), date_trunc('SECOND', max(ts)))").alias("seconds"), F.expr("min(ts) + INTERVAL 1 DAY").alias("expires")
    )


@query(
    "rel29_access_check",
    f"""WITH {DOCS}, {PERMS}, held AS (SELECT document_id, user_id, bool_or(permission_level IN ('write', 'admin')) AS w FROM perms GROUP BY ALL),
  req AS (SELECT o_orderkey AS document_id, o_orderkey % 10 AS user_id, o_orderkey % 97 = 0 AS is_admin, o_orderkey % 2 = 0 AS write FROM orders)
SELECT r.document_id, r.user_id, coalesce(r.is_admin OR d.owner_id = r.user_id OR (h.w IS NOT NULL AND (NOT r.write OR h.w)), false) AS allowed
FROM req r JOIN docs d USING (document_id) LEFT JOIN held h ON h.document_id = r.document_id AND h.user_id = r.user_id""",
)
def access_check(spark, sf_dir):
    k = F.col("o_orderkey")
    req = table(spark, sf_dir, "orders").select(k.alias("document_id"), (k % 10).alias("user_id"), (k % 97 == 0).alias("is_admin"), (k % 2 == 0).alias("write"))
    return R.access_check(req, documents(spark, sf_dir), permissions(spark, sf_dir)).select("document_id", "user_id", "allowed")


@query("rel30_latest_version", "SELECT l_orderkey AS document_id, 'v' || max(l_linenumber) AS blob_key, max(l_linenumber) AS version_num FROM lineitem GROUP BY 1")
def latest_version(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("version_num"), F.concat(F.lit("v"), "l_linenumber").alias("blob_key"))
    return R.latest_version(v)


@query("rel32_delete_conversation", "SELECT conv_id AS conversation_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY 1")
def delete_conversation(spark, sf_dir):
    m = messages(spark, sf_dir)
    left = R.cascade_delete(m.filter("role = 'system'"), "conversation_id", messages=m)["messages"]
    return left.groupBy("conversation_id").agg(F.count("*").alias("n"))


@query("snk08_cascade_delete", f"WITH {DOCS}, {PERMS} SELECT document_id, count(*) AS n_permissions FROM perms WHERE document_id NOT IN (SELECT document_id FROM docs WHERE status = 'ready') GROUP BY 1")
def cascade_delete(spark, sf_dir):
    gone = documents(spark, sf_dir).filter("status = 'ready'")
    left = R.cascade_delete(gone, "document_id", permissions=permissions(spark, sf_dir))["permissions"]
    return left.groupBy("document_id").agg(F.count("*").alias("n_permissions"))


@query("snk02_vector_delete", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def vector_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").join(gone, "vec_id", "left_anti").select("vec_id", "label")


@query(
    "rel25_approximate",
    """SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact, median(l_extendedprice) AS middle, true AS count_in_bound, true AS median_in_bound FROM lineitem GROUP BY l_returnflag""",
)
def approximate(spark, sf_dir):
    """Estimates beside the exact values: counts must be within three times the asked error, and the
    approximate median between the 49th and the 51st percentile."""
    x = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_orderkey", 0.02).alias("guess"), F.countDistinct("l_orderkey").alias("exact"), F.median("l_extendedprice").alias("middle"),
        F.percentile_approx("l_extendedprice", 0.5, 1000).alias("near"), F.percentile("l_extendedprice", F.array(F.lit(0.49), F.lit(0.51))).alias("ends"),
    )
    return x.select("l_returnflag", "exact", "middle", (F.abs(F.col("guess") - F.col("exact")) <= 0.06 * F.col("exact")).alias("count_in_bound"), F.col("near").between(F.col("ends")[0], F.col("ends")[1]).alias("median_in_bound"))


@query(
    "rel31_figure_key",
    """WITH f AS (SELECT l_orderkey AS document_id, 'p' || l_linenumber || '_f' || (l_partkey % 3) AS figure_id, 'figures/' || l_orderkey || '/' || l_partkey || '.png' AS blob_key FROM lineitem)
SELECT document_id, 'f1' AS wanted, coalesce(min(CASE WHEN figure_id = 'f1' OR ends_with(figure_id, '_f1') THEN blob_key END), 'figures/' || document_id || '/f1.png') AS blob_key FROM f GROUP BY document_id""",
)
def figure_keys(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    f = x.select(
        F.col("l_orderkey").cast("string").alias("document_id"), F.concat(F.lit("p"), "l_linenumber", F.lit("_f"), (F.col("l_partkey") % 3).cast("string")).alias("figure_id"),
        F.concat(F.lit("figures/"), "l_orderkey", F.lit("/"), "l_partkey", F.lit(".png")).alias("blob_key"),
    )
    return R.figure_key(f, F.lit("f1"), F.col("document_id")).select(F.col("document_id").cast("long").alias("document_id"), "wanted", "blob_key")


@query(
    "doc07_job_lifecycle",
    """WITH s AS (SELECT user_id AS document_id, ['profile', 'parse', 'tables', 'chunk', 'index'][1 + event_id % 5] AS stage, event_type <> 'error' AS ok, ts, event_id FROM events),
  last AS (SELECT document_id, stage, arg_max(ok, (ts, event_id)) AS ok FROM s GROUP BY ALL)
SELECT document_id, count(*) AS n_stages, CASE WHEN count(*) FILTER (WHERE NOT ok) > 0 THEN 'failed' WHEN count(*) = 5 THEN 'ready' ELSE 'processing' END AS status FROM last GROUP BY document_id""",
)
def job_lifecycle(spark, sf_dir):
    """Failed if some stage's last word is a failure, ready when all five are done, else processing."""
    from folioframe.streaming.ingest import document_status

    stage = F.element_at(F.array(*map(F.lit, ("profile", "parse", "tables", "chunk", "index"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("document_id"), stage.alias("stage"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.struct("ts", "event_id").alias("at")
    )
    return document_status(rows)


@query(
    "snk04_figure_manifest",
    "SELECT l_orderkey AS document_id, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS figures FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) GROUP BY 1",
)
def figure_manifest(spark, sf_dir):
    from folioframe.operators.figures import manifest

    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number"), F.col("l_partkey").alias("number")).distinct()
    item = F.transform("figures", lambda x: F.concat(x["page_number"].cast("string"), F.lit(":"), x["number"].cast("string")))
    return manifest(f).select("document_id", F.array_join(item, ",").alias("figures"))


@query(
    "rel07_range_join",
    """SELECT a.l_orderkey AS page, a.l_linenumber AS line, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_quantity BETWEEN a.l_quantity - 10 AND a.l_quantity + 10
  AND a.l_linenumber < b.l_linenumber GROUP BY ALL""",
)
def range_join(spark, sf_dir):
    """Always with the page as an equality key, so that it is a hash join with a residual range."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("q"))
    b = x.select("page", F.col("line").alias("other"), F.col("q").alias("q2"))
    return x.join(b, "page").filter("q2 between q - 10 and q + 10 and line < other").groupBy("page", "line").agg(F.count("*").alias("n"))


@query("rel11_cross_join", "SELECT n_name, min(levenshtein(n_name, r_name)) AS nearest FROM nation CROSS JOIN region GROUP BY n_name")
def cross_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").crossJoin(F.broadcast(table(spark, sf_dir, "region")))
    return n.groupBy("n_name").agg(F.min(F.levenshtein("n_name", "r_name")).cast("long").alias("nearest"))


@query(
    "rel12_asof_join",
    """WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT p.event_id, p.user_id, v.view_id FROM events p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts WHERE p.event_type = 'purchase'""",
)
def asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    views = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    bought = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return R.asof_join(bought, views, "user_id", "ts", ["view_id"]).select("event_id", "user_id", "view_id")


@query(
    "rel24_windows",
    """SELECT o_orderkey, rank() OVER w AS rank, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS running, lag(o_orderkey) OVER w AS before
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def windows(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.rank().over(w).cast("long").alias("rank"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("before")
    )
