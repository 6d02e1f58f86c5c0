"""Queries over the text functions, each with the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.plans.registry import query, table

WC = r"\p{L}\p{N}_"
S_, E_ = f"(^|[^{WC}])", f"($|[^{WC}])"

#: Literal rows for what the invented prose never says; every query unions them with its whole table.
SAMPLES = (
    "Show me a photo of the pump on page 11", "what does it look like?", "Compare the P vs the Q series",
    "Compare the P VS the Q series", "difference between A and B", "see pg 3, p. 2 or page 7", "12", "Page 4", "p. 12",
    "Page 11 of 12", "www.example.com  262-681-3583", "(c) Example Corporation", "All rights reserved 53154", "Acme Inc, 53154-1234",
    "BATTERY PACK", "WEIGHT 200 LBS", "Weight: 441-481lbs (200-218kg)", "Run Time*: up to 2.5 Hours", "System Voltage/Amps 24 VDC / 20",
    "* Based on standard options", "“Based off tests", "1,200 lbs and 24VDC, 441-481 units *", "• a bullet line -",
    "As shown [Doc: manual.pdf, Page: 3] and 【Doc: Guide, Page 12】.", "There is insufficient evidence.", "Hours: 7 hours",
    "one and two three four five six seven eight nine ten eleven", "no colon here", ": empty key", "key only:",
)


def _values() -> str:
    return ", ".join(f"({-1 - k}, '" + s.replace("'", "''") + "')" for k, s in enumerate(SAMPLES))


def samples(spark: SparkSession) -> DataFrame:
    """(id, text) of the literal rows."""
    return spark.createDataFrame([(-1 - k, s) for k, s in enumerate(SAMPLES)], "id long, text string")


SAMPLE_ROWS = f"samples AS (SELECT CAST(id AS BIGINT) AS id, text FROM (VALUES {_values()}) v(id, text))"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): the samples, all turns of conversations and all benchmark passages."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select((1_000_000_000 + F.col("item_id")).cast("long").alias("id"), "text")
    return samples(spark).unionByName(turns).unionByName(items)


TEXTS = f"""texts AS (SELECT CAST(id AS BIGINT) AS id, text FROM (VALUES {_values()}) v(id, text)
  UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT 1000000000 + item_id, text FROM benchmark)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line): all lines of all documents, and the samples as documents of one line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    samples = spark.createDataFrame([(-1 - k, 0, s) for k, s in enumerate(SAMPLES)], "doc_id long, line_no int, line string")
    return docs.unionByName(samples).withColumn("line_no", F.col("line_no").cast("long"))


LINES = f"""lines AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS line_no, unnest(p) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
  UNION ALL SELECT CAST(id AS BIGINT), 0, text FROM (VALUES {_values()}) v(id, text))"""

TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
COLLAPSE = TRIM.format(r"regexp_replace({0}, '\s+', ' ', 'g')")


def trim(x: str) -> str:
    return TRIM.replace("{0}", x)


def collapse(x: str) -> str:
    return COLLAPSE.replace("{0}", x)


QUALITY = rf"""
  quality_of AS (SELECT id, t, CAST(length(t) AS DOUBLE) AS n,
      length(regexp_replace(t, '[^\x09-\x0D\x20-\x7E{T.CLEAN_CHARS}]', '', 'g')) AS good,
      length(regexp_replace(t, '\s+', '', 'g')) / CAST(len(regexp_split_to_array(t, '\s+')) AS DOUBLE) AS mean
    FROM (SELECT doc_id AS id, {trim("coalesce(text, '')")} AS t FROM documents)),
  quality AS (SELECT id, t, CASE WHEN t = '' THEN 0.0 ELSE round(good / n * 0.7 + 0.3 *
      CASE WHEN mean < 2 THEN mean / 2 WHEN mean <= 15 THEN 1.0 ELSE greatest(0.0, 1 - (mean - 15) / 15) END, 4) END AS quality FROM quality_of)"""


@query("fn03_text_quality", f"WITH {QUALITY} SELECT id AS doc_id, quality FROM quality")
def text_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.text_quality(F.col("text")).alias("quality"))


@query(
    "fn05_page_route",
    f"""WITH {QUALITY}, p AS (SELECT id, length(t) AS chars, quality, CAST(id % 10 AS DOUBLE) / 10 AS image_ratio FROM quality)
SELECT id AS doc_id, CAST(chars AS BIGINT) AS char_count, round(chars / 501811.2, 6) AS char_density, quality,
  CASE WHEN NOT (chars >= 50 AND quality >= 0.65) AND chars >= 50 AND image_ratio > 0.1 THEN 'hybrid'
    WHEN NOT (chars >= 50 AND quality >= 0.65) THEN 'scanned' WHEN image_ratio > 0.35 THEN 'hybrid' ELSE 'text_native' END AS route FROM p""",
)
def page_route(spark, sf_dir):
    chars, quality = T.char_count(F.col("text")), T.text_quality(F.col("text"))
    ratio = (F.col("doc_id") % 10).cast("double") / 10
    return table(spark, sf_dir, "documents").select(
        "doc_id", chars.alias("char_count"), F.round(chars / F.lit(501811.2), 6).alias("char_density"), quality.alias("quality"),
        T.page_route(chars, quality, ratio).alias("route"),
    )


@query("fn06_boilerplate_normalise", f"WITH {LINES} SELECT doc_id, line_no, {collapse(chr(39).join(['regexp_replace(lower(line), ', chr(92) + 'd+', ', ', '#', ', ', 'g', ')']))} AS template FROM lines")
def boilerplate_normalise(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", T.boilerplate_template(F.col("line")).alias("template"))


CONTACT = "(?i)" + "|".join(f"({p})" for p in T.CONTACT_PATTERNS)


@query("fn07_contact_legal", f"WITH {LINES} SELECT doc_id, line_no, regexp_matches(line, '{CONTACT}') AS legal FROM lines")
def contact_legal(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", T.is_contact_or_legal(F.col("line")).alias("legal"))


PAGE_NO = (
    f"CAST(coalesce(nullif(regexp_extract({trim('line')}, '^(\\d{{1,3}})$', 1), ''), "
    f"nullif(regexp_extract(line, '(?i){S_}(page|p\\.?)\\s*(\\d{{1,3}}){E_}', 3), '')) AS INTEGER)"
)


@query("fn08_printed_page_no", f"WITH {LINES} SELECT doc_id, line_no, {PAGE_NO} AS page_no FROM lines")
def printed_page_no(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", T.printed_page_number(F.col("line")).alias("page_no"))


@query("fn09_whitespace", f"WITH {LINES} SELECT doc_id, line_no, {collapse('line')} AS text FROM lines")
def whitespace(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", T.collapse(F.col("line")).alias("text"))


HEADER = "(line = upper(line) AND upper(line) <> lower(line) AND length(line) > 3" + "".join(f" AND NOT contains(line, '{u}')" for u in T.HEADER_STOPS) + ")"


@query("fn11_section_header", f"WITH {LINES} SELECT doc_id, line_no, {HEADER} AS header FROM lines")
def section_header(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", T.is_section_header(F.col("line")).alias("header"))


VOLTAGE = r"(?i)^(System Voltage(?:/Amps)?)\s+(.*)$"


@query(
    "fn12_key_value",
    rf"""WITH {LINES}, kv AS (SELECT doc_id, line_no,
    CASE WHEN contains(line, ':') THEN {trim("substr(line, 1, instr(line, ':') - 1)")} ELSE {trim(f"regexp_extract(line, '{VOLTAGE}', 1)")} END AS attribute,
    CASE WHEN contains(line, ':') THEN {trim("substr(line, instr(line, ':') + 1)")} ELSE {trim(f"regexp_extract(line, '{VOLTAGE}', 2)")} END AS value FROM lines)
SELECT * FROM kv WHERE attribute <> '' AND value <> ''""",
)
def key_values(spark, sf_dir):
    kv = lines(spark, sf_dir).select("doc_id", "line_no", T.key_value(F.col("line")).alias("kv")).filter("kv is not null")
    return kv.select("doc_id", "line_no", "kv.attribute", "kv.value")


@query(
    "fn13_unit_variants",
    rf"""WITH {LINES}, u AS (SELECT doc_id, line_no, line, nullif({trim(f"regexp_extract(line, '{T.UNIT_PAIR}', 1)")}, '') AS imperial,
    nullif({trim(f"regexp_extract(line, '{T.UNIT_PAIR}', 2)")}, '') AS metric, nullif(regexp_extract(line, '{T.HOURS}', 1), '') AS h FROM lines),
  v AS (SELECT doc_id, line_no, imperial, metric, CASE WHEN imperial IS NULL THEN h END AS hours FROM u)
SELECT doc_id, line_no, imperial, metric, hours, CAST(CAST(floor(TRY_CAST(hours AS DOUBLE) * 60) AS INTEGER) AS VARCHAR) AS minutes FROM v""",
)
def unit_variants(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", T.unit_variants(F.col("line")).alias("u")).select("doc_id", "line_no", "u.*")


MARKS = T.MARKS.replace("'", "''")


@query(
    "fn14_footnotes",
    rf"""WITH {LINES} SELECT doc_id, line_no, {trim(f"regexp_replace(line, '^[{MARKS}]+', '* ')")} AS footnote FROM lines
WHERE regexp_matches(line, '^[{MARKS}]{{1,4}}') OR regexp_matches(line, '(?i)^[{MARKS}]*based\s+(on|off)')""",
)
def footnotes(spark, sf_dir):
    return lines(spark, sf_dir).filter(T.is_footnote(F.col("line"))).select("doc_id", "line_no", T.footnote_text(F.col("line")).alias("footnote"))


@query(
    "fn17_tokenise",
    f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[{WC}]{{2,}}')) AS token FROM documents)
SELECT doc_id, token, count(*) AS n FROM t GROUP BY doc_id, token""",
)
def tokenise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("fn18_token_counts", r"SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS estimate, CAST(len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) AS BIGINT) AS words FROM documents")
def token_counts(spark, sf_dir):
    words = F.size(F.split(T.strip(F.col("text")), r"\s+")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("estimate"), words.alias("words"))


VISUAL = f"regexp_matches(lower(text), '{S_}({'|'.join(T.VISUAL_KEYWORDS)}){E_}')"


@query("fn19_visual_intent", f"WITH {TEXTS} SELECT id, {VISUAL} AS visual FROM texts")
def visual_intent(spark, sf_dir):
    return texts(spark, sf_dir).select("id", T.is_visual(F.col("text")).alias("visual"))


@query("fn20_page_reference", f"WITH {TEXTS} SELECT id, TRY_CAST(nullif(regexp_extract(lower(text), '{S_}(page|pg|p\\.?)\\s*(\\d+){E_}', 3), '') AS INTEGER) AS page FROM texts")
def page_reference(spark, sf_dir):
    return texts(spark, sf_dir).select("id", T.page_reference(F.col("text")).alias("page"))


STOPS = ", ".join(f"'{w}'" for w in T.FIGURE_STOP_WORDS)


@query("fn21_figure_tokens", f"WITH {TEXTS}, t AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '[{WC}]+')) AS token FROM texts) SELECT id, token FROM t WHERE token NOT IN ({STOPS})")
def figure_tokens(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.explode(T.figure_tokens(F.col("text"))).alias("token"))


@query(
    "fn22_citation_extract",
    rf"""WITH {TEXTS}, c AS (SELECT id, unnest(regexp_extract_all(text, '{T.CITATION}', 1)) AS document, unnest(regexp_extract_all(text, '{T.CITATION}', 2)) AS page FROM texts)
SELECT id, {trim("document")} AS document, CAST(page AS INTEGER) AS page FROM c""",
)
def citation_extract(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.explode(T.citations(F.col("text"))).alias("c")).select("id", "c.document", "c.page")


@query("fn23_insufficient", f"WITH {TEXTS} SELECT id, contains(lower(text), 'insufficient evidence') AS insufficient FROM texts")
def insufficient(spark, sf_dir):
    return texts(spark, sf_dir).select("id", T.says_insufficient(F.col("text")).alias("insufficient"))


@query(
    "fn25_query_plan",
    rf"""WITH {TEXTS}, q AS (SELECT id, {trim("text")} AS q FROM texts),
  f AS (SELECT id, q, (contains(lower(q), 'compare') OR contains(lower(q), 'difference between') OR contains(lower(q), 'versus') OR contains(lower(q), ' vs ')) AS cmp, string_split(q, ' vs ') AS parts FROM q)
SELECT id, CASE WHEN cmp THEN 'compare' WHEN contains(lower(q), ' and ') AND len(regexp_split_to_array(q, '\s+')) > 10 THEN 'unified' ELSE 'direct' END AS plan,
  CASE WHEN cmp AND contains(lower(q), ' vs ') AND len(parts) = 2 THEN {trim("parts[1]")} || '|' || {trim("parts[2]")} || '|' || q ELSE q END AS sub_queries FROM f""",
)
def query_plan(spark, sf_dir):
    p = texts(spark, sf_dir).select("id", T.query_plan(F.col("text")).alias("p"))
    return p.select("id", "p.plan", F.array_join("p.sub_queries", "|").alias("sub_queries"))


@query("fn26_clean_lines", rf"WITH {LINES} SELECT doc_id, line_no, " + collapse(r"regexp_replace(regexp_replace(line, '^[\s•●⁃·\x{95}\-*]+', ''), '[\s•●⁃·\x{95}\-*]+$', '')") + " AS text FROM lines")
def clean_lines(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", T.clean_line(F.col("line")).alias("text"))


def normalised(source: str) -> str:
    """SQL for the normalised tokens (``token``, ``pos``) of ``source(id, text)``."""
    t = "translate(coalesce(text, ''), '’‘“”', '''''\"\"')"
    for pattern, to in (
        (r"(\d),(\d)", r"\1\2"), (r"(\d+)([a-zA-Z]+)", r"\1 \2"), (r"([a-zA-Z]+)(\d+)", r"\1 \2"),
        (r"(\d+)-(\d+)", r"\1 - \2"), (r"""(\d+)(["''*+])""", r"\1 \2"), (r"(\*+)", r" \1 "),
    ):
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return f"""(SELECT id, pos, token FROM (SELECT id, generate_subscripts(p, 1) AS pos, lower(trim(unnest(p), ' ,;:()[]{{}}')) AS token
      FROM (SELECT id, regexp_split_to_array({t}, '\\s+') AS p FROM {source})) WHERE token <> '')"""


@query("fn27_normalise_tokens", f"WITH {TEXTS} SELECT id, token, count(*) AS n FROM {normalised('texts')} GROUP BY id, token")
def normalise_tokens(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.explode(T.normalised_tokens(F.col("text"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))


@query(
    "fn28_numeric_tokens",
    f"WITH d AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT CAST(id AS BIGINT), text FROM (VALUES {_values()}) v(id, text)) SELECT id, token, count(*) AS n FROM {normalised('d')} WHERE regexp_matches(token, '\\d') GROUP BY id, token",
)
def numeric_tokens(spark, sf_dir):
    samples = spark.createDataFrame([(-1 - k, s) for k, s in enumerate(SAMPLES)], "id long, text string")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(samples)
    return docs.select("id", F.explode(T.numeric_tokens(F.col("text"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))


FILTERED = (r"all rights reserved.*", r"(www\.)?example\.com")


@query(
    "fn31_boilerplate_filter",
    rf"""WITH {LINES} SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE {trim("line")} <> ''
  AND NOT regexp_matches(lower({trim("line")}), '{"|".join(f"({p})" for p in FILTERED)}')), '') AS text FROM lines GROUP BY doc_id""",
)
def boilerplate_filter(spark, sf_dir):
    samples = spark.createDataFrame([(-1 - k, s) for k, s in enumerate(SAMPLES)], "doc_id long, text string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(samples)
    return docs.select("doc_id", T.without_lines(F.col("text"), FILTERED).alias("text"))


@query(
    "fn34_conversation_title",
    rf"""SELECT conv_id, coalesce(nullif({trim("substr(text, 1, 50)")}, ''), 'New conversation') AS title FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) = 1""",
)
def conversation_title(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("text"))
    return first.select("conv_id", T.conversation_title(F.col("text")).alias("title"))


@query(
    "snk01_point_id",
    """WITH h AS (SELECT doc_id, sha1(CAST(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('documents:' || source || ':' || doc_id) AS BLOB)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""",
)
def point_id(spark, sf_dir):
    name = F.concat(F.lit("documents:"), F.col("source"), F.lit(":"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", T.uuid5(name).alias("point_id"))


@query(
    "snk07_citation_projection",
    """SELECT doc_id AS chunk_id, source AS document, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet,
  round(CAST(n_chars AS DOUBLE) / 7000, 4) AS score FROM documents""",
)
def citation_projection(spark, sf_dir):
    score = F.round(F.col("n_chars").cast("double") / 7000, 4)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document"), T.snippet(F.col("text")).alias("snippet"), score.alias("score"))


@query(
    "src11_validate_upload",
    """WITH u AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN '%PDF-1.7' || text WHEN 'fr' THEN '' ELSE text END AS body,
    CASE WHEN doc_id % 2 = 0 THEN 'a.PDF' ELSE 'a.txt' END AS name, CASE WHEN doc_id % 3 = 0 THEN 'application/pdf' ELSE 'text/plain' END AS mime FROM documents)
SELECT doc_id, sha256(body) AS file_hash, CASE WHEN NOT (lower(name) LIKE '%.pdf' OR mime = 'application/pdf') THEN 'type' WHEN strlen(body) = 0 THEN 'empty'
  WHEN strlen(body) > 52428800 THEN 'too large' WHEN substr(body, 1, 4) <> '%PDF' THEN 'signature' END AS refused FROM u""",
)
def validate_upload(spark, sf_dir):
    body = F.when(F.col("lang") == "en", F.concat(F.lit("%PDF-1.7"), "text")).when(F.col("lang") == "fr", "").otherwise(F.col("text"))
    name = F.when(F.col("doc_id") % 2 == 0, "a.PDF").otherwise("a.txt")
    mime = F.when(F.col("doc_id") % 3 == 0, "application/pdf").otherwise("text/plain")
    content = body.cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(content, 256).alias("file_hash"), T.fails_upload(name, mime, content).alias("refused"))


@query("q24_hash_dedupe", "SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def hash_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("file_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
