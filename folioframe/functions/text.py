"""Text functions, Column -> Column, all inside code generation or built-in higher-order functions.

A word character is a letter, a digit or an underscore of any script; boundaries are spelled out with that
class, since the engines' own ``\\w`` and ``\\b`` differ in what they take for a word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"\p{L}\p{N}_"
START, END = f"(^|[^{W}])", f"($|[^{W}])"

# Characters of clean text besides printable ASCII and white space.
CLEAN_CHARS = "–—’“”°·±µ²³"
# Contact and legal patterns.
CONTACT_PATTERNS = (
    f"https?://[{W}]|{START}ww|www\\.[{W}]|[{W}]\\.(com|org|net){END}",
    r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}",
    f"corporation|(inc|llc|ltd|gmbh){END}",
    r"all\s*rights\s*reserved|subject\s*to\s*change|changewithoutnotice|copyright|\(c\)|©",
    f"{START}\\d{{5}}(-\\d{{4}})?{END}",
)
# Words and phrases that ask for something to look at.
VISUAL_KEYWORDS = (
    "photo", "photos", "photograph", "photographs", "pic", "pics", "picture", "pictures",
    "image", "images", "figure", "figures", "fig", "diagram", "diagrams", "schematic",
    "schematics", "illustration", "illustrations", "drawing", "drawings", "cutaway",
    "exploded", "view", "visual", "look like", "appearance", "show me", "display",
    "see the", "graph", "chart",
)
# Words left out of a figure query.
FIGURE_STOP_WORDS = ("a", "an", "the", "in", "on", "of", "to", "for", "is", "are", "what", "how", "i", "want", "show", "me")
# Units that keep a capitalised row from being a section header.
HEADER_STOPS = (":", "LBS", "KG", "RPM", "HP", "VDC", "AH", "GALLONS")
# A numbered heading.
HEADING_PREFIX = f"(?i)^(choose your{END}|section{END}|chapter{END}|part \\d+|view inside{END})"

# The same for RE2, whose own folding of case goes beyond ASCII.
HEADING_PREFIX_RE2 = "".join(f"[{x.upper()}{x}]" if x.islower() else x for x in "^(choose your@|section@|chapter@|part 0|view inside@)").replace("@", END).replace("0", "[0-9]")
# For RE2: what every line matches that ``is_contact_or_legal`` takes, and every row that ``table_records`` uses.
MAY_BE_CONTACT = r"(?i)://|ww|\.(com|org|net)|[0-9]{3}[-.\s\x0B]*[0-9]{3}[-.\s\x0B]*[0-9]{4}|[0-9]{5}|corporation|(inc|llc|ltd|gmbh)($|[^a-z0-9_])|all[\s\x0B]*rights|subject|changewithoutnotice|copyright|\(c\)|©"
MAY_BE_RECORD = ":|^[*\\s\\x0B\"'“”]|(?i:based|system voltage)|^[^a-z]*$"


def strip(c: Column) -> Column:
    """Trim all six ASCII white space characters, not only spaces."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def once(c: Column, then) -> Column:
    """``then(c)`` with ``c`` computed a single time, however often ``then`` uses it."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def text_quality(c: Column) -> Column:
    """0.7 * share of clean characters + 0.3 * sanity of the mean word length; 0 for blank text."""
    def share(x: Column) -> Column:
        mean = x["letters"] / x["words"]
        sane = F.when(mean < 2, mean / 2).when(mean <= 15, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - (mean - 15) / 15))
        return F.when(x["n"] == 0, F.lit(0.0)).otherwise(F.round(x["clean"] / x["n"] * 0.7 + sane * 0.3, 4))

    def counts(t: Column) -> Column:
        return F.struct(
            F.length(t).cast("double").alias("n"), F.length(F.regexp_replace(t, rf"[^\x09-\x0D\x20-\x7E{CLEAN_CHARS}]", "")).alias("clean"),
            F.length(F.regexp_replace(t, r"\s+", "")).alias("letters"), F.size(F.split(t, r"\s+")).cast("double").alias("words"),
        )

    return once(once(strip(F.coalesce(c, F.lit(""))), counts), share)


def char_count(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))).cast("long")


def page_route(chars: Column, quality: Column, image_ratio: Column, min_chars: int = 50, min_quality: float = 0.65, hybrid: float = 0.35) -> Column:
    readable = (chars >= min_chars) & (quality >= min_quality)
    return (
        F.when(~readable & (chars >= min_chars) & (image_ratio > 0.1), "hybrid")
        .when(~readable, "scanned")
        .when(image_ratio > hybrid, "hybrid")
        .otherwise("text_native")
    )


def boilerplate_template(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(c), r"\d+", "#"))


def is_contact_or_legal(c: Column, zip_codes: bool = True) -> Column:
    patterns = CONTACT_PATTERNS if zip_codes else CONTACT_PATTERNS[:-1]
    return F.coalesce(c.rlike("(?i)" + "|".join(f"({p})" for p in patterns)), F.lit(False))


def printed_page_number(c: Column) -> Column:
    """A bare number of one to three digits, else the number after 'page' or 'p.'; null without one."""
    bare = F.regexp_extract(strip(c), r"^(\d{1,3})$", 1)
    named = F.regexp_extract(c, f"(?i){START}(page|p\\.?)\\s*(\\d{{1,3}}){END}", 3)
    return F.coalesce(F.nullif(bare, F.lit("")), F.nullif(named, F.lit(""))).cast("int")


def is_section_header(c: Column) -> Column:
    """Capitals only (at least one cased letter), more than three characters, no unit inside."""
    capitals = (c == F.upper(c)) & (F.upper(c) != F.lower(c)) & (F.length(c) > 3)
    for unit in HEADER_STOPS:
        capitals = capitals & ~c.contains(unit)
    return capitals


def key_value(c: Column) -> Column:
    """struct(attribute, value) at the first colon, or after a known attribute; null without both."""
    named = r"(?i)^(System Voltage(?:/Amps)?)\s+(.*)$"
    colon = F.instr(c, ":") > 0
    attribute = F.when(colon, strip(F.substring_index(c, ":", 1))).otherwise(strip(F.regexp_extract(c, named, 1)))
    value = F.when(colon, strip(F.substr(c, F.instr(c, ":") + 1))).otherwise(strip(F.regexp_extract(c, named, 2)))
    return F.when((attribute != "") & (value != ""), F.struct(attribute.alias("attribute"), value.alias("value")))


# A pair of units, and hours.
UNIT_PAIR = r"(?i)([\d.\s\-]+(?:lbs|gal|gpm|hp|sqft/hr))\s*\(([\d.\s\-]+(?:kg|liters|lpm|watts|sqm))\)"
HOURS = r"(?i)([\d.]+)\s*hours"


def unit_variants(c: Column) -> Column:
    """struct(imperial, metric, hours, minutes), each null where the value does not state it."""
    imperial = F.nullif(strip(F.regexp_extract(c, UNIT_PAIR, 1)), F.lit(""))
    metric = F.nullif(strip(F.regexp_extract(c, UNIT_PAIR, 2)), F.lit(""))
    hours = F.when(imperial.isNull(), F.nullif(F.regexp_extract(c, HOURS, 1), F.lit("")))
    minutes = F.floor(hours.try_cast("double") * 60).cast("int").cast("string")
    return F.struct(imperial.alias("imperial"), metric.alias("metric"), hours.alias("hours"), minutes.alias("minutes"))


# Characters that open a footnote.
MARKS = r"\*\s\"'“”"


def is_footnote(c: Column) -> Column:
    return c.rlike(f"^[{MARKS}]{{1,4}}") | c.rlike(f"(?i)^[{MARKS}]*based\\s+(on|off)")


def footnote_text(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"^[{MARKS}]+", "* "))


def tokens(c: Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"([{W}]{{2,}})"), 1)


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def is_visual(c: Column) -> Column:
    return F.lower(c).rlike(START + "(" + "|".join(VISUAL_KEYWORDS) + ")" + END)


def page_reference(c: Column) -> Column:
    got = F.regexp_extract(F.lower(c), f"{START}(page|pg|p\\.?)\\s*(\\d+){END}", 3)
    return F.nullif(got, F.lit("")).try_cast("int")


def figure_tokens(c: Column) -> Column:
    every = F.regexp_extract_all(F.lower(c), F.lit(f"([{W}]+)"), 1)
    return F.array_except(F.array_distinct(every), F.array(*map(F.lit, FIGURE_STOP_WORDS)))


# A citation tag.
CITATION = r"(?i)[\[【]Doc:\s*([^,]+?),\s*Page:?\s*(\d+)[\]】]"


def citations(c: Column) -> Column:
    """array<struct(document, page)> of the citation tags, in order."""
    names = F.regexp_extract_all(c, F.lit(CITATION), 1)
    pages = F.regexp_extract_all(c, F.lit(CITATION), 2)
    return F.zip_with(names, pages, lambda a, b: F.struct(strip(a).alias("document"), b.try_cast("int").alias("page")))


def says_insufficient(c: Column) -> Column:
    """As the verifier looks for it."""
    return F.lower(c).contains("insufficient evidence")


def says_not_enough(c: Column, phrase: str = "insufficient evidence in authorized documents") -> Column:
    """As the generator looks for it; the phrase is a parameter."""
    return F.lower(c).contains(phrase)


def query_plan(c: Column) -> Column:
    """struct(plan, sub_queries): comparisons split in two, long conjunctions unified, else direct."""
    q = strip(c)
    low = F.lower(q)
    compares = low.contains("compare") | low.contains("difference between") | low.contains("versus") | low.contains(" vs ")
    parts = F.split(q, " vs ", -1)
    halves = compares & low.contains(" vs ") & (F.size(parts) == 2)
    long_and = low.contains(" and ") & (F.size(F.split(q, r"\s+")) > 10)
    plan = F.when(compares, "compare").when(long_and, "unified").otherwise("direct")
    subs = F.when(halves, F.array(strip(parts[0]), strip(F.get(parts, 1)), q)).otherwise(F.array(q))
    return F.struct(plan.alias("plan"), subs.alias("sub_queries"))


# Bullets around a line.
BULLETS = r"[\s•●⁃·\x{95}\-*]+"


def clean_line(c: Column) -> Column:
    return collapse(F.regexp_replace(F.regexp_replace(c, "^" + BULLETS, ""), BULLETS + "$", ""))


def normalised_tokens(c: Column) -> Column:
    """Order-free tokens: one kind of quotes, no thousands commas, numbers apart from units and ranges."""
    t = F.translate(F.coalesce(c, F.lit("")), "’‘“”", "''\"\"")
    # What is set apart, in this order.
    for pattern, to in (
        (r"(\d),(\d)", "$1$2"), (r"(\d+)([a-zA-Z]+)", "$1 $2"), (r"([a-zA-Z]+)(\d+)", "$1 $2"),
        (r"(\d+)-(\d+)", "$1 - $2"), (r"(\d+)([\"'*+])", "$1 $2"), (r"(\*+)", " $1 "),
    ):
        t = F.regexp_replace(t, pattern, to)
    bare = F.transform(F.split(t, r"\s+"), lambda x: F.lower(F.btrim(x, F.lit(" ,;:()[]{}"))))
    return F.filter(bare, lambda x: x != "")


def numeric_tokens(c: Column) -> Column:
    return F.filter(normalised_tokens(c), lambda x: x.rlike(r"\d"))


def cer(truth: Column, found: Column) -> Column:
    """Levenshtein distance over the length of the truth; an empty truth gives 0 or 1."""
    return F.when(F.length(truth) == 0, F.when(F.length(found) == 0, 0.0).otherwise(1.0)).otherwise(
        F.levenshtein(truth, found) / F.length(truth)
    )


def without_lines(c: Column, patterns: tuple[str, ...]) -> Column:
    """Drop blank lines and lines that hold one of the patterns (lower case)."""
    test = "|".join(f"({p})" for p in patterns) if patterns else r"(?!)"
    keep = F.filter(F.split(c, "\r\n|\n|\r"), lambda x: (strip(x) != "") & ~F.lower(strip(x)).rlike(test))
    return F.array_join(keep, "\n")


def conversation_title(c: Column, default: str = "New conversation") -> Column:
    return F.coalesce(F.nullif(strip(F.substring(c, 1, 50)), F.lit("")), F.lit(default))


def snippet(c: Column, n: int = 200) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def uuid5(name: Column, namespace_hex: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Version-5 UUID in the DNS namespace: SHA-1 with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        F.lower(F.hex(nibble)), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def fails_upload(name: Column, mime: Column, content: Column, most: int = 50 << 20) -> Column:
    """Why an upload is refused, or null: kind, emptiness, size, PDF signature, in this order."""
    pdf = F.lower(name).endswith(".pdf") | (mime == "application/pdf")
    n = F.octet_length(content)
    return (
        F.when(~F.coalesce(pdf, F.lit(False)), "type").when(n == 0, "empty").when(n > most, "too large")
        .when(F.substring(content, 1, 4) != F.lit("%PDF").cast("binary"), "signature")
    )
