"""Statistics of whole texts that the quality operators learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.runtime import extend_batches

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_HIGH = bytes(range(128, 192))

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_chars", "n_lines",
    "n_upper", "n_lower", "n_digits", "n_distinct", "n_top_word", "n_stops", "n_marks",
)


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    if distinct < 1 << 21:
        window = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        pair = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)[1]
        window = pair * distinct + ids[2:]
    order = np.argsort(window, kind="stable")
    s = window[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS``; a null text counts like an empty one."""
    if not text:
        return (0,) * 5 + (0, 1) + (0,) * 7
    raw = text.encode()
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines, earlier, dup = text.split("\n"), set(), 0
    for line in lines:
        if line in earlier:
            dup += 1
        elif line.strip(SPACE):
            earlier.add(line)
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), dup,
        repeat_words(ids, len(seen)), len(text), len(lines),
        len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LOWER)),
        len(raw) - len(raw.translate(None, _DIGIT)), len(seen),
        int(np.bincount(ids).max()) if len(words) else 0, raw.count(b".") + raw.count(b","), raw.count(b"!") + raw.count(b"?"),
    )


def attach_counts(docs: DataFrame) -> DataFrame:
    """Every row as a struct ``row`` beside the counts of its whole text; one Arrow pass, no shuffle."""

    def make():
        return lambda texts: dict(zip(COUNTS, zip(*map(count_text, texts))))

    return extend_batches(docs, ["text"], make, ", ".join(f"{c} long" for c in COUNTS))


def text_counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every whole text."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return attach_counts(narrow).select("row.doc_id", *COUNTS)


def features() -> dict[str, Column]:
    """Named statistics as columns over ``COUNTS``; all are finite, also for empty texts."""
    c = {n: F.col(n).cast("double") for n in COUNTS}
    over = lambda a, b: a / F.greatest(b, F.lit(1.0))
    return {
        "words": c["n_words"],
        "mean_word": over(c["word_chars"], c["n_words"]),
        "symbol_share": over(c["n_symbols"], c["n_words"]),
        "dup_line_share": over(c["n_dup_lines"], c["n_lines"]),
        "repeat_share": over(c["n_repeat_words"], c["n_words"]),
        "distinct_share": over(c["n_distinct"], c["n_words"]),
        "top_word_share": over(c["n_top_word"], c["n_words"]),
        "upper_share": over(c["n_upper"], c["n_upper"] + c["n_lower"]),
        "digit_share": over(c["n_digits"], c["word_chars"]),
        "stop_share": over(c["n_stops"], c["n_words"]),
        "mark_share": over(c["n_marks"], c["n_words"]),
        "words_per_line": over(c["n_words"], c["n_lines"]),
        "letter_share": over(c["n_upper"] + c["n_lower"], c["word_chars"]),
    }


def labelled_sample(docs: DataFrame, labels: DataFrame, fold: Column | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``most`` labelled rows, the first by a hash of ``doc_id``.

    The ids are bounded by ``most``, so they are broadcast and the statistics of just these rows are
    collected (``most`` x features doubles; of rows that share an id, the least statistics). Null labels
    and ids are left out.
    """
    picked = labels.filter("quality is not null and doc_id is not null")
    if fold is not None:
        picked = picked.filter(fold)
    picked = picked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    rows = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    spark, names = docs.sparkSession, list(features())
    ids = spark.createDataFrame([(r[0], int(r[1])) for r in rows], "label_id long, quality int")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"), "left_semi")
    each = text_counts(some).join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"))
    each = each.groupBy("doc_id").agg(F.min(F.struct("quality", *(v.alias(k) for k, v in features().items()))).alias("row"))
    got = sorted(each.select("doc_id", "row.*").collect(), key=tuple)
    return np.array([r[2:] for r in got], float).reshape(-1, len(names)), np.array([r[1] for r in got], int)
