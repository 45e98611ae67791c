"""Line-first quality rules, in built-in functions only.

Each line is judged by itself: punctuation (marks that prose seldom has, and shouting),
navigation (entries between bars) and boilerplate (phrases of page furniture). Lines that
fail go, and a document that loses too large a share of its text is rejected, as is one
that is too short or that repeats itself. Everything is computed within a row, so nothing
is shuffled, whatever the sizes of sources or groups of copies.

Null text has no words and fails the base rule; so does empty text. Three-word windows are
compared by 64-bit hashes within one document only: two different windows of a document of
n words are taken for equal with a probability below ``n**2 / 2**65``. Rows with the same
id are judged each for itself. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Of the characters in words, the share that lines which fail may hold.
MAX_LOST_PERCENT = 25

# White space between words, marks counted as symbols, marks of the line
# rules, and phrases of page furniture.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
LINE_MARKS = r"[#*$%&<>{}\[\]~^=]"
BOILERPLATE = (
    r"(?i)\b(lorem ipsum|(enable|requires?) javascript|accept (all )?cookies|we use cookies"
    r"|subscribe to our newsletter|click here to|skip to (main )?content|share on facebook"
    r"|follow us on|sign up for free|log in to continue|read more\s*$)"
)


def line_fails(line: Column) -> Column:
    """True if a line is not prose; marks are counted against the line's words."""
    n = F.regexp_count(line, F.lit(WORD))
    marks = F.regexp_count(line, F.lit(LINE_MARKS))
    punctuation = (marks >= 3) & (marks * 5 > n)
    shouting = F.regexp_count(line, F.lit("!")) * 3 > n
    navigation = F.regexp_count(line, F.lit(r"\|")) * 4 >= n
    return punctuation | (shouting & (n >= 3)) | navigation | line.rlike(BOILERPLATE)


def _chars(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.char_length(w))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, lost_chars, clean_text, row)`` of each document; ``row`` is the document itself."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Each step is a projection of its own, so that no array is computed twice.
    found = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.filter(F.split(text, SPACE + "+"), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    inner = F.greatest(n - 2, F.lit(0))
    part = lambda first: F.slice("w", first, inner)
    found = found.withColumn("h", F.zip_with(
        F.zip_with(part(1), part(2), lambda a, b: F.xxhash64(a, b)), part(3), lambda h, c: F.xxhash64(h, c)))
    found = found.withColumn("bad", F.filter("lines", line_fails))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    found = found.withColumn("s", F.when(repeats, F.sort_array(
        F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    m = F.size("s") - 1
    found = found.withColumn("at", F.sort_array(F.array_distinct(F.flatten(F.filter(F.zip_with(
        F.slice("s", 1, m), F.slice("s", 2, m),
        lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))), lambda p: p.isNotNull())))))
    steps = F.size("at") - 1
    covered = F.when(F.size("at") > 0, 3 + F.aggregate(
        F.zip_with(F.slice("at", 1, steps), F.slice("at", 2, steps), lambda x, y: F.least(y - x, F.lit(3))),
        F.lit(0), lambda s, x: s + x)).otherwise(0)
    lost = F.aggregate("bad", F.lit(0).cast("long"), lambda s, x: s + _chars(F.split(x, SPACE + "+")))
    found = found.select(
        "doc_id", n.cast("long").alias("n_words"), _chars(F.col("w")).alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), lost.alias("lost_chars"),
        "bad", "text", "row")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    clean = F.when(F.size("bad") > 0, F.array_join(
        F.filter(F.split("text", "\n"), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & line_fails(x))), "\n")
    ).otherwise(F.col("text"))
    return found.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars")))
        .alias("kept"), "lost_chars", clean.alias("clean_text"), "row")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns and without the lines that fail.

    A condition on ``kept`` alone would be moved below the projections and its arrays computed
    anew for each of their elements; a condition on a row number stays where it is.
    """
    judged = judge(docs, id_col, text_col).withColumn("at", F.monotonically_increasing_id())
    kept = judged.where("kept AND at >= 0")
    return kept.select(*(
        F.col("clean_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
