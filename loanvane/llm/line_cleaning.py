"""Line-first cleaning, in DataFrame operations only.

Every line of a text is judged by itself: lines of menus, boilerplate and broken or shouted punctuation go, and a text
that loses too much of its words goes as a whole. Nothing shuffles: one row in, one row out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanvane.llm.shared import WORD

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 30

# A line fails with a bar per ten words or more (menus, table rests), an exclamation run or a symbol on a fifth of
# its words, or one of the boilerplate phrases.
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[#*$%&|<>]|[!?]{2,}"
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "lorem ipsum",
    "javascript", "click here", "sign up", "log in", "subscribe to", "skip to content", "skip to main content", "back to top",
)
# A window's sort key holds its position in the low bits; longer texts sort pairs of hash and position.
PLACE_BITS = 20


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def window_keys(words: Column) -> Column:
    """Sorted keys of the three-word windows: hash above, position in the low bits; null with under three words."""
    hash_at = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    key = lambda i: F.shiftleft(hash_at(i), PLACE_BITS).bitwiseOR(i.cast("long"))
    return F.when(F.size(words) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), key)))


def window_pairs(words: Column) -> Column:
    """As ``window_keys`` for texts of any length, as structs of hash and position."""
    hash_at = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    pair = lambda i: F.struct(hash_at(i).alias("w"), i.cast("long").alias("at"))
    return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), pair))


def repeated_places(keys: Column, words: Column, hash_of, place_of) -> Column:
    """Sorted positions of the windows that have an equal neighbour in the sorted keys, compared word by word."""

    def equal(x: Column, y: Column) -> Column:
        i, j = place_of(x).cast("int"), place_of(y).cast("int")
        same = [F.get(words, i + k) == F.get(words, j + k) for k in range(3)]
        return F.coalesce((hash_of(x) == hash_of(y)) & same[0] & same[1] & same[2], F.lit(False))

    found = F.filter(keys, lambda x, i: equal(x, F.get(keys, i - 1)) | equal(x, F.get(keys, i + 1)))
    return F.sort_array(F.transform(found, lambda x: F.coalesce(place_of(x), F.lit(0).cast("long"))))


def covered_words(places: Column) -> Column:
    """Words under windows of three at sorted positions."""
    step = lambda p, i: F.least(F.lit(3).cast("long"), p - F.coalesce(F.get(places, i - 1), F.lit(-3).cast("long")))
    zero = F.lit(0).cast("long")
    return F.coalesce(F.aggregate(F.transform(places, step), zero, lambda s, x: s + x), zero)


def has_phrase(text: Column) -> Column:
    """Whether a boilerplate phrase stands in a lower-cased text."""
    found = F.lit(False)
    for words in BOILERPLATE:
        found = found | text.contains(words)
    return found


def line_fails(line: Column) -> Column:
    """Verdict on one line; words are counted only where a mark was found."""
    n = F.regexp_count(line, F.lit(WORD))
    bars = F.length(line) - F.length(F.replace(line, F.lit("|")))
    marks = F.regexp_count(line, F.lit(MARKS))
    by_marks = line.rlike(MARKS) & ((10 * bars > n) | (5 * marks > n))
    return line.rlike(WORD) & (by_marks | has_phrase(F.lower(line)))


def clean_by_lines(
    docs: DataFrame, key: str = "doc_id", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT, max_lost: int = MAX_LOST_PERCENT
) -> DataFrame:
    """Per row: the key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words, kept, clean_text.

    ``kept`` is false if the base rules fail or more than ``max_lost`` percent of the words stand in failed lines.
    ``clean_text`` has the lines that passed, null for a rejected text. Null and empty texts have no words and fail.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words, short = F.col("_words"), F.size("_words") < (1 << PLACE_BITS)
    mask = (1 << PLACE_BITS) - 1
    fast = repeated_places(F.col("_keys"), words, lambda x: F.shiftright(x, PLACE_BITS), lambda x: x.bitwiseAND(F.lit(mask).cast("long")))
    slow = repeated_places(F.col("_pairs"), words, lambda x: x["w"], lambda x: x["at"])
    # each step has a projection of its own, so that arrays are made once
    zero = F.lit(0).cast("long")
    steps = (
        docs.select(key, text.alias("_text"), words_of(text).alias("_words"), F.split(text, "\n").alias("_lines"), F.lower(text).alias("_low"))
        .withColumn("_suspect", F.col("_text").rlike(MARKS) | has_phrase(F.col("_low")))
        .withColumns({"_keys": F.when(short, window_keys(words)), "_pairs": F.when(~short, window_pairs(words))})
        .withColumn("_places", F.when(short, fast).otherwise(slow))
        .withColumn("_failed", F.when(F.col("_suspect"), F.filter("_lines", line_fails)).otherwise(F.array().cast("array<string>")))
        .withColumn("_worded", F.filter("_lines", lambda x: x.rlike(WORD)))
    )
    rows = steps.select(
        key,
        "_lines",
        "_suspect",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.when(F.col("_suspect"), F.regexp_count(F.col("_text"), F.lit(SYMBOLS)).cast("long")).otherwise(zero).alias("n_symbols"),
        (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("n_dup_lines"),
        covered_words(F.col("_places")).alias("n_repeat_words"),
        F.aggregate("_failed", zero, lambda s, x: s + F.regexp_count(x, F.lit(WORD))).alias("lost_words"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    kept = ~failed & (100 * F.col("lost_words") <= max_lost * F.col("n_words"))
    passed = F.array_join(F.when(F.col("_suspect"), F.filter("_lines", lambda x: ~line_fails(x))).otherwise(F.col("_lines")), "\n")
    return rows.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "lost_words", kept.alias("kept"), F.when(kept, passed).alias("clean_text"),
    )
