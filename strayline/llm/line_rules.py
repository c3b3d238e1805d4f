"""Quality rules that clean documents line by line before they judge the whole."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strayline.llm.common import WORD, let

SYMBOL = r"[#*$%&|<>]"
FEWEST_WORDS = 50
# Percent of words in repeated windows at most, percent of words that cleaning must leave.
MOST_REPEATED, LEAST_LEFT = 50, 50
WINDOW = 3

# Phrases of lines that belong to a site and not to its text.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "accept cookies", "we use cookies", "privacy policy",
    "terms of use", "terms of service", "enable javascript", "subscribe to our", "sign up for",
    "click here", "lorem ipsum", "released under the", "licensed under the", "copyright (c)",
)
_BOILERPLATE = "(?i)" + "|".join(re.escape(phrase) for phrase in BOILERPLATE)


def has_boilerplate(text: Column) -> Column:
    """Whether some line of a text may have a boilerplate phrase: a quick look at the whole of it."""
    lower = F.lower(text)
    return reduce(Column.__or__, [F.contains(lower, F.lit(phrase)) for phrase in BOILERPLATE])


def failed_line(line: Column, may_have_boilerplate: Column) -> Column:
    """Whether a line that has a word fails a rule: symbols (one for every five words or more),
    shouting (all capitals), navigation (two or more separators, more than one for five words),
    boilerplate phrases, or a few words without an end of a sentence. A line without words fails none."""

    def of(words: Column) -> Column:
        symbols = F.regexp_count(line, F.lit(SYMBOL))
        separators = F.regexp_count(line, F.lit(r"[|»›·•]|\s(?:>|/|::)\s"))
        is_ended = line.rlike(r"[.!?…:;,。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$")
        return (words > 0) & (
            (symbols * 5 >= words)
            | ((F.upper(line) == line) & (F.lower(line) != line) & (words > 1))
            | (let(separators, lambda n: (n >= 2) & (n * 5 > words)))
            | (may_have_boilerplate & line.rlike(_BOILERPLATE))
            | ((words < 5) & ~is_ended)
        )

    return let(F.regexp_count(line, F.lit(WORD)), of)


def _repeated_words(words: Column) -> Column:
    """Words in WINDOW-word windows that occur twice or more."""
    size = F.size(words)

    def covered(hashes: Column) -> Column:
        """From a window's hash and place in order, the places of equal neighbours, in order again."""
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            def same(k: Column, h: Column) -> Column:
                return F.coalesce(F.get(s, k)["h"] == h, F.lit(False))

            flagged = F.transform(
                s, lambda e, k: F.struct(e["i"].alias("i"), (same(k - 1, e["h"]) | same(k + 1, e["h"])).alias("r"))
            )
            return F.sort_array(F.transform(F.filter(flagged, lambda e: e["r"]), lambda e: e["i"]))

        def count(places: Column) -> Column:
            steps = F.transform(
                places,
                lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - i, F.lit(WINDOW))),
            )
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        all_differ = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(all_differ, F.lit(0)).otherwise(let(let(placed, repeated), count))

    hashes = F.transform(
        F.sequence(F.lit(0), size - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )
    return F.when(size < WINDOW, F.lit(0)).otherwise(let(hashes, covered))


def clean_lines(docs: DataFrame) -> DataFrame:
    """Base figures, cleaned text and verdict of every document.

    ``docs`` has ``doc_id, text``. Rows ``(doc_id, clean_text, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_left_words, base_failed, kept)``, one for each row of ``docs``,
    repeated rows included. Lines that fail `failed_line` are removed, blank lines stay; a document
    is kept if it passes the base rules (FEWEST_WORDS, MOST_REPEATED) and LEAST_LEFT percent of its
    words are left. A null or empty text has no words and fails. Nothing is shuffled; windows are
    compared by 64-bit hashes within one text. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), has_boilerplate(text).alias("boilerplate"))
    rows = rows.select(
        "*",
        F.regexp_extract_all("text", F.lit(f"({WORD})"), 1).alias("words"),
        F.split("text", "\n").alias("lines"),
    )
    rows = rows.select(
        "*",
        F.filter("lines", lambda x: x.rlike(WORD)).alias("worded"),
        F.array_join(F.filter("lines", lambda x: ~failed_line(x, F.col("boilerplate"))), "\n").alias("clean_text"),
    )
    rows = rows.select(
        "doc_id",
        "clean_text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.regexp_count("clean_text", F.lit(WORD)).cast("long").alias("n_left_words"),
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = 100 * F.col("n_left_words") >= LEAST_LEFT * F.col("n_words")
    return rows.select("*", failed.alias("base_failed")).select("*", (~F.col("base_failed") & left).alias("kept"))
