"""Text expressions. All are Catalyst columns but NFKC, for which Spark has no built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space as Python's str.strip and \s see it; Java's (?U)\s lacks U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"
#: Sentence ends: after a full-width terminator, or at line breaks.
SENTENCE = rf"(?U)(?<=[。！？]){SPACE}*|\n+"
# Phrases that are filtered from prompts, in this order.
INJECTIONS = [r"ignore\s+previous\s+instructions", r"ignore\s+all\s+instructions", r"system\s+prompt", r"simulated\s+response"]
FILTERED = "[Filtered]"


def trim(c: Column) -> Column:
    """Strip Unicode white space on both sides."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def sentences(c: Column) -> Column:
    """Array of stripped, non-empty sentences in order. Null gives null, empty gives an empty array."""
    return F.filter(F.transform(F.split(c, SENTENCE, -1), trim), lambda s: F.length(s) > 0)


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_each(col: pd.Series) -> pd.Series:
    return col.map(lambda a: None if a is None else [x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in a])


def normalize_each(c: Column) -> Column:
    """NFKC of every element of an array; ASCII elements pass the worker unchanged, without the normalizer."""
    return _nfkc_each(c)


def longest_word(c: Column) -> Column:
    """Length of the longest run without white space; 0 for empty text."""
    return F.coalesce(F.array_max(F.transform(F.split(c, rf"(?U){SPACE}+"), F.length)), F.lit(0))


def has_control(c: Column) -> Column:
    """Whether a character of Unicode's C categories other than line feed, tab and return occurs."""
    return c.rlike(r"[\p{C}&&[^\n\t\r]]")


def guard(c: Column, max_length: int = 500_000, max_word: int = 1000) -> Column:
    """What is wrong with a text as summarizer input: 'empty', 'too long', 'control', 'long word', or null."""
    return (
        F.when(c.isNull() | (F.length(c) == 0), "empty")
        .when(F.length(c) > max_length, "too long")
        .when(has_control(c), "control")
        .when(longest_word(c) > max_word, "long word")
    )


def clean(c: Column, max_word: int = 1000) -> Column:
    """The text without what :func:`guard` calls 'control' and 'long word': control characters that
    are white space become a blank, the others go, and longer words are parted by blanks."""
    c = F.regexp_replace(c, r"[\x0b\x0c\x1c-\x1f\x85]", " ")
    c = F.regexp_replace(c, r"[\p{C}&&[^\n\t\r]]+", "")
    return F.regexp_replace(c, rf"(?U)([^\s\x1c-\x1f]{{{max_word}}})(?=[^\s\x1c-\x1f])", "$1 ")


def sanitize(c: Column) -> Column:
    """Replace prompt injections, whatever white space stands between their words."""
    for pattern in INJECTIONS:
        c = F.regexp_replace(c, "(?iU)" + pattern.replace(r"\s", SPACE), FILTERED)
    return c


def mock_summary(c: Column) -> Column:
    """The deterministic summarizer: a prefix of the sanitized text; empty stays empty."""
    return F.when(F.length(c) == 0, "").otherwise(F.concat(F.lit("Summary of "), F.substring(sanitize(c), 1, 20), F.lit("...")))


DENSITY_STEPS = (
    "Below are passages of one document that belong together:\n",
    "\n\nWrite a dense summary of about 400 characters. Note names, numbers and terms it lacks, "
    "work them in without making it longer, and do so three times. Give only the last version.",
)
VERIFY_STEPS = (
    "Check every claim of a summary against its source.\n\nSource:\n",
    "\n\nSummary:\n",
    "\n\nMark each claim Supported, Contradicted or Unsupported with a reason. Answer with a JSON object "
    'of "score" (share of supported claims), "details" (claim, verdict, reasoning) and "unsupported_claims".',
)


def summary_prompt(context: Column) -> Column:
    return F.concat(F.lit(DENSITY_STEPS[0]), context, F.lit(DENSITY_STEPS[1]))


def verification_prompt(source: Column, summary: Column) -> Column:
    return F.concat(F.lit(VERIFY_STEPS[0]), source, F.lit(VERIFY_STEPS[1]), summary, F.lit(VERIFY_STEPS[2]))


def error_category(message: Column) -> Column:
    """What kind of model error a message tells of."""
    low = F.lower(message)
    return (
        F.when(message.isNull(), None)
        .when(low.contains("context_length_exceeded"), "context_length_exceeded")
        .when(low.contains("rate_limit") | low.contains("rate limit"), "rate_limit")
        .otherwise("other")
    )


def strip_fence(c: Column) -> Column:
    """A model's reply without a Markdown code fence around it."""
    return trim(F.regexp_replace(trim(c), r"(?i)\A```(?:json)?\s*|\s*```\z", ""))


def display_id(node_id: Column, is_leaf: Column) -> Column:
    return F.when(is_leaf, F.concat(F.lit("chunk_"), node_id)).otherwise(node_id)
