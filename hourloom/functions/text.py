"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and letters of the language heuristic.
SWEDISH_WORDS = ["och", "för", "på", "inte", "från", "vid", "till", "efter", "under"]
ENGLISH_WORDS = ["and", "for", "the", "due", "to", "on", "at", "from", "after", "during"]
SWEDISH_LETTERS = "åäö"


def strip(text: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def redact_token(text: Column, parameter: str = "securityToken") -> Column:
    """Hide the value of a secret query-string parameter, whatever its case."""
    return F.regexp_replace(text, f"(?i)({parameter}=)[^&\\s]+", "$1***REDACTED***")


def word_set(text: Column) -> Column:
    spaced = F.translate(F.lower(text), ".,", "  ")
    return F.array_distinct(F.filter(F.split(spaced, r"\s+"), lambda w: w != ""))


def language_label(
    text: Column,
    foreign_words: list[str] = SWEDISH_WORDS,
    english_words: list[str] = ENGLISH_WORDS,
    foreign_letters: str = SWEDISH_LETTERS,
) -> Column:
    """Struct(label, ambiguous): 'empty', 'foreign' or 'english'."""
    clean = strip(F.coalesce(text, F.lit("")))
    words = word_set(clean)
    foreign = F.size(F.array_intersect(words, F.array(*map(F.lit, foreign_words))))
    english = F.size(F.array_intersect(words, F.array(*map(F.lit, english_words))))
    marked = F.lower(clean).rlike(f"[{foreign_letters}]")
    label = (
        F.when(clean == "", "empty").when(marked | (foreign > english), "foreign").otherwise("english")
    )
    ambiguous = (clean != "") & (foreign == 0) & (english == 0) & ~marked & (F.size(words) < 3)
    return F.struct(label.alias("label"), ambiguous.alias("ambiguous"))
