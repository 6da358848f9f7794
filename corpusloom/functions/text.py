"""Small projections on raw text: lengths, guards, snippets, percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import fixed


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def stripped(text: Column) -> Column:
    """Cut white space, in the Unicode sense, off both ends."""
    return F.regexp_replace(
        filled(text), F.lit(rf"^[{fixed.SPACE}]+|[{fixed.SPACE}]+\z"),
        F.lit(""))


def words(text: Column) -> Column:
    """Whitespace-separated words; no empty ones."""
    return F.regexp_extract_all(
        filled(text), F.lit(f"{fixed.NONSPACE}+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def char_count(text: Column) -> Column:
    return F.length(filled(text))


def guard_status(text: Column, min_chars: int) -> Column:
    """``accepted`` if enough characters are left after stripping."""
    return F.when(F.length(stripped(text)) >= min_chars,
                  F.lit("accepted")).otherwise(F.lit("rejected"))


def snippet(text: Column, chars: int = 250) -> Column:
    return F.concat(F.substring(filled(text), 1, chars), F.lit("..."))


def preview(text: Column, chars: int = 600) -> Column:
    return F.substring(text, 1, chars)


def percent(score: Column) -> Column:
    return F.round(score * 100, 1)


def clamp(score: Column) -> Column:
    """Progress-bar value: never above one."""
    return F.least(score, F.lit(1.0))


def file_key(category: Column) -> Column:
    return F.concat(F.lit("JD_"), F.replace(category, F.lit(" "), F.lit("_")))
