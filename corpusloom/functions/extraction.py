"""Skill and experience extraction, as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.functions.text import filled

Dictionary = Mapping[str, Sequence[str]]


def dictionary_phrases(dictionary: Dictionary) -> list[str]:
    """All phrases once, in order of their first mention."""
    return list(dict.fromkeys(p for ps in dictionary.values() for p in ps))


def find_phrases(lowered: Column, dictionary: Dictionary = fixed.SKILLS
                 ) -> Column:
    """Phrases contained in already lower-cased text, in dictionary order.

    Plain containment, so a one-letter phrase matches nearly every text.
    """
    return F.array_compact(F.array(*[
        F.when(F.contains(lowered, F.lit(p)), F.lit(p))
        for p in dictionary_phrases(dictionary)]))


def group_phrases(found: Column, dictionary: Dictionary = fixed.SKILLS
                  ) -> Column:
    """``array<struct<label, phrases>>``: found phrases by domain.

    Phrases keep the order of ``found``; a phrase of two domains stands in
    both; domains without a phrase are left out.
    """
    def of_domain(phrases: Sequence[str]) -> Column:
        return F.filter(found, lambda p: p.isin(list(phrases)))

    groups = F.array(*[
        F.struct(F.initcap(F.lit(domain.replace("_", " "))).alias("label"),
                 of_domain(phrases).alias("phrases"))
        for domain, phrases in dictionary.items()])
    return F.filter(groups, lambda g: F.size(g["phrases"]) > 0)


@lru_cache(maxsize=1)
def _digits() -> tuple[str, str]:
    pairs = [(chr(c), str(unicodedata.decimal(chr(c))))
             for c in range(0x80, sys.maxunicode + 1)
             if unicodedata.category(chr(c)) == "Nd"]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def years_digits(text: Column) -> Column:
    """Largest number of years mentioned, as decimal digits; ``'1'`` if none.

    Numbers of any length are compared exactly, as (length, digits).
    """
    source, target = _digits()
    numbers = F.regexp_extract_all(F.lower(filled(text)), F.lit(fixed.YEARS),
                                   F.lit(1))
    plain = F.transform(numbers, lambda n: F.regexp_replace(
        F.translate(n, source, target), F.lit("^0+(?=.)"), F.lit("")))
    largest = F.array_max(F.transform(plain, lambda n: F.struct(
        F.length(n).alias("size"), n.alias("digits"))))
    return F.coalesce(largest["digits"], F.lit("1"))


def years(text: Column) -> Column:
    """:func:`years_digits` as a decimal(38, 0), null where it does not fit."""
    return years_digits(text).try_cast("decimal(38,0)")


def pick_title(category: Column, mapped: Column, found: Column) -> Column:
    """Mapped title, else the first rule the found phrases meet."""
    by_skill = None
    for phrases, title in fixed.TITLE_BY_SKILL:
        hit = F.arrays_overlap(found, F.array(*[F.lit(p) for p in phrases]))
        by_skill = (F.when(hit, title) if by_skill is None
                    else by_skill.when(hit, title))
    known = F.when(category != "", mapped)
    return F.coalesce(known, by_skill.otherwise(fixed.DEFAULT_TITLE))
