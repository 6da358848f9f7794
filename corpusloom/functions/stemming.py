"""Porter stemming of a token array with built-in expressions only.

The word is first rewritten so that a consonantal *y* is an upper-case ``Y``.
After that "vowel" and "consonant" are plain character classes, the measure of
a stem is a regular expression, and each step of the algorithm is one CASE
over suffixes. Each step is its own ``transform`` pass, so no expression is
repeated inside another and nothing leaves the JVM or shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import fixed

_V = "[aeiouy]"
_C = "[^aeiouy]"
_M1 = f"{_V}{_C}"                       # measure > 0
_M2 = f"{_V}{_C}.*{_V}{_C}"             # measure > 1
_CVC = f"(?:{_C}{_V}[^aeiouywxY]|^{_V}{_C})$"
_DOUBLE = r"(?:([^aeiouy])\1|yY)$"


def _cut(word: Column, count: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - count)


def _swap(word: Column, suffix: str, new: str) -> Column:
    stem = _cut(word, len(suffix))
    return F.concat(stem, F.lit(new)) if new else stem


def _case(branches, default: Column) -> Column:
    """First condition that holds wins."""
    out = None
    for condition, value in branches:
        out = (F.when(condition, value) if out is None
               else out.when(condition, value))
    return out.otherwise(default)


def _suffix_rules(word: Column, rules, measure: str) -> Column:
    """The first suffix that fits decides, whether or not its stem qualifies."""
    return _case(
        [(word.endswith(suffix),
          F.when(_cut(word, keep).rlike(measure),
                 _swap(word, suffix, new)).otherwise(word))
         for suffix, new, keep in rules], word)


def _mark_y(word: Column) -> Column:
    once = F.regexp_replace(F.lower(word), F.lit("(^|[aeiou])y"), F.lit("$1Y"))
    return F.regexp_replace(once, F.lit("yy"), F.lit("yY"))


def _plurals(word: Column) -> Column:
    return _case([
        (word.endswith("ies"), F.when(F.length(word) == 4, _cut(word, 1))
         .otherwise(_cut(word, 2))),
        (word.endswith("sses"), _cut(word, 2)),
        (word.endswith("ss"), word),
        (word.endswith("s"), _cut(word, 1))], word)


def _past(word: Column) -> Column:
    """Drop -ed / -ing; a trailing ``+`` marks stems that need repair."""
    return _case([
        (word.endswith("ied"), F.when(F.length(word) == 4, _cut(word, 1))
         .otherwise(_cut(word, 2))),
        (word.endswith("eed"), F.when(_cut(word, 3).rlike(_M1), _cut(word, 1))
         .otherwise(word)),
        (word.endswith("ed") & _cut(word, 2).rlike(_V), _swap(word, "ed", "+")),
        (word.endswith("ing") & _cut(word, 3).rlike(_V),
         _swap(word, "ing", "+"))], word)


def _repair(marked: Column) -> Column:
    stem = _cut(marked, 1)
    return F.when(~marked.endswith("+"), marked).otherwise(_case([
        (stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e"))),
        (stem.rlike(_DOUBLE), F.when(stem.rlike("[lsz]$"), stem)
         .otherwise(_cut(marked, 2))),
        (stem.rlike(_M1) & ~stem.rlike(_M2) & stem.rlike(_CVC),
         F.concat(stem, F.lit("e")))], stem))


def _final_y(word: Column) -> Column:
    return F.when(word.rlike(f".{_C}[yY]$"), _swap(word, "y", "i")
                  ).otherwise(word)


def _alli(word: Column) -> Column:
    """-alli loses its ending before the other endings are looked at."""
    return F.when(word.endswith("alli") & _cut(word, 4).rlike(_M1),
                  _cut(word, 2)).otherwise(word)


def _step2(word: Column) -> Column:
    # the l of -logi counts towards the stem
    return _suffix_rules(
        word, [(s, n, len(s) - (s == "logi")) for s, n in fixed.PORTER_STEP2],
        _M1)


def _step3(word: Column) -> Column:
    return _suffix_rules(
        word, [(s, n, len(s)) for s, n in fixed.PORTER_STEP3], _M1)


def _step4(word: Column) -> Column:
    return _case(
        [(word.endswith(s),
          F.when(_cut(word, len(s)).rlike(
              f"(?=.*[st]$).*{_M2}" if s == "ion" else _M2),
              _cut(word, len(s))).otherwise(word))
         for s in fixed.PORTER_STEP4], word)


def _final_e(word: Column) -> Column:
    stem = _cut(word, 1)
    return F.when(word.endswith("e") & (stem.rlike(_M2) | (
        stem.rlike(_M1) & ~stem.rlike(_CVC))), stem).otherwise(word)


def _final_ll(word: Column) -> Column:
    stem = _cut(word, 1)
    return F.when(word.endswith("ll") & stem.rlike(_M2), stem).otherwise(word)


_STEPS = [_plurals, _past, _repair, _final_y, _alli, _step2, _step3, _step4,
          _final_e, _final_ll]


def stem_tokens(tokens: Column) -> Column:
    """Porter stem of every token, in place and in order."""
    found = F.transform(tokens, F.lower)
    work = F.transform(found, _mark_y)
    for step in _STEPS:
        work = F.transform(work, step)
    irregular = F.create_map(*[F.lit(x) for kv in fixed.PORTER_IRREGULAR.items()
                               for x in kv])
    # short and irregular words keep what the table (or the word itself) says
    return F.zip_with(found, work, lambda word, stem: F.coalesce(
        F.element_at(irregular, word),
        F.when(F.length(word) <= 2, word).otherwise(F.lower(stem))))
