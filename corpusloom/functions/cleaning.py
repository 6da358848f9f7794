"""Text cleaning as column expressions: ``Column -> Column``, no UDF."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import fixed


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition of every code point, cut down to ASCII.

    Dropping non-ASCII characters after NFKD works code point by code point,
    so the whole mapping can be computed once on the driver from the Unicode
    tables. Returns the one-to-one part as two aligned strings and the
    one-to-many part as a dictionary.
    """
    source, target, several = [], [], {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char)
                        if c < "\x80")
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        elif plain:
            several[char] = plain
    return "".join(source), "".join(target), several


def _char_class(chars) -> str:
    """A regex class in ranges, so that matching does not try every member.

    The look-ahead turns ASCII away after one comparison.
    """
    codes = sorted(map(ord, chars))
    ranges = []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    body = "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in ranges)
    return rf"(?=[^\x00-\x7F])[{body}]"


def strip_emails(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(fixed.EMAIL), F.lit("$1 "))


def strip_phones(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(fixed.PHONE), F.lit(" "))


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(fixed.URL), F.lit(" "))


def fold_ascii(text: Column) -> Column:
    """Replace characters by their ASCII look-alikes, drop those without."""
    source, target, several = _fold_tables()
    wide = _char_class(several)
    # one literal instead of hundreds keeps planning fast; it is folded once
    mapping = F.str_to_map(
        F.lit("\x02".join(f"{k}\x01{v}" for k, v in several.items())),
        F.lit("\x02"), F.lit("\x01"))
    # Ligatures, fractions and the like become several characters each; only
    # those that do occur in the row are looked up and replaced.
    spelled = F.aggregate(
        F.array_distinct(F.regexp_extract_all(text, F.lit(wide), F.lit(0))),
        text,
        lambda acc, c: F.replace(acc, c, F.element_at(mapping, c)))
    return F.regexp_replace(F.translate(spelled, source, target),
                            F.lit(r"[^\x00-\x7F]+"), F.lit(""))


def strip_contacts(text: Column) -> Column:
    """E-mail addresses, then phone numbers, then URLs, each to a blank.

    Most texts show no sign of an address and skip two of the three passes.
    """
    return F.when(text.rlike(fixed.ADDRESS_SIGN),
                  strip_urls(strip_phones(strip_emails(text)))
                  ).otherwise(strip_phones(text))


def clean(text: Column, lowercase: bool = True) -> Column:
    """The whole cleaning chain; null and blank input give ``''``.

    ``text`` should be a plain column: it is looked at twice so that rows of
    pure ASCII skip the character folding.
    """
    text = F.coalesce(text, F.lit(""))
    pure = F.octet_length(text) == F.char_length(text)
    folded = F.when(pure, strip_contacts(text)).otherwise(
        fold_ascii(strip_contacts(text)))
    # Special characters become blanks, runs of blanks collapse and the ends
    # are cut: what is left are the runs of letters and digits. Picking those
    # out is several times faster than replacing everything between them.
    runs = F.regexp_extract_all(folded, F.lit("[a-zA-Z0-9]+"), F.lit(0))
    words = F.array_join(runs, " ")
    return F.lower(words) if lowercase else words
