"""Token operators as column expressions over ``array<string>``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import fixed

TOKENIZERS = ("regex", "word")


def tokens_regex(cleaned: Column) -> Column:
    """Every maximal run of ASCII letters."""
    return F.regexp_extract_all(cleaned, F.lit("[a-zA-Z]+"), F.lit(0))


def tokens_word(cleaned: Column) -> Column:
    """Split cleaned text at blanks, taking fused words apart."""
    text = cleaned
    for head, tail in fixed.FUSED_WORDS:
        text = F.regexp_replace(text, F.lit(rf"(?i)\b({head})({tail})\b"),
                                F.lit("$1 $2"))
    return F.regexp_extract_all(text, F.lit("[^ ]+"), F.lit(0))


def tokenize(cleaned: Column, tokenizer: str = "regex") -> Column:
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"tokenizer must be one of {TOKENIZERS}")
    pick = tokens_regex if tokenizer == "regex" else tokens_word
    return pick(F.coalesce(cleaned, F.lit("")))


def stopword_set(stopwords: Iterable[str] | None = None,
                 extra: Iterable[str] = ()) -> list[str]:
    """Base list (the built-in one by default) plus lower-cased extras."""
    base = fixed.STOPWORDS if stopwords is None else stopwords
    return sorted(set(base) | {w.lower() for w in extra})


def drop_stopwords(tokens: Column, stopwords: Iterable[str]) -> Column:
    listed = list(stopwords)
    if not listed:
        return tokens
    return F.filter(tokens, lambda t: ~F.lower(t).isin(listed))


def keep_alphabetic(tokens: Column, min_length: int = 2) -> Column:
    return F.filter(tokens, lambda t: t.rlike(r"^\p{L}+\z")
                    & (F.length(t) >= min_length))


def keep_long(tokens: Column, min_length: int) -> Column:
    """The length half alone, for tokens known to be letters only."""
    return F.filter(tokens, lambda t: F.length(t) >= min_length)


def process_tokens(cleaned: Column, *, tokenizer: str = "regex",
                   stopwords: Iterable[str] | None = None,
                   extra_stopwords: Iterable[str] = (),
                   min_token_length: int = 2) -> Column:
    """Tokenise, drop stop words, keep alphabetic tokens long enough."""
    listed = stopword_set(stopwords, extra_stopwords)
    found = tokenize(cleaned, tokenizer)
    if tokenizer == "word":
        return keep_alphabetic(drop_stopwords(found, listed), min_token_length)
    # regex tokens are letters already: one pass does both filters
    return F.filter(found, lambda t: (F.length(t) >= min_token_length)
                    & ~F.lower(t).isin(listed))


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def model_tokens(text: Column) -> Column:
    """Tokens as the vectorisers see them: lower-cased word runs of >= 2."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))),
        F.lit(rf"{fixed.WORD}{{2,}}"), F.lit(0))
