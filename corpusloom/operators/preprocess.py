"""From raw text to token rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import cleaning, stemming, tokens
from corpusloom.operators import lemma, token_rows
from corpusloom.operators.common import keep_rows, require_columns

MIN_CORPUS_CHARS = 10


def with_cleaned(df: DataFrame, text_col: str = "text",
                 lowercase: bool = True) -> DataFrame:
    require_columns(df, text_col)
    return df.withColumn("cleaned", cleaning.clean(F.col(text_col), lowercase))


def with_tokens(df: DataFrame, cleaned_col: str = "cleaned", *,
                tokenizer: str = "regex",
                stopwords: Iterable[str] | DataFrame | None = None,
                extra_stopwords: Iterable[str] = (),
                min_token_length: int = 2,
                normalize: str | None = "lemma",
                lexicon: DataFrame | None = None,
                exceptions: DataFrame | None = None,
                key: str = "doc_id") -> DataFrame:
    """Add ``tokens`` and ``processed`` (the tokens joined by blanks).

    ``normalize`` is ``"lemma"``, ``"stem"`` or ``None``. Lemmas need a
    ``lexicon`` table; without one tokens stay as they are. ``stopwords`` is a
    list, or a table with a column ``word``; ``key`` must then tell the rows
    apart, as it must for a lexicon.
    """
    if normalize not in ("lemma", "stem", None):
        raise ValueError("normalize must be 'lemma', 'stem' or None")
    require_columns(df, cleaned_col)
    listed = isinstance(stopwords, DataFrame)
    out = df.withColumn("tokens", tokens.process_tokens(
        F.col(cleaned_col), tokenizer=tokenizer,
        stopwords=() if listed else stopwords,
        extra_stopwords=extra_stopwords, min_token_length=min_token_length))
    if listed:
        out = token_rows.drop_listed(out, stopwords, key)
    if normalize == "stem":
        out = out.withColumn("tokens", stemming.stem_tokens(F.col("tokens")))
    elif normalize == "lemma" and lexicon is not None:
        out = lemma.lemmatize_tokens(out, lexicon, exceptions, key)
    return out.withColumn("processed", tokens.join_tokens(F.col("tokens")))


def prepare(corpus: DataFrame, *, text_col: str = "text",
            key: str = "doc_id", keep: Iterable[str] = ("category",),
            min_chars: int | None = MIN_CORPUS_CHARS, show: bool = False,
            **options) -> DataFrame:
    """Clean and process a corpus; drop rows with too little text left.

    The result holds ``key``, the ``keep`` columns and the ``tokens`` that
    vectorisers use, hash partitioned by ``key``: what is later grouped by
    document, alone or with more columns, needs no further shuffle. It is the
    compact token rows that move, once, not raw text or exploded terms.
    ``show`` keeps ``cleaned`` and ``processed`` as well, for reports.
    """
    keep = list(keep)
    require_columns(corpus, key, text_col, *keep)
    source = corpus.withColumnRenamed(text_col, "text").select(
        key, *keep, "text")
    lexicon, exceptions = options.get("lexicon"), options.get("exceptions")
    ready = with_tokens(with_cleaned(source).select(key, *keep, "cleaned"),
                        key=key, **{**options, "lexicon": None}).select(
        key, *keep, "tokens", *(["cleaned"] if show else []))
    if lexicon is not None and options.get("normalize", "lemma") == "lemma":
        # only now, as the cleaned texts need not move along
        ready = lemma.lemmatize_tokens(ready, lexicon, exceptions, key)
    # short rows go after the shuffle, so that a fit and the texts of the same
    # corpus to score read the same one
    ready = ready.repartition(key)
    if show:
        # a generator of one row looks at both columns, so that all uses of
        # the rows read one shuffle, whichever columns they need
        ready = ready.withColumn("processed", tokens.join_tokens(
            F.col("tokens"))).select("*", F.explode(F.array(
                F.length("cleaned") + F.size("tokens"))).alias("_n")
        ).drop("_n")
    if min_chars is not None:
        ready = keep_rows(ready, "tokens", F.length(
            tokens.join_tokens(F.col("tokens"))) > min_chars)
    if (options.get("min_token_length", 2) < 2
            or options.get("normalize") == "stem"
            or options.get("lexicon") is not None):
        # vectorisers skip tokens of one character
        ready = ready.withColumn("tokens", tokens.keep_long(
            F.col("tokens"), 2))
    return ready


def prepare_texts(texts: DataFrame, **options) -> DataFrame:
    """Like :func:`prepare`, for texts to score: nothing is dropped."""
    options.setdefault("keep", ())
    return prepare(texts, min_chars=None, **options)


def from_processed(df: DataFrame, text_col: str = "processed",
                   key: str = "doc_id", keep: Iterable[str] = ("category",)
                   ) -> DataFrame:
    """Token rows from text that was processed elsewhere; nulls are empty."""
    require_columns(df, key, text_col, *keep)
    return df.select(key, *keep, tokens.model_tokens(F.col(text_col))
                     .alias("tokens")).repartition(key)
