"""TF-IDF weights: sub-linear tf, smoothed idf, rows of unit length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import ngrams
from corpusloom.operators.common import join_small

MAX_FEATURES = 10_000
DOC_IDX = -1  # term_idx of the document mark


def sublinear(tf: Column) -> Column:
    return 1 + F.ln(tf)


def smooth_idf(df: Column, n_docs: Column) -> Column:
    return F.ln((1 + n_docs) / (1 + df)) + 1


def with_mark(max_features: int | None) -> int | None:
    """Row bound of a vocabulary, which holds the document mark as well."""
    return None if max_features is None else max_features + 1


def fit_vocabulary(prepared: DataFrame, *,
                   max_features: int | None = MAX_FEATURES,
                   ngram_range: tuple[int, int] = (1, 2)) -> DataFrame:
    """``(term, term_idx, cf, df, idf)``, at most ``max_features`` terms;
    all terms if it is ``None``.

    One row more stands for the document mark: ``term_idx`` -1, ``df`` the
    number of documents, ``idf`` 0. It is counted in the same pass as the
    terms, so the number of documents needs no scan of its own, and it lets
    documents without a known term survive the joins on the vocabulary.
    """
    keep = ("doc_id", "category") if "category" in prepared.columns else (
        "doc_id",)
    mark = F.col("term") == ngrams.DOC_MARK
    if max_features is None:
        counts = ngrams.corpus_counts(ngrams.term_counts(
            prepared, keep=keep, ngram_range=ngram_range, mark_docs=True))
        marks = counts.where(mark)
        terms = ngrams.number_terms(counts.where(~mark), None)
        return terms.select(
            "term", "term_idx", "cf", "df", smooth_idf(
                F.col("df"), marks.agg(F.max("df")).scalar()).alias("idf")
        ).unionByName(marks.select(
            "term", F.lit(DOC_IDX).alias("term_idx"), "cf", "df",
            F.lit(0.0).alias("idf")))
    counts = ngrams.frequent_counts(prepared, max_features, keep=keep,
                                    ngram_range=ngram_range)
    top = counts.orderBy(F.desc(mark), F.desc("cf"), F.asc("term")).limit(
        max_features + 1)
    # from here on there are max_features + 1 rows at most
    everything = Window.partitionBy(F.lit(0))
    n_docs = F.max(F.when(mark, F.col("df"))).over(everything)
    place = F.row_number().over(everything.orderBy("term"))
    return top.select(
        "term", (place + DOC_IDX - 1).alias("term_idx"), "cf", "df",
        F.when(mark, F.lit(0.0)).otherwise(smooth_idf(F.col("df"), n_docs))
        .alias("idf"))


def weigh(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Turn ``tf`` and ``idf`` into ``weight``; all-zero rows stay zero.

    The sum of squares is a window by document: on rows partitioned by
    document it needs a sort within tasks and no shuffle.
    """
    raw = counts.withColumn("raw", sublinear(F.col("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(
        Window.partitionBy(key)))
    return (raw.withColumn("weight", F.when(norm > 0, F.col("raw") / norm)
                           .otherwise(F.lit(0.0)))
            .drop("raw", "idf"))


def transform(prepared: DataFrame, vocabulary: DataFrame, *,
              max_features: int | None = MAX_FEATURES,
              ngram_range: tuple[int, int] = (1, 2),
              key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, keep..., term_idx, tf, weight)`` for prepared texts.

    Terms are counted within the row of their text, then unknown ones drop
    out. Every text has one row with ``term_idx`` -1 and weight 0, also if it
    has no known term.
    """
    index = vocabulary.select("term", "term_idx", "idf")
    found = ngrams.term_counts(prepared, ngram_range=ngram_range,
                               keep=(key, *keep), mark_docs=True)
    counts = join_small(found, index, "term", with_mark(max_features),
                        sizes=vocabulary.select("term", "df"))
    return weigh(counts.select(key, *keep, "term_idx", "tf", "idf"), key)


def terms_only(weights: DataFrame) -> DataFrame:
    """Without the row that stands for the document."""
    return weights.where(F.col("term_idx") > DOC_IDX)


def with_terms(weights: DataFrame, vocabulary: DataFrame,
               max_features: int | None = MAX_FEATURES) -> DataFrame:
    """Spell ``term_idx`` out again."""
    index = vocabulary.select("term", "term_idx")
    return join_small(terms_only(weights), index, "term_idx",
                      with_mark(max_features),
                      sizes=vocabulary.select("term_idx", "df"))
