"""Bag of n-grams: a count matrix with encoded labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import ngrams
from corpusloom.operators.tfidf import DOC_IDX, with_mark
from corpusloom.operators.common import (BROADCAST_ROWS, bounded, dense_index,
                                         has_at_most, require_columns,
                                         top_rows)

NO_TERMS = "After pruning, no terms remain."


def label_encode(df: DataFrame, label_col: str = "category") -> DataFrame:
    """``(label, label_idx)``: distinct labels numbered in sorted order."""
    found = df.select(F.col(label_col).alias("label")).distinct()
    return dense_index(found, "label", "label_idx").withColumn(
        "label_idx", F.col("label_idx").cast("int"))


def label_map(encoded: DataFrame, per_row: int = 10_000) -> DataFrame:
    """``(part, mapping map<int, string>)``: so many labels in a row, so that
    few labels are one row and many never are."""
    return encoded.groupBy(F.expr(f"label_idx div {per_row}").alias("part")
                           ).agg(F.map_from_entries(F.sort_array(
                               F.collect_list(F.struct("label_idx", "label"))))
                               .alias("mapping"))


def top_ngrams(matrix: DataFrame, vocabulary: DataFrame, n: int = 20,
               max_features: int | None = None) -> DataFrame:
    """``(ngram, count)`` with the largest counts; ties: later term first."""
    totals = matrix.groupBy("term_idx").agg(F.sum("tf").alias("count"))
    return (totals.join(bounded(vocabulary.select("term", "term_idx"),
                                max_features), "term_idx")
            .orderBy(F.desc("count"), F.desc("term_idx")).limit(n)
            .select(F.col("term").alias("ngram"), "count"))


def top_ngrams_by_label(matrix: DataFrame, vocabulary: DataFrame, n: int = 20,
                        max_features: int | None = None) -> DataFrame:
    """:func:`top_ngrams` within every label at once."""
    totals = matrix.groupBy("category", "term_idx").agg(
        F.sum("tf").alias("count"))
    ranked = top_rows(totals, ["category"],
                      [F.desc("count"), F.desc("term_idx")], n)
    return (ranked.join(bounded(vocabulary.select("term", "term_idx"),
                                max_features), "term_idx")
            .select("category", "rank", F.col("term").alias("ngram"),
                    "count"))


@dataclass(frozen=True)
class BagOfNgrams:
    """A fitted count model. All members are lazy DataFrames.

    ``rows`` is ``(doc_id, category, term_idx, tf)`` with one row more for each
    document, of ``term_idx`` -1: ``matrix`` is all but these, ``docs`` is
    these, also of documents without a known term. ``prepared`` are the rows
    of the fit.
    """

    rows: DataFrame
    vocabulary: DataFrame
    ngram_range: tuple[int, int]
    max_features: int | None
    prepared: DataFrame

    @property
    def matrix(self) -> DataFrame:
        return self.rows.where(F.col("term_idx") > DOC_IDX)

    @property
    def docs(self) -> DataFrame:
        return self.rows.where(F.col("term_idx") == DOC_IDX).select(
            "doc_id", "category")

    @classmethod
    def fit(cls, docs: DataFrame, *, ngram_range: tuple[int, int] = (1, 2),
            max_features: int | None = 20_000, min_df: int | float = 2,
            max_df: int | float = 0.95) -> BagOfNgrams:
        """``docs``: ``(doc_id, category, tokens)``, best from ``prepare``.

        Counts, number of documents and matrix read one scan, and n-grams are
        counted within the row of their document. If pruning leaves no term, whatever reads the matrix raises;
        :meth:`check` runs the fit up to there and raises at once.
        """
        require_columns(docs, "doc_id", "category", "tokens")
        mark = F.col("term") == ngrams.DOC_MARK
        n_docs = ngrams.doc_count(docs)

        def pruned(counts: DataFrame) -> DataFrame:
            return ngrams.prune(counts.where(~mark), n_docs, min_df, max_df)

        if max_features is None:
            counts = ngrams.corpus_counts(ngrams.term_counts(
                docs, ngram_range=ngram_range, mark_docs=True))
        else:
            counts = ngrams.frequent_counts(
                docs, max_features, ngram_range=ngram_range, kept=pruned)
        kept = pruned(counts)
        vocabulary = ngrams.number_terms(
            ngrams.most_frequent(kept, max_features), max_features)
        terms = vocabulary.agg(F.count(F.lit(1))).scalar()
        place = F.when(terms == 0, F.raise_error(F.lit(NO_TERMS)).cast("int")
                       ).otherwise(F.lit(DOC_IDX))
        marked = vocabulary.select("term", "term_idx", "df").unionByName(
            docs.sparkSession.range(1).select(
                F.lit(ngrams.DOC_MARK).alias("term"), place.alias("term_idx"),
                F.lit(0).cast("long").alias("df")))
        found = ngrams.term_counts(docs, ngram_range=ngram_range,
                                   mark_docs=True)
        rows = ngrams.matrix(found, marked, with_mark(max_features)).select(
            "doc_id", "category", "term_idx", "tf")
        return cls(rows, vocabulary, ngram_range, max_features, docs)

    def check(self) -> BagOfNgrams:
        """Raise if pruning has left no term at all."""
        if self.vocabulary.isEmpty():
            raise ValueError(NO_TERMS)
        return self

    def transform(self, texts: DataFrame, key: str = "doc_id") -> DataFrame:
        """Counts of known terms in new texts; a text without any keeps one
        row with null ``term_idx`` and ``tf``."""
        found = ngrams.matrix(
            ngrams.term_counts(texts, keep=(key,),
                               ngram_range=self.ngram_range),
            self.vocabulary, self.max_features)
        return texts.select(key).join(found, key, "left").select(
            key, "term_idx", "tf")

    def feature_names(self) -> DataFrame:
        return self.vocabulary.select("term_idx", "term")

    def label_index(self) -> DataFrame:
        return label_encode(ngrams.doc_rows(self.prepared))

    def features(self) -> DataFrame:
        """One row per document: counts as a map, and the label number."""
        terms = F.map_from_entries(F.sort_array(F.collect_list(F.when(
            F.col("term_idx") > DOC_IDX, F.struct("term_idx", "tf")))))
        nested = self.rows.groupBy("doc_id", "category").agg(terms.alias("x"))
        # reads the label column alone, not what the fit makes of the texts
        few = BROADCAST_ROWS if has_at_most(self.prepared.select(
            "category").distinct(), 10_000) else None
        index = self.label_index()
        return (nested.withColumnRenamed("category", "label")
                .join(bounded(index, few), "label")
                .select("doc_id", "x", F.col("label_idx").alias("y")))

    def top_ngrams(self, n: int = 20) -> DataFrame:
        return top_ngrams(self.matrix, self.vocabulary, n, self.max_features)

    def top_ngrams_by_label(self, n: int = 20) -> DataFrame:
        return top_ngrams_by_label(self.matrix, self.vocabulary, n,
                                   self.max_features)

    def top_ngrams_of(self, label: str, n: int = 20) -> DataFrame:
        """One label; a label that does not occur is an error."""
        rows = self.matrix.where(F.col("category") == label)
        if self.docs.where(F.col("category") == label).isEmpty():
            raise ValueError(f"unknown label: {label!r}")
        return top_ngrams(rows, self.vocabulary, n, self.max_features)

    def summary(self) -> DataFrame:
        """One row: range, number of terms and documents, labels, shape."""
        low, high = self.ngram_range
        terms = self.vocabulary.agg(F.count(F.lit(1))).scalar()
        return self.docs.agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.sort_array(F.collect_set("category")).alias("labels")
        ).select(F.lit(f"({low}, {high})").alias("ngram_range"),
                 terms.alias("n_features"), "n_docs", "labels",
                 F.format_string("(%d, %d)", F.col("n_docs"),
                                 F.col("n_features")).alias("shape"))
