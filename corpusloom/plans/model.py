"""A fitted corpus model: one TF-IDF fit shared by classifier and matcher."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import (centroid, matcher, ngrams, preprocess,
                                  tfidf)
from corpusloom.operators.common import (BROADCAST_ROWS, NotFittedError,
                                         require_columns)
from corpusloom.operators.postings import PostingIndex

TABLES = ("vocabulary", "weights", "centroids", "postings")
MIN_CLASSIFY_CHARS = 20
MIN_MATCH_CHARS = 10


@dataclass(frozen=True)
class CorpusModel:
    """Fitted tables, all lazy until an action or :meth:`save` runs them.

    ``vocabulary (term, term_idx, cf, df, idf)``,
    ``weights (doc_id, category, term_idx, tf, weight)`` and
    ``centroids (category, label_first_id, term_idx, weight, norm)``;
    ``docs (doc_id, category)`` lists the documents of the index. ``ready`` are
    the prepared rows of the fit, if it has not been stored. A corpus without
    categories is not ``labelled``: filters are skipped then. ``index`` are the
    posting lists that matching uses; a stored model has them.
    """

    vocabulary: DataFrame
    weights: DataFrame
    centroids: DataFrame
    docs: DataFrame
    max_features: int | None
    ngram_range: tuple[int, int]
    centroid_rows: int | None = None
    options: tuple = ()
    ready: DataFrame | None = None
    labelled: bool = True
    index: PostingIndex | None = None

    @classmethod
    def fit(cls, corpus: DataFrame, *,
            max_features: int | None = tfidf.MAX_FEATURES,
            ngram_range: tuple[int, int] = (1, 2), **options) -> CorpusModel:
        """Fit on raw ``(doc_id, category, text)`` rows.

        ``options`` go to ``prepare``. Counting and weighting both read the
        same shuffle of token rows by document; nothing is cached. Without a
        ``category`` column all documents have the label ``?``.
        ``max_features=None`` keeps every term.
        """
        require_columns(corpus, "doc_id", "text")
        labelled = "category" in corpus.columns
        corpus = matcher.placeholder_category(corpus)
        ready = preprocess.prepare(corpus, **options)
        bound = centroid.centroid_bound(corpus, max_features)
        return cls.fit_prepared(ready, max_features=max_features,
                                ngram_range=ngram_range, centroid_rows=bound,
                                options=tuple(options.items()),
                                labelled=labelled)

    @classmethod
    def fit_prepared(cls, ready: DataFrame, *,
                     max_features: int | None = tfidf.MAX_FEATURES,
                     ngram_range: tuple[int, int] = (1, 2),
                     centroid_rows: int | None = None,
                     options: tuple = (), labelled: bool = True
                     ) -> CorpusModel:
        """Fit on ``(doc_id, category, tokens)`` rows."""
        require_columns(ready, "doc_id", "category", "tokens")
        vocabulary = tfidf.fit_vocabulary(
            ready, max_features=max_features, ngram_range=ngram_range)
        weights = tfidf.transform(
            ready, vocabulary, max_features=max_features,
            ngram_range=ngram_range, keep=("category",))
        docs = ngrams.doc_rows(ready)
        return cls(vocabulary, weights, centroid.fit_centroids(weights), docs,
                   max_features, ngram_range, centroid_rows, options, ready,
                   labelled)

    # -- storage ---------------------------------------------------------

    def save(self, path: str) -> CorpusModel:
        """Write the fitted tables and return a model that reads them.

        Each table is made from the stored one before it, so each step of the
        fit runs once. ``meta``, with the parameters of the fit, comes last: a
        folder without it is no model.
        """
        spark = self.vocabulary.sparkSession
        self.vocabulary.write.parquet(f"{path}/vocabulary")
        vocabulary = spark.read.parquet(f"{path}/vocabulary")
        if vocabulary.where(F.col("term_idx") >= 0).isEmpty():
            raise ValueError("empty vocabulary: no terms in the corpus")
        weights = self.weights if self.ready is None else tfidf.transform(
            self.ready, vocabulary, max_features=self.max_features,
            ngram_range=self.ngram_range, keep=("category",))
        weights.write.parquet(f"{path}/weights")
        stored = spark.read.parquet(f"{path}/weights")
        centroid.fit_centroids(stored).write.parquet(f"{path}/centroids")
        PostingIndex.build(stored).postings.sortWithinPartitions(
            "block", "term_idx").write.parquet(f"{path}/postings")
        plain = {}
        for name, value in self.options:
            if isinstance(value, DataFrame):
                value.write.parquet(f"{path}/{name}")
            elif isinstance(value, (set, frozenset)):
                plain[name] = sorted(value)
            elif isinstance(value, (str, int, float, type(None))):
                plain[name] = value
            else:
                plain[name] = list(value)
        meta = {"max_features": self.max_features,
                "ngram_range": list(self.ngram_range),
                "labelled": self.labelled, "options": plain,
                "tables": [n for n, v in self.options
                           if isinstance(v, DataFrame)]}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(
            1).write.parquet(f"{path}/meta")
        return CorpusModel.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CorpusModel:
        """A stored model, with the parameters that it was fitted with."""
        try:
            meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
            tables = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}
            options = meta["options"] | {
                t: spark.read.parquet(f"{path}/{t}") for t in meta["tables"]}
        except AnalysisException as error:
            raise NotFittedError(f"no fitted model at {path}") from error
        docs = tables["weights"].where(
            F.col("term_idx") == tfidf.DOC_IDX).select("doc_id", "category")
        index = PostingIndex(tables.pop("postings"))
        return cls(**tables, docs=docs, index=index, max_features=meta["max_features"],
                   ngram_range=tuple(meta["ngram_range"]),
                   options=tuple(options.items()),
                   labelled=meta["labelled"],
                   centroid_rows=centroid.small_enough(tables["centroids"]))

    def indexed(self) -> CorpusModel:
        """With posting lists for matching, made anew unless there are some."""
        return self if self.index is not None else replace(
            self, index=PostingIndex.build(self.weights))

    # -- use -------------------------------------------------------------

    def vectorize(self, prepared: DataFrame, key: str = "doc_id",
                  keep: tuple[str, ...] = ()) -> DataFrame:
        return tfidf.transform(prepared, self.vocabulary, key=key, keep=keep,
                               max_features=self.max_features,
                               ngram_range=self.ngram_range)

    def categories(self) -> DataFrame:
        return centroid.labels(self.centroids)

    def scores(self, texts: DataFrame, key: str = "doc_id") -> DataFrame:
        """Scores of every label for raw ``(key, text)`` rows.

        A ``category`` column is carried along unread: the corpus of the fit is
        then cleaned and shuffled once for both.
        """
        keep = ("category",) if "category" in texts.columns else ()
        ready = preprocess.prepare_texts(texts, key=key, keep=keep,
                                         **dict(self.options))
        return self.prepared_scores(ready, key, keep)

    def prepared_scores(self, ready: DataFrame, key: str = "doc_id",
                        keep: tuple[str, ...] = ()) -> DataFrame:
        return centroid.label_scores(self.vectorize(ready, key, keep),
                                     self.centroids, self.centroid_rows, key)

    def classify(self, texts: DataFrame, k: int = 5, key: str = "doc_id"
                 ) -> DataFrame:
        """``(key, rank, category, score)`` for raw texts."""
        return centroid.predict_topk(self.scores(texts, key), k, key)

    def classify_report(self, texts: DataFrame, k: int = 5,
                        key: str = "doc_id") -> DataFrame:
        """One row per text: best label, its score, the top ``k``, and the
        cleaned and the processed text. Each text is cleaned once; ``key``
        tells the texts apart."""
        ready = preprocess.prepare_texts(texts, key=key, show=True,
                                         **dict(self.options))
        nested = centroid.nested_topk(centroid.predict_topk(
            self.prepared_scores(ready, key), k, key), key)
        best = F.get("top_k", 0)
        return (ready.join(nested, key)
                .select(key, best["category"].alias("category"),
                        best["score"].alias("score"), "top_k", "cleaned",
                        "processed"))

    def match(self, queries: DataFrame, corpus: DataFrame | None = None,
              top_n: int = matcher.DEFAULT_TOP_N) -> DataFrame:
        """Best rows for raw ``(query_id, text)`` queries, which may have
        their own ``top_n`` and ``category_filter``. With ``corpus`` the
        result is shaped for reading, else it has ids and raw scores."""
        asked = matcher.normalize_queries(queries, top_n)
        if not self.labelled:
            asked = asked.withColumn("category_filter",
                                     F.lit(None).cast("string"))
        n, rows = matcher.query_bounds(asked)
        rows = matcher.gram_bound(rows, self.ngram_range)
        if n <= 0:
            raise ValueError("no queries, or top_n is not positive")
        ready = preprocess.prepare_texts(asked, key="query_id",
                                         **dict(self.options))
        found = matcher.match(self.weights, self.docs, asked,
                              self.vectorize(ready, "query_id"), n, rows,
                              self.index,
                              self.vocabulary.select("term_idx", "df"))
        if corpus is None:
            return found
        shown = rows * n if rows is not None else None
        if shown is not None and shown > BROADCAST_ROWS:
            shown = None
        return matcher.present(found, corpus, shown)


def split_by_length(texts: DataFrame, min_chars: int) -> DataFrame:
    """Add ``status``: texts too short to work on are ``rejected``."""
    return texts.withColumn("status", tx.guard_status(F.col("text"),
                                                      min_chars))


def accepted(texts: DataFrame, min_chars: int) -> DataFrame:
    return (split_by_length(texts, min_chars)
            .where(F.col("status") == "accepted").drop("status"))
