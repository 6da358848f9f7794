"""Top-N rows of a corpus for each of many query texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import slabs
from corpusloom.operators.centroid import SCORE_DIGITS
from corpusloom.operators.common import (BROADCAST_ROWS, bounded, join_small,
                                         require_columns, top_rows)
from corpusloom.operators.postings import PostingIndex
from corpusloom.operators.tfidf import terms_only

DEFAULT_TOP_N = 5
MASKED = -1.0


def normalize_queries(queries: DataFrame, top_n: int = DEFAULT_TOP_N
                      ) -> DataFrame:
    """``(query_id, text, top_n, category_filter)``; a missing, empty or
    ``All`` filter is no filter."""
    require_columns(queries, "query_id", "text")
    wanted = (F.coalesce("top_n", F.lit(top_n)) if "top_n" in queries.columns
              else F.lit(top_n))
    chosen = F.lit(None).cast("string")
    if "category_filter" in queries.columns:
        chosen = F.when(~F.col("category_filter").isin("", "All"),
                        F.col("category_filter"))
    return queries.select("query_id", "text", wanted.cast("int")
                          .alias("top_n"), chosen.alias("category_filter"))


def query_bounds(queries: DataFrame) -> tuple[int, int | None]:
    """Largest ``top_n``, and a bound on query tokens if that is small.

    Folding makes at most three tokens of a character, and every query has one
    row more for itself.
    """
    n, size = queries.agg(F.max("top_n"), F.coalesce(F.sum(
        3 * F.length(tx.filled(F.col("text"))) + 1), F.lit(0))).first()
    return n or 0, size if size <= BROADCAST_ROWS else None


def gram_bound(rows: int | None, ngram_range: tuple[int, int]) -> int | None:
    """Bound on the n-grams of so many tokens, if that is small."""
    if rows is None:
        return None
    grams = rows * (ngram_range[1] - ngram_range[0] + 1)
    return grams if grams <= BROADCAST_ROWS else None


def similarities(weights: DataFrame, query_weights: DataFrame,
                 rows: int | None = None, sizes: DataFrame | None = None
                 ) -> DataFrame:
    """``(query_id, doc_id, category, score)`` of pairs that share a term.

    The query side is broadcast while its bound is small. Corpus rows then
    stay where they are: both the join and the sum by (query, document) run
    within the partitions by document. ``query_weights`` may carry a
    ``category_filter``; other documents are left out before the sum.
    ``sizes``, ``(term_idx, df)``, tells hot terms beyond the bound.
    """
    asked = terms_only(query_weights).withColumnRenamed("weight", "qw")
    met = join_small(terms_only(weights), asked, "term_idx", rows,
                     sizes=sizes)
    if "category_filter" in asked.columns:
        met = met.where(F.col("category_filter").isNull()
                        | (F.col("category") == F.col("category_filter")))
    return (met.groupBy("query_id", "doc_id", "category")
            .agg(F.round(F.sum(F.col("qw") * F.col("weight")), SCORE_DIGITS)
                 .alias("score")))


def _fillers(docs: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """Rows that stand in when too few documents share a term with a query.

    Ties go to later documents, so only the last few can ever show: the last
    2n a query may match count 0, and the last n it may not count -1. Per
    category the last 2n documents are kept; the last 3n of those hold what
    any query needs across categories, because at most 2n of them are of its
    own category. No pairing of queries and documents beyond that.
    """
    tail = top_rows(docs, ["category"], [F.desc("doc_id")], 2 * n, "r")
    newest = (tail.orderBy(F.desc("doc_id")).limit(3 * n)
              .agg(F.sort_array(F.collect_list(F.struct("doc_id", "category")),
                                asc=False).alias("a")))
    recent = newest.scalar()
    ask = queries.select("query_id", "category_filter",
                         recent.alias("recent"))
    free = F.col("category_filter").isNull()

    def spread(frame: DataFrame, rows: Column, score: float) -> DataFrame:
        return (frame.select("query_id", F.explode(rows).alias("d"))
                .select("query_id", "d.doc_id", "d.category",
                        F.lit(score).alias("score")))

    open_zero = spread(ask.where(free), F.slice("recent", 1, 2 * n), 0.0)
    # many queries may ask for one category: deal them out, repeat the tail
    own = queries.where(~free).select(
        "query_id", F.col("category_filter").alias("category"))
    own_zero = join_small(own, tail.drop("r"), "category", None).select(
        "query_id", "doc_id", "category", F.lit(0.0).alias("score"))
    masked = spread(ask.where(~free), F.slice(F.filter(
        "recent", lambda d: ~d["category"].eqNullSafe(
            F.col("category_filter"))),
        1, n), MASKED)
    return open_zero.unionByName(own_zero).unionByName(masked)


def match(weights: DataFrame, docs: DataFrame, queries: DataFrame,
          query_weights: DataFrame, n: int, rows: int | None = None,
          index: PostingIndex | None = None,
          sizes: DataFrame | None = None) -> DataFrame:
    """``(query_id, rank, doc_id, category, score)``.

    With an ``index`` pairs are made in the blocks that can hold a result only;
    without one, all documents that share a term are scored, many queries slab
    by slab and without rows for their pairs. ``docs`` is ``(doc_id,
    category)`` of the whole index. Score falling, later documents first on
    ties. Documents outside the filtered category, or without one, are not
    removed: they follow at -1.
    """
    if n <= 0:
        raise ValueError("top_n must be positive")
    order = [F.desc("score"), F.desc("doc_id")]
    asked = query_weights.join(
        bounded(queries.select("query_id", "category_filter"), rows),
        "query_id")
    if index is not None:
        hits = index.hits(asked, n, rows)
    else:
        # too many queries to be broadcast would make rows of nearly all pairs
        found = (slabs.best_hits(weights, asked, docs, queries, n)
                 if rows is None else
                 similarities(weights, asked, rows, sizes))
        hits = top_rows(found, ["query_id"], order, n, "r").drop("r")
    every = (hits.unionByName(_fillers(docs, queries, n))
             .groupBy("query_id", "doc_id", "category")
             .agg(F.max("score").alias("score")))
    # a literal limit first, so that Spark can cut before it shuffles
    ranked = top_rows(every, ["query_id"], order, n)
    wanted = queries.select("query_id", "top_n")
    return (ranked.join(bounded(wanted, rows), "query_id")
            .where(F.col("rank") <= F.col("top_n"))
            .select("query_id", "rank", "doc_id", "category", "score"))


def present(matches: DataFrame, corpus: DataFrame, rows: int | None = None
            ) -> DataFrame:
    """``(query_id, rank, Category, similarity_pct, resume_snippet)``.

    ``rows`` bounds the number of matches. A corpus without categories shows
    ``?``, one without texts an empty snippet.
    """
    body = F.col("text") if "text" in corpus.columns else F.lit("")
    shown = corpus.select("doc_id", tx.snippet(body).alias("resume_snippet"))
    label = (F.col("category") if "category" in matches.columns
             else F.lit("?"))
    return (shown.join(bounded(matches, rows), "doc_id")
            .select("query_id", "rank", label.alias("Category"),
                    tx.percent(F.col("score")).alias("similarity_pct"),
                    "resume_snippet"))


def placeholder_category(df: DataFrame) -> DataFrame:
    """Give a corpus without categories the placeholder label."""
    return df if "category" in df.columns else df.withColumn(
        "category", F.lit("?"))

