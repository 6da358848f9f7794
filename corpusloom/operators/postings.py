"""Posting lists in blocks of documents, and a cut before pairs are made.

The index has a row per block and term: the largest weight of the term in the
block, and the documents that have it. Query weights times largest weights, sum
over the terms that a query shares with a block, bound the score of any of its
documents. The blocks of largest bound are scored first; the n-th best score
found there is what any other document must reach, so blocks whose bound stays
below it make no pairs at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.common import (BROADCAST_ROWS, bounded, join_small,
                                         top_rows)
from corpusloom.operators.tfidf import DOC_IDX, terms_only

DOCS_PER_BLOCK = 8
SCORE_DIGITS = 9
FEW_ROWS = BROADCAST_ROWS // 4  # of queries whose ids a block may list
SLACK = 2e-9  # scores are rounded, and sums differ in their last bits


@dataclass(frozen=True)
class PostingIndex:
    """``(block, category, term_idx, top, docs)``: ``docs`` is an array of
    ``(doc_id, weight)``, ``top`` the largest of its weights. A block has
    documents of one category only."""

    postings: DataFrame

    @classmethod
    def build(cls, weights: DataFrame,
              docs_per_block: int = DOCS_PER_BLOCK) -> PostingIndex:
        """From ``(doc_id, category, term_idx, weight)`` with document rows.

        Blocks are hash slices of the documents of a category, so a large
        category is many blocks. Weights shuffle by block, once, and each list
        is made where its block lies.
        """
        docs = weights.where(F.col("term_idx") == DOC_IDX)
        blocks = F.greatest(F.lit(1), F.ceil(
            docs.agg(F.count(F.lit(1))).scalar() / docs_per_block))
        slices = F.pmod(F.xxhash64("doc_id"), blocks)
        placed = terms_only(weights).select(
            F.xxhash64("category", slices).alias("block"), "category",
            "term_idx", "doc_id", "weight").repartition("block")
        return cls(placed.groupBy("block", "category", "term_idx").agg(
            F.max("weight").alias("top"),
            F.collect_list(F.struct("doc_id", "weight")).alias("docs")))

    def bounds(self, asked: DataFrame, rows: int | None) -> DataFrame:
        """``(query_id, block, bound)``; other blocks share no term."""
        # the largest weight as the lists have it: all uses of lists that are
        # not stored then read one shuffle of the weights
        tops = self.postings.select("block", "category", "term_idx",
                                    F.array_max("docs.weight").alias("top"))
        met = join_small(tops, asked, "term_idx", rows)
        if "category_filter" in asked.columns:
            met = met.where(F.col("category_filter").isNull() | (
                F.col("category") == F.col("category_filter")))
        return met.groupBy("query_id", "block").agg(
            F.sum(F.col("qw") * F.col("top")).alias("bound"))

    def scores(self, asked: DataFrame, chosen: DataFrame, rows: int | None
               ) -> DataFrame:
        """``(query_id, doc_id, category, score)`` of the chosen blocks.

        ``chosen`` is ``(query_id, block)``; ``rows`` bounds its rows times the
        terms of a query.
        """
        pairs = chosen.join(asked.select("query_id", "term_idx", "qw"),
                            "query_id")
        return (self.postings.drop("top")
                .join(bounded(pairs, rows), ["block", "term_idx"])
                .select("query_id", "category", "qw", F.inline("docs"))
                .groupBy("query_id", "doc_id", "category")
                .agg(F.round(F.sum(F.col("qw") * F.col("weight")),
                             SCORE_DIGITS).alias("score")))

    def scores_in_place(self, asked: DataFrame, chosen: DataFrame
                        ) -> DataFrame:
        """:meth:`scores` for many chosen blocks and few queries.

        Lists and chosen blocks both lie by block, so neither moves, nor do
        rows for each block and term of a query; of each document at most the
        sums leave the task.
        """
        wanted = chosen.groupBy("block").agg(
            F.collect_set("query_id").alias("wanted"))
        met = (self.postings.drop("top").join(wanted, "block")
               .join(F.broadcast(asked.select("query_id", "term_idx", "qw")),
                     "term_idx")
               .where(F.array_contains("wanted", F.col("query_id"))))
        return (met.select("block", "query_id", "category", "qw",
                           F.inline("docs"))
                .groupBy("block", "query_id", "doc_id", "category")
                .agg(F.round(F.sum(F.col("qw") * F.col("weight")),
                             SCORE_DIGITS).alias("score")).drop("block"))

    def chosen(self, asked: DataFrame, n: int, rows: int | None
               ) -> tuple[DataFrame, DataFrame]:
        """``(query_id, block)``: first blocks, and the others that are left.

        Each block has a document that shares a term with the query, so n
        blocks hold n of them.
        """
        bounds = self.bounds(asked, rows)
        first = top_rows(bounds, ["query_id"], [F.desc("bound"), F.asc(
            "block")], n, "r").select("query_id", "block")
        nth = self.best(self.scores(asked, first, _times(rows, n)), n).where(
            F.col("r") == n).select("query_id", F.col("score").alias("least"))
        # blocks stay where they are while the queries are few
        rest = (bounds.join(bounded(nth, rows), "query_id", "left").where(
            F.col("least").isNull()
            | (F.col("bound") + SLACK >= F.col("least")))
            .select("query_id", "block")
            .join(bounded(first, _times(rows, n)), ["query_id", "block"],
                  "left_anti"))
        return first, rest

    def best(self, scores: DataFrame, n: int) -> DataFrame:
        return top_rows(scores, ["query_id"], [F.desc("score"), F.desc(
            "doc_id")], n, "r")

    def hits(self, query_weights: DataFrame, n: int, rows: int | None = None
             ) -> DataFrame:
        """``(query_id, doc_id, category, score)`` of the best n documents.

        As many as share a term with the query, if those are fewer.
        ``query_weights`` may carry a ``category_filter``; other categories
        are left out. ``rows`` bounds the query weights, if known.
        """
        asked = terms_only(query_weights).withColumnRenamed("weight", "qw")
        first, rest = self.chosen(asked, n, rows)
        others = (self.scores_in_place(asked, rest)
                  if rows is not None and rows <= FEW_ROWS
                  else self.scores(asked, rest, None))
        found = self.scores(asked, first, _times(rows, n)).unionByName(others)
        return self.best(found, n).drop("r")


def _times(rows: int | None, n: int) -> int | None:
    """Bound on the rows of n blocks for each query term, if it is small."""
    return (rows * n if rows is not None and rows * n <= BROADCAST_ROWS
            else None)
