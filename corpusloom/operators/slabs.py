"""Best documents of many queries, without a row for each pair.

Queries that are too many to be broadcast share a term with nearly every
document, and rows for all these pairs would fill any disk. Here weights are
packed into slabs of documents and blocks of queries, and each slab meets each
block. A slab is laid out as a table of terms by documents, in parts of bounded
size; the scores of a query are one product with the rows of its terms, and
only its best documents of a slab become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.tfidf import terms_only

DOCS_PER_SLAB = 1_024
QUERIES_PER_BLOCK = 2_048
CELLS = 1 << 22   # terms times documents laid out at once, 32 MB
SCORE_DIGITS = 9
_SLACK = 2e-9  # scores are rounded before they are ranked


def _packed(weights: DataFrame, ids: list[str], group: str, weight: str,
            groups: Column, part: str) -> DataFrame:
    """One row for each part: arrays of the ``ids`` columns, of sizes, and of
    all terms and weights one after another. Rows alike in ``group`` are in
    the same part, the largest ids first."""
    lists = weights.groupBy(*ids).agg(F.collect_list(F.struct(
        "term_idx", F.col(weight).cast("double").alias("w"))).alias("l"))
    rows = lists.select(
        F.pmod(F.xxhash64(group), groups).alias(part), *ids,
        F.col("l.term_idx").alias("t"), F.col("l.w").alias("w"))
    each = F.sort_array(F.collect_list(F.struct(*ids, "t", "w")), asc=False)
    return (rows.repartition(part).groupBy(part).agg(each.alias("r")).select(
        part, *[F.col("r")[c].alias(c) for c in ids],
        F.transform("r", lambda x: F.size(x["t"])).alias(f"{part}_n"),
        F.flatten(F.col("r")["t"]).alias(f"{part}_t"),
        F.flatten(F.col("r")["w"]).alias(f"{part}_w")))


def _count(rows: DataFrame, per: int) -> Column:
    # a sum of ones that looks at all columns, so that it reads the same
    # shuffle of documents as the weights do, not one with fewer columns
    one = F.pmod(F.xxhash64(*rows.columns), F.lit(1)) + 1
    return F.greatest(F.lit(1), F.ceil(rows.agg(F.sum(one)).scalar() / per))


def _laid_out(terms: np.ndarray, weights: np.ndarray, sizes: np.ndarray
              ) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of a slab: first document, terms in order, terms by documents."""
    out, ends = [], np.concatenate([[0], np.cumsum(sizes)])
    docs = max(1, CELLS // max(1, len(np.unique(terms))))
    for first in range(0, len(sizes), docs):
        last = min(first + docs, len(sizes))
        here = slice(ends[first], ends[last])
        names, row = np.unique(terms[here], return_inverse=True)
        cells = np.zeros((len(names), last - first))
        column = np.repeat(np.arange(last - first), sizes[first:last])
        np.add.at(cells, (row, column), weights[here])
        out.append((first, names, cells))
    return out


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores above 0; equal ones from the left."""
    found = np.flatnonzero(scores > 0)
    if len(found) > n:
        value = scores[found]
        found = found[value >= np.partition(value, -n)[-n] - _SLACK]
        rounded = np.floor(scores[found] * 10 ** SCORE_DIGITS + 0.5)
        found = found[np.argsort(-rounded, kind="stable")[:n]]
    return found


def _scored(batches: Iterator[pa.RecordBatch], n: int, names: list[str]
            ) -> Iterator[pa.RecordBatch]:
    last, parts = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}

            def numbers(c: str) -> np.ndarray:
                return row[c].values.to_numpy(zero_copy_only=False)

            if last != row["slab"].as_py():
                last = row["slab"].as_py()
                parts = _laid_out(numbers("slab_t"), numbers("slab_w"),
                                  numbers("slab_n"))
            category = np.array(row["category"].as_py(), dtype=object)
            asked = row["category_filter"].as_py()
            ids = row["query_id"].values
            terms, weight = numbers("block_t"), numbers("block_w")
            end = np.cumsum(numbers("block_n"))
            start = end - numbers("block_n")
            # the rows of one query stand together, with a filter each
            alike = ids.dictionary_encode().indices.to_numpy()
            queries = np.split(np.arange(len(ids)),
                               np.flatnonzero(np.diff(alike)) + 1)
            wanted = {c: (category == c) for c in set(asked) - {None}}
            total = np.zeros((len(queries), len(category)))
            for first, known, cells in parts:
                at = np.minimum(np.searchsorted(known, terms),
                                len(known) - 1)
                use = known[at] == terms
                shown = slice(first, first + cells.shape[1])
                for q, rows in enumerate(queries):
                    for r in rows:
                        here = slice(start[r], end[r])
                        mask = use[here]
                        got = weight[here][mask] @ cells[at[here][mask]]
                        if asked[r] is not None:
                            got = got * wanted[asked[r]][shown]
                        total[q, shown] += got
            best = [_best(s, n) for s in total]
            q = np.repeat([rows[0] for rows in queries],
                          [len(b) for b in best])
            d = np.concatenate(best)
            score = total[np.repeat(np.arange(len(best)),
                                    [len(b) for b in best]), d]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(q)), row["doc_id"].values.take(
                    pa.array(d)), row["category"].values.take(pa.array(d)),
                 pa.array(score)], names=names)


def best_hits(weights: DataFrame, asked: DataFrame, docs: DataFrame,
              queries: DataFrame, n: int) -> DataFrame:
    """``(query_id, doc_id, category, score)``: for each slab of documents the
    ``n`` best of each query, later documents first on ties.

    ``asked`` is ``(query_id, term_idx, weight, category_filter)``; documents
    of other categories than the filter are left out. ``docs`` and ``queries``
    tell how many slabs and blocks there are to be. The best of all are among
    these rows. No row is made, and nothing is written, for other pairs.
    """
    slabs = _packed(terms_only(weights), ["doc_id", "category"], "doc_id",
                    "weight", _count(docs, DOCS_PER_SLAB), "slab")
    blocks = _packed(terms_only(asked), ["query_id", "category_filter"],
                     "query_id", "weight",
                     _count(queries, QUERIES_PER_BLOCK), "block")
    met = slabs.crossJoin(blocks)
    names = ["query_id", "doc_id", "category", "score"]
    kinds = [asked.schema["query_id"], weights.schema["doc_id"],
             weights.schema["category"]]
    schema = ", ".join(f"{c} {k.dataType.simpleString()}"
                       for c, k in zip(names, kinds)) + ", score double"
    return met.mapInArrow(lambda b: _scored(b, n, names), schema).withColumn(
        "score", F.round("score", SCORE_DIGITS))
