"""Nearest-centroid classification by cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.common import (BROADCAST_ROWS, has_at_most,
                                         join_small, top_rows)
from corpusloom.operators.tfidf import DOC_IDX, MAX_FEATURES

DENSE_LABELS = 2_000  # centroids that one row is compared with at once
DENSE_SLICES = 64     # parts of the vectors that blocks of centroids meet
SCORE_DIGITS = 9  # sums differ in their last bits; ranks must not


def fit_centroids(weights: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(category, label_first_id, term_idx, weight, norm)``.

    The mean is over all documents of a label, also those without terms:
    their number is the count of document rows (``term_idx`` -1). The shuffle
    moves at most labels x terms rows per task, whatever the sizes of the
    labels, because sums are built before it.
    """
    sums = weights.groupBy("category", "term_idx").agg(
        F.sum("weight").alias("total"), F.count(F.lit(1)).alias("rows"),
        F.min(key).alias("first_id"))
    label = Window.partitionBy("category")
    doc_row = F.col("term_idx") == DOC_IDX
    means = sums.select(
        "category", "term_idx",
        F.max(F.when(doc_row, F.col("first_id"))).over(label)
        .alias("label_first_id"),
        (F.col("total") / F.max(F.when(doc_row, F.col("rows"))).over(label))
        .alias("weight"))
    return means.withColumn("norm", F.sqrt(F.sum(
        F.col("weight") * F.col("weight")).over(label)))


def centroid_bound(corpus: DataFrame,
                   max_features: int | None = MAX_FEATURES,
                   label_col: str = "category") -> int | None:
    """Largest number of centroid rows, if it can be shown to be small.

    Reads the label column alone.
    """
    if max_features is None:
        return None
    labels = BROADCAST_ROWS // (max_features + 1)
    seen = corpus.select(label_col).distinct().limit(labels + 1).count()
    return seen * (max_features + 1) if seen <= labels else None


def label_scores(weights: DataFrame, centroids: DataFrame,
                 rows: int | None = None, key: str = "doc_id") -> DataFrame:
    """``(key, category, label_first_id, score)`` for all texts and labels.

    An equi-join on the term: document rows meet the document row of every
    centroid, so a text without any known term still gets each label, at 0.
    Text rows already have unit length (or are zero).
    """
    met = join_small(weights.select(key, "term_idx", F.col("weight")
                                    .alias("w")), centroids, "term_idx", rows)
    dots = met.groupBy(key, "category").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot"),
        F.max("norm").alias("norm"),
        F.min("label_first_id").alias("label_first_id"))
    score = F.when(F.col("norm") > 0, F.col("dot") / F.col("norm")
                   ).otherwise(F.lit(0.0))
    return dots.select(key, "category", "label_first_id",
                       F.round(score, SCORE_DIGITS).alias("score"))


def predict_topk(scores: DataFrame, k: int = 5, key: str = "doc_id"
                 ) -> DataFrame:
    """``(key, rank, category, score)``; equal scores go to the label that
    came first in the training rows."""
    best = top_rows(scores, [key], [F.desc("score"), F.asc("label_first_id")],
                    k)
    return best.select(key, "rank", "category", "score")


def predict(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, category, score)`` of the best label, without a sort."""
    order = F.struct("score", (-F.col("label_first_id")).alias("early"))
    return (scores.groupBy(key)
            .agg(F.max(F.struct(order.alias("order"), "category", "score"))
                 .alias("best"))
            .select(key, "best.category", "best.score"))


def nested_topk(ranked: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per text: ``top_k array<struct<category, score>>``."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "category", "score")))
    return (ranked.groupBy(key).agg(rows.alias("r"))
            .select(key, F.transform("r", lambda x: F.struct(
                x["category"].alias("category"), x["score"].alias("score")))
                .alias("top_k")))


def labels(df: DataFrame, label_col: str = "category") -> DataFrame:
    """Known labels in order."""
    return df.select(label_col).distinct().orderBy(label_col)


def _length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def dense_centroids(vectors: DataFrame, key: str, vector_col: str,
                    label_col: str) -> DataFrame:
    """``(category, label_first_id, norm, mean)``: the mean vector of each
    label as ``array<double>``. Sums are built before anything shuffles."""
    long = vectors.select(F.col(label_col).alias("category"), key,
                          F.posexplode(vector_col).alias("i", "value"))
    means = long.groupBy("category", "i").agg(
        F.avg(F.col("value").cast("double")).alias("x"),
        F.min(key).alias("first_id"))
    packed = means.groupBy("category").agg(
        F.min("first_id").alias("label_first_id"),
        F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m"))
    mean = F.col("m.x")
    return packed.select("category", "label_first_id",
                         _length(mean).alias("norm"), mean.alias("mean"))


def dense_scores(vectors: DataFrame, centroids: DataFrame, key: str,
                 vector_col: str, labels: int | None = None) -> DataFrame:
    """``(key, category, label_first_id, score)``: cosines within the row.

    ``centroids`` are those of :func:`dense_centroids`, ``labels`` a bound on
    their number, if known. Up to DENSE_LABELS they go to every row as one
    array. Beyond that they are dealt out over blocks of about so many, and
    blocks and slices of the vectors shuffle to meet. Values of a scored vector
    are never spread over rows. A null vector counts as zero.
    """
    each = F.struct("category", "label_first_id", F.col("norm").alias("cn"),
                    "mean")
    norm = F.coalesce(_length(F.col(vector_col).cast("array<double>")),
                      F.lit(0.0))
    rows = vectors.select(key, F.col(vector_col).alias("v"),
                          norm.alias("norm"))
    if labels is not None and labels <= DENSE_LABELS:
        met = rows.withColumn("cents", centroids.agg(
            F.collect_list(each)).scalar())
    else:
        n = F.greatest(F.lit(1), F.ceil(centroids.agg(F.count(F.lit(1)))
                                        .scalar() / DENSE_LABELS))
        every = F.explode(F.sequence(F.lit(0), F.lit(DENSE_SLICES - 1)))
        blocks = (centroids.withColumn("block", F.pmod(F.xxhash64("category"),
                                                       n))
                  .groupBy("block").agg(F.collect_list(each).alias("cents"))
                  .withColumn("slice", every))
        met = (rows.withColumn("slice", F.pmod(
            F.xxhash64(key), F.lit(DENSE_SLICES)).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"),
                                                      n - 1)))
            .join(blocks, ["block", "slice"]))

    def scored(c: Column) -> Column:
        dot = F.aggregate(F.zip_with("v", c["mean"], lambda x, y: x * y),
                          F.lit(0.0), lambda total, x: total + x)
        return F.struct(c["category"].alias("category"),
                        c["label_first_id"].alias("label_first_id"),
                        c["cn"].alias("cn"), dot.alias("dot"))

    score = F.when((F.col("norm") > 0) & (F.col("cn") > 0), F.col("dot") / (
        F.col("norm") * F.col("cn"))).otherwise(F.lit(0.0))
    return (met.select(key, "norm", F.inline(F.transform("cents", scored)))
            .select(key, "category", "label_first_id",
                    F.round(score, SCORE_DIGITS).alias("score")))


def label_bound(df: DataFrame, label_col: str) -> int | None:
    """Number of labels, if it is small; reads the label column alone."""
    seen = df.select(label_col).distinct().limit(DENSE_LABELS + 1).count()
    return seen if seen <= DENSE_LABELS else None


def small_enough(centroids: DataFrame) -> int | None:
    """Row bound of a stored centroid table, by counting it."""
    return (BROADCAST_ROWS if has_at_most(centroids, BROADCAST_ROWS)
            else None)
