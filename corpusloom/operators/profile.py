"""Corpus profile: counts, lengths, histograms, keywords."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.tokens import stopword_set
from corpusloom.operators.common import top_rows, with_slice


def overview(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count(F.lit(1)).alias("n_rows"),
                      F.count_distinct("category").alias("n_labels"))


def value_counts(corpus: DataFrame, column: str = "category") -> DataFrame:
    return (corpus.groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.desc("cnt"), F.asc(column)))


def lengths(corpus: DataFrame) -> DataFrame:
    return (corpus.withColumn("char_len", tx.char_count(F.col("text")))
            .withColumn("word_count", tx.word_count(F.col("text"))))


def quantiles(df: DataFrame, column: str, shares: Iterable[float],
              slices: int | None = None) -> DataFrame:
    """One row, one array column: exact quantiles, between neighbours by
    their distance; null without values.

    Equal values are one row with their number. Split points cut the range of
    values into slices, each slice counts up on its own, and the numbers of
    the slices before it are added: no task sees all values. Of all rows only
    the neighbours of each rank are left.
    """
    value = F.col("value")
    counts = (df.select(F.col(column).cast("double").alias("value"))
              .where(value.isNotNull()).groupBy("value")
              .agg(F.count(F.lit(1)).alias("n")))
    sliced = with_slice(counts, "value", slices)
    # as many rows as slices: one task is enough
    before = Window.orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = (sliced.groupBy("_slice").agg(F.sum("n").alias("_n"))
              .select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0))
                      .alias("_start")))
    inside = Window.partitionBy("_slice").orderBy("value")
    placed = sliced.join(F.broadcast(starts), "_slice").select(
        "value", "n", (F.col("_start") + F.sum("n").over(inside))
        .alias("upto")).withColumn("total", counts.agg(F.sum("n")).scalar())

    def at(rank: Column) -> Column:
        here = (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n"))
        return F.max(F.when(here, value))

    shares = list(shares)
    ranks = [F.lit(q) * (F.col("total") - 1) for q in shares]
    found = placed.agg(F.max("total").alias("total"), *[
        at(edge(rank)).alias(f"{name}{i}") for i, rank in enumerate(ranks)
        for name, edge in (("low", F.floor), ("high", F.ceil))])
    return found.select(F.when(F.col("total") > 0, F.array(*[
        F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}"))
        * (rank - F.floor(rank)) for i, rank in enumerate(ranks)]))
        .alias("quantiles"))


def describe(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles, max; rounded."""
    columns = list(columns)
    quarts = {c: quantiles(df, c, (.25, .5, .75)) for c in columns}
    aggs = []
    for c in columns:
        aggs += [F.count(c).alias(f"{c}_count"), F.avg(c).alias(f"{c}_mean"),
                 F.stddev_samp(c).alias(f"{c}_std"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    wide = df.agg(*aggs).select("*", *[
        quarts[c].scalar().alias(f"{c}_q") for c in columns])

    def row(c: str):
        quart = F.col(f"{c}_q")
        values = {"count": F.col(f"{c}_count"), "mean": F.col(f"{c}_mean"),
                  "std": F.col(f"{c}_std"), "min": F.col(f"{c}_min"),
                  "q25": quart[0], "q50": quart[1], "q75": quart[2],
                  "max": F.col(f"{c}_max")}
        return F.struct(F.lit(c).alias("column_name"), *[
            F.round(v.cast("double"), 0).alias(n) for n, v in values.items()])

    return wide.select(F.inline(F.array(*[row(c) for c in columns])))


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """``(bin, lower, upper, cnt)`` over equal widths, last bin closed.

    The limits come from a scalar subquery; rows are counted per bin before
    anything is shuffled, so at most ``bins`` rows per task move.
    """
    span = df.agg(F.struct(F.min(column).cast("double").alias("lo"),
                           F.max(column).cast("double").alias("hi"))).scalar()
    # all values equal: half a unit to either side
    flat = span["lo"] == span["hi"]
    low = F.when(flat, span["lo"] - 0.5).otherwise(span["lo"])
    high = F.when(flat, span["hi"] + 0.5).otherwise(span["hi"])
    width = (high - low) / bins
    place = F.least(F.floor((F.col(column) - low) / width).cast("int"),
                    F.lit(bins - 1))
    counts = (df.where(F.col(column).isNotNull())
              .select(place.alias("bin")).groupBy("bin")
              .agg(F.count(F.lit(1)).alias("cnt")))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int")
                                               .alias("bin"))
    return (every.join(counts, "bin", "left")
            .select("bin", (low + F.col("bin") * width).alias("lower"),
                    (low + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce("cnt", F.lit(0)).alias("cnt")))


def top_keywords(corpus: DataFrame, n: int = 20, min_length: int = 4,
                 stopwords: Iterable[str] | None = None) -> DataFrame:
    """``(category, rank, keyword, cnt)`` from the raw, lower-cased text.

    Ties go to the keyword seen first. Counts are combined before the shuffle
    and each task passes on only its best ``n`` per label, so one label with
    most of the corpus does not land in one task.
    """
    listed = stopword_set(stopwords)
    seen = (corpus.select("doc_id", "category", F.posexplode(
        tx.words(F.lower("text"))).alias("pos", "keyword"))
        .where((F.length("keyword") >= min_length)
               & F.col("keyword").rlike(r"^\p{L}+\z")
               & ~F.col("keyword").isin(listed)))
    counts = seen.groupBy("category", "keyword").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min(F.struct("doc_id", "pos")).alias("first"))
    return (top_rows(counts, ["category"],
                     [F.desc("cnt"), F.asc("first")], n)
            .select("category", "rank", "keyword", "cnt"))


def label_choices(corpus: DataFrame, label_col: str = "category"
                  ) -> DataFrame:
    """Sorted labels behind the choice ``All``: ``(choice_order, choice)``."""
    found = corpus.select(F.lit(1).alias("choice_order"),
                          F.col(label_col).alias("choice")).distinct()
    first = corpus.sparkSession.range(1).select(
        F.lit(0).alias("choice_order"), F.lit("All").alias("choice"))
    return first.unionByName(found).orderBy("choice_order", "choice")
