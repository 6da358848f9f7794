"""N-grams, their counts, and vocabularies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.common import dense_index, join_small

# Term of the one extra row each document may contribute: it counts documents
# in the same pass that counts terms and keeps documents without any term.
DOC_MARK = ""
# Sums of counts by hash of the term, from which it is seen which terms can be
# among the most frequent. A task holds no more sums than this.
BUCKETS = 1 << 20


def check_range(ngram_range: tuple[int, int]) -> tuple[int, int]:
    low, high = ngram_range
    if not 1 <= low <= high:
        raise ValueError(f"bad ngram_range {ngram_range}")
    return low, high


def explode_ngrams(df: DataFrame, tokens: str = "tokens",
                   ngram_range: tuple[int, int] = (1, 2),
                   keep: tuple[str, ...] = ("doc_id", "category"),
                   mark_docs: bool = False) -> DataFrame:
    """One row per n-gram occurrence: the ``keep`` columns and ``term``.

    ``tokens`` are those of ``prepare`` or ``from_processed``: two characters
    or more each.

    Tokens of one character are left out first, as vectorisers do. Longer
    n-grams look ahead in the array by position, so the whole step is two
    generators and array reads inside generated code: no lambda, no sort.
    """
    low, high = check_range(ngram_range)
    usable = df.select(*keep, F.col(tokens).alias("t"))
    size = F.size("t")
    # an extra, last position stands for the document itself
    span = (F.sequence(F.lit(0), size) if mark_docs else
            F.when(size > 0, F.sequence(F.lit(0), size - 1)))

    def gram(n: int) -> Column:
        parts = [F.get("t", F.col("i") + k) for k in range(n)]
        one = parts[0] if n == 1 else F.concat_ws(" ", *parts)
        return F.when(F.col("i") + n <= size, one)

    grams = [gram(n) for n in range(low, high + 1)]
    if mark_docs:
        grams.append(F.when(F.col("i") == size, F.lit(DOC_MARK)))
    return (usable.select(*keep, "t", F.explode(span).alias("i"))
            .select(*keep, F.explode(F.array(*grams)).alias("term"))
            .where(F.col("term").isNotNull()))


def doc_rows(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "category"),
             tokens: str = "tokens") -> DataFrame:
    """The ``keep`` columns of every document, without a pass of their own.

    A generator of one row looks at the tokens, so that this reads the same
    shuffle of token rows as the counts do, not one without tokens.
    """
    return df.select(*keep, F.explode(F.array(F.size(tokens))).alias("_n")
                     ).drop("_n")


def doc_count(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "category")
              ) -> Column:
    """Number of documents as :func:`term_counts` tells them apart, from the
    shuffle of token rows and without any n-grams."""
    seen = F.explode(F.array(F.when(F.col("tokens").isNotNull(),
                                    F.size("tokens"))))
    return (df.select(*keep, seen.alias("_n")).where("_n is not null")
            .select(*keep).distinct().agg(F.count(F.lit(1))).scalar())


def term_counts(df: DataFrame, *, keep: tuple[str, ...] = ("doc_id",
                                                          "category"),
                tokens: str = "tokens",
                ngram_range: tuple[int, int] = (1, 2),
                mark_docs: bool = False, among: Column | None = None
                ) -> DataFrame:
    """``(keep..., term, tf)``. Local to each task if ``df`` is partitioned
    by the document key, which is what ``prepare`` returns.

    Rows that are alike in ``keep`` are one document. Its n-grams are sorted
    and counted within its row, so no table of documents and terms is held by
    an aggregate, which would spill. ``among`` are bits of :func:`bucket_bits`:
    n-grams of other buckets are left out before the sort.
    """
    low, high = check_range(ngram_range)

    def grams(t: Column) -> Column:
        size = F.size(t)

        def longer(n: int) -> Column:
            heads = F.slice(t, F.lit(1), F.greatest(size - (n - 1), F.lit(0)))
            return F.transform(heads, lambda head, i: F.concat_ws(
                " ", head, *[F.get(t, i + k) for k in range(1, n)]))

        parts = [t if n == 1 else longer(n) for n in range(low, high + 1)]
        if mark_docs:
            parts.append(F.array(F.lit(DOC_MARK)))
        return F.concat(*parts)

    # a generator of one row, so that each array is made once
    merged = df.groupBy(*keep).agg(F.collect_list(tokens).alias("_lists"))
    every = F.flatten(F.transform("_lists", grams))
    if among is not None:
        merged = merged.withColumn("_among", among)
        every = F.filter(every, lambda t: _is_set("_among", bucket(t)))
    listed = merged.select(*keep, F.explode(F.array(F.sort_array(every)))
                           .alias("_t"))
    starts = F.filter(
        F.when(F.size("_t") > 0, F.sequence(F.lit(0), F.size("_t") - 1)),
        lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1)))
    return (listed.select(*keep, "_t", F.explode(F.array(starts))
                          .alias("_starts"))
            .select(*keep, "_t", "_starts", F.posexplode("_starts")
                    .alias("_n", "_from"))
            .select(*keep, F.get("_t", F.col("_from")).alias("term"),
                    (F.coalesce(F.get("_starts", F.col("_n") + 1),
                                F.size("_t")) - F.col("_from"))
                    .cast("long").alias("tf")))


def corpus_counts(counts: DataFrame) -> DataFrame:
    """``(term, cf, df)``: total count and number of documents per term."""
    return counts.groupBy("term").agg(F.sum("tf").alias("cf"),
                                      F.count(F.lit(1)).alias("df"))


def bucket(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS))


def _is_set(bits: Column | str, place: Column) -> Column:
    word = F.get(bits, F.shiftright(place, 6).cast("int"))
    return F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1


def bucket_bits(buckets: DataFrame) -> Column:
    """One bit per bucket, set for those in the column ``bucket``, as a
    subquery: an array of longs of fixed size."""
    words = buckets.groupBy(F.expr("bucket div 64").alias("id")).agg(F.expr(
        "bit_or(shiftleft(1L, cast(bucket % 64 as int)))").alias("bits"))
    every = buckets.sparkSession.range(0, BUCKETS // 64, 1, 1).join(
        F.broadcast(words), "id", "left")
    listed = F.sort_array(F.collect_list(F.struct(
        "id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(listed.alias("w")).select("w.bits").scalar()


def frequent_counts(df: DataFrame, n: int, *,
                    keep: tuple[str, ...] = ("doc_id", "category"),
                    ngram_range: tuple[int, int] = (1, 2),
                    kept: Callable[[DataFrame], DataFrame] | None = None
                    ) -> DataFrame:
    """``(term, cf, df)`` like :func:`corpus_counts` with marked documents, of
    all terms that can be among the ``n`` most frequent of those that ``kept``
    keeps, and some others.

    Most n-grams are rare, and a shuffle of all of them is what a fit would
    cost. So counts are first summed by hash of the term, a bound on the count
    of each term of a bucket. The terms of the 2n largest buckets are counted;
    the n-th best count is what any other must reach, so only terms of buckets
    that do are counted for the result. The counts are exact.
    """
    if not 0 < n <= BUCKETS // 16:
        return corpus_counts(term_counts(df, keep=keep, mark_docs=True,
                                         ngram_range=ngram_range))
    # generators of one row look at all columns and keep filters on the tokens
    # above the shuffle, so that the counts read the same one
    rows = df.select("tokens", F.explode(F.array(F.xxhash64(*keep)))).select(
        F.explode(F.array("tokens")).alias("tokens"))
    grams = explode_ngrams(rows, ngram_range=ngram_range, keep=())
    # only as many rows as there are buckets leave each task; the last
    # generator keeps filters above the sums, so that both uses share them
    sums = grams.groupBy(bucket("term").alias("_b")).agg(
        F.count(F.lit(1)).alias("n")).select(
        F.explode(F.array("_b")).alias("bucket"), "n")
    # the mark is counted always
    mark = df.sparkSession.range(1).select(
        bucket(F.lit(DOC_MARK)).alias("bucket"))

    def counts(buckets: DataFrame) -> DataFrame:
        return corpus_counts(term_counts(
            df, keep=keep, ngram_range=ngram_range, mark_docs=True,
            among=bucket_bits(buckets.select("bucket").unionByName(mark))))

    largest = sums.orderBy(F.desc("n")).limit(2 * n)
    if kept is None:
        first = grams.where(_is_set(bucket_bits(largest), bucket("term"))
                            ).groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    else:
        first = kept(counts(largest))
    nth = first.where(F.col("term") != DOC_MARK).select("cf").orderBy(
        F.desc("cf")).limit(n).agg(F.when(F.count(F.lit(1)) == n, F.min("cf"))
                                   .otherwise(F.lit(0))).scalar()
    return counts(sums.where(F.col("n") >= nth))


def _threshold(value: int | float, n_docs: Column | int) -> Column:
    """An int is a number of documents, a float a share of all of them."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError("document frequency limits must be int or float")
    if isinstance(value, int):
        return F.lit(value)
    return F.lit(value) * n_docs


def prune(counts: DataFrame, n_docs: Column | int,
          min_df: int | float = 1, max_df: int | float = 1.0) -> DataFrame:
    out = counts
    if min_df != 1 or isinstance(min_df, float):
        out = out.where(F.col("df") >= _threshold(min_df, n_docs))
    if isinstance(max_df, int) or max_df != 1.0:
        out = out.where(F.col("df") <= _threshold(max_df, n_docs))
    return out


def most_frequent(counts: DataFrame, max_features: int | None) -> DataFrame:
    """The terms counted most often overall; equal counts go by the alphabet.
    A document mark does not use up a place."""
    if max_features is None:
        return counts
    marked = F.col("term") == DOC_MARK
    terms = counts.where(~marked).orderBy(F.desc("cf"), F.asc("term"))
    return terms.limit(max_features)


def number_terms(terms: DataFrame, max_features: int | None) -> DataFrame:
    """Add ``term_idx``: 0, 1, ... in alphabetical order."""
    if max_features is None:
        return dense_index(terms, "term", "term_idx").withColumn(
            "term_idx", F.col("term_idx").cast("int"))
    # no more than max_features rows are left, so one task can number them
    return terms.withColumn(
        "term_idx", F.row_number().over(Window.orderBy("term")) - 1)


def matrix(counts: DataFrame, vocabulary: DataFrame,
           max_features: int | None) -> DataFrame:
    """Counts of known terms only, as ``(..., term_idx, tf)``."""
    index = vocabulary.select("term", "term_idx")
    return join_small(counts, index, "term", max_features,
                      sizes=vocabulary.select("term", "df")).drop("term")
