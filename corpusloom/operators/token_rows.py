"""Token arrays as rows and back, for joins with tables of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.common import require_columns


def spread(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, pos, token, rest)``: a row per token, from position 0.

    One row more per document, at position -1 and without a token, carries all
    its other columns, so documents without tokens stay and no column is
    repeated.
    """
    require_columns(df, key, "tokens")
    rest = F.struct(F.lit(0).alias("_"), *[
        F.col(c) for c in df.columns if c not in (key, "tokens")])
    token = F.lit(None).cast("string")
    rows = F.concat(
        F.array(F.struct(F.lit(-1).alias("pos"), token.alias("token"))),
        F.coalesce(F.transform("tokens", lambda t, i: F.struct(
            i.alias("pos"), t.alias("token"))), F.array()))
    return (df.select(key, rest.alias("rest"), F.explode(rows).alias("t"))
            .select(key, "t.pos", "t.token", F.when(
                F.col("t.pos") < 0, F.col("rest")).alias("rest")))


def gathered(rows: DataFrame, columns: list[str], key: str = "doc_id"
             ) -> DataFrame:
    """Undo :func:`spread`: the tokens that are left, in order. ``key`` tells
    the documents apart; ``columns`` are those of the result."""
    kept = F.sort_array(F.collect_list(F.when(
        F.col("pos") >= 0, F.struct("pos", "token"))))
    back = rows.groupBy(key).agg(kept.alias("kept"), F.first(
        "rest", ignorenulls=True).alias("rest"))
    return back.select(*[
        F.col(key) if c == key else F.col("kept.token").alias("tokens")
        if c == "tokens" else F.col(f"rest.`{c}`").alias(c) for c in columns])


def drop_listed(df: DataFrame, words: DataFrame, key: str = "doc_id"
                ) -> DataFrame:
    """Drop the tokens whose lower case is in the column ``word`` of a table.

    Spark picks the anti join from the size of the table that it measures: a
    broadcast, or a shuffle by token whose hot partitions it splits.
    """
    require_columns(words, "word")
    listed = words.select(F.lower("word").alias("_word")).where(
        F.col("_word").isNotNull()).distinct()
    rows = spread(df, key)
    left = rows.join(listed, F.lower("token") == F.col("_word"), "left_anti")
    return gathered(left, df.columns, key)


def document_counts(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(form, n)``: each token, and in how many documents it occurs.

    Rows of one ``key`` are one document, those without a key none. Tokens are
    told apart within the row, so that it is not pairs of tokens and documents
    that shuffle; rows from ``prepare`` stay where they are.
    """
    own = df.select(key, F.array_distinct("tokens").alias("t"))
    return (own.groupBy(key).agg(F.flatten(F.collect_list("t")).alias("t"))
            .select(key, F.explode(F.array_distinct("t")).alias("form"))
            .groupBy("form").agg(F.count(key).alias("n")))
