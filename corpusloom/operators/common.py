"""Helpers shared by the operators: checks, partitioning, size bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A side is broadcast only when its number of rows is known to stay below
# this; at some 60 bytes a row that is well under the memory of an executor.
BROADCAST_ROWS = 2_000_000
# Rows of one key that a task should join at most.
SALT_ROWS = 1_000_000
# Slices of a key range; beyond so many million rows they hold more each.
MOST_SLICES = 1_000


class NotFittedError(RuntimeError):
    """Raised when a model is used that has not been fitted or stored."""


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    for column in columns:
        if column not in df.columns:
            raise ValueError(f"Column '{column}' not found in DataFrame.")
    return df


def bounded(df: DataFrame, rows: int | None,
            limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if the row bound is known and small, else no hint.

    Without the hint Spark picks the join itself, from the sizes it measures
    at run time.
    """
    return F.broadcast(df) if rows is not None and rows <= limit else df


def join_small(big: DataFrame, small: DataFrame, on: str, rows: int | None,
               how: str = "inner", sizes: DataFrame | None = None
               ) -> DataFrame:
    """Inner or left join with a side that usually fits everywhere.

    Within its bound the small side is broadcast and the large side stays
    where it is. Beyond that Spark picks the join from the sizes it measures.
    ``sizes``, ``(on, df)`` with one row per key, tells how many rows of the
    large side have a key: the rows of a key with more than SALT_ROWS are dealt
    out over as many salts as that takes, and the small side's rows of that key
    are repeated; no other key's are. The rows are the same.
    """
    if rows is not None and rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    if sizes is None:
        return big.join(small, on, how)
    # no more keys can be hot than the large side has rows / SALT_ROWS
    hot = sizes.where(F.col("df") > SALT_ROWS).select(on, F.ceil(
        F.col("df") / SALT_ROWS).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    salt = F.pmod(F.xxhash64(*big.columns), salts).cast("int")
    every = F.explode(F.sequence(F.lit(0), salts - 1))
    return (big.join(F.broadcast(hot), on, "left").withColumn("_salt", salt)
            .drop("_salts").join(
                small.join(F.broadcast(hot), on, "left")
                .withColumn("_salt", every).drop("_salts"),
                [on, "_salt"], how).drop("_salt"))


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than so many rows; counts no further."""
    return df.limit(rows + 1).count() <= rows


def keep_rows(df: DataFrame, column: str, condition: Column) -> DataFrame:
    """Filter on a computed ``column`` without computing it twice.

    Spark moves a plain filter below the projection that makes the column and
    evaluates the whole expression there once more, even below a shuffle. A
    generator in between stops that.
    """
    rest = [c for c in df.columns if c != column]
    kept = F.explode(F.array(F.when(condition, F.col(column))))
    return df.select(*rest, kept.alias(column)).where(
        F.col(column).isNotNull())


def top_rows(df: DataFrame, partition: list[str], order: list[Column],
             n: int | Column, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each partition, with their rank from 1."""
    window = Window.partitionBy(*partition).orderBy(*order)
    return (df.withColumn(rank, F.row_number().over(window))
            .where(F.col(rank) <= n))


def with_slice(df: DataFrame, key: str, slices: int | None = None
               ) -> DataFrame:
    """Add ``_slice``: the number of the slice of the key range of a row.

    Without ``slices`` there is one for each SALT_ROWS rows, eight at least and
    MOST_SLICES at most. The split points come from a few keys, those of least
    hash. They decide how even the slices are, never a result. Both are
    subqueries of the plan, so nothing runs while it is built. Null keys are
    in the first slice.
    """
    number = F.lit(slices) if slices else F.least(F.lit(MOST_SLICES), F.greatest(
        F.lit(8), F.ceil(df.agg(F.count(F.lit(1))).scalar() / SALT_ROWS)))
    probe = (df.select(key).where(F.col(key).isNotNull())
             .orderBy(F.xxhash64(key)).limit(MOST_SLICES * 10)
             .agg(F.sort_array(F.collect_list(key)).alias("k"))
             .withColumn("n", number.cast("int"))
             .select(F.transform(
                 F.sequence(F.lit(1), F.col("n") - 1),
                 lambda i: F.get("k", (i * F.size("k") / F.col("n"))
                                 .cast("int"))).alias("points"))).scalar()
    # a generator of one row, so that the optimiser does not put the expression
    # in place of its result where the key is no longer there
    return (df.withColumn("_points", probe)
            .select(*df.columns, F.explode(F.array(F.size(F.filter(
                "_points", lambda p: p <= F.col(key))))).alias("_slice")))


def dense_index(df: DataFrame, key: str, name: str = "row_index",
                slices: int | None = None) -> DataFrame:
    """Number the rows 0..n-1 in the order of a unique key, distributed.

    A window over the whole table would run in one task. Here split points
    cut the key range into slices, each slice is numbered on its own, and the
    running total of the slice sizes is added. See :func:`with_slice`.
    """
    cut = with_slice(df, key, slices)
    sizes = cut.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each slice is left here, so one task is enough
    before = Window.orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = sizes.select("_slice", F.coalesce(F.sum("_n").over(before),
                                               F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_slice").orderBy(key)
    return (cut.withColumn("_pos", F.row_number().over(inside) - 1)
            .join(F.broadcast(starts), "_slice")
            .withColumn(name, (F.col("_start") + F.col("_pos")).cast("long"))
            .drop("_slice", "_pos", "_start"))
