"""Helpers of the training-data operators: checkpoints, ranks, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import (Column, DataFrame, Observation, SparkSession,
                         Window)
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the cluster's ``spark.checkpoint.dir``. Only a local session without
    one, as in tests, gets a temporary folder.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        given = context.getConf().get("spark.checkpoint.dir")
        if not given and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs"
                             " a folder that all its machines see")
        context.setCheckpointDir(given or tempfile.mkdtemp(
            prefix="corpusloom-"))
    return context.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as a table and go on from there.

    One job, where a checkpoint runs the last stage twice, and the rows take
    less room. ``discard`` removes the table; what a result still reads stays
    in the shared folder, which is cleared with its checkpoints. The shuffle
    files of the job go as soon as the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.table_path = path
    return kept


def discard(*tables: DataFrame | None) -> None:
    """Remove tables of ``cut`` that nothing reads any more."""
    for kept in tables:
        if kept is not None and hasattr(kept, "table_path"):
            spark = kept.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(kept.table_path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(
                path, True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """As ``cut``, with the number of rows, counted while they are written."""
    seen = Observation()
    kept = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return kept, seen.get["rows"]


def in_pieces(batches: Iterator[pd.DataFrame], rows: int = 500
              ) -> Iterator[pd.DataFrame]:
    """So many rows of a batch at a time, as texts can be long."""
    for batch in batches:
        for i in range(0, max(1, len(batch)), rows):
            yield batch.iloc[i:i + rows]


FIELD_WORDS = 1 << 17  # 8 Mbit, some 10 MB when it is broadcast


def may_be_in(big: DataFrame, column: str, small: DataFrame,
              words: int = FIELD_WORDS) -> DataFrame:
    """Rows of ``big`` whose value may be in the column of ``small``.

    A filter by one bit per hashed value, of fixed size however large ``small``
    is: rows can pass by chance, none is lost. An exact join follows it, which
    then shuffles little of ``big``.
    """
    at = F.pmod(F.xxhash64(column), F.lit(words * 64))
    field = (small.select(at.alias("_at"))
             .groupBy(F.expr("_at div 64").alias("_word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(_at % 64 as int)))")
                  .alias("_bits")))
    return (big.withColumn("_at", at)
            .join(F.broadcast(field), F.expr("_at div 64") == F.col("_word"))
            .where("getbit(_bits, cast(_at % 64 as int)) = 1")
            .drop("_at", "_word", "_bits"))


def slim(df: DataFrame, named: dict[str, str]) -> DataFrame:
    """The columns ``named`` {new name: name} and all others in one, ``rest``.

    So an operator's own columns can't clash with those it only passes on.
    """
    rest = [F.col(c) for c in df.columns if c not in named.values()]
    return df.select(*[F.col(old).alias(new) for new, old in named.items()],
                     F.struct(F.lit(0).alias("_slim"), *rest).alias("rest"))


def widened(df: DataFrame, columns: list[str], named: dict[str, str],
            *new: str | Column) -> DataFrame:
    """Undo ``slim``: ``columns`` under their names, then the new ones."""
    back = {old: name for name, old in named.items()}
    return df.select(*[
        F.col(back[c]).alias(c) if c in back
        else F.col("rest").getField(c).alias(c) for c in columns], *new)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def ranked(df: DataFrame, group: str, key: list[str], name: str = "rank",
           per_slice: int = 200_000) -> DataFrame:
    """Number the rows of each group 0..n-1 without a task per group.

    Groups larger than ``per_slice`` are dealt out over hash slices; each
    slice is numbered on its own and starts where the slices before it end.
    ``key`` must tell the rows of a group apart. ``df`` is read three times, so
    it should be a stored table.
    """
    sizes = df.groupBy(group).agg(
        F.ceil(F.count(F.lit(1)) / per_slice).alias("_slices"))
    sliced = (df.join(sizes, df[group].eqNullSafe(sizes[group]))
              .drop(sizes[group])
              .withColumn("_slice", F.pmod(F.xxhash64(*key),
                                           F.col("_slices"))))
    # as many rows as slices: groups + rows / per_slice
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = (sliced.groupBy(group, "_slice")
              .agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before),
                                               F.lit(0)))
              .select(F.col(group).alias("_group"),
                      F.col("_slice").alias("_of"), "_start"))
    inside = Window.partitionBy(group, "_slice").orderBy(*key)
    numbered = sliced.withColumn("_pos", F.row_number().over(inside) - 1)
    return (numbered.join(starts, numbered[group].eqNullSafe(F.col("_group"))
                          & (F.col("_slice") == F.col("_of")))
            .withColumn(name, F.col("_start") + F.col("_pos"))
            .drop("_slices", "_slice", "_pos", "_group", "_of", "_start"))


def _moves(links: DataFrame, turn: int) -> DataFrame:
    """(node, at): the first of each node and its neighbours, in this turn."""
    # Spark puts numbers into the code that it compiles, but not texts: the
    # rounds share one compiled plan
    own, other = (F.struct(F.xxhash64(c, F.lit(f"round {turn}")).alias("h"),
                           F.col(c).alias("node")) for c in ("a", "b"))
    return (links.groupBy("a").agg(F.min(other).alias("first"))
            .select(F.col("a").alias("node"),
                    F.least(own, "first")["node"].alias("at")))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, component).

    Each round every node moves to that one of itself and its neighbours which
    a new random order puts first, and edges move along; a star is one node
    after a round, and of a path half of the nodes stay. The component is its
    smallest node. Nodes without an edge to another node do not appear. Each
    round is written to a table; nothing is collected. The rounds' moves are
    joined last round first, so each join has only the nodes that its round
    began with.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b")
    links, left = counted(both.where("a <> b").distinct())
    rounds = []
    while left:
        rounds.append(links)
        moves = _moves(links, len(rounds))
        links, left = counted(
            links.join(moves.toDF("a", "na"), "a")
            .join(moves.toDF("b", "nb"), "b").where("na <> nb")
            .select(F.col("na").alias("a"), F.col("nb").alias("b"))
            .distinct())
    if not rounds:
        return links.select(F.col("a").alias("node"),
                            F.col("b").alias("component"))
    place = None
    discard(links)
    while rounds:
        moves, later = _moves(rounds[-1], len(rounds)), place
        if later is not None:
            moves = moves.join(later.toDF("at", "to"), "at", "left").select(
                "node", F.coalesce("to", "at").alias("at"))
        place = cut(moves)
        discard(rounds.pop(), later)
    label = place.groupBy("at").agg(F.min("node").alias("component"))
    found = cut(place.join(label, "at").select("node", "component"))
    discard(place)
    return found
