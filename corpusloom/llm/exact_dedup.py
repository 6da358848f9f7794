"""Exact deduplication by a two-pass Bloom filter, in DataFrame functions.

Pass 1 throws the hash of every text on two cells of a bit field and keeps the
cells hit more than once. Pass 2 holds every row against that filter: a text
whose cells were not both hit again is unique and passes straight through; only
the others shuffle and are grouped by their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import cut, slim, table, widened

BITS_PER_ROW = 16
# 2**20 words of 64 bits are the most that is ever broadcast (some 30 MB as a
# hash table). Beyond it more rows are taken for possible repeats and shuffle;
# the result is the same.
MAX_WORDS = 1 << 20


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _cells(digest: Column, cells: int) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(seed)), F.lit(cells))
            for seed in (1, 2)]



def repeat_filter(digests: DataFrame, cells: int) -> DataFrame:
    """Bits of the cells hit more than once: (word, bits), one row per word."""
    hit = digests.select(F.explode(F.array(*_cells(F.col("sha"), cells)))
                         .alias("cell"))
    again = (hit.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
             .where("n > 1"))
    return (again.groupBy(F.expr("cell div 64").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(cell % 64 as int)))")
                 .alias("bits")))


def _suspects(df: DataFrame, field: DataFrame, cells: int) -> DataFrame:
    """Add ``suspect``: both cells of the row's digest were hit again."""
    for i, cell in enumerate(_cells(F.col("sha"), cells)):
        words = field.toDF(f"_word{i}", f"_bits{i}")
        df = df.withColumn(f"_cell{i}", cell)
        df = df.join(F.broadcast(words),
                     F.expr(f"_cell{i} div 64") == F.col(f"_word{i}"), "left")
    test = [F.coalesce(F.expr(f"getbit(_bits{i}, cast(_cell{i} % 64 as int))")
                       == 1, F.lit(False)) for i in (0, 1)]
    return df.withColumn("suspect", test[0] & test[1]).drop(
        *[f"{c}{i}" for c in ("_cell", "_word", "_bits") for i in (0, 1)])


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text",
                bits_per_row: int = BITS_PER_ROW) -> DataFrame:
    """All rows of ``docs`` with keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest key stays (null keys are smaller
    than any other). A null text counts as empty. Of rows that repeat key and
    text only one is kept. Columns of ``docs`` that already have one of the new
    names are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    named = {"key": key, "text": text}
    body = slim(docs, named).withColumn("sha", sha256(F.col("text")))
    digests = cut(body.select("key", "sha"))
    words = min(MAX_WORDS, digests.count() * bits_per_row // 64 + 1)
    cells = words * 64
    field = cut(repeat_filter(digests, cells))

    # rows that repeat both key and text come together first, so that a hot
    # text is summed up before it shuffles
    same = (_suspects(digests, field, cells).where("suspect")
            .groupBy("sha", "key").agg(F.count(F.lit(1)).alias("n")))
    groups = same.groupBy(F.col("sha").alias("group")).agg(
        F.max(F.struct("key", "n")).alias("best"),
        F.sum("n").alias("group_size"))
    marked = _suspects(body, field, cells)
    result = marked.where("not suspect").select(
        "key", "text", "rest", F.col("key").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    found = marked.where("suspect").join(groups, F.col("sha")
                                         == F.col("group"))
    first = F.col("key").eqNullSafe(F.col("best.key"))
    twice = first & (F.col("best.n") > 1)
    once = Window.partitionBy("sha", "key").orderBy(F.lit(1))
    for part in (found.where(~twice).withColumn("kept", first),
                 found.where(twice).withColumn(
                     "kept", F.row_number().over(once) == 1)):
        result = result.unionByName(part.select(
            "key", "text", "rest", F.col("best.key").alias("keep_id"),
            "group_size", "kept", F.col("sha").alias("text_sha256")))
    return widened(result, docs.columns, named, "keep_id", "group_size",
                   "kept", "text_sha256")


def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(table(spark, sf, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
