"""Scoring texts as they arrive, against a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.common import NotFittedError
from corpusloom.plans.model import (MIN_CLASSIFY_CHARS, MIN_MATCH_CHARS,
                                    CorpusModel, split_by_length)

TEXT_SCHEMA = "doc_id long, text string"
QUERY_SCHEMA = ("query_id long, text string, top_n int, "
                "category_filter string")
MATCH_SCHEMA = ("query_id long, rank int, Category string, "
                "similarity_pct double, resume_snippet string")


def read_texts(spark: SparkSession, path: str, schema: str = TEXT_SCHEMA,
               files_per_batch: int | None = None) -> DataFrame:
    """A stream of the parquet files that appear below ``path``."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _parted(batch: DataFrame, min_chars: int) -> tuple[DataFrame, DataFrame]:
    marked = split_by_length(batch, min_chars)
    return (marked.where(F.col("status") == "accepted").drop("status"),
            marked.where(F.col("status") == "rejected"))


def _both(scored: DataFrame, short: DataFrame) -> DataFrame:
    """Scored and rejected rows as one table, so one write holds both."""
    return scored.withColumn("status", F.lit("accepted")).unionByName(
        short.withColumn("status", F.lit("rejected")),
        allowMissingColumns=True)


def _write_batch(result: DataFrame, out: str, batch_id: int) -> None:
    # Every batch owns one directory, so a batch that is run again after a
    # failure replaces its own output and nothing else.
    result.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def _start(stream: DataFrame, handle, checkpoint: str, available_now: bool
           ) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option(
        "checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def classify_stream(stream: DataFrame, model: CorpusModel, out: str,
                    checkpoint: str, k: int = 5, available_now: bool = True
                    ) -> StreamingQuery:
    """Top labels of arriving ``(doc_id, text)`` rows.

    Every row shows up: texts that are too short have one row without rank,
    label and score and the ``status`` rejected.
    """
    if model is None:
        raise NotFittedError("fit or load a model first")

    def handle(batch: DataFrame, batch_id: int) -> None:
        ok, short = _parted(batch, MIN_CLASSIFY_CHARS)
        _write_batch(_both(model.classify(ok, k), short.select("doc_id")),
                     out, batch_id)

    return _start(stream, handle, checkpoint, available_now)


def match_stream(stream: DataFrame, model: CorpusModel, corpus: DataFrame,
                 out: str, checkpoint: str, available_now: bool = True
                 ) -> StreamingQuery:
    """Best corpus rows for arriving queries.

    Queries that are too short have one row with their id and the ``status``
    rejected, also in a batch that has no others.
    """
    if model is None:
        raise NotFittedError("fit or load a model first")

    def handle(batch: DataFrame, batch_id: int) -> None:
        ok, short = _parted(batch, MIN_MATCH_CHARS)
        found = (batch.sparkSession.createDataFrame([], MATCH_SCHEMA)
                 if ok.isEmpty() else model.match(ok, corpus))
        _write_batch(_both(found, short.select("query_id")), out, batch_id)

    return _start(stream, handle, checkpoint, available_now)


def read_results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).withColumn(
        "batch_id", F.col("batch_id").cast("long"))
