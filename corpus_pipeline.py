"""Training-data pipeline over documents: language, copies, mix, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import stages
from corpusloom.llm.shared import shared_folder, table

# Each function takes (spark, docs, sf_dir). What it returns is written as
# Parquet and read again as the docs of the next one.
STAGES = [
    ("language_id", stages.language_id),
    ("exact_dedup", stages.exact_dedup),
    ("ngram_jaccard_join", stages.ngram_jaccard_join),
    ("mix_sources", stages.mix_sources),
    ("best_fit_packing", stages.best_fit_packing),
]

# Language ID and the packing heuristic have no SQL form; the tests compare
# run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
