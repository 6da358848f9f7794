"""Pipeline stages: each applies one operator and returns documents.

A stage works on all documents that the stage before kept and returns the same
columns; only the last one returns the operator's own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup as copies
from corpusloom.llm import language_id as languages
from corpusloom.llm import mixing, ngram_join, packing


def language_id(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents without a language, or with an ambiguous one, go."""
    model = languages.fit(docs.where(~languages.held_out(F.col("doc_id"))))
    found = languages.identify(docs, model)
    return found.where("not ambiguous").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return copies.exact_dedup(docs).where("kept").select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf: str
                       ) -> DataFrame:
    """One document of each group of linked texts stays, the smallest id."""
    return ngram_join.without_near_duplicates(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents in the order of the mix, repeated as their weight asks for.

    Each part holds a range of positions in order.
    """
    mixed = mixing.mix(docs)
    return (mixed.repartitionByRange("position")
            .sortWithinPartitions("position").select(*docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf: str
                     ) -> DataFrame:
    """Pieces of all documents with their place in a training sequence."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(packing.tokenized(docs, path))
