"""Reading corpora and writing documents."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.functions.text import file_key
from corpusloom.operators.common import require_columns

# Our own rows for a first try without any file: six labels, 3+3+3+3+3+2.
INLINE_ROWS = [
    ("Data Science", "Statistics and machine learning with Python and pandas for 4 years"),
    ("Data Science", "Deep learning research using TensorFlow, NLP and computer vision"),
    ("Data Science", "Dashboards in Tableau on top of SQL and Spark, 3 yrs"),
    ("Java Developer", "Spring services in Java with Kafka and PostgreSQL, 7 years"),
    ("Java Developer", "Hibernate, Maven and JUnit on large Java code bases"),
    ("Java Developer", "Gradle builds and microservices in Java with Redis"),
    ("Web Designing", "Page layouts in HTML and CSS with React and Redux"),
    ("Web Designing", "TypeScript front ends with Angular, webpack and GraphQL"),
    ("Web Designing", "Vue components and Node tooling, 2 years of JavaScript"),
    ("Python Developer", "Django sites with MySQL and Docker over 5 years"),
    ("Python Developer", "FastAPI and Flask services in Python on AWS"),
    ("Python Developer", "Python workers with MongoDB, Redis and Kafka"),
    ("DevOps Engineer", "Terraform and Ansible on Azure, Linux and bash"),
    ("DevOps Engineer", "Kubernetes clusters watched by Prometheus and Grafana"),
    ("DevOps Engineer", "Jenkins deliveries with Docker for 6 years"),
    ("Testing", "Selenium and Cucumber suites tracked in Jira"),
    ("Testing", "Interface checks with Postman and pytest, 3 years"),
]


def inline_corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, c, t) for i, (c, t) in enumerate(INLINE_ROWS)],
        "doc_id long, category string, text string")


def _headers(spark: SparkSession, path: str) -> list[str] | None:
    """Column names of a CSV file, from its first line; None if absent."""
    try:
        return spark.read.csv(path, header=True).columns
    except AnalysisException:
        return None


def dealt(df: DataFrame, partitions: int | None, key: str | None = None
          ) -> DataFrame:
    """Rows over so many partitions, by ``key`` if given; None: as they lie.

    For tables of few files or row groups, which are few tasks on any cluster;
    tables of many need none, and whole texts would move for nothing.
    """
    if partitions is None:
        return df
    return df.repartition(partitions, *([key] if key else []))


def read_csv(spark: SparkSession, path: str, columns: Iterable[str],
             partitions: int | None = None) -> DataFrame:
    """All columns as strings, quoted line breaks kept, missing cells null.

    Files with quoted line breaks cannot be split: ``partitions`` deals their
    rows out for what follows. At volume store them as parquet once.
    """
    names = list(columns)
    schema = ", ".join(f"`{c}` string" for c in names)
    raw = (spark.read.option("header", True).option("multiLine", True)
           .option("quote", '"').option("escape", '"')
           .schema(schema).csv(path))
    return dealt(raw, partitions).select(*[
        F.when(~F.col(f"`{c}`").isin(fixed.CSV_MISSING), F.col(f"`{c}`"))
        .alias(c) for c in names])


def write_csv(corpus: DataFrame, path: str) -> None:
    """The two columns of a corpus as CSV that :func:`read_csv` reads back."""
    require_columns(corpus, "category", "text")
    (corpus.select(F.col("category").alias(fixed.CSV_CATEGORY),
                   F.col("text").alias(fixed.CSV_TEXT))
     .write.option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def with_doc_id(df: DataFrame) -> DataFrame:
    """Ids that rise with file position; unique, not dense."""
    return df.withColumn("doc_id", F.monotonically_increasing_id())


def load_corpus(spark: SparkSession, paths: Sequence[str] = fixed.CSV_PATHS
                ) -> DataFrame:
    """``(doc_id, category, text)`` of the first usable CSV file.

    A file without the two columns is passed over. Rows with a missing value
    are dropped. Without any usable file the inline rows are returned.
    """
    for path in paths:
        names = _headers(spark, path)
        if names and {fixed.CSV_CATEGORY, fixed.CSV_TEXT} <= set(names):
            found = with_doc_id(read_csv(spark, path, names))
            return drop_missing(found.select(
                "doc_id", F.col(fixed.CSV_CATEGORY).alias("category"),
                F.col(fixed.CSV_TEXT).alias("text")))
    return inline_corpus(spark)


def drop_missing(corpus: DataFrame) -> DataFrame:
    return corpus.na.drop(subset=["category", "text"])


def read_parquet(spark: SparkSession, path: str, *, key: str = "doc_id",
                 category: str = "category", text: str = "text",
                 partitions: int | None = None) -> DataFrame:
    """A corpus from parquet with the columns renamed to the usual three.

    ``partitions`` deals the rows out by key, see :func:`dealt`.
    """
    raw = require_columns(spark.read.parquet(path), key, category, text)
    # Columns that already fit are passed on as they are: an alias that
    # changes nothing can keep two uses of the corpus from sharing a shuffle.
    number = raw.schema[key].dataType.simpleString() == "bigint"
    picked = [renamed(key if number else F.col(key).cast("long"), "doc_id"),
              renamed(category, "category"), renamed(text, "text")]
    return dealt(drop_missing(raw.select(*picked)), partitions, "doc_id")


def renamed(column: str | Column, name: str) -> Column:
    if isinstance(column, str):
        column = F.col(column) if column == name else F.col(column).alias(name)
        return column
    return column.alias(name)


def write_documents(documents: DataFrame, path: str) -> None:
    """Text files below ``path``, one directory per ``JD_<category>``."""
    require_columns(documents, "category", "document")
    (documents.select(F.col("document").alias("value"),
                      file_key(F.col("category")).alias("file_key"))
     .write.mode("errorifexists").partitionBy("file_key").text(path))
