"""Every registered query against its SQL, and the shape of key plans."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.plans import catalog
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
SQL = entry.oracle_sql()
OWN = sorted(catalog.REGISTRY)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(OWN) <= set(SQL)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    assert differences(spark, con, SF, entry.queries()[name],
                       SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split(
        "== Initial Plan ==")[0]


def test_fit_reads_text_once(spark):
    plan = executed(catalog.REGISTRY["q_centroids"](spark, SF))
    assert plan.count("FileScan") == 1
    # rows of documents are never shuffled by term and document
    assert "hashpartitioning(doc_id" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize(("name", "scans"), [
    ("q_classify", 1), ("q_bow", 1), ("q_features", 1), ("q_classify_raw", 2)])
def test_each_table_is_read_once(spark, name, scans):
    assert executed(catalog.REGISTRY[name](spark, SF)).count(
        "FileScan") == scans


def test_dense_vectors_are_scored_within_the_row(spark):
    plan = executed(catalog.REGISTRY["q_dense_centroid"](spark, SF))
    scored = plan.split("Subquery")[0]
    assert "posexplode" not in scored and "NestedLoop" not in plan


def test_match_has_no_cross_join(spark):
    plan = executed(catalog.REGISTRY["q_match_filtered"](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "WindowGroupLimit" in plan


def test_label_filter_reaches_the_scan(spark):
    docs = catalog.documents(spark, SF).where(F.col("category") == "en")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan
