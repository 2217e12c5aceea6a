"""Every registered query against DuckDB, and against itself at another partitioning."""

import pytest

from oracle import connection, same
from tessella.catalogue import ORACLES, QUERIES
from tessella.plans import clinical, derived, files, inference, relational, rules  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
INVARIANT = ("conf_merge_locking", "line_of_therapy", "cohort_ids", "km_curve", "asof_join", "code_resolve", "concat_notes", "manifest_extend")


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_every_query_has_an_oracle():
    # Iterated fits are held against brute force in test_inference and test_graphs.
    assert set(QUERIES) - set(ORACLES) == {"cox_with_entry", "moderated_expression", "embedding_communities"} and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    same(spark, con, QUERIES[name], ORACLES[name], FOLDER)


@pytest.mark.parametrize("name", INVARIANT)
@pytest.mark.parametrize("partitions", ["1", "7"])
def test_partitioning_does_not_matter(spark, con, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        same(spark, con, QUERIES[name], ORACLES[name], FOLDER)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
