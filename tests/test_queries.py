"""Every registered query against its SQL, and with other partition counts."""

from __future__ import annotations

import pytest
from harness import TABLES, canon, compare, connect, rows

from folioframe.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_sql(spark, sf_dir, con, name):
    assert compare(spark, sf_dir, catalogue.QUERIES[name], catalogue.ORACLES[name], con) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_partition_counts(spark, sf_dir, name):
    """Queries without SQL give the same rows whatever the number of shuffle partitions."""
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = catalogue.QUERIES[name](spark, sf_dir)
        got.append(rows(df.columns, [tuple(r) for r in df.collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] and got[0]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert canon(1.0) == canon(1) and len(TABLES) == 14
