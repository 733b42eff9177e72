"""Every query of the engine against its DuckDB SQL on the smallest tables."""

import pytest

import lattica.engine_queries  # noqa: F401  registers more
from lattica.catalogue_queries import FLAGSHIP, ORACLE_SQL, QUERIES
from tools.parity import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    said = compare(spark, name, QUERIES[name], ORACLE_SQL[name], sf_dir)
    assert ": ok" in said, said


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys() and FLAGSHIP in QUERIES


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
