"""Every registered query against its DuckDB oracle on the smallest tables
(the driver repeats this at sf0.01; ``python -m vitrine.oracle.check``)."""

import pytest

import __spark_entry__ as entry
from vitrine.oracle.check import compare, duck

from suite import SF_SMALL

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF_SMALL)
    rel = con.execute(SQL[key])
    # same column names and the same value types on both sides
    duck_types = {d[0]: str(d[1]) for d in rel.description}
    for f in df.schema.fields:
        assert TYPES.get(f.dataType.simpleString()) == duck_types.get(f.name), (f.name, f.dataType, duck_types)
    ok, msg = compare(df.toPandas(), rel.df())
    assert ok, msg


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
