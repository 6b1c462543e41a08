"""Every registered query of the library's own operators against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lumenvault.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return connection


def plain(value):
    if isinstance(value, (list, np.ndarray)):
        return str([plain(x) for x in value])
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    return f"{float(value):.9g}" if isinstance(value, (int, float, np.number)) else str(value)


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sql, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    wanted = sql.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry_points_without_training_data(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_training_data", lambda: [])
    assert set(entry.queries()) == set(registry.QUERIES)
    assert set(entry.oracle_sql()) == set(registry.ORACLE_SQL)
    assert entry.entry(spark).count() > 0
