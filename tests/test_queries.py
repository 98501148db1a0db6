"""Every registered query agrees with its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from leafwright.bindings import ORACLES, QUERIES
from tests.conftest import SF


@pytest.fixture(scope="session")
def con():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _plain(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, float):
            return None if v != v else (int(v) if v == int(v) else round(v, 9))
        return int(v) if hasattr(v, "as_tuple") else v

    return sorted((tuple(cell(row[i]) for i in order) for row in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    frame = QUERIES[name](spark, SF)
    got = [tuple(r) for r in frame.collect()]
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    assert _plain(got, frame.columns) == _plain(cursor.fetchall(), names)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["doc_id", "errors", "warnings", "info"]
