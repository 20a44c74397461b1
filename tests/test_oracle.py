"""Every query against its SQL on the driver tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from rallyframe import oracle, queries
from rallyframe.operators import ordered

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def normalise(rows, columns):
    order = sorted(range(len(columns)), key=lambda place: columns[place])
    return sorted(
        (tuple(plain(row[place]) for place in order) for row in rows),
        key=lambda row: tuple((value is None, str(type(value)), value) for value in row),
    )


def plain(value):
    if isinstance(value, float):
        assert not math.isnan(value)
        return round(value, 6) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 6) + 0.0
    return value


def compare(spark, duck, name):
    got = entry_point.queries()[name](spark, FOLDER)
    rows = [tuple(row) for row in got.collect()]
    want = duck.execute(entry_point.oracle_sql()[name])
    columns = [column[0] for column in want.description]
    assert sorted(got.columns) == sorted(columns)
    expected = want.fetchall()
    assert len(rows) == len(expected)
    assert normalise(rows, got.columns) == normalise(expected, columns)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_sql(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("block_rows", [7, 60])
@pytest.mark.parametrize(
    "name",
    ["q07_lag_ungated", "q08_lag_gated", "q22_frequency_model", "q23_masked", "q34_segment", "q41_sections", "q43_features"],
)
def test_queries_match_sql_when_groups_are_cut(spark, duck, name, block_rows, monkeypatch):
    """Blocks so narrow that every user counts as large."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block_rows)
    compare(spark, duck, name)


def test_every_query_but_boosting_has_sql():
    missing = set(queries.registered()) - set(oracle.SQL)
    assert missing == {"q32_mllib", "q32_importance"}


def test_flagship_has_all_rotations(spark):
    assert entry_point.entry(spark).count() == 7
