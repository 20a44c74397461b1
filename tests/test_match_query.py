"""The single-match query: full settings and all features of the model, fitted on sets 1-3."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from rallyframe import oracle, queries
from rallyframe.plans import match
from rallyframe.schema import MATCH_MODEL, MODEL_FEATURES

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not present")


def test_match_query_fits_all_features_with_full_settings(spark, monkeypatch):
    asked, fit = [], match.fit_boosted_model

    def quick(train, features, target, classes, **settings):
        asked.append((list(features), settings, train.agg(F.min("set_number"), F.max("set_number")).first()))
        return fit(train, features, target, classes, **settings | {"max_iter": 1})

    monkeypatch.setattr(match, "fit_boosted_model", quick)
    got = queries.registered()["q32_match"](spark, FOLDER)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    want = duck.execute(oracle.SQL["q32_match"])
    columns = [column[0] for column in want.description]
    assert sorted(tuple(row) for row in got.select(*columns).collect()) == sorted(want.fetchall())
    assert asked == [(MODEL_FEATURES, MATCH_MODEL, (1, 3))]
