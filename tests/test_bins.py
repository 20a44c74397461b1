"""Bins of boosted trees follow the widest feature, however wide it is."""

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from rallyframe.models.boosted import _bins, fit_boosted_model


def test_no_values_of_a_wide_feature_share_a_bin(spark):
    frame = spark.range(6000).select((F.col("id") % 3000).alias("wide"), (F.col("id") % 5).alias("narrow"))
    assert _bins(frame, ["wide", "narrow"]) > 3000
    assert _bins(frame, ["narrow"]) == 32


def test_a_fit_reads_equal_rows_once(spark, monkeypatch):
    """Weighted distinct rows give the trees that all rows give."""
    frame = spark.range(4000).select((F.col("id") % 5).alias("x"), (F.col("id") % 3).alias("y"), (F.col("id") % 7 % 2).alias("target"))
    read, fit = [], GBTClassifier.fit

    def counted(self, dataset, *rest):
        read.append(dataset.count())
        return fit(self, dataset, *rest)

    monkeypatch.setattr(GBTClassifier, "fit", counted)
    model = fit_boosted_model(frame, ["x", "y"], "target", ["a", "b"], 4, 2, 0.1, 1.0, 42)
    plain = fit_boosted_model(frame, ["x", "y"], "target", ["a", "b"], 4, 2, 0.1, 1.0 - 1e-12, 42)
    assert read[:2] == [30, 30] and read[2:] == [4000, 4000]
    probabilities = [m.transform(frame.limit(15)).select("x", "y", "probability").collect() for m in (model, plain)]
    for got, want in zip(*[sorted(rows) for rows in probabilities]):
        assert got.probability == pytest.approx(want.probability, rel=1e-9)
