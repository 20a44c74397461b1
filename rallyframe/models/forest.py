"""Multi-class random forest: one ensemble with a probability for every class."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.models.boosted import _bins


@dataclass(frozen=True)
class ForestModel:
    """The same contract as the boosted model: classes and probability, in class order."""

    features: list[str]
    classes: list[str]
    member: RandomForestClassificationModel

    def transform(self, df: DataFrame) -> DataFrame:
        """Add classes and probability. Rows need every feature to be present."""
        doubles = df.withColumns({f"__f_{name}": F.col(name).cast("double") for name in self.features})
        assembler = VectorAssembler(inputCols=[f"__f_{name}" for name in self.features], outputCol="__features")
        scored = self.member.transform(assembler.transform(doubles))
        missing = len(self.classes) - self.member.numClasses  # last classes that training had no row of
        shares = F.concat(vector_to_array("__p"), F.array_repeat(F.lit(0.0), missing))
        helpers = ["__features", "__raw", "__p", "__hit", *[f"__f_{name}" for name in self.features]]
        names = F.array(*[F.lit(name) for name in self.classes])
        return scored.withColumns({"classes": names, "probability": shares}).drop(*helpers)

    def importances(self, df: DataFrame) -> DataFrame:
        """Gain share per feature, ascending (df gives the session)."""
        rows = list(zip(self.features, self.member.featureImportances.toArray().tolist()))
        found = df.sparkSession.createDataFrame(rows, "feature string, importance double")
        return found.orderBy("importance", "feature")


def fit_forest_model(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    classes: Sequence[str],
    trees: int = 60,
    max_depth: int = 10,
    subsample: float = 0.8,
    seed: int = 42,
    max_bins: int | None = None,
    feature_subset: str = "all",
) -> ForestModel:
    """Fit on rows whose integer ``target`` is a place in ``classes``; rows need every feature.

    Like the boosted trees, a split may use every feature unless ``feature_subset`` names another of MLlib's strategies.

    All classes are learned by the same trees, level by level, so the number of jobs follows the depth and not the number
    of classes, as it does with one chain of boosting rounds for each.
    """
    doubles = [F.col(name).cast("double").alias(name) for name in features]
    vectors = (
        VectorAssembler(inputCols=list(features), outputCol="__features")
        .transform(train.select(F.col(target).cast("double").alias("__label"), *doubles))
        .select("__label", "__features")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        forest = RandomForestClassifier(
            featuresCol="__features",
            labelCol="__label",
            predictionCol="__hit",
            probabilityCol="__p",
            rawPredictionCol="__raw",
            numTrees=trees,
            maxDepth=max_depth,
            subsamplingRate=subsample,
            featureSubsetStrategy=feature_subset,
            seed=seed,
            maxBins=max_bins or _bins(train, features),
        )
        return ForestModel(list(features), list(classes), forest.fit(vectors))
    finally:
        vectors.unpersist()
