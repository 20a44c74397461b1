"""Multi-class boosted trees: one binary MLlib classifier per class, normalised over classes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.probability import renormalise
from rallyframe.session import settle, shared_folder

# Fits that share the cluster at the same time; each is a distributed job of its own.
PARALLEL_FITS = 4
# Rows that are worth a task of their own in each of the hundreds of jobs of a fit.
TASK_ROWS = 20_000


@dataclass(frozen=True)
class BoostedModel:
    """``members`` holds the classifier of each class; None where training had no row of it."""

    features: list[str]
    classes: list[str]
    members: list[GBTClassificationModel | None]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add classes and probability. Rows need every feature to be present."""
        scored = VectorAssembler(inputCols=self.features, outputCol="__features").transform(
            df.withColumns({name: F.col(name).cast("double") for name in self.features})
        )
        parts, helpers = [], ["__features"]
        for place, member in enumerate(self.members):
            if member is None:
                parts.append(F.lit(0.0))
                continue
            scored = member.transform(scored)
            helpers += [f"__raw_{place}", f"__p_{place}", f"__hit_{place}"]
            parts.append(vector_to_array(f"__p_{place}")[1])
        classes = F.array(*[F.lit(name) for name in self.classes])
        raw = scored.withColumns({"classes": classes, "probability": F.array(*parts)}).drop(*helpers)
        return renormalise(raw, "probability", len(self.classes))

    def importances(self, df: DataFrame) -> DataFrame:
        """Gain share per feature averaged over the class models, ascending (df gives the session)."""
        fitted = [member.featureImportances.toArray() for member in self.members if member is not None]
        mean = [float(sum(column) / len(fitted)) for column in zip(*fitted)]
        rows = list(zip(self.features, mean))
        return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
            "importance", "feature"
        )


def _bins(train: DataFrame, features: Sequence[str]) -> int:
    """One more than the values of the widest feature, and MLlib's default of 32 at least."""
    counted = train.agg(*[F.approx_count_distinct(name, 0.02) for name in features]).first()
    widest = int(1.1 * max(counted, default=0)) + 1
    return max(widest, 32)


def fit_boosted_model(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    classes: Sequence[str],
    max_iter: int,
    max_depth: int,
    step_size: float,
    subsample: float,
    seed: int,
    max_bins: int | None = None,
) -> BoostedModel:
    """Fit on rows whose integer ``target`` is a place in ``classes``; rows need every feature.

    ``max_bins`` is the number of bins per feature; by default it follows the widest feature, so that no two values
    are merged. Rows that are equal in all features and the target give the trees the same numbers, so without
    subsampling they go in once, with their number as weight: every round reads the distinct rows only.
    """
    shared_folder(train.sparkSession)  # boosting cuts its growing lineage there
    doubles = [F.col(name).cast("double").alias(name) for name in features]
    rows = train.select(F.col(target).cast("int").alias("__target"), *doubles)
    if subsample == 1.0:
        weight = F.count(F.lit(1)).cast("double").alias("__weight")
        rows = settle(rows.groupBy("__target", *features).agg(weight), TASK_ROWS)
        rows = rows.coalesce(math.ceil(rows.count() / TASK_ROWS) or 1)
    else:
        rows = rows.withColumn("__weight", F.lit(1.0))
    vectors = (
        VectorAssembler(inputCols=list(features), outputCol="__features")
        .transform(rows)
        .select("__target", "__features", "__weight")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        present = {row[0] for row in vectors.groupBy("__target").count().collect()}
        bins = max_bins or _bins(train, features)

        def fit(place: int) -> GBTClassificationModel | None:
            if place not in present:
                return None
            classifier = GBTClassifier(
                featuresCol="__features",
                labelCol="__label",
                predictionCol=f"__hit_{place}",
                maxIter=max_iter,
                maxDepth=max_depth,
                stepSize=step_size,
                subsamplingRate=subsample,
                seed=seed,
                maxBins=bins,
                weightCol="__weight",
            )
            classifier.set(classifier.rawPredictionCol, f"__raw_{place}")
            classifier.set(classifier.probabilityCol, f"__p_{place}")
            label = (F.col("__target") == place).cast("double")
            return classifier.fit(vectors.withColumn("__label", label))

        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            members = list(pool.map(fit, range(len(classes))))
    finally:
        vectors.unpersist()
    return BoostedModel(list(features), list(classes), members)
