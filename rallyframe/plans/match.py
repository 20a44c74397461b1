"""Single-match analysis: sets 1-3 train, set 4 test, set 5 held out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.models.boosted import BoostedModel, fit_boosted_model
from rallyframe.operators import evaluation as E
from rallyframe.operators.features import (
    FEATURE_INPUTS,
    FeatureBuilder,
    FeatureModel,
    base_features,
    on_court,
)
from rallyframe.operators.groups import unseen_labels, value_counts
from rallyframe.operators.labels import class_counts, class_list
from rallyframe.plans.season import IN_SYSTEM, model_rows, score
from rallyframe.schema import MATCH_MODEL, MODEL_FEATURES, PROFILE_FEATURE
from rallyframe.session import FILE_ROWS, settle

TRAIN_SETS, TEST_SET, HELD_OUT_SET = (1, 2, 3), 4, 5
ROW_KEY = ["game_number", "point_id"]

# Features that can be NULL before any dictionary is applied.
NULLABLE_FEATURES = ["receiving_rotation", "pass_quality", "score_diff", "set_number"]


@dataclass(frozen=True)
class MatchAnalysis:
    features: FeatureModel
    model: BoostedModel
    names: list[str]
    rows: DataFrame
    scored: DataFrame
    unseen_attackers: DataFrame

    def test_rows(self) -> DataFrame:
        return self.scored.where(F.col("set_number") == TEST_SET)

    def test_cells(self) -> DataFrame:
        return E.confusion_cells(self.test_rows(), "attacker_id", "top_predicted")

    def report(self) -> DataFrame:
        return E.class_report(self.test_cells())

    def confusion(self) -> DataFrame:
        """Over the labels seen in the test set as actual or predicted."""
        labels = [row[0] for row in self.report().select("label").orderBy("label").collect()]
        return E.confusion_matrix(self.test_cells(), labels)

    def log_loss(self) -> DataFrame:
        return E.log_loss(self.test_rows(), "attacker_id")

    def summary(self) -> DataFrame:
        return E.summarise(self.scored, F.col("pass_quality") >= IN_SYSTEM)

    def by_rotation(self) -> DataFrame:
        return E.by_rotation(self.scored, "receiving_rotation", 1, 6)

    def class_counts(self) -> DataFrame:
        return class_counts(self.rows, self.features.targets, "target", "label")

    def predicted_counts(self) -> DataFrame:
        return value_counts(self.scored, "top_predicted")

    def actual_counts(self) -> DataFrame:
        return value_counts(self.scored, "attacker_id")

    def patterns(self) -> DataFrame:
        return E.probability_patterns(self.scored)

    def diagnostics(self, rows: int = 3) -> DataFrame:
        """Spot check of the first rows in playing order."""
        first = self.scored.orderBy(*ROW_KEY).limit(rows)
        return E.probability_diagnostics(first, ROW_KEY, on_court())

    def importances(self) -> DataFrame:
        return self.model.importances(self.scored)

    def example(self) -> DataFrame:
        """Unmasked probability of every class for the first test point."""
        first = self.rows.where(F.col("set_number") == TEST_SET).orderBy(*ROW_KEY).limit(1)
        return E.list_probabilities(self.model.transform(first), ROW_KEY)


def analyse_match(
    match: DataFrame,
    focus_team: str,
    fit_encoders_on: str = "all",
    include_attacker_profile: bool = False,
    settings: Mapping[str, float] = MATCH_MODEL,
    train_sets: Sequence[int] = TRAIN_SETS,
) -> MatchAnalysis:
    """``fit_encoders_on``: "all" rows or only "train" rows for every dictionary but the target's."""
    base = settle(base_features(match, focus_team, gated_lag=False).select(*FEATURE_INPUTS), FILE_ROWS)
    in_training = F.col("set_number").isin(list(train_sets))
    complete = in_training
    for name in NULLABLE_FEATURES:
        complete = complete & F.col(name).isNotNull()
    builder = FeatureBuilder(focus_team, [], gated_lag=False, include_attacker_profile=include_attacker_profile)
    fitted = builder.fit_rows(base if fit_encoders_on == "all" else base.where(in_training), complete)
    names = [*MODEL_FEATURES, PROFILE_FEATURE] if include_attacker_profile else list(MODEL_FEATURES)
    rows = settle(model_rows(fitted.encode(base), names), FILE_ROWS)
    classes = class_list(fitted.targets, "label")
    training = rows.where(in_training)
    model = fit_boosted_model(training, names, "target", classes, **settings)
    known = fitted.targets.withColumnRenamed("label", "attacker_id")
    unseen = unseen_labels(base, known, "attacker_id")
    return MatchAnalysis(fitted, model, names, rows, settle(score(model, rows)), unseen)
