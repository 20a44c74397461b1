"""Season analysis: per period fit on its training games, score all of them, compare the periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.columns import percent, player_label
from rallyframe.operators import evaluation as E
from rallyframe.operators.features import (
    FEATURE_INPUTS,
    FeatureBuilder,
    FeatureModel,
    base_features,
    on_court,
)
from rallyframe.operators.groups import unseen_labels
from rallyframe.operators.labels import class_list
from rallyframe.models.boosted import BoostedModel, fit_boosted_model
from rallyframe.schema import MODEL_FEATURES, PERIODS, PROFILE_FEATURE, SEASON_MODEL
from rallyframe.session import FILE_ROWS, settle

IN_SYSTEM = 3


@dataclass(frozen=True)
class SeasonAnalysis:
    """Fitted parts and scored rows (one row per reception with an attack, masked probabilities)."""

    features: FeatureModel
    models: Mapping[str, BoostedModel]
    scored: DataFrame
    unseen_attackers: DataFrame

    def summary(self, *keys: str) -> DataFrame:
        """Means over training and test rows together, per period and any further keys."""
        return E.summarise(self.scored, F.col("pass_quality") >= IN_SYSTEM, ["period", *keys])

    def listed_summary(self) -> DataFrame:
        """(period, metric, value, shown): rates as percent, entropies to three places."""
        rate = F.col("metric").contains("accuracy") | F.col("metric").contains("rate")
        return E.listed_metrics(self.summary(), ["period"]).withColumn(
            "shown", F.when(rate, percent(F.col("value"))).otherwise(F.format_number("value", 3))
        )

    def by_rotation(self) -> DataFrame:
        return E.by_rotation(self.scored, "receiving_rotation", 1, 6, ["period"])

    def comparison(self) -> DataFrame:
        """Metrics by period, periods in playing order."""
        return E.compare_periods(self.summary(), "period", list(self.models))

    def test_cells(self) -> DataFrame:
        test = self.scored.where(F.col("split") == "test")
        return E.confusion_cells(test, "attacker_id", "top_predicted", ["period"])

    def report(self) -> DataFrame:
        return E.class_report(self.test_cells(), ["period"]).withColumn("name", player_label(F.col("label")))

    def log_loss(self) -> DataFrame:
        return E.log_loss(self.scored.where(F.col("split") == "test"), "attacker_id", ["period"])

    def importances(self) -> DataFrame:
        """(period, feature, importance), ascending within a period."""
        tables = [
            model.importances(self.scored).select(F.lit(period).alias("period"), "feature", "importance")
            for period, model in self.models.items()
        ]
        listed = tables[0]
        for table in tables[1:]:
            listed = listed.unionByName(table)
        return listed.orderBy("period", "importance", "feature")


def model_rows(encoded: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with every feature and a target, as the model sees them."""
    return encoded.na.drop(subset=[*features, "target"])


def score(model: BoostedModel, rows: DataFrame) -> DataFrame:
    """Masked probabilities and predictability columns."""
    masked = E.mask_to_available(model.transform(rows), model.classes, on_court())
    return E.add_predictability(masked, "attacker_id", len(model.classes))


def analyse_season(
    season: DataFrame,
    focus_team: str,
    periods: Sequence[str] = tuple(PERIODS),
    include_attacker_profile: bool = False,
    settings: Mapping[str, float] = SEASON_MODEL,
) -> SeasonAnalysis:
    """One model per period.

    Training and test rows go through the same plan with the period as a column; lags run within a game
    and a game has one split, so splitting later changes nothing. Only the model fits loop over periods.
    """
    chosen = season.where(F.col("period").isin(list(periods)))
    base = settle(base_features(chosen, focus_team).select(*FEATURE_INPUTS), FILE_ROWS)
    train = base.where(F.col("split") == "train")
    builder = FeatureBuilder(focus_team, ["period"], include_attacker_profile=include_attacker_profile)
    fitted = builder.fit_rows(train)
    names = [*MODEL_FEATURES, PROFILE_FEATURE] if include_attacker_profile else list(MODEL_FEATURES)
    rows = settle(model_rows(fitted.encode(base), names), FILE_ROWS)
    models, scored = {}, None
    for period in periods:
        of_period = rows.where(F.col("period") == period)
        classes = class_list(fitted.targets.where(F.col("period") == period), "label")
        training = of_period.where(F.col("split") == "train")
        if training.isEmpty():
            continue
        models[period] = fit_boosted_model(training, names, "target", classes, **settings)
        piece = score(models[period], of_period)
        scored = piece if scored is None else scored.unionByName(piece)
    if scored is None:
        raise ValueError("no period has training rows")
    known = fitted.targets.withColumnRenamed("label", "attacker_id")
    unseen = unseen_labels(base, known, "attacker_id", ["period"])
    return SeasonAnalysis(fitted, models, settle(scored), unseen)
