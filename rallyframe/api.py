"""The analysis as a handful of functions, for callers who work step by step.

    season = load_and_combine_games(spark, "games", "season", "1", "Team A")
    train, features = build_features(season.where("split = 'train'"), "Team A")
    test, _ = build_features(season.where("split = 'test'"), "Team A", features)
    model = fit_boosted_model(train, MODEL_FEATURES, "target", classes(features), **SEASON_MODEL)
    scored, summary = compute_predictability(get_masked_probas(test, model))
    print_predictability_summary(summary)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions import probability as P
from rallyframe.functions.columns import percent
from rallyframe.models.boosted import BoostedModel, fit_boosted_model
from rallyframe.operators import evaluation as E
from rallyframe.operators.features import (
    FeatureBuilder,
    FeatureModel,
    base_features,
    on_court,
)
from rallyframe.operators.labels import class_list, encode, fit_dictionary
from rallyframe.operators.profiles import add_profile, fit_profile
from rallyframe.plans.season import IN_SYSTEM, model_rows
from rallyframe.schema import MODEL_FEATURES, PROFILE_FEATURE, SEASON_MODEL
from rallyframe.sources.season import extract_match, update_season

__all__ = [
    "MODEL_FEATURES",
    "SEASON_MODEL",
    "add_attack_profiles",
    "build_features",
    "classes",
    "compute_predictability",
    "encode_target",
    "extract_serve_receive_plays",
    "fit_boosted_model",
    "get_masked_probas",
    "load_and_combine_games",
    "mask_probabilities",
    "print_predictability_summary",
]


def extract_serve_receive_plays(
    spark: SparkSession, path: str, focus_team_id: str, focus_team_name: str
) -> DataFrame:
    """One row per serve-receive point of one match file."""
    return extract_match(spark, path, focus_team_id, focus_team_name)


def load_and_combine_games(
    spark: SparkSession,
    folder: str,
    stored: str,
    focus_team_id: str,
    focus_team_name: str,
    force_rerun: bool = False,
) -> DataFrame:
    """Season table of a folder; files already stored are not extracted again unless forced."""
    return update_season(spark, folder, stored, focus_team_id, focus_team_name, force_rerun).rows


def build_features(
    df: DataFrame, focus_team: str, model: FeatureModel | None = None, keys: Sequence[str] = ()
) -> tuple[DataFrame, FeatureModel]:
    """Features with the given dictionaries, or with dictionaries fitted on ``df``."""
    rows = base_features(df, focus_team)
    fitted = model or FeatureBuilder(focus_team, keys).fit_rows(rows)
    return fitted.encode(rows), fitted


def classes(model: FeatureModel) -> list[str]:
    """Attackers the target was fitted on, in index order."""
    return class_list(model.targets, "label")


def encode_target(df: DataFrame, train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Target index per row, NULL for attackers without training rows, and the dictionary."""
    targets = fit_dictionary(train.select(F.col("attacker_id").alias("label")), "label")
    return encode(df.drop("target"), targets, F.col("attacker_id"), "target", "label", unseen=None), targets


def add_attack_profiles(df: DataFrame, train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index of the attacker's most frequent attack code in training, and the profiles.

    The feature is a function of the target, which a model can exploit.
    """
    profiles = fit_profile(train, "attacker_id", "attack_code", PROFILE_FEATURE)
    return add_profile(df, profiles, "attacker_id", PROFILE_FEATURE), profiles


def mask_probabilities(
    df: DataFrame, class_names: Sequence[str], available: Column, probabilities: str = "probability"
) -> DataFrame:
    """Zero the classes that are not available and renormalise."""
    return P.mask(df, probabilities, class_names, available)


def get_masked_probas(df: DataFrame, model: BoostedModel) -> DataFrame:
    """Probabilities masked to the players on court, for the rows a model can score."""
    return mask_probabilities(model.transform(model_rows(df, model.features)), model.classes, on_court())


def compute_predictability(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the predictability columns, and (metric, rotation, value, shown).

    The six means have no rotation; mean entropy and non-top rate come again for every rotation with rows.
    """
    scored = E.add_predictability(df, "attacker_id")
    means = E.listed_metrics(E.summarise(scored, F.col("pass_quality") >= IN_SYSTEM))
    series = E.by_rotation(scored, "receiving_rotation", 1, 6).select(
        F.col("receiving_rotation").alias("rotation"),
        F.col("mean_entropy").alias("entropy_by_rotation"),
        F.col("non_top_rate").alias("non_top_by_rotation"),
    )
    by_rotation = series.unpivot("rotation", ["entropy_by_rotation", "non_top_by_rotation"], "metric", "value")
    listed = means.withColumn("rotation", F.lit(None).cast("int")).unionByName(by_rotation.where("value IS NOT NULL"))
    rate = F.col("metric").contains("accuracy") | F.col("metric").contains("non_top_rate")
    shown = F.when(rate, percent(F.col("value"))).otherwise(F.format_number("value", 3))
    return scored, listed.select("metric", "rotation", "value", shown.alias("shown"))


def print_predictability_summary(summary: DataFrame, label: str = "") -> None:
    """The six metrics and the two series by rotation as text."""
    print(f"Predictability {label}".strip())
    summary.where("rotation IS NULL").select("metric", "shown").show(truncate=False)
    series = summary.where("rotation IS NOT NULL")
    series.orderBy("metric", "value", "rotation").select("metric", "rotation", "shown").show(12, truncate=False)
