"""Model features of the focus side's receptions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions import columns as C
from rallyframe.operators.labels import encode, encode_all, fit_dictionaries
from rallyframe.operators.ordered import Ordered, previous
from rallyframe.operators.profiles import add_profile, fit_profile
from rallyframe.schema import (
    COURT,
    GAME_TAGS,
    LABEL_OF_NO_PREVIOUS,
    PASS_QUALITY,
    PROFILE_FEATURE,
    ROTATION_OF_SETTER_POSITION,
)

COURT_COLUMNS = [f"{side}_p{slot}" for side in ("recv", "opp") for slot in COURT]

# What models and reports read of a feature row; the rest of a point can be joined back by game and point.
FEATURE_INPUTS = [
    *GAME_TAGS.fieldNames(),
    "set_number",
    "point_id",
    "receiving_rotation",
    "pass_quality",
    "score_diff",
    "server_id",
    *COURT_COLUMNS,
    "attacker_id",
    "attack_code",
    "prev_attacker_id",
    "prev_point_won",
]


def focus_rows(season: DataFrame, focus_team: str) -> DataFrame:
    """Rows where the focus side receives and attacks."""
    return season.where((F.col("receiving_team") == focus_team) & ~F.col("no_attack"))


def add_quality_and_sides(df: DataFrame) -> DataFrame:
    """Pass quality, rotation, and the players on court by role."""
    receives_home = F.col("receiving_team") == F.col("home_team")
    serves_home = F.col("serving_team") == F.col("home_team")
    setter = C.side_value(receives_home, F.col("home_setter_position"), F.col("visiting_setter_position"))
    court = {}
    for slot in COURT:
        home, visiting = F.col(f"home_player_id{slot}"), F.col(f"visiting_player_id{slot}")
        court[f"recv_p{slot}"] = C.side_value(receives_home, home, visiting)
        court[f"opp_p{slot}"] = C.side_value(serves_home, home, visiting)
    return df.withColumns(
        {
            "pass_quality": C.lookup(F.col("receive_eval_code"), PASS_QUALITY),
            "receiving_rotation": C.lookup(setter, ROTATION_OF_SETTER_POSITION),
            **court,
        }
    )


def on_court() -> Column:
    """The receiving side's six players as one array; slots may be NULL."""
    return F.array(*[F.col(f"recv_p{slot}") for slot in COURT])


def add_gated_lag(
    rows: Ordered,
    group: Sequence[str],
    position: str,
    actor: str,
    winner: str,
    focus: Column,
) -> Ordered:
    """Previous actor and outcome, kept only when the previous row is the directly preceding position.

    Adds ``is_consecutive``, ``prev_actor`` (``none`` where the gate is closed) and ``prev_won``
    (0.0 where it is closed). The gate needs the same group, so the lag may run over a coarser one.
    """
    before = F.col("__previous")
    same = [before[name] == F.col(name) for name in group]
    gate = before[position] + 1 == F.col(position)
    for test in same:
        gate = gate & test
    names = dict.fromkeys([*group, position, actor, winner])
    return rows.scan(__previous=previous(*names)).map(
        lambda df: df.withColumn("is_consecutive", C.never_null(gate))
        .withColumns(
            {
                "prev_actor": F.when(
                    F.col("is_consecutive"), F.coalesce(before[actor], F.lit(LABEL_OF_NO_PREVIOUS))
                ).otherwise(F.lit(LABEL_OF_NO_PREVIOUS)),
                "prev_won": F.when(F.col("is_consecutive"), C.indicator(before[winner] == focus)).otherwise(
                    F.lit(0.0)
                ),
            }
        )
        .drop("__previous")
    )


def add_ungated_lag(rows: Ordered, actor: str, winner: str, focus: Column) -> Ordered:
    """Previous actor and outcome of the group's previous row, whatever lies between."""
    before = F.col("__previous")
    return rows.scan(__previous=previous(*dict.fromkeys([actor, winner]))).map(
        lambda df: df.withColumns(
            {
                "prev_actor": F.coalesce(before[actor], F.lit(LABEL_OF_NO_PREVIOUS)),
                "prev_won": C.indicator(before[winner] == focus),
            }
        ).drop("__previous")
    )


def base_features(season: DataFrame, focus_team: str, gated_lag: bool = True) -> DataFrame:
    """Everything that needs no dictionary."""
    rows = add_quality_and_sides(focus_rows(season, focus_team))
    ordered = Ordered.by_position(rows, ["game_number"], "point_id")
    if gated_lag:
        ordered = add_gated_lag(
            ordered, ["set_number"], "point_id", "attacker_id", "point_won_by", F.lit(focus_team)
        )
    else:
        ordered = add_ungated_lag(ordered, "attacker_id", "point_won_by", F.lit(focus_team))
    return (
        ordered.df.withColumnRenamed("prev_actor", "prev_attacker_id")
        .drop("prev_point_won")
        .withColumnRenamed("prev_won", "prev_point_won")
        .drop("is_consecutive")
    )


@dataclass(frozen=True)
class FeatureModel:
    """Fitted dictionaries, stored as tables, keyed by ``keys`` (such as the period)."""

    focus_team: str
    keys: list[str]
    gated_lag: bool
    servers: DataFrame
    players: DataFrame
    previous: DataFrame
    targets: DataFrame
    profiles: DataFrame | None = field(default=None)

    def transform(self, season: DataFrame) -> DataFrame:
        """Features and target; a label unseen in fitting is -1, an unseen attacker has target NULL."""
        return self.encode(base_features(season, self.focus_team, self.gated_lag))

    def encode(self, rows: DataFrame) -> DataFrame:
        """The dictionary part of ``transform`` for rows from ``base_features``."""
        rows = encode(rows, self.servers, C.label_text(F.col("server_id")), "server_encoded", "label", self.keys)
        court = {f"{column}_enc": C.label_text(F.col(column)) for column in COURT_COLUMNS}
        rows = encode_all(rows, self.players, court, "label", self.keys)
        rows = encode(rows, self.previous, F.col("prev_attacker_id"), "prev_attacker_enc", "label", self.keys)
        rows = encode(
            rows, self.targets, F.col("attacker_id"), "target", "label", self.keys, unseen=None
        )
        if self.profiles is not None:
            rows = add_profile(rows, self.profiles, "attacker_id", PROFILE_FEATURE, self.keys)
        return rows


@dataclass(frozen=True)
class FeatureBuilder:
    """Learns the dictionaries from training rows.

    ``include_attacker_profile`` adds the top attack code of the row's own attacker. That is a function
    of the prediction target, so it is off unless asked for.
    """

    focus_team: str
    keys: Sequence[str] = ("period",)
    gated_lag: bool = True
    include_attacker_profile: bool = False

    def fit(self, train: DataFrame) -> FeatureModel:
        return self.fit_rows(base_features(train, self.focus_team, self.gated_lag))

    def fit_rows(self, rows: DataFrame, target_rows: Column | None = None) -> FeatureModel:
        """Fit on rows from ``base_features``, all dictionaries in one pass.

        ``target_rows`` marks the rows to learn the target and the profiles from, where the other
        dictionaries are fitted on more.
        """
        keys = list(self.keys)
        learn = F.lit(True) if target_rows is None else C.never_null(target_rows)
        fitted = fit_dictionaries(
            rows,
            {
                "servers": [C.label_text(F.col("server_id"))],
                "players": [C.label_text(F.col(name)) for name in COURT_COLUMNS],
                "previous": [F.col("prev_attacker_id")],
                "targets": [F.when(learn, F.col("attacker_id"))],
            },
            "label",
            keys,
        )
        profiles = None
        if self.include_attacker_profile:
            profiles = fit_profile(rows.where(learn), "attacker_id", "attack_code", PROFILE_FEATURE, keys)
        return FeatureModel(self.focus_team, keys, self.gated_lag, profiles=profiles, **fitted)
